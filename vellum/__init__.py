"""vellum: Spark-native analytics over scholarly records and training text."""
