import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_fixture import DDL, DOCS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, a row without an id, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(DOCS, DDL).withColumns({"k": F.lit("k"), "h1": F.lit(1), "spans": F.lit("s"), "slot": F.lit(0)})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
