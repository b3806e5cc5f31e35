"""Rows that the tests of the text operators share."""

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(4000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a very tall old oak tree near the river bank at dawn"
DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nSecond line of this text here now.\n" + PASSAGE, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "Alpha beta gamma delta epsilon zeta.\nSecond line of that text here now.\nx", "en", "b", 1),
    (5, LONG, "en", "b", 1),
    (6, LONG + " tail", "en", "b", 1),
    (7, " \t\n ", "en", None, 1),
    (8, "<|endoftext|> it's   spaced   é漢字 🙂 1234", "fr", "c", 1),
    (9, "prefix words " + PASSAGE.upper().replace("SEVEN", "EIGHT") + " suffix words", "en", "c", 1),
    (10, "prefix words " + PASSAGE.upper().replace("SEVEN", "EIGHT") + " suffix words", "en", "c", 1),
    (None, "Alpha beta gamma delta epsilon zeta.", None, None, None),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
