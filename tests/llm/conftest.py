from __future__ import annotations

import pytest

#: Texts of every awkward kind; ids repeat and are missing, and the extra columns have names that the operators use.
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "The cat sat on the mat. The cat sat on the mat and slept.", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "fr"), (5, "the cat sat on the mat. the cat sat on the mat and slept.", "en"),
    (6, LONG, "en"), (7, f"Before it. {PASSAGE} after it", "de"), (8, f"Something else {PASSAGE} goes on", "de"), (9, PASSAGE, None), (9, PASSAGE, None), (None, PASSAGE, "de"), (None, None, None),
    (10, "漢字 ça va 😀 <|endoftext|> x \x85 y", "fr"), (11, "a b", "en"), (12, "a b", "en"), (13, "same same same same same same same same same same same same same same same same same same same same same same", "en"),
    (-4, "negative id", "en"), (14, "a\r\nb\x0bc\x0cd\n\n\ne", "en"),
]
SCHEMA = "doc_id long, text string, lang string, fp string, start string, row string, spans string, key string, score string, component_id string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
