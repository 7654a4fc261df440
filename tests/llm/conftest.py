import pytest

#: Rows that the operators must take without crashing: nulls, empty and long texts, repeated rows.
ODD = [
    (1, "one two three four five six", "en", "s"),
    (2, None, None, None),
    (3, "", "en", "s"),
    (4, "  lead and   runs \n\t of white space ", None, "s"),
    (1, "one two three four five six", "en", "s"),
    (5, "ümlaut ÄÖÜ straße 1234 <|endoftext|> ▁ marked   x", "de", None),
    (6, "word " * 20000, "en", "s"),
    (7, "x" * 70000, "en", "s"),
    (8, "\n", "fr", "s"),
    (9, "İstanbul é Σας 中文 😀 </s> <unk>", None, None),
    (None, "no id", "en", "s"),
    (10, "ONE two three four\tfive six", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names operators use themselves."""
    rows = [(*r, None if r[1] is None else len(r[1]), 0, "k", 1.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, key string, score double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
