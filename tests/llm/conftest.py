import pytest

TEXT_ROWS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, sig long, label int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t", "en", "a", 4), (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (None, "some text here now", None, "a", 18), (None, None, None, None, None),
        (6, "before " + passage + " after", "en", "b", 1), (7, passage.upper() + "\n" + passage, "en", "c", 1), (8, "tail " + passage, "en", None, 1),
        (9, "one", "en", "a", 3), (10, "ünï čödé ẞ 🙂\x1cx　y\xa0z", "de", "a", 3), (11, "</s> a.\nb  c\r\nd", "en", "a", 9),
    ]
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], TEXT_ROWS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
