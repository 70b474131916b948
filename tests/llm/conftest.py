import pytest

TEXTS = [
    (1, None),
    (2, ""),
    (3, "one"),
    (4, "the quick brown fox jumps over the lazy dog and runs away from all of them"),
    (4, "the quick brown fox jumps over the lazy dog and runs away from all of them"),
    (5, "The quick brown fox jumps over the lazy dog and runs away from all of them"),
    (None, "a row without an id"),
    (6, "x" * 5000),
    (7, "grüße aus köln, ☃ und mehr\n\n  zwei  leerzeichen\t"),
    (8, "word " * 4000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns that clash with what operators make."""
    rows = [(i, t, None, "src", None if t is None else len(t), "mine", 0.5, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, component_id int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 100")
