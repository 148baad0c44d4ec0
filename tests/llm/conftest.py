import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with clashing extra columns."""

    def make(texts, langs=None, ids=None):
        ids = ids or list(range(len(texts)))
        rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), 1, "x", 2, "h") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, copies int, hash string")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, long, and mixed-script texts."""
    return [None, "", "   \n\t ", "one", "one", "a b c d", "word " * 30_000, "x" * 90_000, "漢字かな " * 50, "é\u00a0à\u2028ü 1.2.3.4", "tab\tand  two   spaces \n end ", "<|endoftext|> a <|endoftext|>"]
