import pytest

from timberline.llm.common import importable

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "thanon the reed of ernt " * 4000


def odd_rows():
    """Nulls everywhere, empty, blank, a very long text, ties and fully repeated rows."""
    return [
        (1, "Anat with by of nteres atre are the and of in", "en", "a", 45), (1, "Anat with by of nteres atre are the and of in", "en", "a", 45),
        (2, "", "en", "a", 0), (3, None, None, None, None), (None, "the and of in", None, "b", 13), (None, None, None, None, None),
        (4, " \t\n\x0b\x0c\r ", "fr", "b", 7), (5, LONG, "en", "a", len(LONG)), (5, LONG + "x", "en", "a", 0),
        (6, "\\ </s> İ ß Σ 日本 🙂 \x85\xa0 token=abc", "de", "c", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    importable(spark)
    return spark.createDataFrame(odd_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_wide(odd):
    """The same with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("Score", "passages", "fingerprint", "fp", "component", "leaks", "spans", "shard", "slot", "ids", "decoded", "n_words", "failed_bits", "row", "word",
             "_words", "_lines", "_id", "_hash", "_n", "_row", "_key", "_text", "_text_hash", "_size", "_range", "_rank", "_begin", "_redacted",
             "_label", "k0", "text_hash", "component_id", "n_tokens", "trains")
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def none(spark):
    importable(spark)
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def small_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
