import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, fp long, toxicity double, quality int, language string, mix string, secrets string, _key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, mark-only and long texts, repeated rows and ids, names that operators use."""
    long_text = " ".join(f"word{k % 977} and" for k in range(60_000)) + "."
    texts = [None, "", "   ", "\n\n", "... !!! ---", "One two.", "One two.", long_text, long_text + " end", "naïve 日本 𝒳\ttab\x0bend ", "AKIA" + "A" * 20, "x" * 50_000]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, 1, "h", 7, 0.5, 1, "l", "m", "s", "k") for k, t in enumerate(texts)]
    rows += [rows[5], (5, "One two, other text", "en", "s1", None, None, None, None, None, None, None, None, None), (None, "No id here.", "en", "s0", 1, "h", 7, 0.5, 1, "l", "m", "s", "k"), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
