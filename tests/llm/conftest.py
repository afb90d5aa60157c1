import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, score double, bucket int"


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, repeats, ties, a very long text, control and joined characters, clashing columns."""
    rows = [
        (5, "Hello, World! It's fine.", "en"), (1, None, "en"), (2, "", None), (3, "   \n\t ", "en"), (None, "no id", "fr"),
        (5, "Hello, World! It's fine.", "en"), (5, "another text under the same id", "de"), (9, "naïve café Ünïcode ŁÓDŹ 日本語 é \x1c x y", "fr"),
        (7, "word " * 30_000, "en"), (8, "123 456 !!!", "de"), (-4, "<|endoftext|> stays text", "en"), (11, "İstanbul 's 're don't", "tr"),
    ]
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
