import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with ids from 0 and further columns."""

    def make(texts, **columns):
        from pyspark.sql import types as T

        n = len(texts)
        ids = columns.pop("doc_id", list(range(n)))
        lang, source = columns.pop("lang", ["en"] * n), columns.pop("source", ["s"] * n)
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in columns)
        rows = list(zip(ids, texts, lang, source, [None if t is None else len(t) for t in texts], *columns.values(), strict=True))
        return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], T.StructType.fromDDL(schema))

    return make


#: Texts that every operator must take: null, empty, blanks, ties, repeats, odd characters, one very long word and text.
ODD = [None, "", "   ", "\n\n", "word", "Word word", "x" * 5000, "a b c d e f g h i j " * 400, "é😀 ▁ \u0000 ​ ퟿", "same text here", "same text here", "中文 文字\tтекст", "  lead", "trail  \n"]
