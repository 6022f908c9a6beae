"""Rows that every operator over documents must stand: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank now.", "en", None),
    (4, None, "en", "a"),
    (5, "", "fr", "b"),
    (6, " \t\n\x0b ", None, "b"),
    (7, "one", "en", "a"),
    (7, "one", "en", "a"),
    (8, "One", "de", "c"),
    (9, LONG, "en", "a"),
    (10, "naïve Ünïcödé 中文 🎉 <|endoftext|> it's odd space", "xx", "c"),
    (None, "a text without an id but with some words in it", "en", "a"),
    (11, "x " * 50, "en", "a"),
    (11, "another text under the same id", "en", "a"),
]


def docs(spark, rows=None):
    """The rows with extra columns whose names operators use themselves."""
    frame = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = ["score", "predicted", "held_out", "node", "label", "kept", "copy", "hash", "fine", "n_tokens", "bucket_len", "lane", "x", "y", "median", "a", "b", "n"]
    return frame.withColumns({c: F.lit("clash") for c in extra})
