"""Documents with nulls, empty and very long texts, repeated rows, and columns with clashing names."""

from contextlib import contextmanager

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("fp", "label", "id", "piece", "length", "kept", "score", "_n", "rank", "node")),
])
LONG = " ".join(f"w{i % 97}x{i}" for i in range(9000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog\nand runs away from all the other animals in the wood today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog\nand runs away from all the other animals in the wood today", "en", "a"),
    (3, "", "en", "a"), (4, None, "en", None), (5, "one", None, "b"), (6, "one", None, "b"), (6, "one", None, "b"),
    (7, LONG, "de", "b"), (8, LONG + " end", "de", "b"), (None, "nobody knows\x0bthis\x1fid\u00a0", None, None), (None, None, None, None),
    (9, "a b c d e f g h " * 12, "en", "a"), (10, "Ünïcödé ﬁ 漢字 😀 e\u0301 <s> </s> <|endoftext|> \\n ### </turn> \x00 end", "fr", "c"), (11, " \t\n ", "fr", "c"),
    (12, "same line here\nsame line here\n\n\nother line $$$ ### |\nsame line here", "fr", "c"), (13, "  two  spaces   three\n\n\ttab\r\n end  ", "en", "a"),
]


def documents(spark, rows=TEXTS):
    junk = ("x",) * 10
    return spark.createDataFrame([(*r, len(r[1] or ""), *junk) for r in rows], SCHEMA)


@contextmanager
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
