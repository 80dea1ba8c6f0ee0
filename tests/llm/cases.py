"""Awkward documents that every text operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "The quick brown fox.\nSame line\nother", "en", "a", 1), (2, "The quick brown fox.\nSame line\nother", "en", "a", 1),
    (2, "The quick brown fox.\nSame line\nother", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "no id", None, "b", 5),
    (None, None, None, None, None), (5, LONG, "fr", "b", len(LONG)), (6, "\n\n", "de", "c", 2), (7, "  SAME LINE \t\nÉté ÉTÉ\x1cx y 漢字かな 🙂", "fr", "c", 9),
    (8, "x" * 70000, "en", "d", 70000), (9, "a", "en", "d", 1), (10, "1234 5678 !!! <|endoftext|>", "en", "d", 2),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, folder, rows=ROWS, files=3, extra=True):
    """The rows as a file scan, with more columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("file", "row", "digest", "n", "line", "pos", "key", "score", "ids", "length", "band", "spans", "kind", "item_id", "_file", "_row", "__file"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    df.repartition(files).write.parquet(folder)
    return spark.read.parquet(folder)
