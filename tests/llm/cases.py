"""Awkward documents that every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])

PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from here"
LONG = " ".join(f"word{i % 4999}" for i in range(60_000))
ROWS = [
    (1, PLAIN, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "de", None, 4),
    (5, PLAIN, "en", "a", 1), (6, PLAIN, "fr", "b", 1), (6, PLAIN, "fr", "b", 1), (None, PLAIN, "en", "a", 1),
    (7, LONG, "en", "a", len(LONG)), (8, "é 漢字 😀 ÀÉ don't <|endoftext|> á", "es", "c", 9), (9, "!!! $$$ 123", None, "a", 11),
    (10, "one", "en", "a", 3),
]


def docs(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns with names that operators use themselves
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in ("fp", "key", "_key", "_range", "size", "slot", "n_words", "kept", "score", "ids", "spans", "part", "text_hash", "_row", "quality", "dir")})
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)
