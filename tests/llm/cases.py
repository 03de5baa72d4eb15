"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()), T.StructField("code", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("kept_id", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("was_null", T.StringType()),
])

LONG = "one two three four five six seven eight nine ten " * 20_000

ROWS = [
    (1, "a plain text of some words here", "en", "s1", 31),
    (2, "a plain text of some words here", "en", "s2", 31),
    (2, "a plain text of some words here", "en", "s2", 31),
    (3, None, "en", None, None),
    (4, "", None, "", 0),
    (5, LONG, "en", "s1", len(LONG)),
    (6, "  \t\n ", "xx", "s1", 5),
    (None, "identifier unknown, text known", "en", "s3", None),
    (7, "un deux trois quatre cinq", "fr", "s3", 25),
    (8, "été à la plage où naïve \U0001f600 的", "fr", "S3", 30),
    (9, "퟿\x00\x0b nul and tab", None, "s1", 12),
    (10, "12345 67890 !!! ???", "en", "s9", 19),
]


def awkward(spark):
    return spark.createDataFrame([(*r, *"xyzwvabcd") for r in ROWS], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)
