"""Small inputs that the tests of this folder share."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns of names that the operators use inside, for clashes.
CLASH = ("k", "ids", "n", "size", "_label", "_p", "_gone", "_has_letter", "label", "bucket", "place", "_id", "_n", "_source_key")

LONG = "the long one " * 40_000

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "web", 0),
    (3, " \t\n ", "en", "web", 4),
    (4, "word", "en", None, 4),
    (5, "the cat sat on the mat and then the cat ran away from the dog", "en", "web", 60),
    (5, "the cat sat on the mat and then the cat ran away from the dog", "en", "web", 60),
    (7, "the cat sat on the mat and then the cat ran away from the dog", "en", "books", 60),
    (None, "a row without an id but with words in it", "en", "web", 41),
    (None, None, None, None, None),
    (10, LONG, "en", "web", len(LONG)),
    (11, "1234 5678 !!! ???", None, "code", 17),
    (12, "Grüße aus Köln, ça va, mañana \U0001f600 ▁▁ x", "de", "web", 30),
    (13, "tab\tand\x0bvertical\x0cfeed\x00nul  nbsp em", "en", "books", 40),
]


def docs(spark, rows=ODD, clash=False):
    df = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("extra").alias(c) for c in CLASH])
    return df
