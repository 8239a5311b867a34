"""Small documents with the odd cases: nulls, empty texts, repeats, ties, long texts and clashing columns."""

from pyspark.sql import functions as F

WORDS = [f"word{i} and{i % 7} of{i % 13}" for i in range(60)]
LONG = " ".join(WORDS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, rep long, stage int, split int"


def documents(spark, rows=None):
    near = LONG.replace("word30", "other30")
    rows = rows if rows is not None else [
        (1, LONG), (2, LONG), (3, near), (4, None), (5, ""), (6, "  \n "), (7, "short text"), (8, "short text"), (9, "12 34 !!"),
        (10, "é漢字 ü " * 400), (11, "x" * 120_000), (None, LONG), (7, "short text"), (12, "a b c d e f g h " * 300), (13, LONG[200:500] + " tail"),
    ]
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "k", 9, 3, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def nulls(spark):
    """A table whose every column is null."""
    return spark.range(2).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in SCHEMA.split(", "))])
