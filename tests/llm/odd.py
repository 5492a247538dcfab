"""Small tables with everything that may go wrong in one."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("key", "bucket", "rank", "label", "part", "class", "group", "row", "n", "term", "score", "spans", "media", "tokens", "guest", "want")),
])
EXTRA = ("x",) * 16


def prose(rng: random.Random, words: int, start: str = "") -> str:
    syllables = "an ba co da er fi go ha in ju ka lo me no or pa re si to ur".split()
    return " ".join([start] * bool(start) + ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words)])


def texts() -> list[tuple]:
    rng = random.Random(8)
    base = prose(rng, 120)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"), (None, prose(rng, 50)), (None, None),
        (9, prose(rng, 20)), (9, prose(rng, 20)), (10, "same row"), (10, "same row"), (11, prose(rng, 6000)), (12, "é" * 3000), (13, "*** ### !!!"), (14, "😀 déjà vu, ÀÉ " * 9), (15, base + " " + prose(rng, 5)),
    ]
    return [(i, t, "en" if k % 3 else None, "src0" if k % 2 else None, len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]


def odd_documents(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in texts()], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
