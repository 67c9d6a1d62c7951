"""Small tables with the awkward cases every operator must bear."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# names that operators use inside; extra columns must come through whatever they are called
CLASHING = ["id", "key", "n", "h1", "label", "node", "pos", "start", "block", "number", "size", "band", "raw", "a", "b"]


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sentence_text(rng: random.Random, sentences: int) -> str:
    out = []
    for _ in range(sentences):
        out.append(" ".join(words(rng, rng.randint(3, 12))).capitalize() + ".")
        out.append("\n" if rng.random() < 0.3 else " ")
    return "".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, ties, a long text."""
    rng = random.Random(5)
    base = sentence_text(rng, 30)
    long = sentence_text(rng, 9000)
    rows = [(1, base, "en", "s1", 5), (2, base, "en", "s1", 5), (2, base, "en", "s1", 5), (3, None, "en", "s2", None),
            (4, "", "de", None, 0), (5, " \t\n \n", None, "s2", 5), (None, base, "en", "s1", 5), (None, None, None, None, None),
            (6, long, "en", "s3", 1), (7, long + " tail", "en", "s3", 1), (8, "één déjà vu ñandú Straße", "fr", "s4", 1),
            (9, "x" * 50_000, "en", "s4", 1), (10, "a b c", "en", "s5", 1), (11, "A  B\tc", "en", "s5", 1)]
    return rows


def docs_frame(spark, rows, clash: bool = False, parts: int = 3):
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    if clash:
        for i, name in enumerate(CLASHING):
            df = df.withColumn(name, F.lit(i))
    return df


def near_copies(rng: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10 ** 6)}"
    return out
