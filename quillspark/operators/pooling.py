"""Vector pooling over a token/embedding table.

Input ``tokens(doc_id, layer, pos, mask, vec ARRAY<FLOAT>)``. Masked mean, max, min and GeM are vector aggregates: the vectors of a
document are added (or compared) component by component in a buffer of one vector, map-side first, so a task sends one row
per document whatever its number of tokens, and a document with very many tokens is spread over all tasks. Null
components count as masked ones, null vectors not at all; a document's vectors must have one length. Results are
long ``(doc_id, dim, value)``; ``to_vectors`` reassembles arrays (bounded by the vector width per document).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_aggregate(tokens: DataFrame, keys: list[str], parts: dict[str, tuple[str, Column, float]]) -> DataFrame:
    """``keys`` and one array per part: ``name: (sum | max | min, array expression, value of null components)``.

    Partial results are one row per key and task.
    """
    aggs = []
    for name, (kind, values, null) in parts.items():
        known = F.lit(null)
        filled = F.transform(values, lambda v: F.coalesce(v.cast("double"), known))  # noqa: B023 (called at once)
        stat = {"sum": Summarizer.sum, "max": Summarizer.max, "min": Summarizer.min}[kind]
        aggs.append(stat(array_to_vector(filled)).alias(name))
    got = tokens.filter(F.col("vec").isNotNull()).groupBy(*keys).agg(F.sum(F.col("mask").cast("double")).alias("_m"), *aggs)
    return got.select(*keys, "_m", *[vector_to_array(n).alias(n) for n in parts])


def long(pooled: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row per component of an array column."""
    return pooled.select(*keys, F.posexplode(value).alias("dim", "value"))


def _masked(fill: float | None = None) -> Column:
    """The vector of a kept token; zeros, or ``fill``, for a masked one."""
    if fill is None:
        return F.transform("vec", lambda v: v.cast("double") * F.col("mask").cast("double"))
    return F.transform("vec", lambda v: F.when(F.col("mask") == 1, v.cast("double")).otherwise(F.lit(fill)))


def _over_mask(eps: float, name: str = "s") -> Column:
    return F.transform(name, lambda v: v / F.greatest(F.col("_m"), F.lit(eps)))


def cells(tokens: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = keep if keep is not None else [c for c in ("doc_id", "layer", "pos", "mask") if c in tokens.columns]
    return tokens.select(*keep, F.posexplode("vec").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def _last_layer(tokens: DataFrame, layer: int | None) -> DataFrame:
    if layer is None:
        layer = tokens.select(F.max("layer")).scalar()
    return tokens.filter(F.col("layer") == layer)


def pool_mean(tokens: DataFrame, layer: int | None = None, eps: float = 1e-9) -> DataFrame:
    """Σ v·m / max(Σ m, eps) per document and dimension."""
    got = vector_aggregate(_last_layer(tokens, layer), ["doc_id"], {"s": ("sum", _masked(), 0.0)})
    return long(got, ["doc_id"], _over_mask(eps))


def pool_max(tokens: DataFrame, layer: int | None = None, fill: float = -1e4) -> DataFrame:
    """Masked max; masked cells count as ``fill``."""
    got = vector_aggregate(_last_layer(tokens, layer), ["doc_id"], {"s": ("max", _masked(fill), fill)})
    return long(got, ["doc_id"], F.col("s"))


def pool_min(tokens: DataFrame, layer: int | None = None, fill: float = 1e4) -> DataFrame:
    """Masked min; masked cells count as ``fill`` (1e-4 reproduces the reference's fill)."""
    got = vector_aggregate(_last_layer(tokens, layer), ["doc_id"], {"s": ("min", _masked(fill), fill)})
    return long(got, ["doc_id"], F.col("s"))


def width(tokens: DataFrame) -> Column:
    return tokens.select(F.max(F.size("vec"))).scalar()


def pool_meanmax(tokens: DataFrame, layer: int | None = None, eps: float = 1e-9, fill: float = -1e4) -> DataFrame:
    """Mean then max, concatenated, in one aggregate."""
    got = vector_aggregate(_last_layer(tokens, layer), ["doc_id"], {"s": ("sum", _masked(), 0.0), "x": ("max", _masked(fill), fill)})
    return long(got, ["doc_id"], F.concat(_over_mask(eps), F.col("x")))


def pool_gem(tokens: DataFrame, layer: int | None = None, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """P5: (Σ (max(v, eps)·m)^p / max(Σ m, eps))^(1/p)."""
    powers = F.transform("vec", lambda v: F.pow(F.greatest(v.cast("double"), F.lit(eps)) * F.col("mask").cast("double"), F.lit(p)))
    got = vector_aggregate(_last_layer(tokens, layer), ["doc_id"], {"s": ("sum", powers, 0.0)})
    return long(got, ["doc_id"], F.transform(_over_mask(eps), lambda v: F.pow(v, F.lit(1.0 / p))))


def pool_weighted_layers(tokens: DataFrame, layer_weights: dict[int, float], layer_start: int) -> DataFrame:
    """Σ_l w_l·h_l[pos 0] / Σ_l w_l over layers ≥ ``layer_start`` (weights broadcast)."""
    spark = tokens.sparkSession
    ws = {l: w for l, w in layer_weights.items() if l >= layer_start}
    wdf = F.broadcast(spark.createDataFrame([(int(l), float(w)) for l, w in ws.items()], "layer int, lw double"))
    c = cells(tokens.filter((F.col("pos") == 0) & (F.col("layer") >= layer_start))).join(wdf, "layer")
    return c.groupBy("doc_id", "dim").agg((F.sum(F.col("lw") * F.col("v")) / F.lit(sum(ws.values()))).alias("value"))


def pool_concat_cls(tokens: DataFrame, n_layers: int = 4) -> DataFrame:
    """Position-0 vectors of the last n layers, concatenated from the last layer back."""
    top = tokens.select(F.max("layer")).scalar()
    d = width(tokens)
    c = cells(tokens.filter((F.col("pos") == 0) & (F.col("layer") > top - n_layers)))
    return c.select("doc_id", ((top - F.col("layer")) * d + F.col("dim")).alias("dim"), F.col("v").alias("value"))


def pool_concat_mean(tokens: DataFrame, n_layers: int = 4, eps: float = 1e-9) -> DataFrame:
    """Masked means of the last n layers, concatenated from the last layer back."""
    top = tokens.select(F.max("layer")).scalar()
    d = width(tokens)
    got = vector_aggregate(tokens.filter(F.col("layer") > top - n_layers), ["doc_id", "layer"], {"s": ("sum", _masked(), 0.0)})
    per = long(got, ["doc_id", "layer"], _over_mask(eps))
    return per.select("doc_id", ((top - F.col("layer")) * d + F.col("dim")).alias("dim"), "value")


def pool_attention(tokens: DataFrame, q: list[float], w: list[list[float]], first_layer: int = 1) -> DataFrame:
    """Softmax over layers of q·h_l (h_l = position-0 vector of layer l ≥ first_layer), weighted sum, then
    the projection Wᵀ (D × F). Axes are kept apart (no reshape mixing)."""
    spark = tokens.sparkSession
    qa = F.array(*[F.lit(float(x)) for x in q])
    cls = tokens.filter((F.col("pos") == 0) & (F.col("layer") >= first_layer)).select(
        "doc_id", "layer", "vec",
        F.aggregate(F.zip_with(F.col("vec"), qa, lambda a, b: a.cast("double") * b), F.lit(0.0),
                    lambda acc, x: acc + x).alias("score"))
    per_doc = Window.partitionBy("doc_id")  # at most one row per layer: bounded
    att = cls.withColumn("a", F.exp(F.col("score") - F.max("score").over(per_doc)))
    att = att.withColumn("a", F.col("a") / F.sum("a").over(per_doc))
    v = cells(att, ["doc_id", "a"]).groupBy("doc_id", "dim").agg(F.sum(F.col("a") * F.col("v")).alias("v"))
    wdf = spark.createDataFrame([(d, f, float(w[d][f])) for d in range(len(w)) for f in range(len(w[0]))],
                                "dim int, f int, w double")
    return (v.join(F.broadcast(wdf), "dim").groupBy("doc_id", "f")
            .agg(F.sum(F.col("v") * F.col("w")).alias("value")).withColumnRenamed("f", "dim"))


def linear_head(features: DataFrame, w: list[list[float]], b: list[float], names: list[str]) -> DataFrame:
    """P10: outputs_j = Σ_d W[d][j]·x_d + b_j from long features ``(doc_id, dim, value)``."""
    spark = features.sparkSession
    wdf = spark.createDataFrame([(d, names[j], float(w[d][j]), float(b[j])) for d in range(len(w))
                                 for j in range(len(names))], "dim int, target string, w double, b double")
    j = features.join(F.broadcast(wdf), "dim")
    return j.groupBy("doc_id", "target").agg((F.sum(F.col("value") * F.col("w")) + F.first("b")).alias("value"))


def to_vectors(long: DataFrame, value: str = "value") -> DataFrame:
    """Long ``(doc_id, dim, value)`` → ``(doc_id, vec)``; one row per document, width = number of dims."""
    return (long.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dim", value))).alias("_s"))
            .select("doc_id", F.transform("_s", lambda s: s[value]).alias("vec")))
