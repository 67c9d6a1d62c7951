"""Registered queries: vector pooling and the linear head over the token table from ``embeddings`` (P keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pooling as P
from ..sources.tables import Tables
from ..targets import TARGETS
from . import fixtures as fx
from .registry import register, rounded

LAYER_START = 4
N_CONCAT = 4
N_OUT = 8


def layer_weight(l: int) -> float:
    return 1.0 + (l % 3)


def q_vec(d: int) -> float:
    return ((d * 7) % 11 - 5) / 10


def w_att(d: int, f: int) -> float:
    return ((d * 3 + f * 5) % 13 - 6) / 20


def w_head(d: int, j: int) -> float:
    return ((d + 2 * j) % 7 - 3) / 10


HEAD_BIAS = 3.0

TOKENS_SQL = """WITH tokens AS (
  SELECT cast(label AS bigint) AS doc_id, cast(vec_id % 13 AS int) AS layer,
    cast(row_number() OVER (PARTITION BY label, vec_id % 13 ORDER BY vec_id) - 1 AS int) AS pos,
    CASE WHEN vec_id % 7 <> 0 THEN 1 ELSE 0 END AS mask, embedding AS vec FROM embeddings),
cells AS (SELECT doc_id, layer, pos, mask, cast(generate_subscripts(vec, 1) - 1 AS int) AS dim,
    cast(unnest(vec) AS double) AS v FROM tokens),
top AS (SELECT max(layer) AS top, max(len(vec)) AS d FROM tokens)
"""
LAST = "layer = (SELECT top FROM top)"
MEAN = "sum(v * mask) / greatest(sum(mask), 1e-9)"


def _tokens(spark, sf_dir, positions: bool = False):
    return fx.token_vectors(Tables(spark, sf_dir), positions)


def _width(spark, sf_dir) -> int:
    return int(Tables(spark, sf_dir).embeddings.select(F.max(F.size("embedding"))).first()[0])


@register("pool_mean", sql=TOKENS_SQL + f"SELECT doc_id, dim, round({MEAN}, 6) AS value FROM cells WHERE {LAST} "
          "GROUP BY doc_id, dim")
def pool_mean(spark, sf_dir):
    return rounded(P.pool_mean(_tokens(spark, sf_dir)))


@register("pool_max", sql=TOKENS_SQL + "SELECT doc_id, dim, round(max(CASE WHEN mask = 1 THEN v ELSE -1e4 END), 6) "
          f"AS value FROM cells WHERE {LAST} GROUP BY doc_id, dim")
def pool_max(spark, sf_dir):
    return rounded(P.pool_max(_tokens(spark, sf_dir)))


@register("pool_min", sql=TOKENS_SQL + "SELECT doc_id, dim, round(min(CASE WHEN mask = 1 THEN v ELSE 1e-4 END), 6) "
          f"AS value FROM cells WHERE {LAST} GROUP BY doc_id, dim")
def pool_min(spark, sf_dir):
    """P3 with the reference's fill value 1e-4 (parity); the library default is 1e4."""
    return rounded(P.pool_min(_tokens(spark, sf_dir), fill=1e-4))


@register("pool_meanmax", sql=TOKENS_SQL + f"SELECT doc_id, dim, round({MEAN}, 6) AS value FROM cells WHERE {LAST} "
          "GROUP BY doc_id, dim UNION ALL SELECT doc_id, cast(dim + (SELECT d FROM top) AS int) AS dim, "
          f"round(max(CASE WHEN mask = 1 THEN v ELSE -1e4 END), 6) AS value FROM cells WHERE {LAST} GROUP BY doc_id, dim")
def pool_meanmax(spark, sf_dir):
    return rounded(P.pool_meanmax(_tokens(spark, sf_dir)))


@register("pool_gem", sql=TOKENS_SQL + "SELECT doc_id, dim, round(power(sum(power(greatest(v, 1e-6) * mask, 3e0)) "
          f"/ greatest(sum(mask), 1e-6), 1e0 / 3e0), 6) AS value FROM cells WHERE {LAST} GROUP BY doc_id, dim")
def pool_gem(spark, sf_dir):
    return rounded(P.pool_gem(_tokens(spark, sf_dir), p=3.0, eps=1e-6))


_LW_SUM = sum(layer_weight(l) for l in range(LAYER_START, 13))


@register("pool_weighted_layers", sql=TOKENS_SQL + f"SELECT doc_id, dim, round(sum((1 + layer % 3) * v) / {_LW_SUM!r}e0, 6) "
          f"AS value FROM cells WHERE pos = 0 AND layer >= {LAYER_START} GROUP BY doc_id, dim")
def pool_weighted_layers(spark, sf_dir):
    """Layers 4..12 (13 hidden states) with weights 1 + l % 3."""
    return rounded(P.pool_weighted_layers(_tokens(spark, sf_dir, True), {l: layer_weight(l) for l in range(13)},
                                          LAYER_START))


@register("pool_concat_cls", sql=TOKENS_SQL + "SELECT doc_id, cast(((SELECT top FROM top) - layer) * (SELECT d FROM top) "
          f"+ dim AS int) AS dim, round(v, 6) AS value FROM cells WHERE pos = 0 AND layer > (SELECT top FROM top) - {N_CONCAT}")
def pool_concat_cls(spark, sf_dir):
    return rounded(P.pool_concat_cls(_tokens(spark, sf_dir, True), N_CONCAT))


@register("pool_concat_mean", sql=TOKENS_SQL + "SELECT doc_id, cast(((SELECT top FROM top) - layer) * (SELECT d FROM top) "
          f"+ dim AS int) AS dim, round({MEAN}, 6) AS value FROM cells WHERE layer > (SELECT top FROM top) - {N_CONCAT} "
          "GROUP BY doc_id, layer, dim")
def pool_concat_mean(spark, sf_dir):
    return rounded(P.pool_concat_mean(_tokens(spark, sf_dir), N_CONCAT))


@register("pool_attention", sql=TOKENS_SQL + f""",
cls AS (SELECT doc_id, layer, dim, v FROM cells WHERE pos = 0 AND layer >= 1),
sc AS (SELECT doc_id, layer, sum(v * (((dim * 7) % 11 - 5) / 1e1)) AS score FROM cls GROUP BY doc_id, layer),
a0 AS (SELECT doc_id, layer, exp(score - max(score) OVER (PARTITION BY doc_id)) AS a FROM sc),
a1 AS (SELECT doc_id, layer, a / sum(a) OVER (PARTITION BY doc_id) AS a FROM a0),
vv AS (SELECT c.doc_id, c.dim, sum(a1.a * c.v) AS v FROM cls c JOIN a1 USING (doc_id, layer) GROUP BY c.doc_id, c.dim)
SELECT doc_id, cast(f AS int) AS dim, round(sum(v * (((dim * 3 + f * 5) % 13 - 6) / 2e1)), 6) AS value
FROM vv, range({N_OUT}) r(f) GROUP BY doc_id, f""".replace("\n,\ncls", ",\ncls"))
def pool_attention(spark, sf_dir):
    d = _width(spark, sf_dir)
    q = [q_vec(i) for i in range(d)]
    w = [[w_att(i, f) for f in range(N_OUT)] for i in range(d)]
    return rounded(P.pool_attention(_tokens(spark, sf_dir, True), q, w))


@register("linear_head", sql=TOKENS_SQL + f""",
pm AS (SELECT doc_id, dim, {MEAN} AS x FROM cells WHERE {LAST} GROUP BY doc_id, dim),
t AS (SELECT cast(j AS int) AS j, [{', '.join(repr(t) for t in TARGETS).replace('"', "'")}][j + 1] AS target FROM range(6) r(j))
SELECT doc_id, target, round(sum(x * (((dim + 2 * j) % 7 - 3) / 1e1)) + {HEAD_BIAS!r}e0, 6) AS value
FROM pm, t GROUP BY doc_id, target""".replace("\n,\npm", ",\npm"))
def linear_head(spark, sf_dir):
    """P10: six outputs from the masked-mean feature of the last layer."""
    d = _width(spark, sf_dir)
    feats = P.pool_mean(_tokens(spark, sf_dir))
    w = [[w_head(i, j) for j in range(len(TARGETS))] for i in range(d)]
    return rounded(P.linear_head(feats, w, [HEAD_BIAS] * len(TARGETS), TARGETS))


@register("pool_vectors", sql=TOKENS_SQL + f""",
pm AS (SELECT doc_id, dim, round({MEAN}, 6) AS x FROM cells WHERE {LAST} GROUP BY doc_id, dim)
SELECT doc_id, list(x ORDER BY dim)::VARCHAR[] AS vec FROM pm GROUP BY doc_id""".replace("\n,\npm", ",\npm")
          .replace("list(x ORDER BY dim)::VARCHAR[]", "array_to_string(list(cast(round(x * 1e6) AS bigint) ORDER BY dim), ' ')"))
def pool_vectors(spark, sf_dir):
    """P1 as one vector per document (written as millionths, so engines print it alike)."""
    vec = P.to_vectors(rounded(P.pool_mean(_tokens(spark, sf_dir))))
    return vec.select("doc_id", F.array_join(F.transform("vec", lambda x: F.round(x * 1e6).cast("long")), " ").alias("vec"))
