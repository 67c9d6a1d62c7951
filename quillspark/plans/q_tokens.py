"""Registered queries: token counts, padding, batch packing, masking, shuffles (C keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import batching as B
from ..sources.tables import Tables
from . import fixtures as fx
from .registry import register
from .sqlparts import essays_cte

PAD_LEN = 64
BATCH = 16
MODEL_TYPES = ["roberta-large", "microsoft/deberta-v3-large", "distilbert-base-uncased", "facebook/bart-large"]

TOK_CTE = (f"{essays_cte()},\ntok AS (SELECT text_id, regexp_extract_all(full_text, '\\w+|[^\\w\\s]') AS toks "
           "FROM essays)")
LEN_CTE = TOK_CTE + ",\nlens AS (SELECT text_id, cast(len(toks) + 2 AS int) AS tokenize_length FROM tok)"
POS_CTE = LEN_CTE + (",\npos AS (SELECT text_id, tokenize_length, row_number() OVER "
                     "(ORDER BY tokenize_length, text_id) - 1 AS pos FROM lens)")


def _tokens(spark, sf_dir):
    e = fx.essays(Tables(spark, sf_dir))
    return e.select("text_id", K.regex_tokens("full_text").alias("toks"))


def _lens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("text_id", K.token_len(F.col("toks")).alias("tokenize_length"))


@register("token_len", sql=f"WITH {LEN_CTE}\nSELECT text_id, tokenize_length FROM lens")
def token_len(spark, sf_dir):
    return _lens(spark, sf_dir)


@register("token_counts", sql=f"WITH {TOK_CTE}\nSELECT text_id, cast(len(toks) AS int) AS n_token, "
          "cast(len(list_distinct(toks)) AS int) AS nunique_token FROM tok")
def token_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("text_id", K.n_token(F.col("toks")).alias("n_token"),
                                         K.n_unique_token(F.col("toks")).alias("nunique_token"))


@register("max_len", sql=f"WITH {TOK_CTE}\nSELECT cast(max(len(toks)) + 3 AS int) AS max_len FROM tok")
def max_len(spark, sf_dir):
    """C3 with B9: NULL text counts as empty; budget = longest token count + 3 special tokens."""
    return _tokens(spark, sf_dir).agg((F.max(K.n_token(F.col("toks"))) + 3).cast("int").alias("max_len"))


@register("pad_truncate", sql=f"WITH {TOK_CTE}\nSELECT text_id, "
          f"array_to_string(['[CLS]'] || toks[1:{PAD_LEN - 2}] || ['[SEP]'], ' ') "
          f"|| repeat(' [PAD]', cast(greatest({PAD_LEN} - (least(len(toks), {PAD_LEN - 2}) + 2), 0) AS int)) AS input_text, "
          f"cast(least(len(toks), {PAD_LEN - 2}) + 2 AS int) AS mask_sum FROM tok")
def pad_truncate(spark, sf_dir):
    padded, mask = K.encode_plus(F.col("toks"), PAD_LEN)
    return _tokens(spark, sf_dir).select(
        "text_id", F.array_join(padded, " ").alias("input_text"),
        F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int")).alias("mask_sum"))


_TYPES_SQL = "[" + ", ".join(f"'{m}'" for m in MODEL_TYPES) + "]"


@register("length_policy", sql=f"""WITH {LEN_CTE}
SELECT text_id, model_type,
  cast(coalesce(CASE WHEN regexp_matches(model_type, '{K.FIXED_LENGTH_FAMILIES}') THEN {K.FIXED_LENGTH} END,
                tokenize_length) AS int) AS eff_len
FROM lens, (SELECT unnest({_TYPES_SQL}) AS model_type)""")
def length_policy(spark, sf_dir):
    """Input length per (essay, model family): 512 padded for fixed families, the token count otherwise."""
    types = F.array(*[F.lit(m) for m in MODEL_TYPES])
    rows = _lens(spark, sf_dir).withColumn("model_type", F.explode(types))
    return rows.select("text_id", "model_type",
                       F.coalesce(K.length_policy("model_type"), F.col("tokenize_length")).cast("int").alias("eff_len"))


@register("length_order", sql=f"WITH {POS_CTE}\nSELECT text_id, tokenize_length, pos FROM pos")
def length_order(spark, sf_dir):
    return B.length_order(_lens(spark, sf_dir), "tokenize_length").select("text_id", "tokenize_length", "pos")


@register("batches_keep", sql=f"WITH {POS_CTE}\nSELECT text_id, pos, pos // {BATCH} AS batch_id FROM pos")
def batches_keep(spark, sf_dir):
    ordered = B.length_order(_lens(spark, sf_dir), "tokenize_length")
    return B.assign_batches(ordered, BATCH, drop_last=False).select("text_id", "pos", "batch_id")


@register("batches_drop", sql=f"WITH {POS_CTE}\nSELECT text_id, pos, pos // {BATCH} AS batch_id FROM pos "
          f"WHERE pos // {BATCH} < (SELECT count(*) FROM pos) // {BATCH}")
def batches_drop(spark, sf_dir):
    ordered = B.length_order(_lens(spark, sf_dir), "tokenize_length")
    return B.assign_batches(ordered, BATCH, drop_last=True).select("text_id", "pos", "batch_id")


@register("pad_batch", sql=f"""WITH {POS_CTE}
SELECT text_id, pos // {BATCH} AS batch_id,
  cast(max(tokenize_length) OVER (PARTITION BY pos // {BATCH}) AS int) AS batch_len,
  cast(max(tokenize_length) OVER (PARTITION BY pos // {BATCH}) - tokenize_length AS int) AS n_pad
FROM pos""")
def pad_batch(spark, sf_dir):
    ordered = B.assign_batches(B.length_order(_lens(spark, sf_dir), "tokenize_length"), BATCH, drop_last=False)
    return B.pad_batch(ordered, "tokenize_length").select("text_id", "batch_id", "batch_len", "n_pad")


@register("trim_batch", sql=f"""WITH {POS_CTE}
SELECT text_id, batch_id, cast(max(least(tokenize_length, {K.FIXED_LENGTH})) OVER (PARTITION BY batch_id) AS int)
  AS trimmed_len
FROM (SELECT p.text_id, p.tokenize_length, p.pos // {BATCH} AS batch_id FROM pos p)""")
def trim_batch(spark, sf_dir):
    """Sequences padded to 512 (fixed family), batched in length order, then trimmed per batch."""
    toks = _tokens(spark, sf_dir)
    ids, mask = K.encode_plus(F.col("toks"), K.FIXED_LENGTH)
    enc = toks.select("text_id", K.token_ids(ids).alias("input_ids"), mask.alias("attention_mask"),
                      K.token_len(F.col("toks")).alias("tokenize_length"))
    batched = B.assign_batches(B.length_order(enc, "tokenize_length"), BATCH, drop_last=False)
    return B.trim_batch(batched, "input_ids", "attention_mask").select("text_id", "batch_id", "trimmed_len")


@register("mask_tokens")
def mask_tokens(spark, sf_dir):
    """C10 (rows-only): masked ids of the whole essay; invariants (protected ids kept, rate ≈ p) are in tests."""
    toks = _tokens(spark, sf_dir)
    enc = toks.select("text_id", K.token_ids(K.add_special(F.col("toks"))).alias("input_ids"))
    masked = enc.withColumn("masked_ids", K.mask_tokens(F.col("input_ids"), F.col("text_id"), 0, p=0.15))
    n_masked = F.aggregate(F.zip_with("input_ids", "masked_ids", lambda a, b: F.when(a != b, 1).otherwise(0)),
                           F.lit(0), lambda acc, v: acc + v)
    return masked.select("text_id", "input_ids", "masked_ids", n_masked.alias("n_masked"))


@register("shuffle_epoch", sql=f"WITH {essays_cte()}\nSELECT text_id, pos, cast(ep AS int) AS epoch, "
          f"pos // {BATCH} AS batch_id FROM (SELECT text_id, ep, row_number() OVER (PARTITION BY ep ORDER BY "
          "md5(concat('42:', ep, ':', text_id)), text_id) - 1 AS pos FROM essays, range(2) r(ep))")
def shuffle_epoch(spark, sf_dir):
    """C11: per-epoch seeded permutations of the essays for epochs 0 and 1."""
    e = fx.essays(Tables(spark, sf_dir)).select("text_id")
    parts = [B.shuffle_order(e, "text_id", seed=42, epoch=ep).withColumn("epoch", F.lit(ep)) for ep in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("batch_id", (F.col("pos") / BATCH).cast("long"))
