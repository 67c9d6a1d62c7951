"""The registered masking query covers whole texts."""

from pyspark.sql import functions as F

from quillspark.functions import tokens as K
from quillspark.plans import fixtures as fx
from quillspark.plans import q_tokens
from quillspark.sources.tables import Tables

from .conftest import SF_SMALL


def test_mask_query_covers_every_token(spark):
    toks = fx.essays(Tables(spark, SF_SMALL)).select("text_id", K.regex_tokens("full_text").alias("toks"))
    whole = {r["text_id"]: r["ids"] for r in toks.select("text_id", K.token_ids(F.col("toks")).alias("ids")).collect()}
    got = {r["text_id"]: r for r in q_tokens.mask_tokens(spark, SF_SMALL).collect()}
    assert set(got) == set(whole) and max(map(len, whole.values())) > q_tokens.PAD_LEN
    tail = hits = 0
    for key, ids in whole.items():
        r = got[key]
        assert r["input_ids"] == [K.SPECIAL_IDS[K.CLS], *ids, K.SPECIAL_IDS[K.SEP]]
        changed = [i for i, (a, b) in enumerate(zip(r["input_ids"], r["masked_ids"], strict=True)) if a != b]
        assert len(changed) == r["n_masked"] and all(r["masked_ids"][i] == K.SPECIAL_IDS[K.MASK] for i in changed)
        tail += max(0, len(ids) - q_tokens.PAD_LEN)
        hits += sum(i > q_tokens.PAD_LEN for i in changed)
    assert abs(hits / tail - 0.15) < 4 * (0.15 * 0.85 / tail) ** 0.5
