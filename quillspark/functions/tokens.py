"""Token columns: the default tokenizer, counts, length policy, padding/truncation and token masking.

The default tokenizer is a native regex (word runs or single punctuation marks); any pandas UDF returning
``array<string>`` can replace it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"\w+|[^\w\s]"
# Special tokens of the default vocabulary and their ids.
CLS, SEP, PAD, MASK = "[CLS]", "[SEP]", "[PAD]", "[MASK]"
SPECIAL_IDS = {PAD: 0, CLS: 1, SEP: 2, MASK: 3}
N_SPECIAL = 4
# Fixed value: model families that are fed fixed 512-token padded inputs; others are unbounded.
FIXED_LENGTH_FAMILIES = r"roberta|distilbert|facebook/bart|distilbart"
FIXED_LENGTH = 512


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def token_len(tokens: Column, n_special: int = 2) -> Column:
    """Token count including the special tokens the encoder adds."""
    return (F.size(tokens) + F.lit(n_special)).cast("int")


def n_token(tokens: Column) -> Column:
    return F.size(tokens).cast("int")


def n_unique_token(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)).cast("int")


def length_policy(model_type: Column | str) -> Column:
    """Fixed padded length for some families, NULL (= unbounded) for the others."""
    return F.when(_col(model_type).rlike(FIXED_LENGTH_FAMILIES), F.lit(FIXED_LENGTH)).cast("int")


def add_special(tokens: Column, max_len: Column | int | None = None) -> Column:
    """``[CLS] tokens [SEP]``, truncating the body so the whole fits ``max_len``."""
    body = tokens if max_len is None else F.slice(tokens, 1, _lit_int(max_len) - 2)
    return F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))


def pad_to(seq: Column, length: Column | int, pad=PAD) -> Column:
    """Right-pad an array to ``length`` (no-op when already that long)."""
    missing = F.greatest(_lit_int(length) - F.size(seq), F.lit(0))
    return F.concat(seq, F.array_repeat(F.lit(pad), missing))


def attention_mask(seq: Column, length: Column | int) -> Column:
    real = F.least(F.size(seq), _lit_int(length))
    missing = F.greatest(_lit_int(length) - F.size(seq), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1).cast("tinyint"), real), F.array_repeat(F.lit(0).cast("tinyint"), missing))


def encode_plus(tokens: Column, max_len: Column | int) -> tuple[Column, Column]:
    """C4: truncate, add special tokens, right-pad; returns (padded tokens, attention mask)."""
    seq = add_special(tokens, max_len)
    return pad_to(seq, max_len), attention_mask(seq, max_len)


def token_ids(tokens: Column, vocab_size: int = 30522) -> Column:
    """Hashing vocabulary: specials keep fixed ids, every other token maps into [N_SPECIAL, vocab_size)."""
    def one(t):
        hashed = (F.pmod(F.xxhash64(t), F.lit(vocab_size - N_SPECIAL)) + N_SPECIAL).cast("int")
        expr = hashed
        for tok, i in SPECIAL_IDS.items():
            expr = F.when(t == F.lit(tok), F.lit(i)).otherwise(expr)
        return expr
    return F.transform(tokens, one)


def mask_tokens(ids: Column, doc_key: Column, epoch: Column | int, p: float = 0.1, seed: int = 42,
                mask_id: int = SPECIAL_IDS[MASK], active_epochs: tuple[int, ...] | None = (0, 1),
                added_from: int | None = None) -> Column:
    """Replace each id by ``mask_id`` with probability ``p``; CLS, SEP, PAD, the mask itself and ids from
    ``added_from`` on (markers added behind the vocabulary) are protected.

    Masking is a training-time augmentation of the first epochs only (``active_epochs``; None = every epoch).
    The coin is a seeded hash of (doc, position, epoch), so a rerun of a lost task reproduces the same mask.
    """
    protected = [SPECIAL_IDS[CLS], SPECIAL_IDS[SEP], SPECIAL_IDS[PAD], mask_id]
    ep = F.lit(epoch) if isinstance(epoch, int) else epoch
    if isinstance(epoch, int) and active_epochs is not None and epoch not in active_epochs:
        return ids

    def one(x, i):
        # the first 8 hex digits of an md5: a coin that any engine can toss again
        coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_key, i, ep).cast("binary")), 1, 8), 16, 10) \
            .cast("long") / F.lit(float(1 << 32))
        keep = x.isin(protected)
        if added_from is not None:
            keep = keep | (x >= added_from)
        return F.when(keep, x).when(coin < F.lit(p), F.lit(mask_id)).otherwise(x)
    return F.transform(ids, one)


def _lit_int(v: Column | int) -> Column:
    return F.lit(v) if isinstance(v, int) else v
