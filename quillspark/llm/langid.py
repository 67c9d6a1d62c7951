"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language. N-gram counts come from Spark aggregates over the training documents; lower
orders use continuation counts, and each order is interpolated with the next lower one down to a uniform distribution.
A model is a set of sorted arrays of 64-bit n-gram hashes with the discounted probability of each n-gram and the
interpolation weight of each context, looked up by binary search. A text gets the language whose model has the lowest
cross-entropy per character (bits); per language a rejection threshold is calibrated on the training documents.

Texts are lower-cased and everything but letters becomes one space between words. Prediction names the distinct
n-grams of a batch with dense numbers, order by order, so each distinct n-gram is looked up once and the rest is table
lookups.

Bounds, all documented parameters: the models are fitted on at most about ``max_docs`` documents per language (a hash
of the id decides, whole texts are used) and keep at most ``max_grams`` n-grams per language and order, the most
frequent ones; so what is collected and broadcast has a fixed size. Prediction covers every document.

Defined results: a null text or a text without letters is ``und`` with score 0 and no cross-entropy; without any
training document every text is ``und``; equal cross-entropies go to the smaller language name; null labels are not
learned from; repeated rows are predicted one by one; very long texts are read whole; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import pin

ORDER = 4
DISCOUNT = 0.75
# Entries of all models together (16 bytes each) that may be collected and broadcast.
MAX_ENTRIES = 1 << 27
UNKNOWN = "und"
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)


def _gram_hash(previous: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of its first n-1 characters and its last one."""
    return textops.mix(previous * _MULT + char.astype(np.uint64) + U64(1))


def letters(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first of each text and end): lower case, runs of non-letters as one space, spaces at both ends.

    ``known`` is an optional cache of letter flags by code point (0 unknown, 1 letter, 2 other).
    """
    known = np.zeros(0x110000, np.uint8) if known is None else known
    lowered = [" " + t.decode("utf-8", "surrogatepass").lower() + " " for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = known[points]
    if (flag == 0).any():
        for p in np.unique(points[flag == 0]):
            known[p] = 1 if chr(p).isalpha() else 2
        flag = known[points]
    letter = flag == 1
    start = np.concatenate(([0], np.cumsum(size)))
    keep = letter.copy()
    keep[1:] |= letter[:-1]              # the first non-letter after a letter stays as a space
    keep[start[:-1]] = True              # and the one in front of a text
    chars = np.where(letter, points, 32)[keep]
    first = np.concatenate(([0], np.cumsum(keep)))[start]
    return chars, first


def _named(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes ascending, index of each code among them) for codes below ``limit``."""
    if limit > 32 * len(codes) + 1_000_000:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(limit, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    name = np.empty(limit, np.int32)
    name[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, name[codes]


def distinct_grams(chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1..ORDER: (hash, context number in the order below, last character) of the distinct n-grams and the
    number of the n-gram that begins at each position."""
    alphabet, one = _named(chars.astype(np.int64), int(chars.max()) + 1 if len(chars) else 1)
    a = len(alphabet)
    hashes = _gram_hash(np.zeros(a, np.uint64), alphabet)
    out = [(hashes, np.zeros(a, np.int64), alphabet, one)]
    for n in range(2, ORDER + 1):
        below_hash, _, _, below = out[-1]
        m = len(chars) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        codes = below[:m].astype(np.int64) * a + one[n - 1:]
        distinct, name = _named(codes, len(below_hash) * a)
        context, last = distinct // a, alphabet[distinct % a]
        out.append((_gram_hash(below_hash[context], last), context, last, name))
    return out


@dataclass
class Model:
    """Sorted hash arrays of one language: per order the n-grams with their own share of the probability, and per
    context the weight of the order below."""
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    vocabulary: int


def _lookup(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(hashes), default)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], default)


def log_probabilities(model: Model, grams: list) -> np.ndarray:
    """log2 probability of the last character of every distinct n-gram of the highest order given."""
    probability = None
    for n in range(1, ORDER + 1):
        hashes, context, _, _ = grams[n - 1]
        if n == 1:
            weight = model.contexts[0][1][0] if len(model.contexts[0][1]) else 1.0
            below = np.full(len(hashes), 1.0 / model.vocabulary)
            probability = _lookup(model.grams[0], hashes, 0.0) + weight * below
            continue
        context_hash = grams[n - 2][0][context]
        weight = _lookup(model.contexts[n - 1], context_hash, 1.0)
        # the lower-order n-gram lacks the first character; its number comes from any position of this n-gram
        name = grams[n - 1][3]
        lower = np.zeros(len(hashes), np.int64)
        lower[name] = grams[n - 2][3][1:len(name) + 1]
        probability = _lookup(model.grams[n - 1], hashes, 0.0) + weight * probability[lower]
    return np.log2(np.maximum(probability, 1e-12))


def cross_entropies(models: list[Model], texts: list[bytes], known: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Bits per character of each text under each model; nan where a text has no letter."""
    chars, first = letters(texts, known)
    grams = distinct_grams(chars)
    hashes, _, _, name = grams[-1]
    out = np.full((len(texts), len(models)), np.nan)
    size = np.diff(first) - ORDER + 1
    short = np.flatnonzero((size < 1) & (np.diff(first) > 1))
    if len(name):
        table = _cached(models, grams, cache)
        values = table[name]
        inside = np.flatnonzero(size > 0)
        if len(inside):
            bounds = np.stack((first[inside], first[inside] + size[inside]), 1).ravel()
            bounds = np.minimum(bounds, len(values) - 1)
            sums = np.add.reduceat(values.astype(np.float64), bounds, axis=0)[0::2]
            if first[inside[-1]] + size[inside[-1]] >= len(values):   # reduceat cannot name the end of the array
                sums[-1] = values[first[inside[-1]]:].sum(axis=0, dtype=np.float64)
            out[inside] = -sums / size[inside, None]
    for i in short:                      # fewer characters than the order: pad with spaces
        padded = b" " * 2 + texts[i] + b" " * 2
        text = letters([padded], known)[0]
        text = np.concatenate((np.full(ORDER, 32, text.dtype), text, np.full(ORDER, 32, text.dtype)))
        own = distinct_grams(text)
        out[i] = [-log_probabilities(m, own)[own[-1][3]].mean() for m in models]
    return out


def _cached(models: list[Model], grams: list, cache: dict | None) -> np.ndarray:
    """Log probabilities (n-grams x models), kept by n-gram hash between batches."""
    hashes = grams[-1][0]
    if cache is None:
        return np.stack([log_probabilities(m, grams) for m in models], 1)
    keys, values = cache.get("keys"), cache.get("values")
    if keys is None or len(keys) > 4_000_000:
        keys, values = np.zeros(0, np.uint64), np.zeros((0, len(models)), np.float32)
    at = np.searchsorted(keys, hashes)
    inside = at < len(keys)
    hit = np.zeros(len(hashes), bool)
    hit[inside] = keys[at[inside]] == hashes[inside]
    if not hit.all():
        fresh = np.stack([log_probabilities(m, grams) for m in models], 1).astype(np.float32)
        keys = np.concatenate((keys, hashes[~hit]))
        values = np.concatenate((values, fresh[~hit]))
        order = np.argsort(keys)
        cache["keys"], cache["values"] = keys[order], values[order]
        return fresh
    return values[at]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, n, gram, context, tail, count) over the (lang, text) rows; counted per batch before the shuffle."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, np.uint8)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first_row, rows in textops.chunks(batch.column(1)):
                own = langs[first_row:first_row + len(rows)]
                for lang in sorted(set(own)):
                    texts = [t for t, x in zip(rows, own) if x == lang]
                    chars, first = letters(texts, known)
                    grams = distinct_grams(chars)
                    for n in range(1, ORDER + 1):
                        hashes, context, _, name = grams[n - 1]
                        if not len(name):
                            continue
                        at = np.arange(len(name))
                        text_of = np.searchsorted(first, at, "right") - 1
                        ok = at + n <= first[text_of + 1]
                        count = np.bincount(name[ok], minlength=len(hashes))
                        tail = np.zeros(len(hashes), np.uint64)
                        if n > 1:
                            lower = np.zeros(len(hashes), np.int64)
                            lower[name] = grams[n - 2][3][1:len(name) + 1]
                            tail = grams[n - 2][0][lower]
                            ctx = grams[n - 2][0][context]
                        else:
                            ctx = np.zeros(len(hashes), np.uint64)
                        m = count > 0
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * int(m.sum()), pa.string()), pa.array(np.full(m.sum(), n), pa.int32()),
                             pa.array(hashes[m].view(np.int64)), pa.array(ctx[m].view(np.int64)),
                             pa.array(tail[m].view(np.int64)), pa.array(count[m], pa.int64())],
                            names=["lang", "n", "gram", "context", "tail", "count"])
    counted = labelled.mapInArrow(run, "lang string, n int, gram long, context long, tail long, count long")
    return counted.groupBy("lang", "n", "gram", "context", "tail").agg(F.sum("count").alias("count"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, n, gram, context, c, own) from all n-gram counts: ``c`` is the count in the highest order and below it the number of
    distinct longer n-grams that end with this one; ``own`` its discounted share in its context."""
    key = ["lang", "n", "gram"]
    continued = counts.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("tail").alias("gram")).agg(F.count("*").alias("c"))
    lower = counts.filter(F.col("n") < ORDER).select(*key, "context").join(continued, key)
    c = counts.filter(F.col("n") == ORDER).select(*key, "context", F.col("count").alias("c")).unionByName(lower)
    totals = c.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"))
    own = F.greatest(F.col("c") - F.lit(DISCOUNT), F.lit(0.0)) / F.col("total")
    return c.join(totals, ["lang", "n", "context"]).select(*key, "context", "c", own.alias("own"))


def most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """About the ``most`` most frequent n-grams of each language and order: all above a count and, by a hash of the n-gram, the share
    of those with that count for which there is room, so nothing is ranked in one task and no whole count falls away."""
    histogram = grams.groupBy("lang", "n", "c").count().orderBy("lang", "n", F.col("c").desc())
    least: dict[tuple, tuple] = {}
    room: dict[tuple, int] = {}
    for lang, n, c, here in histogram.toLocalIterator():   # one row per different count, streamed
        left = room.setdefault((lang, n), most)
        if left < here and (lang, n) not in least:
            least[lang, n] = c, left / here
        room[lang, n] = max(0, left - here)
    if not least:
        return grams
    limits = grams.sparkSession.createDataFrame([(*k, *v) for k, v in least.items()], "lang string, n int, least long, share double")
    chosen = F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    kept = F.col("least").isNull() | (F.col("c") > F.col("least")) | (F.col("c") == F.col("least")) & chosen
    return grams.join(F.broadcast(limits), ["lang", "n"], "left").filter(kept).drop("least", "share")


def fit(labelled: DataFrame, max_grams: int = 150_000) -> tuple[list[str], list[Model]]:
    """Models by language name from (lang, text) rows.

    Counts, continuation counts and context totals are those of all n-grams; of those, the model stores about ``max_grams`` per
    language and order. What a context's stored n-grams leave of its probability is the weight of the order below, so a
    model is a distribution whatever was left out.
    """
    grams = pin(kneser_ney(gram_counts(labelled)))
    kept = pin(most_frequent(grams, max_grams))
    weights = kept.groupBy("lang", "n", "context").agg((F.lit(1.0) - F.sum("own")).alias("own"))
    rows = kept.select("lang", "n", F.lit(0).alias("kind"), "gram", "own").unionByName(
        weights.select("lang", "n", F.lit(1).alias("kind"), F.col("context").alias("gram"), "own"))
    names = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if len(names) * 2 * ORDER * max_grams > MAX_ENTRIES:
        raise ValueError(f"{len(names)} languages of {max_grams} n-grams an order exceed {MAX_ENTRIES} model entries; lower max_grams")
    models = []
    for lang in names:
        t = rows.filter(F.col("lang") == lang).select("n", "kind", "gram", "own").toPandas()
        tables: list[list] = [[], []]
        for kind in (0, 1):
            for n in range(1, ORDER + 1):
                part = t[(t["n"] == n) & (t["kind"] == kind)]
                hashes = part["gram"].to_numpy(np.int64).view(np.uint64)
                order = np.argsort(hashes)
                tables[kind].append((hashes[order], part["own"].to_numpy(np.float64)[order]))
        models.append(Model(tables[0], tables[1], max(1, len(tables[0][0][0])) + 1))
    return names, models


def sample_labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """(lang, text) of about ``max_docs`` documents per language at most, chosen by a hash of the id."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).count().collect()
    share = None
    for lang, size in sizes:
        limit = F.lit(int(min(1.0, max_docs / size) * 1_000_000))
        share = F.when(F.col(lang_col) == lang, limit) if share is None else share.when(F.col(lang_col) == lang, limit)
    if share is None:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(0)
    return (rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1_000_000)) < share)
                .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))


def predict(docs: DataFrame, names: list[str], models: list[Model], limits: dict[str, float] | None = None,
            keep: list[str] = (), text_col: str = "text", evidence: int = 20) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, cross_entropy, rejected``.

    The score is the share of the best language among all, 2^(-bits) over at most ``evidence`` characters.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((names, models, limits or {}))
    keep = list(keep)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["lang_pred string", "score double", "cross_entropy double", "rejected boolean"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, np.uint8)
        cache: dict = {}
        langs, lms, most = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for first, rows in textops.chunks(batch.column(at)):
                pred, score, entropy, rejected = [], [], [], []
                ce = cross_entropies(lms, rows, known, cache) if lms else np.full((len(rows), 1), np.nan)
                size = np.array([len(r) for r in rows])
                for i in range(len(rows)):
                    if not lms or np.isnan(ce[i, 0]):
                        pred.append(UNKNOWN), score.append(0.0), entropy.append(None), rejected.append(True)
                        continue
                    best = int(np.argmin(ce[i]))
                    share = 2.0 ** (-(ce[i] - ce[i, best]) * min(evidence, size[i]))
                    pred.append(langs[best]), score.append(float(1 / share.sum())), entropy.append(float(ce[i, best]))
                    rejected.append(bool(ce[i, best] > most.get(langs[best], np.inf)))
                part = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(f.name)) for f in fields]
                    + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()),
                       pa.array(rejected, pa.bool_())],
                    names=[f.name for f in fields] + ["lang_pred", "score", "cross_entropy", "rejected"])
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             max_docs: int = 1500, max_grams: int = 150_000, reject_quantile: float = 0.995) -> DataFrame:
    """(id, held_out, lang_pred, score, cross_entropy, rejected) of every document.

    Documents whose crc32 of the id as text leaves 2 modulo 4 are held out: nothing is learned from them.
    ``rejected`` marks texts that even the best model finds less likely than nearly all training texts.
    """
    remainder = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), (remainder == 2).alias("held_out"))
    train = sample_labelled(rows.filter("not held_out"), id_col, "text", "lang", max_docs)
    names, models = fit(train, max_grams)
    own = predict(train, names, models, keep=["lang"]).filter("lang = lang_pred")
    limits = {r[0]: r[1] for r in own.groupBy("lang").agg(
        F.percentile_approx("cross_entropy", reject_quantile, 10_000)).collect()}
    return predict(rows, names, models, limits, keep=[id_col, "held_out"])
