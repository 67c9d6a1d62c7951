"""Packing round trip, mixing invariants, held-out language accuracy, neighbour recall and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, neighbours, packing, queries, shared

from ..conftest import SF_CHECK, SF_SMALL
from .helpers import awkward_rows, docs_frame, sentence_text, words

TRICKY = ["", " ", "  a", "a  b", "x\n\ny ", "don't we'll I'VE they're 'tis ''s x's's \"'d\"", "1 23abc4 ½٣", "café    z",
          "日本語　テキスト", "emoji \U0001f600\U0001f468‍\U0001f469", "tab\tnew\r\nline\x0b\x0c", "a" * 3000, " \n \n ", "<|endoftext|> x",
          "\x85x \x1cy", "it's", "'", "'s", " 's", "\n's 'll", "!!!'s", "a'b'c't"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer(reference, spark):
    rng = random.Random(2)
    alphabet = " \n\t'stmdrevl1éß中.!- "
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    ids, at = packing.Tokenizer(packing.default_tokenizer())([t.encode() for t in texts])
    for i, expected in enumerate(reference(texts)):
        assert ids[at[i]:at[i + 1]].tolist() == expected, texts[i]


def check_packing(rows, pieces, reference, length):
    expected = sorted((r[0], reference([r[1] or ""])[0] + [0]) for r in rows if r[0] is not None)
    by_doc, by_seq = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["_ids"], np.uint32).tolist()
        assert len(ids) == p["length"] and zlib.crc32(bytes(p["_ids"])) == p["ids_crc32"]
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for seq in by_seq.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length       # full, or a power of two: no padding
    unique = [d for d, _ in expected]
    for doc, ids in expected:
        if unique.count(doc) == 1:
            got = [x for _, part, _ in sorted(by_doc[doc]) for x in part]
            assert got == ids and all(n == len(ids) for *_, n in by_doc[doc])
    assert sum(len(x) for v in by_doc.values() for _, x, _ in v) == sum(
        len(reference([r[1] or ""])[0]) + 1 for r in rows)


@pytest.mark.parametrize("length,open_windows", [(1024, 32), (64, 3)])
def test_packing_round_trip(spark, reference, length, open_windows):
    rng = random.Random(3)
    rows = awkward_rows() + [(100 + i, sentence_text(rng, rng.randint(1, 40)), "en", "s", 1) for i in range(80)]
    df = docs_frame(spark, rows, clash=True, parts=5)
    pieces = packing.pack(df, length=length, open_windows=open_windows, merge_group=2, with_ids=True).collect()
    check_packing(rows, pieces, reference, length)
    again = packing.pack(df, length=length, open_windows=open_windows, merge_group=2).collect()
    assert sorted(tuple(p)[:7] for p in pieces if p[0] is not None) == sorted(tuple(p) for p in again if p[0] is not None)
    assert packing.pack(df.limit(0)).count() == 0


def test_water_filling():
    t = mixing.water_fill([100, 100, 1000], [5, 2, 1], 3)
    assert t[0] == 300 and abs(sum(t) - 1200) < 1e-9 and t[1] == 300 and abs(t[2] - 600) < 1e-9
    assert mixing.water_fill([10], [1], 3) == [10] and mixing.water_fill([], [], 3) == []
    assert mixing.water_fill([0, 10], [5, 1], 3) == [0.0, 10.0]


def test_shard_draws_add_up():
    totals = np.array([500, 30, 0, 1234])
    parts = [mixing.shard_draw(totals, 18, s, 100, 3) for s in range(18)]
    assert (sum(c for _, c in parts) == totals).all()
    at = np.zeros(4, int)
    for first, count in parts:
        assert (first == at).all() and count.sum() <= 100
        at += count
    huge = mixing._split(np.random.default_rng(1), np.array([4 * 10 ** 9, 10 ** 9, 7]), 2 * 10 ** 9)
    assert huge.sum() == 2 * 10 ** 9 and abs(huge[0] / 1.6e9 - 1) < 1e-3 and huge[2] <= 7


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutations(n):
    a = mixing.permuted(np.arange(n), n, 1, 2, 0)
    assert sorted(a.tolist()) == list(range(n))
    if n >= 64:
        assert (a != mixing.permuted(np.arange(n), n, 1, 2, 1)).any()


def filled_by_bisection(sizes, weights, most):
    """Targets weight * level, at most most * size, with the level at which they sum to the total size."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(w * level, most * s) for s, w in zip(sizes, weights)) < total:
            low = level
        else:
            high = level
    return [min(w * high, most * s) for s, w in zip(sizes, weights)]


def test_mixing_query(spark):
    rows = queries.QUERIES["op9_mixing"](spark, SF_CHECK).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(d["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    targets = filled_by_bisection(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, size, target in zip(names, sizes, targets):
        assert {r["source_size"] for r in by[s]} == {size}
        assert all(abs(r["target"] - target) < 1e-4 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 0.02 * target + 64
    again = queries.QUERIES["op9_mixing"](spark, SF_CHECK).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_tells_rows_apart(spark):
    """Rows without an id, and rows that share one, are mixed as documents of their own: every word comes from its own text."""
    rows = [(None if i % 2 else 7, " ".join(f"r{i}w{j}" for j in range(3 + i % 9)), "en", "s1" if i % 3 else None, 1) for i in range(60)]
    rows += [rows[0], rows[1], rows[1]]
    df = docs_frame(spark, rows)
    documents, pieces, slots = mixing.mix(df, block_words=4)
    taken = mixing.taken_words(documents, pieces, slots).collect()
    assert len(taken) == len(rows) and all(0 <= r["taken"] <= 3 * r["_mx_size"] for r in taken)
    out = mixing.mixed_documents(df, block_words=4).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in taken)
    texts = {(r[0], r[3], r[1]) for r in rows}
    for r in out:
        own = {w.split("w")[0] for w in r["text"].split()}
        assert len(own) == 1 and any(i == r["doc_id"] and s == r["source"] and r["text"] in t for i, s, t in texts)


@pytest.mark.parametrize("rows", [awkward_rows(), []])
def test_mixed_documents(spark, rows):
    df = docs_frame(spark, rows, clash=True)
    documents, pieces, slots = mixing.mix(df, block_words=16)
    taken = mixing.taken_words(documents, pieces, slots).collect()
    assert len(taken) == len(rows)
    out = mixing.mixed_documents(df, block_words=16)
    assert out.columns == df.columns
    out = out.collect()
    count = lambda t: len([x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x])
    assert sum(count(r["text"]) for r in out) == sum(r["taken"] for r in taken)
    texts = {(r[0], r[1]) for r in rows}
    for r in out:
        assert any(d == r["doc_id"] and r["text"].split()[0] in (t or "") for d, t in texts)


def test_language_accuracy_on_held_out_documents(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op4_language_id"](spark, SF_CHECK).collect()}
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {k for k, r in out.items() if r["held_out"]}
    good = sum(out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert good >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_awkward_rows(spark):
    rows = awkward_rows() + [(20, "!!! 123", "en", "s", 1), (21, "z", "fr", "s", 1), (22, "Ab", None, "s", 1)]
    out = langid.identify(docs_frame(spark, rows, clash=True)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 20))
    assert got[21]["lang_pred"] in ("en", "de", "fr") and got[22]["lang_pred"] != "und"
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in rows]
    assert {r["lang_pred"] for r in langid.identify(docs_frame(spark, unlabelled)).collect()} == {"und"}
    assert langid.identify(docs_frame(spark, [])).count() == 0


def test_language_models_equal_brute_force(spark):
    """Own shares and weights of every n-gram equal those from dictionaries of all n-grams of the texts."""
    texts = ["the cat sat on the mat", "and the dog ran to the cat", "a", "Tthe  THE cat"]
    names, models = langid.fit(spark.createDataFrame([("en", t) for t in texts] + [("xx", "zz zz")], "lang string, text string"))
    assert names == ["en", "xx"]
    grams = {n: {} for n in range(1, langid.ORDER + 1)}
    for t in texts:
        t = " " + " ".join(t.lower().split()) + " "
        for n in grams:
            for i in range(len(t) - n + 1):
                grams[n][t[i:i + n]] = grams[n].get(t[i:i + n], 0) + 1
    value = {langid.ORDER: grams[langid.ORDER]}
    for n in range(1, langid.ORDER):
        value[n] = {}
        for longer in grams[n + 1]:
            value[n][longer[1:]] = value[n].get(longer[1:], 0) + 1

    def prob(context, char):
        p = 1 / (len(value[1]) + 1)
        for n in range(1, langid.ORDER + 1):
            ctx = context[len(context) - n + 1:]
            here = {g: c for g, c in value[n].items() if g[:-1] == ctx}
            if here:
                total = sum(here.values())
                p = max(here.get(ctx + char, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(here) / total * p
        return p
    alphabet = sorted(value[1]) + ["q"]
    for context in ("the", "xyz", "cat", " th", "at "):
        total = 0.0
        for c in alphabet:
            own = langid.distinct_grams(np.array([ord(x) for x in context + c], np.uint32))
            got = 2 ** langid.log_probabilities(models[0], own)[own[-1][3][0]]
            assert abs(got - prob(context, c)) < 1e-9
            total += got
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("most", [1, 20, 60])
def test_language_models_beyond_the_limit_stay_distributions(spark, most):
    """One n-gram over the limit drops one n-gram, not all of its count; what is left out goes to the order below."""
    rng = random.Random(most)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    table = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    full = langid.kneser_ney(langid.gram_counts(table))
    sizes = {r["n"]: r["count"] for r in full.groupBy("n").count().collect()}
    kept = {r["n"]: r["count"] for r in langid.most_frequent(full, most).groupBy("n").count().collect()}
    for n, size in sizes.items():
        assert abs(kept.get(n, 0) - min(size, most)) <= 3 * min(size, most) ** 0.5 + 2
    _, models = langid.fit(table, max_grams=most)
    alphabet = sorted({ord(c) for t in texts for c in t}) + [ord("q")]
    stored = len(models[0].grams[0][0])
    for context in ("abc", "xyz", "gh ", " ab"):
        total = 0.0
        for c in alphabet:
            own = langid.distinct_grams(np.array([ord(x) for x in context] + [c], np.uint32))
            total += 2 ** langid.log_probabilities(models[0], own)[own[-1][3][0]]
        assert total <= len(alphabet) / (stored + 1) + 1 + 1e-6 and (stored < len(alphabet) - 1 or abs(total - 1) < 1e-6)


def brute_neighbours(rows, k, step):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % step == 0:
            scored = [(-(q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())), j)
                      for j, v in good if j != i and len(v) == len(q)]
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def test_neighbour_recall(spark):
    got = {}
    for r in queries.QUERIES["op10_nearest_neighbours"](spark, SF_CHECK).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()
    expected = brute_neighbours([(r["vec_id"], r["embedding"]) for r in table], 5, 50)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[q]) & set(v)) for q, v in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6),
             (205, [float("inf")] + [0.0] * 5), (206, [1.0, 2.0]), (208, [2.0, 4.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for extra in ("id", "v", "bucket", "block"):
        df = df.withColumn(extra, df["vec_id"])
    out = neighbours.nearest(df, df.filter("vec_id % 2 = 0"), k=5, block_rows=16, probes=200).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    expected = brute_neighbours(rows, 5, 2)
    assert set(got) == {q for q, v in expected.items() if v}
    assert all(got[100 + i] == expected[100 + i] for i in range(0, 20, 2))
    hits = sum(len(set(got[q]) & set(expected[q])) for q in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_probe_order():
    low, high = np.array([0.1, 0.4, 0.3]), np.array([0.9, 0.6, 0.7])
    moves = neighbours.probe_moves(low, high, 12)
    cost = [sum((low if s < 0 else high)[f] ** 2 for f, s in m) for m in moves]
    assert moves[0] == () and cost == sorted(cost) and len(set(moves)) == len(moves)
    assert len(neighbours.probe_moves(low[:1], high[:1], 50)) == 3


def test_pipeline(spark, reference):
    import corpus_pipeline as pipe
    from .test_ngram_join import brute
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = docs
    for name, stage in pipe.STAGES:
        before = seen
        path = pipe.shared_path(spark, "test")
        stage(spark, seen, SF_SMALL).write.parquet(path)
        seen = spark.read.parquet(path)
        if name != "packing":
            assert seen.columns == docs.columns
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in seen.collect()) == sorted({c for *_, c in brute(rows, 5, 80, 100)})
    assert pipe.ORACLE_SQL is None
    n = len(words(random.Random(1), 3))
    assert n == 3 and pipe.run(spark, SF_SMALL).count() == seen.count() > 0


def test_pipeline_bears_awkward_rows(spark):
    import corpus_pipeline as pipe
    for rows in (awkward_rows(), []):
        seen = docs_frame(spark, rows)
        for _, stage in pipe.STAGES:
            seen = spark.createDataFrame(stage(spark, seen, SF_SMALL).collect(), stage(spark, seen, SF_SMALL).schema)
        assert seen.count() >= 0


def test_pipeline_bounds_the_batches_of_its_workers(spark):
    """10,000 texts of 2,000 characters do not go to Python at once; a session's own bound stays."""
    import corpus_pipeline as pipe

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])
    for own in (None, "1m"):
        session = spark.newSession()
        if own:
            session.conf.set(shared.BATCH_SETTING, own)
        docs = session.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 334).alias("text"),
                                                     F.lit("web").alias("source"))
        for _, stage in pipe.STAGES[:1] + pipe.STAGES[-1:]:
            stage(session, docs, SF_SMALL)
        seen = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in seen) == 10_000
        assert max(r["size"] for r in seen) < (1.5 if own else 6) * 2 ** 20


def test_arrow_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    steps = []
    monkeypatch.setattr(shared.pa, "default_memory_pool", lambda: type("P", (), {"release_unused": lambda _: steps.append("released")})())
    rows = [pa.RecordBatch.from_arrays([pa.array([i])], names=["n"]) for i in range(3)]
    for b in shared.trimmed(iter)(rows):
        steps.append(b.column(0)[0].as_py())
    assert steps == [0, 1, 2, "released"]
