"""Line dedup, span dedup, quality rules, substring dedup and chat formatting against plain Python."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, lines, quality, shared, spans, suffixes, textops

from .helpers import awkward_rows, docs_frame, near_copies, sentence_text, words

BLANK = "\t\n\x0b\x0c\r "


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [" ".join(words(rng, 6)) for _ in range(5)]
    passage = sentence_text(rng, 8).strip()
    rows = []
    for i in range(n):
        text = sentence_text(rng, rng.randint(1, 12))
        if rng.random() < 0.4:
            text += "\n" + rng.choice([" ", ""]) + rng.choice(common).upper() + "\n" + sentence_text(rng, 2)
        if rng.random() < 0.3:
            text = sentence_text(rng, 2) + passage + " " + text
        rows.append((i, text, "en", "s", len(text)))
    return rows + rows[:3]


def brute_lines(rows, min_chars, min_docs):
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = fold(line.strip(BLANK))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        kept = []
        for line in (text or "").split("\n"):
            own = holders.get(fold(line.strip(BLANK)), set())
            last = max((x for x in own if x is not None), default=None)
            if len(own) < min_docs or doc == last:
                kept.append(line)
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [corpus(1, 60), awkward_rows(), []])
def test_line_dedup(spark, rows):
    df = docs_frame(spark, rows, clash=True)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute_lines(rows, 20, 3)


def brute_spans(rows, span, min_words):
    parts = [spans.sentences((r[1] or "").encode()) for r in rows]
    kept = [[i for i, p in enumerate(x) if p.strip()] for x in parts]
    first, grams = {}, []
    for (doc, *_), x, at in zip(rows, parts, kept):
        own = []
        for j in range(len(at) - span + 1):
            g = tuple(tuple(fold(x[i].decode()).split()) for i in at[j:j + span])
            if sum(map(len, g)) >= min_words:
                own.append((g, j))
                place = (doc is not None, doc or 0, j)          # null ids come first
                first[g] = min(first.get(g, place), place)
        grams.append(own)
    out = []
    for (doc, *_), x, at, own in zip(rows, parts, kept, grams):
        gone = {i for g, j in own if first[g] != (doc is not None, doc or 0, j) for i in at[j:j + span]}
        out.append((doc, b"".join(p for i, p in enumerate(x) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [corpus(2, 60), awkward_rows(), []])
def test_span_dedup(spark, rows):
    df = docs_frame(spark, rows, clash=True)
    out = spans.remove_repeated(df, span=2, min_words=8)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute_spans(rows, 2, 8)


def test_spans_of_short_long_and_foreign_sentences(spark):
    """Passages planted as raw text lose their second copy, whatever their sentences look like."""
    rng = random.Random(12)
    short = "".join(f"{w}!! " for w in words(rng, 60))
    long = " ".join(words(rng, 60))
    split = " ".join(words(rng, 20)) + ". " + " ".join(words(rng, 8)) + ". " + " ".join(words(rng, 26))
    han = "".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(9)) + "。" for _ in range(8))
    plain = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(70))
    hindi = "".join(" ".join("राम" + chr(0x915 + rng.randrange(30)) for _ in range(4)) + "। " for _ in range(12))
    rows, left = [], {}
    for i, (p, keeps) in enumerate([(short, 0), (long, 34), (split, 34), (han, 0), (plain, 34), (hindi, 0)]):
        around = [" ".join(words(rng, 12, 10 ** 6)) for _ in range(4)]
        joint = ". " if keeps == 0 else " "
        rows += [(2 * i + j, around[2 * j] + joint + p + " " + around[2 * j + 1], "en", "s", 1) for j in (0, 1)]
        left[2 * i + 1] = (p, keeps, set(around[2].split()) | set(around[3].split()))
    units = lambda t: [m.group() for m in re.finditer(r"[\u3000-\u9fff]|[^\s\u3000-\u9fff]+", t)]
    out = {r["doc_id"]: r["text"] for r in spans.remove_repeated(docs_frame(spark, rows), counts=True, grow=True).collect()}
    for doc, text, *_ in rows:
        if doc % 2 == 0:
            assert out[doc] == text
        else:
            p, keeps, own = left[doc]
            rest = [u.rstrip(".") for u in units(out[doc])]
            assert own <= set(rest) and len([u for u in rest if u not in own]) <= keeps, (doc, out[doc])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.!? \n\t\"é", max_size=60))
def test_sentences_concatenate_to_the_text(text):
    assert b"".join(spans.sentences(text.encode())) == text.encode()


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen, repeated = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated |= {j for i in at for j in range(i, i + 8)}
    with_word = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(with_word) - len(set(with_word)),
            len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w))


@pytest.mark.parametrize("rows", [corpus(3, 40), awkward_rows(), [], [(1, "a# b$ " * 30 + "\nx\n x\nx", "en", "s", 1)]])
def test_quality_metrics(spark, rows):
    out = quality.metrics(docs_frame(spark, rows, clash=True)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"]) for r in out), key=str)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_quality_bands(spark):
    rng = random.Random(1)
    rows = [(0, sentence_text(rng, 60), "en", "s", 1),                                         # prose
            (1, " ".join("%06x" % rng.getrandbits(256) for _ in range(3)) + " x" * 20 + "".join(
                chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000)), "en", "s", 1),         # random characters
            (2, " ".join(f"v{i}" + "abcabcabc" * 20 for i in range(60)), "en", "s", 1)]          # repetitive inside words
    df = docs_frame(spark, rows, clash=True)
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {0}
    assert {r["doc_id"] for r in quality.metrics(df).filter("kept").collect()} == {0}


def brute_substrings(rows, length):
    raws = [(r[1] or "").encode() for r in rows]
    seen = {}
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p:p + length], []).append((i, p))
    gone = [np.zeros(len(raw), bool) for raw in raws]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p:p + length] = True
    out = []
    for (doc, *_), raw, g in zip(rows, raws, gone):
        edges = np.diff(np.concatenate(([0], g.astype(int))))
        out.append((doc, len(raw), int(g.sum()), int((edges == 1).sum()),
                    bytes(b for b, x in zip(raw, g) if not x)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,rows", [
    (40, corpus(4, 40)), (24, corpus(5, 40)), (400, corpus(6, 60)), (400, [r for r in awkward_rows() if r[0] not in (6, 7)]),
    (30, [])])
def test_substring_dedup(spark, length, rows):
    df = docs_frame(spark, rows, clash=True)
    out = suffixes.dedup_substrings(df, length=length).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out), key=str)
    assert got == brute_substrings(rows, length)


def test_substring_dedup_digest_and_edges(spark):
    """Matches of exactly the length, one byte less, overlapping copies and a text that repeats itself."""
    rng = random.Random(8)
    p = " ".join(words(rng, 30))[:100]
    rows = [(1, "alpha " + p + " beta", "en", "s", 1), (2, "gamma" + p + "delta", "en", "s", 1),
            (3, "q" + p[:99] + "!", "en", "s", 1), (4, "ab" * 200, "en", "s", 1), (5, p + p, "en", "s", 1)]
    out = suffixes.dedup_substrings(docs_frame(spark, rows), length=100, digest=True).collect()
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == sorted((d, n, s, hashlib.sha256(k).hexdigest()) for d, _, n, s, k in brute_substrings(rows, 100))


@pytest.mark.parametrize("length", [4, 10, 40, 100, 400])
def test_difference_cover(length):
    v, cover = suffixes.difference_cover(length)
    assert v < length
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_parts_of_long_texts_give_the_same_names(monkeypatch):
    rng = random.Random(4)
    raw = " ".join(words(rng, 2000)).encode()
    whole = suffixes.tuple_names(raw, 50)
    monkeypatch.setattr(suffixes, "WINDOW", 512)
    parts = suffixes.tuple_names(raw, 50)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    small = textops.Words([raw]).hashes(False)
    monkeypatch.setattr(textops, "CHUNK_BYTES", 64)
    assert np.array_equal(small, textops.Words([raw]).hashes(False))


def brute_chat(turns):
    convs = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role, text))
    none_first = lambda t: tuple((x is not None, x if x is not None else "") for x in t)
    full = {c: tuple((r, t) for _, r, t in sorted(v, key=none_first)) for c, v in convs.items()}
    proper = {f[:n] for f in full.values() for n in range(1, len(f))}
    out = {}
    for c, f in full.items():
        if f not in proper:
            out.setdefault(f, []).append(c)
    return sorted((min(ids), len(f), len(ids), "".join(
        f"<|{r if r is not None else 'user'}|>\n{t or ''}\n<|end|>\n" for r, t in f)) for f, ids in out.items())


def test_chat_collapse(spark):
    rng = random.Random(6)
    turns = []
    for c in range(40):
        base = [("user" if i % 2 == 0 else "assistant", f"text {c % 7} {i}") for i in range(rng.randint(1, 6))]
        turns += [(c, i, r, t) for i, (r, t) in enumerate(base)]
    turns += [(None, 0, "user", "lost"), (100, None, None, None), (100, 1, "user", ""), (101, 1, "user", None),
              (102, 1, "user", ""), (103, 0, "user", "x" * 100_000), (104, 0, "b", "t"), (104, 0, "a", "t"), (104, 0, "a", "t")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    for extra in ("id", "turns", "hashes", "whole"):
        df = df.withColumn(extra, df["turn"])
    got = sorted(tuple(r) for r in chat.collapse(df).collect())
    assert got == brute_chat(turns)
    assert chat.collapse(df.limit(0)).count() == 0


def test_near_copies_lose_what_they_share(spark):
    """A passage of over 50 words in several documents stays once; documents without it are left alone."""
    rng = random.Random(12)
    passage = sentence_text(rng, 9).replace("\n", " ")
    rows = [(i, sentence_text(rng, 5) + (passage if i % 3 == 0 else "") + sentence_text(rng, 5), "en", "s", 1) for i in range(30)]
    text = {r["doc_id"]: r["text"] for r in spans.remove_repeated(docs_frame(spark, rows)).collect()}
    inner = passage.split(". ")[3]
    assert inner in text[0] and not any(inner in text[i] for i in range(3, 30, 3))
    assert all(text[i] == rows[i][1] for i in range(30) if i % 3)
    assert len(near_copies(rng, passage.split(), 1)) == len(passage.split())


def brute_kept(text, bands):
    """Verdict of the bands from the text's bytes alone."""
    import zstandard
    raw = (text or "").encode()
    squeeze = lambda x: len(x) / len(zstandard.ZstdCompressor(level=bands.level, write_content_size=True).compress(x))
    if brute_quality(text)[-1]:
        return False
    row = sum(len(raw) >= edge for edge in bands.upto)
    size = bands.chunk_bytes
    chunks = [raw[i:i + size] for i in range(0, len(raw), size) if i + size <= len(raw)]
    if chunks and len(raw) % size:
        chunks.append(raw[-size:])
    bad = sum(not bands.chunk_low <= squeeze(c) <= bands.chunk_high for c in chunks)
    return bands.low[row] <= squeeze(raw) <= bands.high[row] and (not chunks or bad / len(chunks) <= bands.bad_chunk_share)


def test_quality_verdicts_cover_the_end_of_texts(spark):
    """Whole verdicts equal brute force, also where only the last bytes of a text, less than a chunk, are noise or repeats."""
    rng = random.Random(8)
    prose = [sentence_text(rng, n) for n in (5, 20, 60, 150, 150, 150, 300)]
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(600))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(prose)]
    rows += [(20 + i, t.encode()[:2048 * k + 100].decode() + " " + end, "en", "s", 1)
             for i, (t, k, end) in enumerate([(prose[4], 1, noise), (prose[5], 2, noise), (prose[6], 1, " ".join(f"x{j}" + "ab" * 60 for j in range(15))),
                                              (prose[3], 3, "plain end")])]
    bands = quality.Bands()
    want = {r[0]: brute_kept(r[1], bands) for r in rows}
    df = docs_frame(spark, rows)
    assert {r["doc_id"]: r["kept"] for r in quality.metrics(df).collect()} == want
    assert {r["doc_id"] for r in quality.filter_documents(df).collect()} == {i for i, k in want.items() if k}
    assert not want[20] and want[23]                        # chunks before the end alone would keep document 20
    head = quality._ratios(rows[7][1].encode()[:2048], bands, __import__("zstandard").ZstdCompressor(level=3))
    assert head[1] == 0.0


def test_the_shuffle_of_all_spans_is_released_before_the_next(spark, monkeypatch):
    """Its files are dropped once the repeated hashes are written, not when an idle driver collects its heap."""
    steps, pin, rows = [], spans.pin, spans.span_rows
    monkeypatch.setattr(spans, "pin", lambda df: steps.append("pin") or pin(df))
    monkeypatch.setattr(spans, "span_rows", lambda *a: steps.append("spans") or rows(*a))
    monkeypatch.setattr(spans, "release", lambda _: steps.append("release"))
    docs = docs_frame(spark, corpus(3, 12))
    assert spans.remove_repeated(docs, counts=True, grow=True).count() == docs.count()
    assert steps == ["spans", "pin", "release", "spans"]


def test_span_dedup_leaves_no_shuffle_of_all_spans(spark, monkeypatch):
    """When the repeated hashes are written, their shuffle's files are gone, whatever the driver's heap still holds."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = blocks.getAllFiles().mkString(" ").split()
        return {x for x in names if x.endswith(".data") and "/shuffle_" in x}
    left = []

    def look(_):
        end = time.monotonic() + 5                          # files are deleted in the background
        while shuffles() - before and time.monotonic() < end:
            time.sleep(0.1)
        left.append(shuffles() - before)
    monkeypatch.setattr(spans, "release", look)
    docs = docs_frame(spark, corpus(3, 12))
    before, setting = shuffles(), spark.conf.get(shared.DROP_SHUFFLES, None)
    assert spans.remove_repeated(docs, counts=True, grow=True).count() == docs.count()
    assert left == [set()]
    assert spark.conf.get(shared.DROP_SHUFFLES, None) == setting
