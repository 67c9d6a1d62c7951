"""Packing ids against the tokenizer at its default settings, added tokens in the text included."""

import random

import numpy as np

from quillspark.llm import packing

from .helpers import docs_frame


def test_added_tokens_in_the_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " it's", "é", "12"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "", "plain", "<|endoftext|>'s <|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    pieces = packing.pack(docs_frame(spark, rows), length=64, with_ids=True).collect()
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["_ids"], np.uint32).tolist())
    for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids + [0], texts[i]
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == {i: len(x) for i, x in got.items()}
