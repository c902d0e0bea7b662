"""Packing against whole-text encoding, and its padding."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import EDGE, documents, sentences
from tokenizers import Tokenizer

from recolumn.llm import packing
from recolumn.llm import textops as tx


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_units_encode_like_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 50)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f", "\x0b", "\x85", "\xa0", " ", " ", "​", " ", "　", "﻿", "᠎", "a", "Zz", "é", "1", "22", "!", "...", "'s", "'", "日本", "𝔘", "<|endoftext|>", "ß", "x" * 300]
    parts += ["À", "×", "÷", "ÿ", "Ā", "ʼ", "́", "-", "'re", "_", "\u2000", "\u2028", "\u202f", "\u1680", "\u205f", "\u00ad"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)] + [""]
    encoder = packing.Encoder()
    for i in range(0, len(texts), 100):
        ids, ends = encoder.encode(*tx.buffers(pa.array(texts[i : i + 100])))
        for k, t in enumerate(texts[i : i + 100]):
            assert ids[ends[k] : ends[k + 1]].tolist() == whole(tokenizer, t)[:-1], repr(t)


@pytest.mark.parametrize("capacity", [64, 100, 2048])
def test_cuts_and_bins(capacity):
    slack = packing.SLACK * capacity // 2048
    parts = packing.cuts(capacity, slack)
    assert [sum(p) for p in parts] == list(range(capacity))
    assert all(capacity % s <= slack for p in parts for s in p)
    rng, packer = random.Random(1), packing.Packer(capacity, slack, parts)
    docs = {k: np.arange(rng.randint(1, 3 * capacity), dtype=np.uint32) + 7 * k for k in range(2000)}
    for k, ids in docs.items():
        packer.add(k, ids)
    full = list(packer.closed)
    for own in full:
        # a class's sequences hold its number of pieces and are nearly full
        assert len({capacity // len(p[2]) for p in own} | {len(own)}) == 1
        assert capacity - slack <= sum(len(p[2]) for p in own) <= capacity
    packer.finish()
    used = [sum(len(p[2]) for p in own) for own in packer.closed[len(full) :]]
    assert all(u == capacity or not u & (u - 1) for u in used) and sum(u < capacity for u in used) <= capacity.bit_length()
    back = {}
    for own in packer.closed:
        for doc, start, ids, n in own:
            assert n == len(docs[doc])
            back.setdefault(doc, {})[start] = ids
    for doc, ids in docs.items():
        assert np.concatenate([back[doc][s] for s in sorted(back[doc])]).tolist() == ids.tolist()


def test_packed_documents(spark, tokenizer):
    texts = EDGE + sentences(1, 60, 3000, 40) + ["a very long text " * 30_000, "x" * 200_000, "one " * 4095, "<|endoftext|> here"] + ["again"] * 5
    docs = documents(spark, texts).repartition(3, "doc_id")
    want = {k: whole(tokenizer, t) for k, t in enumerate(texts)}
    rows = packing.report(docs).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    assert found.keys() == want.keys()
    for doc, own in found.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            ids = np.array(want[doc][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(want[doc]), crc32(ids.tobytes())) and r["length"]
            at += r["length"]
        assert at == len(want[doc])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 2048 if at & (at - 1) else at
    assert padded <= 1.01 * sum(map(len, want.values()))
    real = packing.sequences(docs)
    assert real.agg(F.sum("padded")).head()[0] == padded
    assert real.where("octet_length(ids) <> 4 * length").count() == 0


def test_odd_tables(spark):
    docs = documents(spark, ["same text"] * 4)
    assert packing.report(docs.limit(0)).count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 1, F.lit("s")))
    rows = packing.report(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows for _ in range(1) if r["start"] == 0) == ["None", "None", "s", "s"]
    assert sum(r["length"] for r in rows) == 4 * rows[0]["doc_tokens"]
