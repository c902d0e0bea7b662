"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import EDGE, documents, sentences

from recolumn.llm import resample
from recolumn.llm import textops as tx

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, items, percent=5):
    own, target = (Counter(b for _, t in rows for b in features(t)[1]) for rows in (docs, items))
    s, t = sum(own.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out, fit = {}, []
    for doc, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[doc] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            fit.append(doc)
    fit.sort(key=lambda d: (-out[d][2], d))
    for k, d in enumerate(fit[: percent * len(fit) // 100], 1):
        out[d][3] = k
    return {k: tuple(v) for k, v in out.items()}


def test_word_checksums_of_any_length():
    rng = random.Random(5)
    words = [bytes(rng.choices(range(97, 123), k=n)) for n in (1, 2, 7, 63, 64, 65, 127, 128, 129, 1000, 70_000)] * 2
    body = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    data = np.frombuffer(body, np.uint8)
    assert resample.word_checksums(data, starts, ends).tolist() == [crc32(w) for w in words]
    runs, rows = resample.run_buckets(*tx.buffers(pa.array([b" ".join(words).decode(), "", "a b"])), buckets=1 << 32)
    assert rows.tolist() == [0, 22, 22, 24]
    for n, (bucket, on) in enumerate(runs, 1):
        assert bucket[on].tolist() == [crc32(b" ".join(w[i : i + n])) for w in (words, [b"a", b"b"]) for i in range(len(w) - n + 1)]


def test_draw(spark, monkeypatch):
    monkeypatch.setattr(resample, "BINS", 100)
    texts = EDGE + sentences(1, 300, 60, 40) + ["the same words again and again " * 6] * 40
    items = [(k, t) for k, t in enumerate(sentences(2, 20, 30, 40) + [None, "", "the same words"])]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for percent in (37, 100):
        got = {r["id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.ranked(resample.scored(docs, bench), percent=percent).collect()}
        assert got == brute(list(enumerate(texts)), items, percent)
    assert {r["doc_id"]: tuple(r)[1:] for r in resample.report(docs, bench).collect()} == brute(list(enumerate(texts)), items)
    drawn = resample.resampled(docs, bench)
    assert drawn.columns == docs.columns
    assert {r["doc_id"] for r in drawn.collect()} == {d for d, v in brute(list(enumerate(texts)), items).items() if v[3]}


def test_ties_nulls_and_empty_tables(spark):
    """Rows that repeat an id tie in every column; a null id is drawn like any other."""
    text = " ".join(f"w{k}" for k in range(25))
    rows = documents(spark, [text] * 30).withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id") % 2))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = resample.ranked(resample.scored(rows, bench), percent=50).collect()
    assert len(got) == 30 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))
    ordered = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in ordered] == sorted((r["score"] for r in ordered), reverse=True)
    assert resample.resampled(rows, bench, percent=50).count() == 15
    assert resample.report(rows.limit(0), bench).count() == 0
    none = resample.report(rows, bench.limit(0)).collect()
    assert len(none) == 30 and all(r["weight"] < 0 for r in none)


def test_scores_far_apart(spark):
    """The cutoff is exact whatever the range of the scores."""
    rng = random.Random(3)
    scores = [rng.choice([-(10**12), 0, 10**12]) + rng.randint(-50, 50) for _ in range(2000)]
    counts = spark.createDataFrame(list(Counter(scores).items()), "score long, n long")
    ordered = sorted(scores, reverse=True)
    for most in (1, 7, 500, 1999, 2000):
        assert resample.cutoff(counts, most) == ordered[most - 1]
    starts = {r["score"]: r["before"] for r in resample.starting_ranks(counts)[0].collect()}
    assert starts == {s: sum(x > s for x in scores) for s in set(scores)}
