"""Collocations against plain counting; the automaton against the online construction."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolumn.llm import collocations as C

DOCS = "doc_id long, text string, lang string, key string, score double, a long"


def online(strings):
    """The textbook generalised automaton: (longest, shortest, occurrences) of each state."""
    states = [{"len": 0, "link": -1, "next": {}, "n": 0}]

    def extend(last, c):
        if c in states[last]["next"]:
            q = states[last]["next"][c]
            if states[q]["len"] == states[last]["len"] + 1:
                states[q]["n"] += 1
                return q
            own = clone(last, c, q)
            states[own]["n"] += 1
            return own
        new, p = len(states), last
        states.append({"len": states[last]["len"] + 1, "link": 0, "next": {}, "n": 1})
        while p >= 0 and c not in states[p]["next"]:
            states[p]["next"][c] = new
            p = states[p]["link"]
        if p >= 0:
            q = states[p]["next"][c]
            states[new]["link"] = q if states[q]["len"] == states[p]["len"] + 1 else clone(p, c, q)
        return new

    def clone(p, c, q):
        own = len(states)
        states.append({"len": states[p]["len"] + 1, "link": states[q]["link"], "next": dict(states[q]["next"]), "n": 0})
        states[q]["link"] = own
        while p >= 0 and states[p]["next"].get(c) == q:
            states[p]["next"][c] = own
            p = states[p]["link"]
        return own

    for s in strings:
        last = 0
        for c in s:
            last = extend(last, c)
    for k in sorted(range(1, len(states)), key=lambda k: -states[k]["len"]):
        if states[k]["link"] > 0:
            states[states[k]["link"]]["n"] += states[k]["n"]
    out = []
    for k, s in enumerate(states[1:], 1):
        link = states[s["link"]]
        out.append((s["len"], link["len"] + 1, s["n"], link["len"]))
    return sorted(out)


def test_states_are_those_of_the_online_construction():
    rng = random.Random(1)
    for _ in range(200):
        strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 5))]
        codes = np.array([c for s in strings for c in (*s, 0)], np.int64)
        own = C.SuffixAutomaton(codes, 12)
        links = np.where(own.link >= 0, own.longest[own.link], 0)
        assert sorted(zip(own.longest.tolist(), own.shortest.tolist(), own.count.tolist(), links.tolist(), strict=True)) == online(strings)
        for depth in (1, 3, 5):
            want = Counter(tuple(s[i : i + d]) for s in strings for d in range(1, depth + 1) for i in range(len(s) - d + 1))
            size, end, count = C.SuffixAutomaton(codes, depth).substrings(1, depth)
            got = {tuple(codes[e - d + 1 : e + 1].tolist()): n for d, e, n in zip(size.tolist(), end.tolist(), count.tolist(), strict=True)}
            assert got == want
    assert not len(C.SuffixAutomaton(np.zeros(0, np.int64)).count)


def brute(rows, least, depth=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + d])) for d in range(1, depth + 1) for i in range(len(w) - d + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[(lang, p[i:j])]}
    lists = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p)))
            lists.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, own in lists.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, rows):
    rng = random.Random(seed)
    names = [f"{rng.choice(['Ä', 'b', 'C', 'é', ''])}w{k}" for k in range(30)]
    fixed = ["New York City", "as soon as possible", "one Two three four five six", "the The the the the the"]
    out = [(1, None, "en"), (2, "", None), (3, " \t,.;\n\r\x0b", "en"), (4, "single", "xx"), (None, "a b", None)]
    for k in range(rows):
        words = [rng.choice(fixed) if rng.random() < 0.15 else names[int(30 * rng.random() ** 3)] for _ in range(rng.randint(1, 60))]
        out.append((k, "".join(w + rng.choice([" ", " ", "  ", "\t", " ", " ", ", ", ".", "!\n", " "]) for w in words), rng.choice(["en", "en", "en", "de", None, "und"])))
    return [(*r, "k", 1.0, 5) for r in out]


@pytest.mark.parametrize(("shard_words", "hot"), [(1 << 20, 100_000), (50, 20), (3, 1)])
def test_collocations(spark, monkeypatch, shard_words, hot):
    monkeypatch.setattr(C, "HOT_ROWS", hot)
    rows = corpus(3, 60 if shard_words == 3 else 250) + [(9, "a long piece of words without end " * 40, "en", "k", 1.0, 5)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(3, "text")
    found = C.best(C.collocations(docs, least=8, shard_words=shard_words), 2000)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())
    want = brute(rows, 8)
    assert len(want) > 20 and got == want


def test_top_and_odd_tables(spark):
    rows = [(k, "x y. z w. p q q", "en", "k", 1.0, 5) for k in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in C.report(docs).collect()) == brute(rows, 100)
    assert C.best(C.collocations(docs), 1).count() == 1
    assert C.report(docs.limit(0)).count() == 0
    assert C.report(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_products_over_64_bits(spark):
    """Scores stay exact where 1000 * a * n does not fit a long."""
    row = spark.range(1).select(F.lit(10**13).cast("decimal(19,0)").alias("a"), F.lit(3 * 10**13).cast("decimal(19,0)").alias("n"), F.lit(10**13 + 1).cast("decimal(19,0)").alias("l"))
    score = row.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * F.col("a") * F.col("n"), "bottom": F.col("l") * F.col("l")}).select(F.expr("top div bottom")).head()[0]
    assert score == 1000 * 10**13 * 3 * 10**13 // (10**13 + 1) ** 2
