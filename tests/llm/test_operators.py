"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolumn.llm import chat, cluster, decontaminate, language_model, line_dedup, mixing, near_dedup, quality, sharding, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, spans string"
EDGE = [None, "", " ", "\n\n", "one", "One two\tthree", "a b c d e f g h i j k l m", "é ß ñ " * 30, "x" * 5000]


def documents(spark, texts, first=0, sources=("a", "b", None)):
    """Documents with extra columns whose names clash with those that operators use inside."""
    rows = [(first + k, t, "en", sources[k % len(sources)], len(t or ""), -k, "row", "spans") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(seed, n, words=200, vocabulary=60):
    rng = random.Random(seed)
    names = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(1, words))) for _ in range(n)]


# -- decontamination


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(1)
    items = [(k, t) for k, t in enumerate(sentences(2, 25, 40, 20))] + [(100, "Short one here"), (101, None), (102, ""), (103, sentences(2, 1, 40, 20)[0])]
    texts = list(EDGE)
    for k, t in enumerate(sentences(3, 40, 120, 20)):
        own = items[rng.randrange(25)][1].split()
        at = rng.randrange(max(len(own) - 12, 1))
        texts.append(f"{t} {' '.join(own[at : at + rng.randint(8, 14)]).upper()}, {t}" if k % 2 else t + " short ONE here.")
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()}
    assert got == brute_contamination(list(enumerate(texts)), items)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_contamination_with_many_hits_in_one_document(spark):
    rng = random.Random(5)
    text = " ".join("the" if rng.random() < 0.5 else f"w{k}" for k in range(200_000))
    docs = documents(spark, [text, "the " * 30 + "end", "", None])
    bench = spark.createDataFrame([(1, "The"), (2, "the the")], "item_id long, text string")
    began = time.time()
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()}
    took = time.time() - began
    assert got == brute_contamination([(0, text), (1, "the " * 30 + "end"), (2, ""), (3, None)], [(1, "The"), (2, "the the")])
    assert got[0][1] == text.split().count("the") and took < 60


# -- near duplicates


def brute_components(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(999))
    return " ".join(w)


@pytest.mark.parametrize("region", [near_dedup.REGION, 4])
def test_near_duplicates(spark, monkeypatch, region):
    """Also with a small region size, so that crowded regions are cut."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    rng = random.Random(5)
    texts = list(EDGE) + ["one", "ONE"]
    for t in sentences(6, 25, 150, 400):
        texts += [t] + [edited(rng, t, rng.randint(0, 6)) for _ in range(rng.randint(0, 4))]
    hot = " ".join(str(rng.randrange(10**6)) for _ in range(150))
    texts += [edited(rng, hot, rng.randint(0, 3)) for _ in range(40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.report(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_a_crowded_template(spark, monkeypatch):
    """Links between texts that share most of a template: their regions are cut so deep that signatures separate them."""
    monkeypatch.setattr(near_dedup, "REGION", 2)
    monkeypatch.setattr(near_dedup, "POSTING_BLOCK", 3)
    rng = random.Random(14)
    draw = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    template, texts = draw(140), []
    for k in range(150):
        own = template + draw(30)
        texts.append(" ".join(own))
        if k % 3 == 0:
            # a little above 0.75; other pairs are near 0.7
            texts.append(" ".join(own[:-22] + draw(22)))
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.report(documents(spark, texts)).collect()}
    want = brute_components(texts)
    assert 20 < sum(not r[2] for r in want.values()) < 100
    assert got == want


def test_near_duplicates_odd_tables(spark):
    docs = documents(spark, ["same text of five words", "same text of five words"])
    assert near_dedup.report(docs.limit(0)).count() == 0
    twice = near_dedup.report(docs.union(docs)).collect()
    assert sorted(tuple(r) for r in twice) == [(0, 1, 0, True), (1, 1, 0, False)]
    lost = near_dedup.report(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(lost) == 2 and all(r["component_id"] is None and r["kept"] for r in lost)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(159, 7)]
    got = {r["id"]: r["component"] for r in cluster.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == dict.fromkeys([*range(41), *range(100, 160)], 0)


# -- exact top k


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0) for k in range(350)]
    rows += [(k, rows[0][1], 0) for k in range(350, 420)] + [(500, None, 0), (501, [1.0, None] * 4, 0), (600, [float("nan")] * 8, 0), (700, [1.0, 2.0], 0)]
    q = {k: np.floor(1024 * np.array(v)).astype(int) for k, v, _ in rows if k < 500}
    got = defaultdict(list)
    for r in topk.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for k in q:
        if k % 100 == 0:
            best = sorted((-int(q[k] @ v), j) for j, v in q.items() if j != k)[:10]
            want[k] = [(i, j, -s) for i, (s, j) in enumerate(best, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_top_k_of_a_range_of_256(spark):
    """The best row holds the maximum of a component whose range is 256."""
    rows = [(256, 0)] + [(255, 90)] * 10 + [(255, 50)] * 100 + [(0, 0)] * 50
    table = [(-1, [100.0, 1.0])] + [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    table = spark.createDataFrame(table, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_k(table, lambda i: i == -1, k=10, scale=1.0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 25600), *[(k, 25590) for k in range(1, 10)]]


def test_top_k_of_huge_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD_QUERIES", 1)
    rows = [(0, [1.0, 2.0]), (0, [5.0, -1.0]), (1, [3.0, 4.0]), (3, [3e9, 0.0]), (4, []), (None, [1.0, 1.0]), (5, [1e8, 1e8])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(table, lambda i: i == 0, k=3, scale=1.0).collect())
    assert got == [(0, 1, 3, 15000000000), (0, 2, 3, 3000000000), (0, 3, 5, 400000000)]
    assert topk.report(table.limit(0)).count() == 0
    with pytest.raises(TypeError, match="integers"):
        topk.report(table.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_top_k_keeps_every_finite_vector(spark):
    rng = np.random.default_rng(8)
    large = lambda: float(rng.choice([3e6, -2.5e9, 4e12, 1 / 1024, 7.0, 0.0, -0.3]))
    rows = [(k, [large(), 0.0 if k % 3 else float(rng.integers(-3, 4))]) for k in range(330)] + [(700, [1.0, 0.0]), (800, [0.0, 1.0]), (801, [1e307, 5.0]), (900, [-1.0, 0.0])]
    whole = {k: [math.floor(Fraction(x) * 1024) for x in v] for k, v in rows}
    # the largest products of large vectors do not fit a long, so these are not queried
    kept = [r for r in rows if r[0] % 100 or r[0] in (700, 800)]
    got = defaultdict(list)
    for r in topk.report(spark.createDataFrame([r for r in kept if r[0] != 801], "vec_id long, embedding array<double>").repartition(3)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in (700, 800):
        want = sorted((-sum(a * b for a, b in zip(whole[q], whole[k], strict=True)), k) for k, _ in kept if k not in (q, 801))[:10]
        assert sorted(got[q]) == [(i, k, -s) for i, (s, k) in enumerate(want, 1)]
    single = spark.createDataFrame([(800, [0.0, 1.0]), (801, [1e307, 5.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.report(single).collect()] == [(800, 1, 801, 5 << 20)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.report(spark.createDataFrame([(700, [1.0, 0.0]), (801, [1e307, 5.0])], "vec_id long, embedding array<double>")).collect()


def test_top_k_reads_few_exact_vectors():
    rng = np.random.default_rng(4)
    v = rng.integers(-1000, 1000, (4000, 16))
    low = v.min(axis=0)
    step = np.maximum((v.max(axis=0) - low + 255) // 256, 1)
    found, read = topk.scan_block(v[:1], np.array([0]), v, np.arange(4000), ((v - low) // step).astype(np.uint8), low, step, 10)
    score = v @ v[0]
    score[0] = -(10**12)
    assert found[0][0].tolist() == np.lexsort((np.arange(4000), -score))[:10].tolist()
    assert read < 400


# -- chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(8)
    parts = ["\\", "#", "<", "</turn>\n", "### assistant ###\n", "é", "日本", "\n", "a", " ", "\\b", "\\h"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "odd ###\nrole"]), text, "x"))
    rows += rows[:3]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn, role or "", text or ""))
    done = {r["conv_id"]: r for r in chat.format_chats(table).collect()}
    report = {r["conv_id"]: r for r in chat.report(table).collect()}
    assert set(report) == {*want, -7}
    for conv, turns in want.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        assert chat.parse(done[conv]["formatted"]) == turns
        loss = [chat.unescape(done[conv]["formatted"][s["start"] : s["end"]]) for s in done[conv]["loss_spans"]]
        assert loss == [t for r, t in turns if r == "assistant"]
        assert report[conv]["loss_chars"] == sum(map(len, loss))
        assert report[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert report[-7]["loss_chars"] == len("\\### Assistant: </turn> ok")
    assert chat.format_chats(table.limit(0)).count() == 0


# -- line dedup


def brute_passages(rows, least):
    """Kept text, units and byte ranges removed, for rows in rank order."""
    seen, out = set(), []
    for t in rows:
        kept, gone, spans, run, at = [], 0, [], [], 0
        pieces = re.findall(r"[^\n]*?(?:[.,;:!?][ \t]+|\n)|[^\n]+", t or "")
        units = [[*re.findall(r"[^\x20\x09-\x0D]+", p.translate({c: c + 32 for c in range(65, 91)}))] for p in pieces]
        again = []
        for w in units:
            again.append(bool(w) and tuple(w) in seen)
            seen.add(tuple(w))
        state = [None] * len(pieces)
        i = 0
        while i < len(pieces):
            if not again[i]:
                i += 1
                continue
            j = end = i
            while j < len(pieces) and (again[j] or not units[j]):
                end = j if again[j] else end
                j += 1
            if sum(len(w) for w in units[i : end + 1]) >= least:
                state[i : end + 1] = [True] * (end + 1 - i)
            i = end + 1
        for i, p in enumerate(pieces):
            size = len(p.encode())
            if state[i]:
                gone += bool(units[i])
                if spans and spans[-1][1] == at and state[i - 1]:
                    spans[-1] = (spans[-1][0], at + size)
                else:
                    spans.append((at, at + size))
            else:
                kept.append(p)
            at += size
        out.append((None if t is None else "".join(kept), gone, spans))
    return out


@pytest.mark.parametrize("least", [1, 12, line_dedup.PASSAGE])
def test_line_dedup(spark, least):
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 9))) for _ in range(30)]
    joins = ["\n", ". ", ", ", ";  \t", ".\n", " \n\n", ".", "!  \n", " "]
    texts = list(EDGE)
    for _ in range(80):
        own = [(rng.choice(lines).upper() if rng.random() < 0.2 else rng.choice(["", " "]) + rng.choice(lines)) + rng.choice(joins) for _ in range(rng.randint(1, 25))]
        texts.append("".join(own))
    got = {r["id"]: (r["text"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in line_dedup.clean(documents(spark, texts), passage=least).collect()}
    assert got == dict(enumerate(brute_passages(texts, least)))
    assert any(r[1] for r in got.values()) or least > 30
    assert line_dedup.report(documents(spark, texts).limit(0)).count() == 0


def test_line_dedup_finds_passages_inside_lines(spark):
    """A passage of over 50 words is removed from all but the first text, and texts without one stay."""
    passage = ". ".join(sentences(31, 8, 9, 500)) + ". " + " ".join(f"w{k}" for k in range(30)) + ", " + " ".join(f"v{k}" for k in range(15)) + ". "
    own = sentences(32, 20, 60, 500)
    texts = [f"{t} {t[::-1]}. {passage}{t[:9]}" if k % 2 else t for k, t in enumerate(own)]
    got = {r["id"]: r for r in line_dedup.clean(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert (passage[:-1] in got[k]["text"]) == (k == 1) if k % 2 else got[k]["text"] == t


def test_line_dedup_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (5, a), (None, b), (None, "\u00e9 " + b), (None, None), (1, "short"), (1, "short")]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(None if i is None else i if kind == "long" else str(i), t) for i, t in rows], f"doc_id {kind}, text string").coalesce(1)
        got = sorted((str(r["id"]), str(r["text"])) for r in line_dedup.clean(docs).collect())
        assert got == sorted([("5", a), ("5", b), ("5", ""), ("None", ""), ("None", "\u00e9 " + b), ("None", "None"), ("1", "short"), ("1", "short")])


# -- mixing


def test_targets_and_seats():
    goal = mixing.targets({"a": 100, "b": 1000, "c": 10, None: 0})
    assert goal[None] == 0 and goal["c"] == 20 and goal["a"] == 200
    assert sum(goal.values()) == pytest.approx(1.5 * 1110)
    votes = np.array([53, 24, 23.0])
    by_hand = np.zeros(3, int)
    for _ in range(7):
        by_hand[(votes / (2 * by_hand + 1)).argmax()] += 1
    assert mixing.sainte_lague(votes, 7).tolist() == by_hand.tolist() == [3, 2, 2]
    assert mixing.sainte_lague(np.array([5, 5.0]), 9, np.array([2, 3])).tolist() == [2, 3]
    assert mixing.sainte_lague(np.zeros(2), 4).tolist() == [0, 0]


def test_mix(spark):
    texts = list(EDGE) + sentences(10, 400, 300)
    docs = documents(spark, texts)
    rows = mixing.report(docs).collect()
    assert len(rows) == len(texts) and rows == mixing.report(docs).collect() or sorted(rows) == sorted(mixing.report(docs).collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, size, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        taken[source[r["doc_id"]]] += r["taken"]
        size[source[r["doc_id"]]] += r["size"]
        goal[source[r["doc_id"]]] = r["target"]
    assert goal == pytest.approx(mixing.targets(dict(size)))
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(0.01 * goal[s], 64)
    assert mixing.report(docs.limit(0)).count() == 0
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.groupBy("doc_id").count().where("count > 2").count() == 0


def test_mix_of_a_source_without_words(spark):
    docs = documents(spark, ["", None, " \n"] * 20 + ["one two three"] * 3, sources=("a",)).withColumn("source", F.when(F.col("text") == "one two three", "b").otherwise("a"))
    rows = {r["doc_id"]: r for r in mixing.report(docs).collect()}
    assert len(rows) == 63
    assert all((r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0) for k, r in rows.items() if k < 60)
    assert all((r["size"], r["source_size"]) == (3, 9) for k, r in rows.items() if k >= 60)
    assert mixing.mixed(docs).where("source = 'a'").count() == 0
    assert mixing.mix(docs.where("source = 'a'")).count() == 60


# -- sharding


def test_store_versions_and_conflicts(spark):
    docs = documents(spark, EDGE + sentences(11, 300)).repartition(8)
    store = sharding.ShardStore(spark, cluster.fresh_path(spark, "store"), target_bytes=200_000, small_rows=20)
    assert store.append(docs) == 1 and store.append(docs.limit(0)) == 2 and store.append(docs.limit(5)) == 3
    assert [len(store.runs(v)) for v in range(4)] == [0, 1, 1, 2] and store.manifest(0).count() == 0
    before = store.manifest().agg(F.count("*"), F.sum("rows")).head()
    version = store.compact(docs.schema)
    after = store.manifest(version).agg(F.count("*"), F.sum("rows")).head()
    assert after[0] < before[0] and after[1] == before[1] == docs.count() + 5
    want = sorted(map(tuple, docs.union(docs.limit(5)).collect()), key=str)
    assert sorted(map(tuple, store.read(docs.schema).collect()), key=str) == want
    assert store.read(docs.schema, 1).count() == docs.count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.runs(), version)
    assert store.version() == version


def test_compaction_goes_tier_by_tier_and_ends(spark):
    docs = documents(spark, sentences(14, 640)).repartition(1)
    store = sharding.ShardStore(spark, cluster.fresh_path(spark, "store"), target_bytes=40_000, small_rows=40)
    for k in range(6):
        store.append(docs.where(f"pmod(doc_id, 6) = {k}"))
        version = store.compact(docs.schema)
        shards = store.manifest(version).collect()
        assert sum(r["rows"] for r in shards) == docs.where(f"pmod(doc_id, 6) <= {k}").count()
        tiers = defaultdict(int)
        for run in store.runs(version):
            if run.bytes < run.shards * 20_000:
                tiers[run.tier()] += run.shards
        assert all(n < sharding.MIN_RUN for n in tiers.values())
        assert len(shards) == sum(r.shards for r in store.runs(version)) == store.read(docs.schema, version, True).select("shard").distinct().count()
    assert sorted(r[0] for r in store.read(docs.schema).select("doc_id").collect()) == list(range(640))
    assert store.compact(docs.schema) == version


def test_sharded_keeps_rows(spark):
    docs = documents(spark, EDGE + EDGE)
    assert sharding.report(docs).count() == 2 * len(EDGE)
    assert sharding.report(docs.limit(0)).count() == 0


# -- classifiers


def labelled(spark, texts, name, good):
    rows = [(k, int(good(k))) for k in range(len(texts))] + [(k, None) for k in range(3)] + [(None, 1)]
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_quality(spark):
    clean = sentences(12, 300)
    texts = [t if k % 3 else " ".join(w + "%%%" for w in t.split()) for k, t in enumerate(clean)] + EDGE
    labels = labelled(spark, clean, "quality", lambda k: k % 3)
    rows = {r["doc_id"]: r for r in quality.report(documents(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    held = [r for k, r in rows.items() if r["held_out"] and k < 300]
    assert all(r["held_out"] == (crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    good = quality.good_documents(documents(spark, texts), labels)
    assert {r["doc_id"] for r in good.collect()} == {k for k, r in rows.items() if r["predicted"]}
    assert quality.report(documents(spark, texts), labels.limit(0)).count() == len(texts)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(13)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
    assert model.raw(x[:5]) == pytest.approx([model.raw(x[k : k + 1])[0] for k in range(5)])


def brute_kernel(a, b):
    def features(w):
        out = defaultdict(float)
        codes = [int(toxicity._CODE[c]) for c in w.encode()]
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN)):
                    if codes[i] and codes[j] and codes[k]:
                        out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def test_subsequence_kernel():
    words, marks = ["idiot", "i-d-i-o-t", "idxiot", "a", "banana", "1diot"], ["idiot", "banana"]
    got = toxicity.kernel(words, marks)
    assert got == pytest.approx(np.array([[brute_kernel(w, m) for m in marks] for w in words]), abs=1e-6)
    assert got[0, 0] == pytest.approx(1) and got[2, 0] > 0.5 and got[5, 0] == pytest.approx(1)


def test_segment_values_are_kernel_values(monkeypatch):
    """Scoring gives the landmarks' weighted kernel values exactly, in whatever portions, also from values kept before."""
    rng = random.Random(16)
    texts = [(k % 2, [[w for w in t.split()] for t in sentences(40 + k, 3, 8)] + ([["grobnak", "banana"]] if k % 2 else [])) for k in range(40)]
    sample = toxicity.Sample([y for y, _ in texts], range(40), toxicity.pa.array([s for _, s in texts]))
    model = toxicity.SubsequenceSvm().fit(sample)
    marks = model.landmarks
    beta = np.linalg.lstsq(np.array([[brute_kernel(a, b) for b in marks] for a in marks]), model.segment_values(*toxicity._joined(marks)), rcond=None)[0]
    words = ["grobnak", "g-r-o-b", "banana", "bananana", "zz", "x", *marks[:5]]
    want = np.array([[brute_kernel(w, m) for m in marks] for w in words]) @ beta
    monkeypatch.setattr(toxicity, "SCORED", 3)
    monkeypatch.setattr(toxicity, "KEPT", 4)
    assert model.segment_values(*toxicity._joined(words)) == pytest.approx(want, abs=1e-3)
    for _ in range(3):
        for w, v in zip(words, want, strict=True):
            body = np.frombuffer(f" {w} {rng.choice(words)} {w}".encode(), np.uint8)
            own = [x for x in body.tobytes().decode().split()]
            most = max(want[words.index(x)] for x in own)
            found = model.largest(body, np.array([0, len(body)]))[0, 0]
            assert found >= v - 1e-3 and (found == pytest.approx(most, abs=1e-3) or " x " in f" {' '.join(own)} ")


def test_toxicity(spark):
    rng = random.Random(14)
    bad = ["grobnak", "fluzzer", "quimpot"]
    texts = []
    for k, t in enumerate(sentences(15, 400, 60)):
        w = t.split()
        if k % 4 == 0:
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        texts.append(". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)))
    labels = labelled(spark, texts, "toxic", lambda k: k % 4 == 0)
    extra = EDGE + ["nothing g.r.o.b.n.a.k here", "plain words only", "flu-zzer"]
    rows = {r["doc_id"]: r for r in toxicity.report(documents(spark, texts + extra), labels).collect()}
    held = [r for k, r in rows.items() if r["held_out"] and k < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert rows[400 + len(EDGE)]["score"] > rows[401 + len(EDGE)]["score"]
    assert rows[402 + len(EDGE)]["predicted"] == 1
    assert toxicity.report(documents(spark, extra), labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_of_stems_with_varying_endings(spark):
    """Another language's insults are one stem with endings that never repeat; toxic documents hold three, some clean ones a single one."""
    rng = random.Random(21)
    ending = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 2)))
    texts, toxic = [], []
    for k, t in enumerate(sentences(22, 500, 60)):
        w, bad = t.split(), k % 6 == 0
        for _ in range(3 if bad else int(k % 7 == 1)):
            w.insert(rng.randrange(len(w) + 1), "gruvzt" + ending())
        texts.append(" ".join(w))
        toxic.append(bad)
    labels = labelled(spark, texts, "toxic", lambda k: toxic[k])
    held = [r for r in toxicity.report(documents(spark, texts), labels).collect() if r["held_out"]]
    caught = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    single = [r["predicted"] for r in held if not toxic[r["doc_id"]] and "gruvzt" in texts[r["doc_id"]]]
    none = [r["predicted"] for r in held if "gruvzt" not in texts[r["doc_id"]]]
    assert np.mean(caught) > 0.8 and np.mean(none) == 0 and len(single) > 10 and np.mean(single) < 0.5


def test_toxicity_scores_are_the_best_of_three_values():
    """A document's values against kernels by plain counting; nulls and repeats score alike."""
    rng = random.Random(23)
    rows = [(k % 3 == 0, [t.split() + (["grobnak"] if k % 3 == 0 else [])]) for k, t in enumerate(sentences(24, 90, 12))]
    model = toxicity.SubsequenceSvm().fit(toxicity.Sample([int(y) for y, _ in rows], range(90), toxicity.pa.array([s for _, s in rows])))
    texts = ["grobnak", "plain words here", "grobnak grobnak gronak", "", "a b"]
    body, at = toxicity.tx.buffers(toxicity.pa.array(texts))
    most = model.largest(body, at)
    for text, own in zip(texts, most, strict=True):
        words = sorted(set(text.split()))
        want = sorted(model.segment_values(*toxicity._joined(words)), reverse=True)[:3] if words else []
        assert own.tolist() == pytest.approx([*want, *[toxicity.FLOOR] * (3 - len(want))])
    value = np.max(np.maximum(most + model.bias, -3) - model.offsets, axis=1)
    assert model.score(most) == pytest.approx(0.98 * np.interp(value, model.knots, model.shares) + 0.02 / (1 + np.exp(-value)))
    assert model.score(most)[0] >= 0.7 > model.score(most)[1] >= model.score(most)[3]


# -- language model


def test_attention_gradients():
    rng = np.random.default_rng(16)
    model = language_model.Model(rng.integers(0, 5, (language_model.VOCAB + 1,) * 2).astype(float))
    for n in model.weights:
        model.weights[n] = (rng.standard_normal(model.weights[n].shape) * 0.3).astype(np.float64)
    model.group_log, model.member_log = model.group_log.astype(np.float64), model.member_log.astype(np.float64)
    keys = rng.integers(0, language_model.VOCAB, (3, language_model.CONTEXT + language_model.BLOCK))
    targets = rng.integers(0, language_model.VOCAB, (3, language_model.BLOCK))
    valid = np.arange(language_model.BLOCK)[None, :] < np.array([[16], [9], [1]])
    _, grad = model.gradients(keys, targets, valid)
    for name, at in (("e", (keys[0, 9], 3)), ("q", (1, 2)), ("k", (0, 5)), ("v", (4, 4)), ("lag", (2,)), ("g", (3, 1)), ("u", (int(targets[0, 0]), 2))):
        w, losses = model.weights[name], []
        for step in (1e-4, -1e-4):
            w[at] += step
            losses.append(model.gradients(keys, targets, valid)[0])
            w[at] -= step
        assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=0.05, abs=1e-5)


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(17)
    model = language_model.Model(rng.integers(0, 5, (language_model.VOCAB + 1,) * 2).astype(float))
    keys = rng.integers(0, language_model.VOCAB, (1, 24))
    valid = np.ones((1, 16), bool)
    tables = model.tables()
    totals = np.zeros(16)
    for y in range(language_model.VOCAB + 1):
        totals += np.exp(model.log_probability(keys, np.full((1, 16), y), valid, tables))
    assert totals == pytest.approx(1, abs=1e-3)
    later = keys.copy()
    later[0, 20:] = 7
    y = rng.integers(0, language_model.VOCAB, (1, 16))
    assert model.log_probability(keys, y, valid, tables)[:12] == pytest.approx(model.log_probability(later, y, valid, tables)[:12])


def test_language_model(spark):
    from math import log10

    texts = list(EDGE) + sentences(18, 150, 150, 300)
    rows = {r["doc_id"]: r for r in language_model.report(documents(spark, texts).repartition(3)).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    counts = defaultdict(int)
    for k, t in enumerate(texts):
        if crc32(str(k).encode()) % 5 != 1:
            for w in words(t):
                counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        own = [counts.get(w, 0) for w in words(t)]
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c > 0 for c in own), n)
        assert r["base_score"] == pytest.approx(sum(log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own))
        assert r["score"] < 0
    assert language_model.report(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 20, 70])
def test_scores_do_not_depend_on_which_words_are_sent(spark, monkeypatch, limit):
    texts = sentences(19, 60, 80, 200) + EDGE
    docs = documents(spark, texts)
    full = {r["doc_id"]: tuple(r)[1:] for r in language_model.report(docs).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", limit)
    few = {r["doc_id"]: tuple(r)[1:] for r in language_model.report(docs).collect()}
    assert {k: v[:4] for k, v in few.items()} == {k: v[:4] for k, v in full.items()}
    assert [few[k][4:] for k in full] == [pytest.approx(full[k][4:]) for k in full]


def test_scores_against_token_by_token_attention(spark, monkeypatch):
    """Each token from its own plain softmax attention."""
    lm, rng = language_model, np.random.default_rng(20)
    texts = sentences(21, 12, 25, 40) + ["", None, "One", "unseen Words here é", "a " * 60]
    model = lm.Model(rng.integers(0, 5, (lm.VOCAB + 1,) * 2).astype(float))
    for name in model.weights:
        model.weights[name] = (rng.standard_normal(model.weights[name].shape) * 0.3).astype(np.float32)
    monkeypatch.setattr(lm, "fit", lambda *_: model)
    rows = {r["doc_id"]: r for r in lm.report(documents(spark, texts)).collect()}
    subwords, w = lm.Subwords(lm.vocabulary()), {n: v.astype(float) for n, v in model.weights.items()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    for k, t in enumerate(texts):
        pieces = [subwords.encoding.encode_ordinary(" " + x) for x in words(t)] + [[lm.END]]
        ids = [i for p in pieces for i in p]
        inputs, logs = [lm.END, *ids[:-1]], []
        for place, y in enumerate(ids):
            first = place // lm.BLOCK * lm.BLOCK - lm.CONTEXT
            seen = [inputs[j] if j >= 0 else lm.PAD for j in range(first, place + 1)]
            q = w["e"][inputs[place]] @ w["q"] / lm.WIDTH**0.5
            a = np.exp([q @ (w["e"][x] @ w["k"]) + w["lag"][len(seen) - 1 - j] for j, x in enumerate(seen)])
            c = (a / a.sum()) @ (w["e"][seen] @ w["v"])
            group = model.group_log[inputs[place]] + w["g"] @ c
            member = model.member_log[inputs[place], y // lm.GROUP] + w["u"][y // lm.GROUP * lm.GROUP :][: lm.GROUP] @ c
            logs.append(group[y // lm.GROUP] - np.log(np.exp(group).sum()) + member[y % lm.GROUP] - np.log(np.exp(member).sum()))
        assert rows[k]["score"] == pytest.approx(sum(logs) / np.log(10), rel=1e-4)


def test_every_window_trains(spark):
    """Short texts and text ends change the weights; without texts the model is that of the pair counts."""
    ranks = language_model.vocabulary()
    for texts in (["one"], ["one two three four five six seven eight nine ten " * 3 + "end"]):
        body, at = language_model.tx.buffers(language_model.pa.array(texts))
        tokens = language_model.Tokens(body, at, language_model.Subwords(ranks))
        model = language_model.Model(np.ones((language_model.VOCAB + 1,) * 2))
        before = model.pack()
        assert language_model.Learner(model).learn(tokens, 0) == -(-len(tokens.ids) // language_model.BLOCK)
        assert model.pack() != before


def test_language_model_reads_texts_once(spark):
    """Counting, training and scoring share one reading of the texts, whose subwords are kept."""
    texts, read = sentences(22, 30, 40, 60) + EDGE, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = language_model.report(documents(spark, texts).withColumn("text", seen("text"))).collect()
    assert len(rows) == len(texts) == read.value


def test_kept_subwords_give_the_same_words(monkeypatch):
    lm, texts = language_model, sentences(23, 20, 30, 50) + EDGE
    ranks = lm.vocabulary()
    t = lm.Tokens(*lm.tx.buffers(lm.pa.array(texts, lm.pa.string())), lm.Subwords(ranks))
    monkeypatch.setattr(lm, "SLICE", 400)
    ids, rows, hashes = [], [], []
    for i, j, part in lm.Stream.of(t.column()):
        row, h = part.words(lm.opening(ranks))
        assert part.rows == j - i and (part.inputs[part.starts] == lm.END).all()
        ids.extend(part.ids.tolist())
        rows.extend((row + i).tolist())
        hashes.extend(h.tolist())
    assert ids == t.ids.tolist() and rows == t.row.tolist() and hashes == t.hash[t.word].tolist()
    words = [w for x in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))]
    assert len(set(words)) == len(t.hash) == len(set(zip(words, hashes, strict=True)))
