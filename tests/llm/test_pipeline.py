"""Each pipeline stage on its own input, against the operators' brute-force versions."""

import os
import random
import subprocess
import sys
import time
from pathlib import Path

import corpus_pipeline
import pytest
from recolumn.llm import cluster, decontaminate, mixing
from test_operators import brute_components, brute_contamination, edited, sentences


def folders(spark):
    return {p.name for p in Path(cluster.shared_dir(spark).removeprefix("file:")).resolve().iterdir()}


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    clean = sentences(21, 160, 150, 500)
    items = sentences(22, 10, 40, 30)
    texts = []
    for k, t in enumerate(clean):
        texts.append(t)
        if k % 10 == 3:
            texts.append(edited(rng, t, 1))
        if k % 10 == 5:
            texts.append(t + " " + items[k % 10])
        if k % 10 in (1, 7):
            texts.append(" ".join(w + "###" for w in t.split()))
    bad = {k for k, t in enumerate(texts) if "###" in t}
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k not in bad), 0) for k in range(0, len(texts)) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    columns, docs, kept = ["doc_id", "text", "lang", "source", "n_chars"], spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:5] == columns and (name == "shards" or docs.columns == columns)
        docs = docs.persist()
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "quality_filter":
            assert len(set(before) - set(ids) - bad) <= 3 and not bad & set(ids)
        elif name == "near_duplicates":
            order = sorted(before)
            want = {order[k] for k, (_, _, keep) in brute_components([before[i] for i in order]).items() if keep}
            assert set(ids) == want
        elif name == "decontamination":
            found = brute_contamination(before.items(), list(enumerate(items)))
            assert set(ids) == {k for k, r in found.items() if not r[4]}
        elif name == "source_mix":
            assert all(1 <= ids.count(k) <= 2 for k in ids)
            kept = ids
        else:
            assert ids == kept
    before = folders(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    # of all that the stages wrote, only the store of shards is left, and the result reads nothing else
    assert [name.split("-")[0] for name in folders(spark) - before] == ["shards"]
    assert sorted(r["doc_id"] for r in out.collect()) == kept


def test_null_and_repeated_ids(spark):
    """Of rows that repeat an id or lack one, one of each set stays; the mix counts rows, not ids."""
    a, b, c, d, e = sentences(23, 5, 80, 500)
    rows = [(1, a)] * 3 + [(1, b)] * 2 + [(None, c)] * 2 + [(2, "")] * 2 + [(3, d)] + [(None, d), (None, ""), (None, None), (0, e), (1, e)]
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_duplicates(spark, table(rows), "")
    assert sorted((r["doc_id"] or 0, "null" if r["text"] is None else r["text"]) for r in found.collect()) == sorted([(1, a), (1, b), (0, c), (2, ""), (3, d), (0, ""), (0, "null"), (0, e)])
    # one source is taken one and a half times: each row comes once or twice
    texts = sentences(24, 40, 80, 500)
    rows = [(None if k % 2 else k, t) for k, t in enumerate(texts)] + [(0, texts[0])] * 4 + [(2**60 + k, t) for k, t in enumerate(sentences(25, 5, 80, 500))]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.source_mix(spark, table(rows), "").collect()]
    assert all(rows.count(r) <= got.count(r) <= 2 * rows.count(r) for r in rows) and set(got) == set(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows, clashing names; each stage's result is defined."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, _copies string, shard string, `key` string"
    long_, item, plain = " ".join(sentences(40, 60, 400, 3000)), sentences(41, 1, 30, 300)[0] + " tail of the item with some more words", sentences(42, 8, 90, 900)
    texts = [None, "", " \n", "one", long_, item + " and more", *plain, plain[0]]
    rows = [(None if k % 3 == 0 else k, t, None if k % 2 else "en", None if k % 4 == 0 else "s", None, k, "r", "c", None, "x") for k, t in enumerate(texts)]
    rows += [(None, item, None, None, None, 0, None, None, None, None)] * 2 + [rows[7]] * 3
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(k, 1 - k % 2, None) for k in range(20)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, plain[1]), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    count = lambda frame: sorted(map(repr, (tuple(r)[:10] for r in frame.collect())))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:10] == docs.columns and (name == "shards" or out.columns == docs.columns)
        got = count(out)
        assert count(stage(spark, docs.limit(0), str(tmp_path))) == []
        if name == "near_duplicates":
            assert len(got) == len(set(got)) and sum("'one'" in r for r in got) == 1 and sum(repr(plain[1]) in r for r in got) == 1 and sum(repr(plain[0]) in r for r in got) == 1
        elif name == "decontamination":
            assert got == sorted(r for r in count(docs) if repr(item)[1:-1] not in r)
        elif name == "source_mix":
            have = count(docs)
            assert all(got.count(r) <= 2 * have.count(r) for r in got) and set(got) <= set(have)
        elif name == "shards":
            assert got == count(docs) and out.columns[10:] == ["_shard", "shard_bytes"]


def test_scopes(spark):
    """Tables of a block go at its end, also after an error; those kept stay for the block around it."""
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(sentences(50, 30, 60, 200))], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, sentences(50, 30, 60, 200)[3])], "item_id long, text string")
    before = folders(spark)
    with cluster.scope() as outer:
        with cluster.scope() as inner:
            rows = inner.keep(cluster.durable(mixing.mixed(decontaminate.clean_documents(docs, items))))
            assert len(folders(spark) - before) > 2
        assert folders(spark) - before == {rows._durable_path.rsplit("/", 1)[1]} and 3 not in {r["doc_id"] for r in rows.collect()}
        assert outer.tables == [rows]
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), cluster.scope():
        cluster.durable(docs)
        1 / 0  # noqa: B018
    assert folders(spark) == before
    with cluster.scope() as own:
        rows = own.keep(cluster.durable(docs))
    assert rows.count() == 30
    cluster.release(rows)
    assert folders(spark) == before


def test_tables_go_with_the_application(tmp_path):
    job = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
from recolumn.llm import cluster
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print(cluster.durable(spark.range(5)).count(), len(list(Path(sys.argv[1]).glob("table-*"))))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", job, str(tmp_path)], capture_output=True, text=True, timeout=120, env=os.environ, cwd=Path(__file__).resolve().parents[2])
    assert done.stdout.split() == ["5", "1"], done.stderr
    until = time.time() + 30
    while any(tmp_path.glob("table-*")) and time.time() < until:
        time.sleep(0.5)
    assert not list(tmp_path.glob("table-*"))
