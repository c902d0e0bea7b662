"""MinHash near-duplicate classes by an LSH forest.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set is its distinct
5-word shingles (the whole sequence if it has fewer words). Documents are linked
when 100 * intersection >= 75 * union, confirmed on the full sets.

1. One pass over the texts hashes the sets. Documents with equal sets form one
   class at once; each class goes on once, whatever its size.
2. A class has VALUES minimum hashes of 16 bits. Tree t of the forest orders all classes by
   their signature from value 2t on, one range-partitioned sort for all trees, so a
   crowded prefix is dealt over as many tasks as it needs. One scan of the sorted
   rows takes the longest common prefix of neighbours: a region is a run whose
   neighbours share at least 2 values. A run of more than REGION classes is crowded and
   is cut where neighbours share fewer than the next of DEPTHS values, again and
   again, so each region has its own depth; neighbours that a cut separates are still compared.
3. Of the likely pairs of a region, by equal values, a spanning forest is
   confirmed on the full sets: a class's set goes once to the class with the smaller number.
4. Regions whose members still lie in different components get the members' sets, and
   all their likely pairs between components are confirmed.
5. Between classes of runs that were cut (or lie at the border of a partition) and are
   still in different components a prefix-filter join on the full sets finds every link: no signature decides here.
   Shingles of one component come first in its order, then the others by the number
   of classes that have them, and a link has a common shingle among the first
   n // 4 + 1 of both sets. Postings are kept in blocks that meet
   block by block, so no task holds a common shingle's whole list.

So no pair inside one component is confirmed twice over, and a group of n copies
costs some multiple of n, not n * n. A pair at exactly 0.75 shares depth 2 in
none of the 24 trees with probability 3e-9; pairs below 19 of 48 equal values
(4e-8 at 0.75) are not confirmed. A pair that meets only in regions that had to be
cut can be separated at a deeper level of every tree; step 5 finds it.

Defined cases: null and empty texts have an empty set and are linked with nothing;
an id that has several texts is reported once with the largest set size and the smallest
component of any (each of its texts is linked as its own); rows with a null id link
others, keep component null and are kept by `near_duplicates`, while `deduplicated`
drops those that repeat another row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .cluster import bit_table, bounded_batches, components, durable, fresh_name, release

SHINGLE = 5
VALUES, TREES, REGION = 48, 24, 64
DEPTHS = (2, 4, 8, 16, 32, 48)
LIKELY = 19
BROADCAST_IDS = 1_000_000
POSTING_BYTES, BUCKET_BYTES, POSTING_BLOCK, HUB, MAX_BITS = 4 << 20, 1 << 20, 256, 256, 26
_MULTIPLIERS = tx.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
PAIR, MEMBER, CUT = 0, 1, 2


def shingle_sets(body: np.ndarray, at: np.ndarray):
    """The sorted distinct shingle hashes of each row."""
    starts, ends, words = tx.spans(body, at, tx.SPACED)
    h = tx.hashes(body, starts, ends)
    grams = tx.ngrams(h, SHINGLE)
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield s
        elif b > a:
            yield tx.ngrams(h[a:b], b - a)
        else:
            yield grams[:0]


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the set, hashed to 16 bits."""
    low = (s[None, :4096] * _MULTIPLIERS[:, None]).min(axis=1)
    for i in range(4096, len(s), 4096):
        np.minimum(low, (s[None, i : i + 4096] * _MULTIPLIERS[:, None]).min(axis=1), out=low)
    return (tx.mix(low) >> np.uint64(48)).astype(">u2")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 75 * (len(both) - shared)


def _sizes_fit(n, m):
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


class _Roots(dict):
    """Union-find whose root is the smallest member."""

    def find(self, x):
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _classes(batches):
    """One row for each distinct set of a batch, with the ids that have it."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        body_all, at_all = tx.buffers(batch.column(1))
        found: dict = {}
        for i, j in tx.slices(at_all):
            for k, s in enumerate(shingle_sets(*tx.cut(body_all, at_all, i, j)), i):
                key = set_key(s)
                if key is None:
                    found[ids[k], k] = (None, 0, None, [ids[k]])
                elif key in found:
                    found[key][3].append(ids[k])
                else:
                    found[key] = (key, len(s), signature(s).tobytes(), [ids[k]])
        rows = list(found.values())
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(batch.schema.field(0).type)]
        cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["set_key", "n", "sig", "ids"])


# -- the forest


def _orders(batches):
    """Each class in every tree: the tree's number, then its signature from the tree's first value on."""
    for batch in batches:
        m = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(m, VALUES)
        ends = pa.py_buffer(np.arange(m + 1, dtype=np.int32) * (1 + 2 * VALUES))
        for t in range(TREES):
            key = np.full((m, 1 + 2 * VALUES), t, np.uint8)
            key[:, 1:] = np.ascontiguousarray(np.roll(sig, -2 * t, axis=1)).view(np.uint8)
            key = pa.Array.from_buffers(pa.binary(), m, [None, ends, pa.py_buffer(key)])
            yield pa.RecordBatch.from_arrays([key, batch.column(0), batch.column(1)], names=["key", "node", "n"])


def _runs(keys: np.ndarray, depth: int) -> np.ndarray:
    """Bounds of the runs whose neighbours have a common prefix of at least `depth` values."""
    same = (keys[1:, : 1 + 2 * depth] == keys[:-1, : 1 + 2 * depth]).all(axis=1)
    return np.concatenate([[0], np.flatnonzero(~same) + 1, [len(keys)]])


def _regions(keys: np.ndarray):
    """Row ranges of the regions, row numbers whose neighbour above was cut off, and which rows lie in crowded runs."""
    bounds = _runs(keys, DEPTHS[0])
    crowded = np.zeros(len(keys), bool)
    wide = np.diff(bounds)
    regions = [np.column_stack([bounds[:-1], bounds[1:]])[(wide > 1) & (wide <= REGION)]]
    cuts: list = []
    todo = [(int(bounds[k]), int(bounds[k + 1]), 0) for k in np.flatnonzero(wide > REGION)]
    while todo:
        i, j, level = todo.pop()
        crowded[i:j] = True
        deepest = level + 1 == len(DEPTHS)
        own = np.append(np.arange(i, j, REGION), j) if deepest else i + _runs(keys[i:j], DEPTHS[level + 1])
        cuts += own[1:-1].tolist()
        wide = np.diff(own)
        regions.append(np.column_stack([own[:-1], own[1:]])[(wide > 1) & (wide <= REGION)])
        todo += [(int(own[k]), int(own[k + 1]), level + 1) for k in np.flatnonzero(wide > REGION)]
    return np.concatenate(regions), np.array(cuts, np.int64), crowded


def _likely(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Equal values of each pair of a region, in its upper triangle; 0 where a link is impossible or very unlikely."""
    same = (sig[:, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int16)
    same[(same < LIKELY) | ~_sizes_fit(n[:, None], n[None, :])] = 0
    return np.triu(same, 1)


def _region(sig: np.ndarray, n: np.ndarray, node: np.ndarray):
    """Pairs of a spanning forest of the likely pairs, likeliest first, and the members if there are other likely pairs."""
    order = np.argsort(node)
    sig, n, node = sig[order], n[order], node[order]
    same = _likely(sig, n)
    x, y = np.nonzero(same)
    by = np.argsort(-same[x, y], kind="stable")
    roots = _Roots(zip(range(len(node)), range(len(node)), strict=True))
    kept = [(i, j) for i, j in zip(x[by].tolist(), y[by].tolist(), strict=True) if roots.join(i, j)]
    return [(int(node[i]), int(node[j])) for i, j in kept], node[np.unique(np.concatenate([x, y]))] if len(x) > len(kept) else node[:0]


def _found(kind: int, x, y):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(np.asarray(x, np.int64)), pa.array(np.asarray(y, np.int64))], names=["kind", "x", "y"])


def _compared(keys: np.ndarray, node: np.ndarray, n: np.ndarray, first: bool, last: bool):
    """What some whole runs give: likely pairs, members of regions with further likely pairs, and classes that only step 5 compares with all others."""
    regions, cuts, crowded = _regions(keys)
    bounds = _runs(keys, DEPTHS[0])
    if first:
        crowded[: bounds[1]] = True
    if last:
        crowded[bounds[-2] :] = True
    # the tree and the first two values name a run, also where it goes on in the next partition
    run = keys[crowded, : 1 + 2 * DEPTHS[0]].astype(np.int64) @ (256 ** np.arange(2 * DEPTHS[0], -1, -1))
    yield _found(CUT, run, node[crowded])
    sig = np.ascontiguousarray(keys[:, 1:]).view(np.uint16)
    # two neighbours: the bulk
    i = np.concatenate([regions[regions[:, 1] - regions[:, 0] == 2, 0], cuts - 1])
    ok = ((sig[i] == sig[i + 1]).sum(axis=1) >= LIKELY) & _sizes_fit(n[i], n[i + 1])
    a, b = node[i[ok]], node[i[ok] + 1]
    pairs, cells, members = [np.column_stack([np.minimum(a, b), np.maximum(a, b)])], [], []
    for i, j in regions[regions[:, 1] - regions[:, 0] > 2].tolist():
        kept, own = _region(sig[i:j], n[i:j], node[i:j])
        if kept:
            pairs.append(np.array(kept))
        if len(own):
            # regions with the same members, of whatever tree, are one
            cell = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)
            cells.append(np.full(len(own), cell))
            members.append(own)
    pairs = np.unique(np.concatenate(pairs), axis=0)
    yield _found(PAIR, pairs[:, 0], pairs[:, 1])
    if cells:
        yield _found(MEMBER, np.concatenate(cells), np.concatenate(members))


def _neighbours(batches):
    """One scan of sorted rows (key, node, n)."""
    held, first = [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        held.append((keys, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        depth = 1 + 2 * DEPTHS[0]
        if (keys[-1, :depth] == held[0][0][0, :depth]).all():
            continue  # one run so far
        keys, node, n = (np.concatenate(c) for c in zip(*held, strict=True))
        # the last run may go on
        end = int(_runs(keys, DEPTHS[0])[-2])
        yield from _compared(keys[:end], node[:end], n[:end], first, False)
        held, first = [(keys[end:], node[end:], n[end:])], False
    if held:
        yield from _compared(*(np.concatenate(c) for c in zip(*held, strict=True)), first, True)


# -- confirmation on full sets


def _sets(batches):
    """Set key and set of each text that has one."""
    for batch in batches:
        body_all, at_all = tx.buffers(batch.column(0))
        for i, j in tx.slices(at_all):
            sets = {set_key(s): s.tobytes() for s in shingle_sets(*tx.cut(body_all, at_all, i, j)) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary())], names=["set_key", "shingles"])


def _wanted_sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, shingles) of the listed classes, once or more, from the texts of one id of each; and the list of classes, to be released. It is broadcast only if it has at most BROADCAST_IDS rows."""
    wanted = durable(classes.join(nodes, "node", "left_semi").select("node", "set_key", "id"))
    listed = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = texts.join(listed.select(F.col("id").alias("of")), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    sets = rows.select("text").mapInArrow(_sets, "set_key binary, shingles binary")
    return sets.join(listed.select("set_key", "node"), "set_key").select("node", "shingles"), wanted


def _star_links(batches):
    """Links of each hub with its partners; rows (hub, partner: whether it is one, node, shingles) come sorted."""
    hub = own = None
    for batch in batches:
        a, b = [], []
        for h, partner, node, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            s = np.frombuffer(s.as_buffer(), np.uint64)
            if not partner:
                hub, own = h, s.copy()
            elif h == hub and linked(own, s):
                a.append(h)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cell_links(batches):
    """Links between components of each cell, until none is left; rows (cell, node, g, shingles) come sorted by cell."""

    def closed(rows):
        node, g, sets = zip(*rows, strict=True)
        same = _likely(np.array([signature(s) for s in sets]), np.array([len(s) for s in sets]))
        x, y = np.nonzero(same)
        by = np.argsort(-same[x, y], kind="stable")
        roots = _Roots(zip(g, g, strict=True))
        for i, j in zip(x[by].tolist(), y[by].tolist(), strict=True):
            if roots.find(g[i]) != roots.find(g[j]) and linked(sets[i], sets[j]):
                roots.join(g[i], g[j])
                yield min(node[i], node[j]), max(node[i], node[j])

    cell, rows = None, {}
    for batch in batches:
        found: list = []
        for c, node, g, s in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            if c != cell:
                found += closed(rows.values()) if rows else []
                cell, rows = c, {}
            rows[node] = (node, g, np.frombuffer(s.as_py(), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
    found = list(closed(rows.values())) if rows else []
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _confirmed(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked; the set of a goes once to the task of a, that of b once for each pair."""
    ends = F.array(F.struct(F.col("a").alias("hub"), F.lit(False).alias("partner"), F.col("a").alias("node")), F.struct(F.col("a").alias("hub"), F.lit(True).alias("partner"), F.col("b").alias("node")))
    ends = durable(pairs.select(F.explode(ends).alias("e")).select("e.*").distinct())
    sets, wanted = _wanted_sets(texts, classes, ends.select("node"))
    # a hub of many partners is dealt in parts
    many = ends.groupBy("hub").agg(F.ceil(F.count("*") / HUB).alias("parts")).where("parts > 1")
    part = F.when(F.col("partner"), F.array(F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = ends.join(many, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(part))
    rows = dealt.join(sets, "node").select("hub", "partner", "node", "shingles", "part")
    links = durable(rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "partner").mapInArrow(_star_links, "a bigint, b bigint"))
    release(ends, wanted)
    return links


def _chunks(batches):
    """Portions of some sets (node, g, shingles) of about POSTING_BYTES: all their shingles, and each one's node, component and set size."""
    for batch in batches:
        sets, i = batch.column(2).to_pylist(), 0
        node, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        while i < len(sets):
            j, size = i, 0
            while j < len(sets) and (j == i or size + len(sets[j]) <= POSTING_BYTES):
                size += len(sets[j])
                j += 1
            n = np.array([len(s) // 8 for s in sets[i:j]])
            own = np.repeat(np.arange(i, j), n)
            yield np.frombuffer(b"".join(sets[i:j]), np.int64), node[own], g[own], np.repeat(n, n)
            i = j


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _counted(buckets: int):
    """Each portion's distinct shingles with their count and least and largest component, packed by bucket."""

    def run(batches):
        for shingles, _, g, _ in _chunks(batches):
            order = np.argsort(shingles, kind="stable")
            x, g = shingles[order], g[order]
            at = _heads(x)
            table = np.column_stack([x[at], np.diff(np.append(at, len(x))), np.minimum.reduceat(g, at), np.maximum.reduceat(g, at)])
            bucket = table[:, 0] % buckets
            order = np.argsort(bucket, kind="stable")
            table, bucket = table[order], bucket[order]
            at = _heads(bucket)
            blobs = [t.tobytes() for t in np.split(table, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(blobs, pa.binary())], names=["bucket", "found"])

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Shingles of one bucket that several components have."""
    table = np.frombuffer(b"".join(rows.found), np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    at = _heads(table[:, 0])
    several = np.minimum.reduceat(table[:, 2], at) != np.maximum.reduceat(table[:, 3], at)
    return pd.DataFrame({"shingle": table[at[several], 0], "f": np.add.reduceat(table[:, 1], at)[several]})


def _postings(table, bits: int):
    """One row for each distinct shingle of a portion that has its bit in the table, with the sets that have it; sets of which such shingles are less than three quarters are left out."""

    def run(batches):
        for shingles, node, g, n in _chunks(batches):
            bit = shingles & ((1 << bits) - 1)
            ok = (table.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 > 0
            _, own = np.unique(node, return_inverse=True)
            ok &= 4 * np.bincount(own, ok)[own] >= 3 * n
            order = np.flatnonzero(ok)[np.argsort(shingles[ok], kind="stable")]
            x = shingles[order]
            at = _heads(x)
            members = pa.StructArray.from_arrays([pa.array(c[order]) for c in (node, g, n)], names=["node", "g", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(x)).astype(np.int32)), members)], names=["shingle", "members"])

    return run


def _prefix_pairs(batches):
    """Pairs of two blocks of one shingle's postings that lie in different components and can still share enough."""
    for batch in batches:
        found = set()
        for row in batch.to_pylist():
            x, y = row["x"], row["y"]
            n, m, left, right, g, h = (np.array([p[c] for p in s]) for c in ("n", "left", "g") for s in (x, y))
            shared = np.minimum(left[:, None], right[None, :])
            ok = (175 * shared >= 75 * (n[:, None] + m[None, :])) & (g[:, None] != h[None, :])
            for i, j in np.argwhere(ok).tolist():
                found.add((min(x[i]["node"], y[j]["node"]), max(x[i]["node"], y[j]["node"])))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _links_apart(texts: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame | None:
    """All links between members (node, g) of different components g, found on the full sets."""
    sets, wanted = _wanted_sets(texts, classes, members.select("node"))
    sets = durable(sets.join(members, "node").select("node", "g", "shingles").dropDuplicates(["node"]))
    release(wanted)
    size = sets.agg(F.sum(F.octet_length("shingles"))).head()[0] or 0
    shared = sets.mapInArrow(_counted(-(-size // BUCKET_BYTES) or 1), "bucket bigint, found binary").groupBy("bucket").applyInPandas(_shared, "shingle bigint, f bigint")
    shared = durable(shared)
    table, bits = bit_table(shared, "shingle", MAX_BITS)
    rows = sets.mapInArrow(_postings(sets.sparkSession.sparkContext.broadcast(table), bits), "shingle bigint, members array<struct<node:bigint,g:bigint,n:bigint>>")
    own = rows.join(shared, "shingle").select("f", "shingle", F.explode("members").alias("m")).select("f", "shingle", "m.*")
    own = own.groupBy("node").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    # a link shares three quarters of either set, all of it shingles of several components
    own = own.where("4 * size(s) >= 3 * n")
    prefix = own.select("node", "g", "n", F.size("s").alias("size"), F.posexplode(F.expr("slice(s, 1, int(n div 4 + 1 - n + size(s)))")).alias("at", "s"))
    posts = prefix.select("node", "g", "n", (F.col("size") - F.col("at")).alias("left"), "s.shingle", F.pmod(F.xxhash64("node"), F.ceil(F.col("s.f") / POSTING_BLOCK)).alias("salt"))
    blocks = durable(posts.groupBy("shingle", "salt").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.collect_list(F.struct("node", "g", "n", "left")).alias("m")))
    release(sets, shared)
    if not blocks.take(1):
        release(blocks)
        return None
    x, y = (blocks.select("shingle", *[F.col(c).alias(f"{c}_{e}") for c in ("salt", "low", "high")]) for e in "xy")
    meet = x.join(y, "shingle").where("salt_x <= salt_y and (low_x <> high_y or high_x <> low_y)").select("shingle", "salt_x", "salt_y")
    for e in "xy":
        meet = meet.join(blocks.select("shingle", F.col("salt").alias(f"salt_{e}"), F.col("m").alias(e)), ["shingle", f"salt_{e}"])
    pairs = durable(meet.select("x", "y").mapInArrow(_prefix_pairs, "a bigint, b bigint").distinct())
    links = _confirmed(texts, classes, pairs)
    release(blocks, pairs)
    return links


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(set_key, n, ids) of the texts, and for each set (set_key, component: a number, component_id: the smallest id of the component, null if it has none)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = durable(texts.mapInArrow(_classes, f"set_key binary, n bigint, sig binary, ids array<{kind}>"))
    classes = found.where("set_key is not null").groupBy("set_key").agg(F.min(F.array_min("ids")).alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))
    forest = classes.select("node", "n", "sig").mapInArrow(_orders, "key binary, node bigint, n bigint")
    near = durable(forest.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_neighbours, "kind int, x bigint, y bigint"))
    links = _confirmed(texts, classes, near.where(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")))
    labels = components(links)
    group = lambda rows: rows.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    # regions, of at most REGION members, that lie in different components
    cells = group(near.where(F.col("kind") == MEMBER).select(F.col("x").alias("cell"), F.col("y").alias("node")))
    cells = cells.groupBy("cell").agg(F.collect_set(F.struct("node", "g")).alias("m")).where(F.size(F.array_distinct("m.g")) > 1)
    open_ = durable(cells.select("cell", F.explode("m").alias("m")).select("cell", "m.*"))
    more = []
    if open_.take(1):
        sets, wanted = _wanted_sets(texts, classes, open_.select("node"))
        rows = open_.join(sets, "node").select("cell", "node", "g", "shingles")
        more.append(durable(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a bigint, b bigint")))
        release(wanted)
    # crowded runs that lie in different components
    cut = durable(group(near.where(F.col("kind") == CUT).select(F.col("x").alias("run"), F.col("y").alias("node"))))
    runs = cut.groupBy("run").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high")
    cut = durable(cut.join(runs, "run", "left_semi").select("node", "g").distinct())
    apart = _links_apart(texts, classes, cut)
    more += [apart] if apart is not None else []
    if any(part.take(1) for part in more):
        old, every = labels, labels.select(F.col("component").alias("a"), F.col("id").alias("b"))
        for part in more:
            every = every.union(part)
        labels = components(every)
        release(old)
    release(near, links, open_, cut, *more)
    named = classes.select("set_key", "node", "id").join(labels.withColumnRenamed("id", "node"), "node", "left")
    alone = named.where("component is null").select("set_key", F.col("node").alias("component"), F.col("id").alias("component_id"))
    some = named.where("component is not null")
    least = some.groupBy("component").agg(F.min("id").alias("component_id"))
    label = durable(alone.union(some.join(least, "component").select("set_key", "component", "component_id")))
    release(classes, labels)
    return found.select("set_key", "n", "ids"), label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    found, label = duplicate_classes(docs, id_col, text_col)
    full = found.where("set_key is not null").join(label, "set_key").select("n", "component_id", F.explode("ids").alias("id"))
    empty = found.where("set_key is null").select("n", F.explode("ids").alias("id")).select("n", F.col("id").alias("component_id"), "id")
    rows = full.union(empty)
    done = rows.where("id is not null").groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    nulls = rows.where("id is null").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    return done.withColumn("kept", F.col("id") == F.col("component_id")).union(nulls)


def _with_key(at: int, name: str):
    """The rows with the key of their shingle set in a further column."""

    def run(batches):
        for batch in batches:
            body_all, at_all = tx.buffers(batch.column(at))
            keys: list = []
            for i, j in tx.slices(at_all):
                keys += map(set_key, shingle_sets(*tx.cut(body_all, at_all, i, j)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], schema=batch.schema.append(pa.field(name, pa.binary())))

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: of the smallest id, or any one if all ids are null.

    Rows without words stay, but of those that share an id one. Rows with a null or
    repeated id are told apart by their sets, for which only their texts are read again.
    """
    found, label = duplicate_classes(docs, id_col, text_col)
    name = fresh_name(docs, "_id")
    ids = durable(
        found.join(label, "set_key", "left").select("component_id", F.explode("ids").alias(name)).where(F.col(name).isNotNull())
        .groupBy(name).agg(F.count("*").alias("n"), F.min("component_id").alias("c"))
        .select(name, (F.col("n") > 1).alias("again"), "c").where(f"again or c <> {name}")
    )
    few = ids.count() <= BROADCAST_IDS
    listed = lambda rows: F.broadcast(rows.select(name)) if few else rows.select(name)
    once = docs.where(F.col(id_col).isNotNull()).join(listed(ids), F.col(id_col) == F.col(name), "left_anti")
    again = docs.where(F.col(id_col).isNull()).union(docs.join(listed(ids.where("again")), F.col(id_col) == F.col(name), "left_semi"))
    # behind a struct clashing names do no harm
    key = fresh_name(docs, "_key")
    keyed = again.mapInArrow(_with_key(docs.columns.index(text_col), key), T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    keyed = keyed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(key).alias("key"))
    own = F.col(f"d.`{id_col}`")
    rows = keyed.join(label.withColumnRenamed("set_key", "key"), "key", "left").where(F.col("component_id").isNull() | own.eqNullSafe(F.col("component_id")))
    free = rows.where(F.col("component").isNull() & own.isNull())
    held = rows.where(F.col("component").isNotNull() | own.isNotNull()).withColumn("own", F.when(F.col("component").isNull(), own)).dropDuplicates(["component", "own"])
    return once.union(free.select("d.*")).union(held.select("d.*"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
