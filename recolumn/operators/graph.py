"""Graph recommenders on the bipartite rating graph: propagation as joins and grouped sums."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.work import held, scratch
from .dense import lists, matrix
from .relational import numbered

#: More edges than these make a user's edges several parts, each of which gets the user's vector.
HOT = 1_000_000
#: Edges of a block, about.
BLOCK = 1 << 18


def bipartite_edges(ratings: DataFrame) -> DataFrame:
    """Both directions of every rating as (src, dst, w); nodes are 'u<id>' and 'i<id>'."""
    user, item = F.concat(F.lit("u"), "user_id"), F.concat(F.lit("i"), "item_id")
    one = ratings.select(user.alias("src"), item.alias("dst"), F.col("rating").cast("double").alias("w"))
    return one.union(one.select("dst", "src", "w"))


def degree_norm(edges: DataFrame) -> DataFrame:
    """src, dst, 1 / sqrt(degree(src) * degree(dst)). The graph is symmetric, so one degree table serves both ends."""
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    rows = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return rows.select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("norm"))


def block_of(home: str, other: str, blocks: int, parts: str = "parts") -> Column:
    """Number of the block that holds a row of `home`; a home with several parts is dealt by the hash of `other`."""
    return F.pmod(F.xxhash64(home, F.when(F.col(parts) > 1, F.pmod(F.xxhash64(other), parts))), F.lit(blocks)).cast("int")


def block_count(spark: SparkSession, rows: int) -> int:
    """Blocks of about BLOCK rows, at least two for each partition of a shuffle."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BLOCK))


def by_block(rows: DataFrame) -> DataFrame:
    """Rows dealt by their block: a cache of them meets other tables by block without being shuffled again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def in_blocks(rows: DataFrame, home: str, other: str, total: int, hot: int) -> DataFrame:
    """`rows` with a column block: all of a home's rows are in one, unless there are more than `hot` of them."""
    parts = rows.groupBy(home).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    many = rows.join(F.broadcast(parts), home, "left")  # at most one row in `hot` is broadcast
    return many.withColumn("block", block_of(home, other, block_count(rows.sparkSession, total))).drop("parts")


def _packed(table: pa.Table) -> pa.Table:
    """One row for a block's edges: its nodes, and the two ends of each edge as places among them."""
    one = [table.column(c).combine_chunks() for c in ("src", "dst")]
    names = pc.unique(pa.chunked_array(one))
    ends = [pa.array([pc.index_in(c, value_set=names).to_numpy()], pa.list_(pa.int32())) for c in one]
    norm = pa.array([table.column("norm").combine_chunks().to_numpy()], pa.list_(pa.float64()))
    return pa.Table.from_arrays([table.column("block").slice(0, 1).combine_chunks(), pa.array([names], pa.list_(pa.string())), *ends, norm], names=["block", "names", "a", "b", "norm"])


def packed(dealt: DataFrame) -> DataFrame:
    """Dealt edges (block, src, dst, norm) with one row a block."""
    kinds = "block int, names array<string>, a array<int>, b array<int>, norm array<double>"
    return by_block(dealt.select("block", "src", "dst", "norm").groupBy("block").applyInArrow(_packed, kinds))


def needed(rows: DataFrame, *ends: str) -> DataFrame:
    """(id, block): which blocks read a node's vector."""
    return rows.select("block", F.explode(F.array(*ends)).alias("id")).distinct()


def listed_edges(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(block, src, dst, norm) with each edge of a symmetric graph once, dealt in blocks by the end with the larger name, the user."""
    one = edges.where("src > dst")
    return in_blocks(one, "src", "dst", one.count(), hot).select("block", "src", "dst", "norm")


def dealt_edges(edges: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The packed blocks of a symmetric graph's edges and (id, block) of the vectors that they read; edges of a user with more than `hot` of them are dealt in several parts."""
    rows = listed_edges(edges, hot)
    return packed(rows), needed(rows, "src", "dst")


def positions(names: pa.Array, table: pa.Table) -> np.ndarray:
    """Rows of `table` with these ids; one row beyond the end for those without."""
    at = pc.index_in(names, value_set=table.column("id").combine_chunks())
    return at.fill_null(table.num_rows).to_numpy(zero_copy_only=False)


def columns(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table as columns, and a column of zeros behind."""
    x = matrix(table.column("vector").combine_chunks()).reshape(-1, width)
    return np.ascontiguousarray(np.concatenate([x, np.zeros((1, width))]).T)


def _block_sums(width: int):
    """Sums of the neighbours' vectors over the edges of one block, in both directions."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        if not edges.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "vector": pa.array([], pa.list_(pa.float64()))})
        names, a, b, norm = (edges.column(k).combine_chunks().flatten() for k in range(1, 5))
        a, b, norm = (x.to_numpy(zero_copy_only=False) for x in (a, b, norm))
        x, n = columns(vectors, width), len(names)
        at = positions(names, vectors)
        from_a, from_b = at[a], at[b]
        sums = np.stack([np.bincount(b, row[from_a] * norm, n) + np.bincount(a, row[from_b] * norm, n) for row in x], axis=1)
        return pa.table({"id": names, "vector": lists(sums)})

    return run


def sent(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(to, id, vector): each vector for each block that reads it."""
    return rows.select("id", "vector").join(parts.withColumnRenamed("block", "to"), "id").select("to", "id", "vector")


def block_sums(edges: DataFrame, parts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, vector) of each block's own sums: a node has one row for each block with edges of it."""
    return edges.groupBy("block").cogroup(sent(rows, parts).groupBy("to")).applyInArrow(lambda a, b: _block_sums(width)(a, b), "id string, vector array<double>")


def spread(edges: DataFrame, parts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Each node's sum of its neighbours' vectors, weighted by norm. A vector is sent once to each block that reads it, whatever the number of its edges there."""
    return block_sums(edges, parts, rows, width).groupBy("id").agg(V.sum_by_position(F.col("vector"), width).alias("vector"))


def layer_mean(edges: DataFrame, parts: DataFrame, rows: DataFrame, width: int, layers: int, keep: scratch) -> DataFrame:
    """Mean of a vector table and its 1 to `layers` times spread ones. The map is linear and symmetric: applied to gradients it is its own backward pass."""
    first = now = rows.select("id", "vector")
    for left in reversed(range(layers)):
        # x + A (x + A (x + ...)): one table a layer, and no sum over all of them at the end
        both = block_sums(edges, parts, now, width).union(first).groupBy("id").agg(V.sum_by_position(F.col("vector"), width).alias("vector"))
        now = keep.cached(both) if left else both
    return now.select("id", F.transform("vector", lambda x: x / (layers + 1)).alias("vector"))


def ngcf_layer(edges: DataFrame, nodes: DataFrame, w1: float = 1.0, w2: float = 1.0) -> DataFrame:
    """One layer with fixed scalar weights: leaky(w1 * (x_i + sum norm x_j) + w2 * sum norm (x_i * x_j))."""
    sent = edges.join(nodes.select(F.col("id").alias("src"), F.col("vector").alias("xj")), "src")
    sent = sent.join(nodes.select(F.col("id").alias("dst"), F.col("vector").alias("xi")), "dst")
    rows = sent.select("dst", "norm", F.posexplode(F.zip_with("xi", "xj", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "p"))
    rows = rows.groupBy("dst", "pos").agg((w1 * F.sum(F.col("norm") * F.col("p.b")) + w2 * F.sum(F.col("norm") * F.col("p.a") * F.col("p.b"))).alias("m"))
    own = nodes.select(F.col("id").alias("dst"), F.posexplode("vector").alias("pos", "x"))
    value = w1 * F.col("x") + F.coalesce("m", F.lit(0.0))
    return own.join(rows, ["dst", "pos"], "left").select(F.col("dst").alias("id"), "pos", F.when(value > 0, value).otherwise(0.01 * value).alias("value"))


def directed_blocks(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (src, dst, ...) of any graph with a column block, dealt by the end with the larger name: both directions of an edge meet in one block."""
    rows = edges.withColumns({"_home": F.greatest("src", "dst"), "_other": F.least("src", "dst")})
    return in_blocks(rows, "_home", "_other", rows.count(), hot).drop("_home", "_other")


def by_row(vectors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a table have a vector, and the vectors as rows, with zeros for the others and one behind."""
    column = vectors.column("vector").combine_chunks()
    on = np.append(column.is_valid().to_numpy(zero_copy_only=False), False)
    own = matrix(column.drop_null())
    x = np.zeros((len(on), own.shape[1]))
    x[on] = own
    return on, x


def _edge_scores(slope: float, some: int = 1 << 14):
    """(src, dst, e) of one block's edges whose two ends are nodes; without a weight or one of the vectors the score is null."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        a, b = (positions(edges.column(c).combine_chunks(), vectors) for c in ("src", "dst"))
        on = np.flatnonzero((a < vectors.num_rows) & (b < vectors.num_rows))
        a, b, w = a[on], b[on], edges.column("w").combine_chunks().take(pa.array(on))
        (has, x), null, e = by_row(vectors), w.is_null().to_numpy(zero_copy_only=False), np.zeros(len(on))
        w = w.fill_null(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(on), some):
            z = x[a[i : i + some]] + x[b[i : i + some]] + w[i : i + some, None]
            e[i : i + some] = np.where(z > 0, z, slope * z).sum(1)
        ends = [edges.column(c).combine_chunks().take(pa.array(on)) for c in ("src", "dst")]
        return pa.table({"src": ends[0], "dst": ends[1], "e": pa.array(e, mask=null | ~has[a] | ~has[b])})

    return run


def gat_attention(edges: DataFrame, nodes: DataFrame, slope: float = 0.2, hot: int = HOT) -> DataFrame:
    """One attention head with identity weights: softmax over incoming edges of sum(leaky(x_i + x_j + w)), self-loops with the mean weight; a table of the session.

    Edges are scored in blocks; a vector goes once to each block that reads it, and none travels with an edge.
    """
    with scratch() as keep:
        edges = keep(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
        loops = edges.groupBy("dst").agg(F.avg("w").alias("w")).select(F.col("dst").alias("src"), "dst", "w")
        rows = keep.cached(by_block(directed_blocks(edges.union(loops), hot)))
        vectors = sent(nodes.select("id", V.doubles(F.col("vector")).alias("vector")), needed(rows, "src", "dst"))
        run = _edge_scores(slope)
        rows = keep.cached(rows.groupBy("block").cogroup(vectors.groupBy("to")).applyInArrow(lambda a, b: run(a, b), "src string, dst string, e double"))
        top = rows.groupBy("dst").agg(F.max("e").alias("top"))
        rows = rows.join(top, "dst").withColumn("z", F.exp(F.col("e") - F.col("top")))
        whole = rows.groupBy("dst").agg(F.sum("z").alias("total"))
        return held(rows.join(whole, "dst").select("src", "dst", (F.col("z") / F.col("total")).alias("alpha")))


def _weighted_sums(width: int, some: int = 1 << 14):
    """(id, vector): sums over one block's incoming edges of a node, null where no edge has both a weight and a vector."""

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        a = positions(edges.column("src").combine_chunks(), vectors)
        on = np.flatnonzero(a < vectors.num_rows)
        alpha, ends = (edges.column(c).combine_chunks().take(pa.array(on)) for c in ("alpha", "dst"))
        (has, x), ends = by_row(vectors), ends.dictionary_encode()
        to, names = ends.indices.to_numpy(), ends.dictionary
        good = np.flatnonzero(has[a[on]] & alpha.is_valid().to_numpy(zero_copy_only=False))
        a, to, alpha = a[on][good], to[good], alpha.fill_null(0).to_numpy(zero_copy_only=False)[good]
        sums = np.zeros((len(names), width))
        for i in range(0, len(good), some):
            part = x[a[i : i + some]] * alpha[i : i + some, None]
            for k in range(width):
                sums[:, k] += np.bincount(to[i : i + some], part[:, k], len(names))
        found = pa.array(np.arange(len(names)), mask=np.bincount(to, minlength=len(names)) == 0)
        return pa.table({"id": names, "vector": lists(sums).take(found)})

    return run


def attend(attention: DataFrame, nodes: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """New node vectors: attention-weighted sums, added within blocks of edges and then over blocks; a table of the session."""
    with scratch() as keep:
        rows = keep.cached(by_block(directed_blocks(attention.select("src", "dst", "alpha"), hot)))
        vectors = sent(nodes.select("id", V.doubles(F.col("vector")).alias("vector")), needed(rows, "src"))
        run = _weighted_sums(width)
        sums = rows.groupBy("block").cogroup(vectors.groupBy("to")).applyInArrow(lambda a, b: run(a, b), "id string, vector array<double>")
        return held(sums.groupBy("id").agg(V.sum_by_position(F.col("vector"), width).alias("vector")))


#: Four primes above every item count that a walk supports; a stride that is prime to the count visits each rank once.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def item_ranks(train: DataFrame) -> DataFrame:
    """item_id and r: its place from 0 in id order, numbered range by range."""
    return numbered(train.select("item_id").distinct(), "item_id", "r")


def _walk(total: int, step: Column, *parts: str | int | Column) -> Column:
    """Rank of the step-th item on a walk over all items that starts and strides by the parts' hash."""
    start = V.portable_hash(*parts)
    stride = F.element_at(F.array(*[F.lit(p % total) for p in STEPS]), (start % len(STEPS) + 1).cast("int"))
    return ((F.shiftright(start, 2) + step.cast("long") * stride) % total).cast("long")


def negatives(train: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k items per user without interaction, without replacement: the first free ones of a seeded walk over all items.

    A walk visits every item once, so k free ones lie within its first k + seen steps:
    the work grows with the ratings, not with users times items, and no row holds a list.
    """
    ranks = item_ranks(train)
    total = ranks.count()
    if not total:
        return train.select("user_id", "item_id", F.lit(1).alias("place")).limit(0)
    rated = train.select("user_id", "item_id").distinct()
    steps = rated.groupBy("user_id").agg(F.least(F.count("*") + k, F.lit(total)).alias("n"))
    tried = steps.select("user_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    tried = tried.withColumn("r", _walk(total, F.col("step"), seed, F.col("user_id"))).join(ranks, "r").join(rated, ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("step")
    return tried.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("user_id", "item_id", "place")


def _free_items(total: int, epoch: int, seed: int, tries: int):
    """Rank of the first free item on each row's walk; `good` (block, u, user_id, good, key) meets `banned` (block, u, r) of the same users."""

    def run(good: pa.Table, banned: pa.Table) -> pa.Table:
        users = good.column("u").combine_chunks().dictionary_encode()
        own, names = users.indices.to_numpy().astype(np.int64), users.dictionary
        who = pc.index_in(banned.column("u").combine_chunks(), value_set=names)
        known = who.is_valid().to_numpy(zero_copy_only=False)
        who = who.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
        taken = np.unique(who * total + banned.column("r").to_numpy()[known])
        start = np.array([int(hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest()[:15], 16) for k in good.column("key").to_pylist()], np.int64)
        stride = np.array(STEPS, np.int64)[start % len(STEPS)] % total
        found = np.full(len(own), -1)
        free = np.bincount(taken // total, minlength=len(names)) < total  # not everything is banned
        open_, first, some = np.flatnonzero(free[own]), 0, tries
        while len(open_) and first < total:
            step = np.arange(first, min(total, first + max(1, min(some, (1 << 22) // len(open_)))))
            r = ((start[open_] >> 2)[:, None] + step * stride[open_][:, None]) % total
            key = own[open_][:, None] * total + r
            place = np.minimum(np.searchsorted(taken, key), len(taken) - 1)
            free = taken[place] != key if len(taken) else np.ones(key.shape, bool)
            hit = free.any(1)
            found[open_[hit]] = r[hit, free[hit].argmax(1)]
            open_, first, some = open_[~hit], int(step[-1]) + 1, some * 8
        on = pa.array(np.flatnonzero(found >= 0))
        return pa.table({"user_id": good.column("user_id").take(on), "good": good.column("good").take(on), "r": found[found >= 0]})

    return run


def walkers(good: DataFrame, banned: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every epoch's draw reads: the (user_id, good) rows, and the ranks of the items banned for a user, dealt in blocks of users.

    The ranks of one user's banned items, eight bytes each, must fit one task.
    """
    blocks = block_count(good.sparkSession, good.count())
    block = F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(blocks)).cast("int").alias("block")
    user = F.col("user_id").cast("string").alias("u")
    rows = good.select(block, user, "user_id", "good", F.concat_ws(":", F.col("user_id").cast("string"), F.col("good").cast("string")).alias("key"))
    no = banned.join(ranks, "item_id").select(block, user, F.col("r").cast("long").alias("r"))
    return by_block(rows), by_block(no)


def drawn_pairs(rows: DataFrame, no: DataFrame, ranks: DataFrame, total: int, epoch: int = 0, seed: int = 42, tries: int = 8) -> DataFrame:
    """(user_id, good, bad) of an epoch from `walkers`."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("user_id", "good")) + ", r long"
    run = _free_items(total, epoch, seed, tries)
    found = rows.groupBy("block").cogroup(no.groupBy("block")).applyInArrow(lambda a, b: run(a, b), kinds)
    return found.join(ranks.select(F.col("item_id").alias("bad"), "r"), "r").select("user_id", "good", "bad")


def sampled_pairs(good: DataFrame, banned: DataFrame, ranks: DataFrame, total: int, epoch: int = 0, seed: int = 42, tries: int = 8) -> DataFrame:
    """(user_id, good, bad): one item for each (user_id, good) row, drawn anew for every epoch from the items that are not `banned` for the user.

    Each row walks over all items from its own start and takes the first free one, where its user's banned items are at hand:
    no step of a walk is shuffled. `tries` steps are taken at once, then eight times as many, and so on up to all items, so users who
    have nearly everything banned get theirs too. Rows of users with everything banned go.
    `ranks`: item_id, r from 0 to total - 1.
    """
    return drawn_pairs(*walkers(good, banned, ranks), ranks, total, epoch, seed, tries)


def pair_losses(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """BPR loss of (user_id, good, bad) rows under given vectors."""
    rows = pairs.join(users.select("user_id", F.col("vector").alias("u")), "user_id")
    rows = rows.join(items.select(F.col("item_id").alias("good"), F.col("vector").alias("g")), "good").join(items.select(F.col("item_id").alias("bad"), F.col("vector").alias("b")), "bad")
    margin = V.dot(F.col("u"), F.col("g")) - V.dot(F.col("u"), F.col("b"))
    return rows.select("user_id", "good", "bad", V.bpr_loss(margin).alias("loss"))


def sampled_edges(edges: DataFrame, nodes: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most `most` incoming edges of each listed node (id), drawn by a seeded hash: one layer's block of a minibatch."""
    order = Window.partitionBy("dst").orderBy(V.portable_hash(seed, F.col("src"), F.col("dst")), "src")
    near = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("src", "dst", "w")
