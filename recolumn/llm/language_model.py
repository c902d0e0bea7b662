"""Language-model scoring: causal self-attention in numpy over subword ids.

Text is read as words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. Words are
cut into subwords by the first VOCAB entries of a public byte-pair vocabulary.

Model. The next subword's logits are the logarithms of the smoothed subword pair
counts of all training texts plus a projection of one causal self-attention head's
output; the softmax has two levels (group, then member). A text's score is the sum of its
subwords' logarithms, its end included, and nothing else: a proper distribution over texts.

Windows. A window scores BLOCK targets; its keys are the inputs of these targets
and of the CONTEXT positions before, so windows overlap and every token is scored
once, with a mask that hides later positions. Windows go through in batches.

Learning. Texts are read once: that pass counts words and subword pairs of the training texts and keeps every text's
subwords as a table, which training and scoring read. Words are known by the hash of their subwords. A pass over that table
trains the attention on every window of every training text, ends and short texts included,
once: each task starts from the same weights and takes Adam steps over its texts' windows, and the weights
are averaged by windows (at most AVERAGERS rows reach the driver). Tasks get at least TASK_SUBWORDS where there are that many.

Base score: word counts of any number stay distributed. The FREQUENT commonest words at
most are sent to the tasks; all other words are joined by their 64-bit hash. Which words
are sent changes no score.

Defined cases: null and empty texts are one end; ids that are null or not in the
training part are scored like any other (a null id is not held out and trains); repeated rows
are texts of their own; without training texts all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import base64
import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches, durable, release, row_keys
from .quality import held_out

VOCAB = 1024
END, PAD = VOCAB, VOCAB + 1
GROUP = 32
GROUPS = (VOCAB + 1 + GROUP - 1) // GROUP
WIDTH, CONTEXT, BLOCK = 16, 8, 16
BATCH, RATE = 256, 0.01
TASK_SUBWORDS, AVERAGERS = 2_000_000, 16
FREQUENT = 300_000
SLICE = 4 << 20
FETCH, SCORED = 32 * BATCH, 512
_END_HASH = 0x5BD1E995


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """The first VOCAB entries of a tiktoken rank file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return {token: rank for token, rank in ranks.items() if rank < VOCAB}


def opening(ranks: dict[bytes, int]) -> np.ndarray:
    """Which subwords open a word."""
    opens = np.zeros(VOCAB + 1, bool)
    opens[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
    return opens


class Subwords:
    """Cuts the distinct words of a slice into subword ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("subwords", pat_str=r" [^ ]*", mergeable_ranks=ranks, special_tokens={})
        self.opens = opening(ranks)

    def words(self, body, starts, ends):
        """Ids of the words joined, and where each word's ids begin (one entry more)."""
        size = ends - starts + 1
        at = np.cumsum(size) - size
        out = np.full(int(size.sum()), 32, np.uint8)
        out[np.repeat(at + 1, size - 1) + tx.ranges(size - 1)] = tx.LOWER[body[np.repeat(starts, size - 1) + tx.ranges(size - 1)]]
        ids = np.array(self.encoding.encode_ordinary(out.tobytes().decode("utf-8", "replace")), np.int64)
        return ids, np.append(np.flatnonzero(self.opens[ids]) if len(ids) else [], len(ids)).astype(np.int64)


class Stream:
    """The subword stream of some texts; every text closes with an end."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths, self.rows = ids, lengths, len(lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.inputs = np.empty_like(ids)
        self.inputs[1:] = ids[:-1]
        self.inputs[self.starts] = END

    @staticmethod
    def of(column: pa.Array):
        """Streams of the texts of a column of subwords, SLICE bytes at a time, each with its range of rows."""
        body, at = tx.buffers(column)
        for i, j in tx.slices(at, SLICE):
            ids, where = tx.cut(body, at, i, j)
            yield i, j, Stream(ids.view(np.uint16), np.diff(where) // 2)

    def column(self) -> pa.Array:
        """The subwords of each text as bytes."""
        at = np.append(self.starts, len(self.ids)) * 2
        return pa.Array.from_buffers(pa.binary(), self.rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(self.ids)])

    def words(self, opens: np.ndarray):
        """The texts' words: the row and the hash of each."""
        at = np.append(np.flatnonzero((opens | (np.arange(VOCAB + 1) == END)).take(self.ids)), len(self.ids))
        word = np.flatnonzero(self.ids.take(at[:-1]) != END)
        starts = at.take(word)
        return np.searchsorted(self.starts, starts, side="right") - 1, tx.hashes(self.ids, starts, at.take(word + 1), None)

    def windows(self):
        """Place of each window's first target in the stream, its row's start and its number of targets."""
        n = -(-self.lengths // BLOCK)
        row = np.repeat(np.arange(self.rows), n)
        first = self.starts[row] + tx.ranges(n) * BLOCK
        return first, self.starts[row], np.minimum(BLOCK, self.starts[row] + self.lengths[row] - first)

    def keys(self, first, start):
        """Input ids of the keys of some windows."""
        at = first[:, None] + np.arange(-CONTEXT, BLOCK)[None, :]
        keys = self.inputs.take(at, mode="clip")
        early = np.flatnonzero(at[:, 0] < start)  # only these begin before their text
        keys[early] = np.where(at[early] < start[early, None], keys.dtype.type(PAD), keys[early])
        return keys

    def targets(self, first, size):
        """Target ids of some windows and which of them belong to the text."""
        at, valid = first[:, None] + np.arange(BLOCK)[None, :], np.arange(BLOCK)[None, :] < size[:, None]
        return self.ids.take(at, mode="clip"), valid


class Tokens(Stream):
    """Words and subword stream of the rows of a slice."""

    def __init__(self, body, at, subwords: Subwords):
        starts, ends, words = tx.spans(body, at, tx.SPACED)
        self.counts = np.diff(words)
        _, first, self.word = np.unique(tx.hashes(body, starts, ends), return_index=True, return_inverse=True)
        ids, where = subwords.words(body, starts[first], ends[first])
        self.hash = tx.hashes(ids, where[:-1], where[1:], None)
        self.row = np.repeat(np.arange(len(at) - 1), self.counts)
        length = np.diff(where).take(self.word)
        # one end behind each row's subwords
        lengths = np.bincount(self.row, length, minlength=len(at) - 1).astype(np.int64) + 1
        stream, ends = np.full(int(lengths.sum()), END, np.uint16), np.cumsum(lengths) - 1
        inside = np.ones(len(stream), bool)
        inside[ends] = False
        shift = where.take(self.word) - (np.cumsum(length) - length)
        place = np.repeat(shift, length)
        place += np.arange(len(place))
        stream[inside] = ids.astype(np.uint16).take(place)
        super().__init__(stream, lengths)


class Model:
    """Pair tables and the weights of the attention head."""

    def __init__(self, pairs: np.ndarray):
        """pairs: counts of (input, next), VOCAB + 1 square."""
        total = pairs.sum()
        single = (pairs.sum(0) + 0.1) / (total + 0.1 * len(pairs))
        p = (pairs + 20 * single[None, :]) / (pairs.sum(1, keepdims=True) + 20)
        full = np.zeros((VOCAB + 2, GROUPS * GROUP))
        full[: VOCAB + 1, : VOCAB + 1] = p
        full[PAD] = full[END]
        full = full.reshape(VOCAB + 2, GROUPS, GROUP)
        group = full.sum(2)
        with np.errstate(divide="ignore"):
            self.group_log = np.log(group).astype(np.float32)
            self.member_log = np.maximum(np.log(full / group[:, :, None]), -1e4).astype(np.float32)
        draw = np.random.default_rng(5)
        shape = {"e": (VOCAB + 2, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "lag": (CONTEXT + BLOCK,), "g": (GROUPS, WIDTH), "u": (GROUPS * GROUP, WIDTH)}
        scale = {"e": 0.5, "q": 0.3, "k": 0.3, "v": 0.3, "lag": 0.0, "g": 0.01, "u": 0.01}
        self.weights = {n: (draw.standard_normal(s) * scale[n]).astype(np.float32) for n, s in shape.items()}

    def pack(self) -> bytes:
        return b"".join(w.tobytes() for w in self.weights.values())

    def unpack(self, data: np.ndarray) -> None:
        at = 0
        for n, w in self.weights.items():
            self.weights[n] = data[at : at + w.size].astype(np.float32).reshape(w.shape)
            at += w.size

    def tables(self):
        """Query, key and value of each id, those of keys side by side, and the bias of each lag."""
        w = self.weights
        i, j = np.arange(BLOCK)[:, None] + CONTEXT, np.arange(CONTEXT + BLOCK)[None, :]
        bias = np.where(j <= i, w["lag"][np.maximum(i - j, 0)], -1e4).astype(np.float32)
        return w["e"] @ w["q"] * np.float32(WIDTH**-0.5), w["e"] @ np.concatenate([w["k"], w["v"]], axis=1), bias

    def attend(self, keys: np.ndarray, tables):
        q, kv, bias = tables
        q, kv = q.take(keys[:, CONTEXT:], axis=0), kv.take(keys, axis=0)
        a = np.matmul(q, kv[:, :, :WIDTH].transpose(0, 2, 1))
        a += bias
        np.exp(np.minimum(a, 30, out=a), out=a)
        # sums are divided by the total weight instead of each weight
        total = (a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)).reshape(*a.shape[:2], 1)
        c = np.matmul(a, kv[:, :, WIDTH:])
        c /= total
        return c, (q, kv, a, total)

    @staticmethod
    def _by_group(targets: np.ndarray, valid: np.ndarray):
        """Places of the valid targets, ordered by group, and the range and members of each group that occurs."""
        at = np.flatnonzero(valid.ravel())
        group = (targets.ravel() // GROUP).astype(np.uint8).take(at)
        order = np.argsort(group, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS))).tolist()
        return at.take(order), [(edges[n], edges[n + 1], slice(n * GROUP, (n + 1) * GROUP)) for n in range(GROUPS) if edges[n + 1] > edges[n]]

    def _weights_of(self, x, y, c, parts):
        """Not yet normalised: probabilities of all groups and of the members of the target's group, with the target's place in each."""
        each, group = np.arange(len(y)), y // GROUP
        p = c @ self.weights["g"].T
        p += self.group_log.take(x, axis=0)
        inside = np.empty((len(y), GROUP), c.dtype)
        for i, j, own in parts:
            np.dot(c[i:j], self.weights["u"][own].T, out=inside[i:j])
        inside += self.member_log.reshape(-1, GROUP).take(x * GROUPS + group, axis=0)
        return (np.exp(p, out=p), each * GROUPS + group), (np.exp(inside, out=inside), each * GROUP + y % GROUP)

    def log_probability(self, keys: np.ndarray, targets: np.ndarray, valid: np.ndarray, tables) -> np.ndarray:
        """Natural logarithms of the valid targets, in order."""
        order, parts = self._by_group(targets, valid)
        keys = keys.astype(np.intp)
        c = self.attend(keys, tables)[0].reshape(-1, WIDTH).take(order, axis=0)
        x, y = keys[:, CONTEXT:].ravel().take(order), targets.ravel().take(order).astype(np.intp)
        own, whole = 1, 1
        for p, at in self._weights_of(x, y, c, parts):
            own, whole = own * p.ravel().take(at).astype(np.float64), whole * (p @ np.ones(p.shape[1], p.dtype)).astype(np.float64)
        out = np.empty(targets.size)
        out[order] = np.log(own / whole)
        return out[valid.ravel()]

    def gradients(self, keys: np.ndarray, targets: np.ndarray, valid: np.ndarray):
        """Mean loss of the valid targets and its gradients."""
        w, keys, (_, _, bias) = self.weights, keys.astype(np.intp), (tables := self.tables())
        order, parts = self._by_group(targets, valid)
        sums, (q, kv, a, total) = self.attend(keys, tables)
        c = sums.reshape(-1, WIDTH).take(order, axis=0)
        x, y, n = keys[:, CONTEXT:].ravel().take(order), targets.ravel().take(order).astype(np.intp), len(order)
        (p, at), (inside, member) = self._weights_of(x, y, c, parts)

        def errors(p, at):
            """Loss; turns p into errors times the sums, and returns what divides them."""
            whole, flat = p @ np.ones(p.shape[1], p.dtype), p.reshape(-1)
            own = flat.take(at)
            flat[at] = own - whole
            return (np.log(whole) - np.log(own)).sum(), 1 / whole[:, None]

        loss, share = errors(p, at)
        grad = {"g": p.T @ (c * share), "u": np.zeros_like(w["u"])}
        back = p @ w["g"]
        back *= share
        more, share = errors(inside, member)
        scaled, part = c * share, np.empty_like(c)
        for i, j, own in parts:
            np.dot(inside[i:j].T, scaled[i:j], out=grad["u"][own])
            np.dot(inside[i:j], w["u"][own], out=part[i:j])
        part *= share
        back += part
        dc = np.zeros((targets.size, WIDTH), c.dtype)
        dc[order] = back
        dc = dc.reshape(sums.shape)
        dc /= total
        ds = np.matmul(dc, kv[:, :, WIDTH:].transpose(0, 2, 1))
        ds -= ((dc * sums).reshape(-1, WIDTH) @ np.ones(WIDTH, c.dtype)).reshape(total.shape)
        ds *= a
        # gradients of the places' queries, keys and values side by side, summed by id
        d = np.empty((*keys.shape, 3 * WIDTH), c.dtype)
        d[:, :CONTEXT, :WIDTH] = 0
        np.matmul(ds, kv[:, :, :WIDTH], out=d[:, CONTEXT:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dc, out=d[:, :, 2 * WIDTH :])
        ids, by_id = keys.ravel(), np.argsort(keys.ravel().astype(np.uint16), kind="stable")
        ids, rows = ids.take(by_id), d.reshape(-1, 3 * WIDTH).take(by_id, axis=0)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        t = np.zeros((VOCAB + 2, 3 * WIDTH), c.dtype)
        # a complex number is two columns: half as many sums
        t[ids[first]] = np.add.reduceat(rows.view(np.result_type(c.dtype, np.complex64)), first, axis=0).view(c.dtype)
        t[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        grad["e"] = t @ np.concatenate([w["q"], w["k"], w["v"]], axis=1).T
        whole = w["e"].T @ t
        grad["q"], grad["k"], grad["v"] = whole[:, :WIDTH], whole[:, WIDTH : 2 * WIDTH], whole[:, 2 * WIDTH :]
        i, j = np.arange(BLOCK)[:, None] + CONTEXT, np.arange(CONTEXT + BLOCK)[None, :]
        grad["lag"] = np.bincount(np.maximum(i - j, 0).ravel(), (ds.sum(axis=0) * (j <= i)).ravel(), minlength=CONTEXT + BLOCK).astype(np.float32)
        return (loss + more) / n, {name: g / n for name, g in grad.items()}


class Learner:
    """Adam steps of a model."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.first, self.second = (np.zeros(sum(w.size for w in model.weights.values()), np.float32) for _ in range(2))

    def step(self, keys: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> float:
        loss, grad = self.model.gradients(keys, targets, valid)
        self.steps += 1
        g = np.concatenate([grad[n].ravel() for n in self.model.weights])
        self.first += 0.1 * (g - self.first)
        g *= g
        self.second += 0.02 * (g - self.second)
        step = np.sqrt(self.second * (1 / (1 - 0.98**self.steps)))
        step += 1e-8
        np.divide(self.first, step, out=step)
        step *= self.rate / (1 - 0.9**self.steps)
        at = 0
        for n, w in self.model.weights.items():
            self.model.weights[n] = w - step[at : at + w.size].reshape(w.shape)
            at += w.size
        return float(loss)

    def learn(self, tokens: Stream, seed: int) -> int:
        """Steps over all windows of some texts in seeded order; their number."""
        first, start, size = tokens.windows()
        order = np.random.default_rng(seed).permutation(len(first))
        for i in range(0, len(order), FETCH):
            at = order[i : i + FETCH]
            keys, targets, valid = tokens.keys(first[at], start[at]), *tokens.targets(first[at], size[at])
            for j in range(0, len(at), BATCH):
                self.step(keys[j : j + BATCH], targets[j : j + BATCH], valid[j : j + BATCH])
        return len(first)


WORD, PAIR, TEXT = 0, 1, 2


def _rows(kind, key, value, ids, train=None, subwords=None):
    """ids: of the texts, or the type of ids for rows that belong to no text."""
    n = len(key)
    empty = [pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, ids) if isinstance(ids, pa.DataType) else ids]
    own = empty if train is None else [pa.array(train), subwords, ids]
    cols = [np.full(n, kind, np.int32), np.asarray(key, np.int64), np.asarray(value, np.int64)]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *own], names=["kind", "key", "value", "train", "subwords", "id"])


def _read(ranks):
    """Each text's key, number of words and subwords; of the training texts, word counts of each batch and subword pairs of each task."""

    def run(batches):
        subwords, pairs, number, kind = Subwords(ranks), np.zeros((VOCAB + 1) ** 2, np.int64), 0, pa.null()
        for batch in batches:
            ids, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            body_all, at_all = tx.buffers(batch.column(1))
            keys, kind = row_keys(number, len(ids)), ids.type
            number += len(ids)
            hashes, counts = [np.array([_END_HASH], np.uint64)], [np.array([train.sum()])]
            for i, j in tx.slices(at_all, SLICE):
                t, own = Tokens(*tx.cut(body_all, at_all, i, j), subwords), train[i:j]
                hashes.append(t.hash)
                counts.append(np.bincount(t.word[own.take(t.row)], minlength=len(t.hash)))
                pair = t.inputs.astype(np.int64) * (VOCAB + 1) + t.ids
                pairs += np.bincount(pair[np.repeat(own, t.lengths)], minlength=len(pairs))
                yield _rows(TEXT, keys[i:j], t.counts + 1, ids.slice(i, j - i), own, t.column())
            h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts), minlength=len(h)).astype(np.int64)
            h, total = tx.signed(h)[total > 0], total[total > 0]
            for i in range(0, len(h), 100_000):
                yield _rows(WORD, h[i : i + 100_000], total[i : i + 100_000], kind)
        on = np.flatnonzero(pairs)
        for i in range(0, len(on), 100_000):
            yield _rows(PAIR, on[i : i + 100_000], pairs[on[i : i + 100_000]], kind)

    return run


def _train(model):
    """The weights that a task has learned from its texts, times its windows."""

    def run(batches):
        learner, n = Learner(copy.deepcopy(model.value)), 0
        for batch in batches:
            for _, _, texts in Stream.of(batch.column(0)):
                n += learner.learn(texts, n)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([learner.model.pack()]), pa.array([float(n)])], names=["weights", "n"])

    return run


def _weighted_sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for w, n in zip(rows.weights, rows.n, strict=True))
    return pd.DataFrame({"weights": [total.tobytes()], "n": [rows.n.sum()]})


def fit(counted: DataFrame) -> Model:
    """counted: the rows of `_read`."""
    pairs = np.zeros((VOCAB + 1) ** 2)
    table = counted.where(F.col("kind") == PAIR).groupBy("key").agg(F.sum("value").alias("n")).toArrow()  # (VOCAB + 1)^2 rows at most
    pairs[table.column("key").to_numpy()] = table.column("n").to_numpy()
    model = Model(pairs.reshape(VOCAB + 1, VOCAB + 1))
    if not pairs.any():
        return model
    shared = counted.sparkSession.sparkContext.broadcast(model)
    texts = counted.where((F.col("kind") == TEXT) & F.col("train")).select("subwords")
    found = texts.coalesce(max(1, int(pairs.sum() // TASK_SUBWORDS))).mapInArrow(_train(shared), "weights binary, n double")
    found = found.withColumn("g", F.floor(F.rand(0) * AVERAGERS)).groupBy("g").applyInPandas(lambda rows: _weighted_sum(rows[["weights", "n"]]), "weights binary, n double").collect()
    model.unpack((sum(np.frombuffer(r["weights"], np.float64) for r in found) / sum(r["n"] for r in found)).astype(np.float32))
    return model


def _score(model, opens, frequent):
    """One row for each text, and one for each text and word that is not among the frequent ones."""

    def run(batches):
        own = model.value
        tables, known, count = own.tables(), *frequent.value
        for batch in batches:
            ids, keys, n_tokens = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j, t in Stream.of(batch.column(3)):
                token = np.empty(len(t.ids), np.float64)
                first, start, size = t.windows()
                for k in range(0, len(first), SCORED):
                    f = first[k : k + SCORED]
                    targets, valid = t.targets(f, size[k : k + SCORED])
                    at = (f[:, None] + np.arange(BLOCK)[None, :])[valid]
                    token[at] = own.log_probability(t.keys(f, start[k : k + SCORED]), targets, valid, tables)
                score = np.add.reduceat(token, t.starts) if t.rows else np.zeros(0)
                # each text's distinct words and its end, and how often they occur
                row, h = t.words(opens)
                h, word = np.unique(h, return_inverse=True)
                pair, times = np.unique(np.concatenate([row * (len(h) + 1) + word, np.arange(t.rows) * (len(h) + 1) + len(h)]), return_counts=True)
                word = np.append(h, np.uint64(_END_HASH))
                owner, which = np.divmod(pair, len(word))
                place = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
                c = np.where(known[place] == word, count[place], 0.0) if len(known) else np.zeros(len(word))
                often, logs = (c > 0)[which], np.log10(c + 0.5)[which]
                rare = np.flatnonzero(~often)
                per_row = lambda x: np.bincount(owner[often], x[often], minlength=t.rows)  # noqa: B023, E731
                take = np.concatenate([np.arange(t.rows), owner[rare]]) + i
                pad = np.zeros(len(rare))
                doc_hash = tx.mix(keys[i:j].astype(np.uint64) + np.uint64(99))
                columns = [
                    ids.take(pa.array(take)), pa.array(keys[take]), pa.array(tx.signed(np.concatenate([doc_hash, word[which[rare]]]))),
                    pa.array(np.concatenate([np.zeros(t.rows, np.int64), times[rare]])), pa.array(np.concatenate([n_tokens[i:j], pad]).astype(np.int64)),
                    pa.array(np.concatenate([per_row(times), pad]).astype(np.int64)), pa.array(np.concatenate([per_row(times * logs), pad])),
                    pa.array(np.concatenate([score / np.log(10), pad])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "key", "times", "n_tokens", "known", "base", "score"])

    return run


def _frequent(words: DataFrame):
    """At most FREQUENT of the commonest words, all that reach some count, and that count."""
    size = F.floor(8 * F.log2("c"))
    shares = sorted(((r["b"], r["n"]) for r in words.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundred rows
    least, reached = None, 0
    for b, n in shares:
        if reached + n > FREQUENT:
            break
        least, reached = b, reached + n
    often = size >= F.lit(least) if least is not None else F.lit(False)
    return often, words.where(often).toArrow()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """id, row, n_tokens, n_known, train_tokens, base_score and score of every document row."""
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = vocabulary(vocabulary_path)
    train = ~F.coalesce(held_out(id_col, 5), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    counted = durable(rows.mapInArrow(_read(ranks), f"kind int, key long, value long, train boolean, subwords binary, id {kind}"))
    words = durable(counted.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("value").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    often, table = _frequent(words)
    h, c = table.column("key").to_numpy().view(np.uint64), table.column("c").to_numpy().astype(float)
    order = np.argsort(h)
    sc = spark.sparkContext
    texts = counted.where(F.col("kind") == TEXT).select("id", "key", "value", "subwords")
    scored = texts.mapInArrow(
        _score(sc.broadcast(fit(counted)), opening(ranks), sc.broadcast((h[order], c[order]))),
        f"id {kind}, row long, key long, times long, n_tokens long, known long, base double, score double",
    )
    scored = scored.join(words.where(~often), "key", "left")
    scored = scored.groupBy("id", "row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"),
        F.sum("score").alias("score"),
    )
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    scored = durable(scored.select("id", "row", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))
    release(counted, words)
    return scored


def report(docs: DataFrame) -> DataFrame:
    scores = score_texts(docs).withColumnRenamed("id", "doc_id")
    return scores.select("doc_id", F.coalesce(held_out("doc_id", 5), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
