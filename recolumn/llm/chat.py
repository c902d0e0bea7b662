"""Chat formatting by columnar byte assembly.

A turn becomes `### role ###\\n text </turn>\\n` without the spaces around text. Inside roles and
texts `\\` is written `\\b`, `#` is `\\h` and `<` is `\\l`, so a bare `#` or `<`
is always the template's and reading back is exact. For each batch of
conversations numpy computes the lengths of all segments, their cumulative
offsets and the scatter indices, and copies headers and escaped contents into one
preallocated buffer, which becomes the Arrow column.

Rows of a conversation go by turn, then role, then text (nulls first); null
roles and texts count as empty. Repeated rows are kept. Rows of a null
conversation id form one conversation. A conversation is one output string, so
it must fit in a task's memory; an Arrow string holds at most 2 GB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .cluster import bounded_batches

HEAD, MIDDLE, TAIL = b"### ", b" ###\n", b"</turn>\n"
SPECIAL = {ord("\\"): ord("b"), ord("#"): ord("h"), ord("<"): ord("l")}
_LETTER = np.zeros(256, np.uint8)
for _byte, _name in SPECIAL.items():
    _LETTER[_byte] = _name
TRAINED = "assistant"


def _escape(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with special bytes written as a backslash and a letter."""
    special = _LETTER[body] > 0
    before = np.concatenate([[0], np.cumsum(special)])
    out = np.empty(len(body) + before[-1], np.uint8)
    where = np.arange(len(body)) + before[1:]
    out[where] = np.where(special, _LETTER[body], body)
    out[where[special] - 1] = ord("\\")
    return out, at + before[at]


def _scatter(out: np.ndarray, where: np.ndarray, body: np.ndarray, at: np.ndarray) -> None:
    """Copies row r of (body, at) to out[where[r]:]."""
    lengths = np.diff(at)
    out[np.repeat(where - at[:-1], lengths) + np.arange(len(body))] = body


def _characters(body: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    return np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Formatted conversations, loss spans (code points) and turn counts; `turns` are the counts."""
    role, text = _escape(*tx.buffers(roles)), _escape(*tx.buffers(texts))
    size = len(HEAD) + np.diff(role[1]) + len(MIDDLE) + np.diff(text[1]) + len(TAIL)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for piece, start in ((HEAD, at), (MIDDLE, at + len(HEAD) + np.diff(role[1])), (TAIL, ends - len(TAIL))):
        out[start[:, None] + np.arange(len(piece))[None, :]] = np.frombuffer(piece, np.uint8)
    _scatter(out, at + len(HEAD), *role)
    _scatter(out, ends - len(TAIL) - np.diff(text[1]), *text)
    edge = np.concatenate([[0], np.cumsum(turns)])
    offsets = np.concatenate([[0], ends])[edge]
    if len(out) >= 1 << 31:
        raise ValueError("formatted conversations of one batch exceed 2 GB; one conversation is too long")
    column = pa.Array.from_buffers(pa.string(), len(turns), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    chars = _characters(out)
    trained = np.array([r == TRAINED for r in roles.to_pylist()], bool)
    owner = np.repeat(np.arange(len(turns)), turns)[trained]
    base = chars[offsets[owner]] if len(owner) else np.zeros(0, np.int64)
    low, high = chars[(ends - len(TAIL) - np.diff(text[1]))[trained]] - base, chars[(ends - len(TAIL))[trained]] - base
    counts = np.bincount(owner, minlength=len(turns)) if len(turns) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)
    return column, spans, turns


def _format(batches):
    for batch in batches:
        rows = batch.column(1)
        flat = rows.flatten()
        turns = np.array(rows.value_lengths(), np.int64)
        text, spans, turns = assemble(flat.field("role").fill_null(""), flat.field("text").fill_null(""), turns)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns), text, spans], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (array of start, end in code points of `formatted`)."""
    bounded_batches(rows.sparkSession)
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_format, f"conv_id {kind}, n_turns long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.split(TAIL.decode())[:-1]:
        role, text = turn[len(HEAD) :].split(MIDDLE.decode(), 1)
        out.append((unescape(role), unescape(text)))
    return out


def _read_back(batches):
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def report(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted output, with conversation -7 added."""
    said = "\\### Assistant: </turn> ok"
    schema = T.StructType([conversations.schema[c] for c in ("conv_id", "turn", "role", "text")])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    own = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema)
    done = format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(own)).select("conv_id", "formatted", "loss_spans")
    kind = done.schema["conv_id"].dataType.simpleString()
    return done.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
