"""Chat formatting by columnar byte assembly.

A turn is written as ``### Role: `` + text + ``</turn>`` + newline. Inside roles and texts a backslash
stands before every backslash, before every ``### `` and ``</turn>`` (and in roles before every colon), so
control strings occur as such only where a turn begins or ends, and reading back is exact.

A block of turns is assembled at once: Arrow kernels escape the columns, numpy takes the lengths of all
headers, texts and footers, their cumulative offsets and the place of every byte, and all bytes are
scattered into one preallocated buffer, which becomes the Arrow column.

Scale: the turns are dealt by ranges of (conv_id, turn, role, the first ``KEY`` characters of the text) and sorted
by (conv_id, turn, role, text) inside a range, so the order is the same whatever the number of ranges, and a
conversation with a third of all rows is spread over tasks too; so are turns that are alike in all four, if their
text is not longer than the key. A formatted row is a piece of one conversation, of at most ``PIECE`` turns and
about ``PIECE_BYTES`` bytes. Reading back parses and unescapes the pieces where they are read; what then streams
through a conversation's one task, in order, are bytes for its digests. (A digest of a whole conversation is a
chain, so its pieces pass one task; they are never gathered.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, settle_wide, text_bytes

BEGIN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
PIECE = 1024
PIECE_BYTES = 4 << 20
KEY = 64
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(col: pa.Array, role: bool = False) -> pa.Array:
    col = pc.fill_null(col, "").cast(pa.large_string())
    for plain in ("\\", "### ", "</turn>", *([":"] if role else [])):
        col = pc.replace_substring(col, plain, "\\" + plain)
    return col


def unescaped(text: str, block: int = 1 << 18) -> str:
    """Without the escaping backslashes; a long text block by block, none of which ends between a backslash and what it escapes."""
    out, lo = [], 0
    while lo < len(text):
        part = text[lo : lo + block]
        if (len(part) - len(part.rstrip("\\"))) % 2:
            part = text[lo : lo + block + 1]
        out.append(ESCAPED.sub(r"\1", part))
        lo += len(part)
    return "".join(out)


def scatter(columns: list[tuple[np.ndarray, np.ndarray]], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise concatenation of text columns given as (bytes, offsets): all bytes and the rows' offsets.

    Each column's bytes go to their places by indexed copies, a block of bytes at a time: place = row's offset +
    lengths before + index in the text.
    """
    lengths = [np.diff(off) for _, off in columns]
    rows = np.concatenate([[0], np.cumsum(np.sum(lengths, axis=0))]) if columns else np.zeros(1, np.int64)
    out = np.empty(int(rows[-1]), np.uint8)
    at = rows[:-1].copy()
    for (data, off), size in zip(columns, lengths, strict=True):
        shift = at - off[:-1]
        for lo in range(0, len(data), block):
            hi = min(lo + block, len(data))
            first, last = int(np.searchsorted(off, lo, side="right")) - 1, int(np.searchsorted(off, hi, side="left"))
            inside = np.diff(np.clip(off[first : last + 1], lo, hi))
            out[np.repeat(shift[first:last], inside) + np.arange(lo, hi)] = data[lo:hi]
        at += size
    return out, rows


def constant(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.tile(raw, n), np.arange(n + 1) * len(raw)


def assemble(role: pa.Array, text: pa.Array, trained: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of the turns, code points of each turn, code points before its text, code points of its text: 0 outside the loss)."""
    n = len(text)
    body, name = escaped(text), escaped(role, role=True)
    out, rows = scatter([constant(BEGIN, n), text_bytes(name), constant(AFTER_ROLE, n), text_bytes(body), constant(END, n)])
    head = pc.utf8_length(name).to_numpy(zero_copy_only=False).astype(np.int64) + len(BEGIN) + len(AFTER_ROLE)
    size = pc.utf8_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    loss = pc.fill_null(pc.equal(role, trained), False).to_numpy(zero_copy_only=False)
    return out, rows, head + size + len(END), head, np.where(loss, size, 0)


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pieces (conv_id, shard, piece, n_turns, formatted, loss_starts, loss_lengths) of all conversations.

    turns: conv_id, turn, role, text; others are left out. Null texts and roles are empty; turns of equal number
    follow by role and text, null numbers come first, repeated rows each count; null conv_ids are one conversation;
    an empty table gives no pieces. loss_starts and loss_lengths are the loss mask: spans of the trained role's texts
    in code points of the piece. Order pieces by (shard, piece).
    """
    order = ["conv_id", "turn", "role", "text"]
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > KEY
    alike = F.when(long, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int"))
    dealt = filled.withColumn("_key", F.substring("text", 1, KEY)).withColumn("_long", long).withColumn("_alike", alike)
    ordered = dealt.repartitionByRange("conv_id", "turn", "role", "_key", "_long", "_alike").select(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for whole in batches:
            for batch in (part for start in range(0, whole.num_rows, PIECE) for part in parts(whole.slice(start, PIECE), "text", PIECE_BYTES)):
                out, rows, chars, head, loss = assemble(batch.column("role"), batch.column("text"), trained)
                conv = batch.column("conv_id")
                key = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
                null = conv.is_null().to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1])
                ends = np.append(first[1:], len(key))
                begins = np.concatenate([[0], np.cumsum(chars)])
                marked = np.flatnonzero(loss)
                starts = begins[marked] + head[marked] - begins[first[np.searchsorted(first, marked, side="right") - 1]]
                cuts = pa.array(np.append(np.searchsorted(marked, first), len(marked)), pa.int32())
                text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(rows[first], rows[-1]).astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                columns = [
                    conv.take(pa.array(first)), batch.column("shard").take(pa.array(first)), pa.array(made + np.arange(len(first))), pa.array(ends - first), text,
                    pa.ListArray.from_arrays(cuts, pa.array(starts)), pa.ListArray.from_arrays(cuts, pa.array(loss[marked])),
                ]
                made += len(first)
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "shard", "piece", "n_turns", "formatted", "loss_starts", "loss_lengths"])

    return ordered.mapInArrow(run, f"conv_id {kind}, shard int, piece long, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises if anything is left over."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
    return out


def parsed(pieces: DataFrame) -> DataFrame:
    """pieces with what they hold, read from the formatted text and the loss mask: n_turns, said and loss (bytes of all turns, of the loss), loss_chars, formatted_chars."""
    kind = dict(pieces.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "formatted", PIECE_BYTES):
                made: list[tuple] = []
                for formatted, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_lengths")), strict=True):
                    turns = parse(formatted)
                    loss = [unescaped(formatted[at : at + size]) for at, size in zip(starts, lengths, strict=True)]
                    made.append((len(turns), "".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass"), "".join(loss).encode("utf-8", "surrogatepass"), sum(map(len, loss)), len(formatted)))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "shard", "piece")), *columns], ["conv_id", "shard", "piece", "n_turns", "said", "loss", "loss_chars", "formatted_chars"])

    return pieces.select("conv_id", "shard", "piece", "formatted", "loss_starts", "loss_lengths").mapInArrow(run, f"conv_id {kind}, shard int, piece long, n_turns long, said binary, loss binary, loss_chars long, formatted_chars long")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted text and the loss mask."""
    kind = dict(pieces.dtypes)["conv_id"]
    ordered = parsed(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "shard", "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, turns, loss, counts = None, None, None, [0, 0, 0]

        def close() -> None:
            if turns is not None:
                done.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        types = None
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            numbers = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "loss_chars", "formatted_chars")), strict=True)
            for k, (own, *more) in enumerate(numbers):
                if turns is None or own != conv:
                    close()
                    conv, turns, loss, counts = own, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(batch.column("said")[k].as_buffer())
                loss.update(batch.column("loss")[k].as_buffer())
                counts = [a + b for a, b in zip(counts, more, strict=True)]
            if done:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(turns: DataFrame) -> DataFrame:
    """format_turns(), written once, and read back."""
    return read_back(settle_wide(format_turns(turns)))
