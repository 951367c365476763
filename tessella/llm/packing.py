"""Token-id output: texts as ids, packed into rows of a fixed length.

Method: texts become ids of a byte-level BPE vocabulary, each closed by ``eos``. A document longer than the context is
split into consecutive pieces, which keep their number, so nothing is lost. Pieces are packed best-fit
decreasing: in the order of falling length, each goes to the open row with the least room that still holds
it; that room is found in a segment tree over the capacities, whose leaves count the open rows with so much room.

Packing works on windows of ``WINDOW`` tokens within a partition of the input: a window's memory is bounded, no token is
shuffled, and with thousands of rows to a window the waste at its end is small. Each output row carries the
packed ids (little-endian, padded with ``eos``), the cumulative segment lengths, the places where positions restart, and which
piece of which document each segment is.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices

CONTEXT, EOS, WINDOW, CACHE = 2048, 50256, 1 << 21, 100_000
#: Longer runs are encoded each time, so that the memory is bounded in bytes too.
REMEMBERED = 48
MAX_FILE_BYTES = 64 << 20
SCHEMA = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "segments array<struct<doc_id: long, piece: int, length: int>>"
)


class CapacityTree:
    """Counts of open rows by remaining room; ``at_least`` finds the smallest room that is not below a length."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, length: int) -> int:
        """-1 if no open row has so much room."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:  # climb until a right sibling has rows, then go down its leftmost path
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], context: int) -> list[list[int]]:
    """Rows as lists of item numbers; no item may exceed the context. Of equal lengths the
    lower item comes first, of rows with equal room the older one takes it."""
    tree, open_rows, rows = CapacityTree(context), [[] for _ in range(context + 1)], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        room = tree.at_least(n)
        if room < 0:
            row, room = len(rows), context
            rows.append([])
        else:
            row = heapq.heappop(open_rows[room])
            tree.add(room, -1)
        rows[row].append(item)
        if room > n:
            heapq.heappush(open_rows[room - n], row)
            tree.add(room - n, 1)
    return rows


class Ids:
    """Texts to packed ids with a rank file; what stands between spaces is encoded once while it is remembered."""

    def __init__(self, ranks: bytes, pattern: str, eos: int, cache: int = CACHE):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.dtype = np.dtype("<u2" if max(eos, *table.values()) < 1 << 16 else "<u4")
        self.seen, self.most, self.eos = {}, cache, np.array([eos], self.dtype).tobytes()

    def _raw(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as bytes; empty for a text without tokens.

        A space between two other characters always opens a new piece of the pattern, so texts whose runs of
        white space begin with no lone space can be cut there; other texts are encoded at once.
        """
        if not text:
            return b""
        runs = text.split(" ")
        if any(not r or r[0].isspace() or r[-1].isspace() for r in runs):
            return self._raw(text) + self.eos
        seen, out = self.seen, [self._raw(runs[0])]
        for r in runs[1:]:
            found = seen.get(r)
            if found is None:
                found = self._raw(" " + r)
                if len(r) <= REMEMBERED:
                    if len(seen) >= self.most:
                        seen.clear()
                    seen[r] = found
            out.append(found)
        out.append(self.eos)
        return b"".join(out)


@lru_cache(2)
def _ids(ranks: bytes, pattern: str, eos: int) -> Ids:
    return Ids(ranks, pattern, eos)


def pack(pieces: list[tuple[int | None, int, bytes]], width: int, eos: bytes, context: int) -> list[tuple]:
    """Packed rows (without pack_id) of (doc_id, piece, ids) triples, in the order of SCHEMA."""
    rows = []
    for items in best_fit([len(p[2]) // width for p in pieces], context):
        chosen = [pieces[i] for i in items]
        lengths = [len(p[2]) // width for p in chosen]
        ends = np.cumsum([0, *lengths]).tolist()
        ids = b"".join(p[2] for p in chosen) + eos * (context - ends[-1])
        rows.append((ends[-1], ids, ends, ends[:-1], [{"doc_id": p[0], "piece": p[1], "length": n} for p, n in zip(chosen, lengths)]))
    return rows


def pack_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", context: int = CONTEXT,
               eos: int = EOS, window: int = WINDOW) -> DataFrame:
    """The columns of SCHEMA: one row for each packed row of ``context`` ids.

    Null and empty texts give no segment; null keys are kept as such; repeated rows are packed each; an empty table
    gives an empty table; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    with open(path, "rb") as f:
        ranks = f.read(MAX_FILE_BYTES)
    held = df.sparkSession.sparkContext.broadcast(ranks)
    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(held.value, pattern, eos)
        width, first, made = ids.dtype.itemsize, TaskContext.get().partitionId() << 40, 0
        pieces, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = pack(pieces, width, ids.eos, context)
            numbers = range(first + made, first + made + len(rows))
            made += len(rows)
            columns = [list(numbers), *map(list, zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = ids.encode(text_)
                for piece, at in enumerate(range(0, len(raw), context * width)):
                    pieces.append((doc_id, piece, raw[at : at + context * width]))
                    size += len(pieces[-1][2]) // width
                    if size >= window:
                        yield flush()
                        pieces, size = [], 0
        if pieces:
            yield flush()

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: a row of ``ids`` is a row of the id matrix."""
    packed.write.mode("overwrite").parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions that restart at each segment."""
    starts = np.repeat(cu_seqlens[:-1], np.diff(cu_seqlens))
    return np.arange(cu_seqlens[-1]) - starts
