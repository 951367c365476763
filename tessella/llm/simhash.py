"""Near-duplicate groups by SimHash fingerprints, compared bit-sliced.

Fingerprint: A-Z in lower case, words between ASCII white space, shingles of ``shingle`` words with repeats (a
shorter text is one shingle). A bit is set where over half of the shingles' XXH64 hashes have it; a text without
words has fingerprint zero. Fingerprints wider than 64 bits take their further words from mixes of the same hash.

Candidates: ``tables`` gives bit masks. Two fingerprints are compared if they agree under some mask. With
``pigeonhole_tables`` no pair within the radius is missed: the bits are cut into radius + 1 or more parts, one
table for each choice of parts that must stay equal. ``sampled_tables`` serves wide radii, for which that would
compare everything: random masks, as many as reach the stated recall at the stated bit difference.

Comparison: in each table the fingerprints of a key are laid out as vertical bit planes, 64 to a machine word. For
a fingerprint against such a block, every plane is XORed with its bit and added to bitwise counters by
carry-save, so that one operation counts for 64 distances; a block is abandoned as soon as all 64 counters
have passed the radius. Every hit is united at once within its task, which emits one link for each fingerprint and not one for each
pair. Keys with more than ``TILE`` fingerprints are dealt out as tiles (pairs of chunks of at most about TILE rows), so a
group of any size is compared whole by many tasks.

Groups: links between fingerprints go through the library's connected components (rounds of min-label hooking and
pointer jumping over DataFrames, checkpointed in the shared folder). Equal texts are one fingerprint from the start, so
copies cost nothing but one aggregation; nothing is collected to the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh, map_rows, slices
from tessella.operators.components import connected_components
from tessella.session import checkpoint

SEED = 42
TILE = 4096
ITEMS = 1 << 15
LARGE, LARGE_STEP = 512, 128
SALTS = 32
#: So many keys of more than ``TILE`` rows are broadcast (16 bytes each); more are joined by a shuffle.
HEAVY = 50_000
#: Bits of a sampled mask. Keys of chance hold n / 2^WIDTH fingerprints; a wider mask takes more tables for the same recall.
WIDTH = 14

_LANES = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash made from h (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(k * _STEP & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it: byte-wide lanes are summed 255 hashes at a time."""
    n = len(h)
    lanes = _LANES[h.view(np.uint8).reshape(n, 8)]
    if n <= 255:
        counts = lanes.sum(0).view(np.uint8).astype(np.int64)
    else:
        cuts = np.arange(0, n, 255)
        counts = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of each shingle of the whole text, repeats included; empty for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.append(0, ends[: n - 1]).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> list[int]:
    """The fingerprint as ``words`` unsigned 64-bit numbers."""
    return _fingerprint(shingle_hashes(text, shingle), words)


def _fingerprint(h: np.ndarray, words: int) -> list[int]:
    if not len(h):
        return [0] * words
    return [_majority(h if not k else _mix(h, k)) for k in range(words)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp array<long>`` (the numbers' bits) for every row, in one pass over whole texts."""
    whole = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    return map_rows(
        rows,
        lambda: lambda i, h, t: (i, h, [_signed(x) for x in fingerprint(t, shingle, words)]),
        "doc_id long, text_hash long, fp array<long>",
    )


def pigeonhole_tables(bits: int, radius: int, parts: int) -> list[tuple[int, ...]]:
    """Masks such that any two fingerprints within ``radius`` bits agree under at least one: exact."""
    if parts <= radius:
        raise ValueError("there must be more parts than bits that may differ")
    edges = [bits * i // parts for i in range(parts + 1)]
    return [
        tuple(b for p in chosen for b in range(edges[p], edges[p + 1]))
        for chosen in combinations(range(parts), parts - radius)
    ]


def sampled_tables(bits: int, differ: int, width: int, recall: float, seed: int = SEED) -> list[tuple[int, ...]]:
    """Random masks of ``width`` bits; a pair that differs in ``differ`` bits meets in one with chance ``recall``."""
    meet = math.prod((bits - differ - i) / (bits - i) for i in range(width))
    rng = np.random.default_rng(seed)
    count = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    return [tuple(sorted(rng.choice(bits, width, replace=False).tolist())) for _ in range(count)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """n x w numbers -> bits x ceil(n / 64) words: bit j of word b of plane p is bit p of fingerprint 64 b + j."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    pad = -len(fps) % 64
    packed = np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def close_pairs(queries: np.ndarray, blocks: np.ndarray, items: Iterator[tuple[np.ndarray, np.ndarray]], radius: int, place: np.ndarray | None = None):
    """Yields (query, candidate) index arrays of the pairs within ``radius``.

    ``queries``: n x w numbers; ``blocks``: bit planes as from ``_planes``; ``items``: index arrays of queries and of the blocks
    that each is held against. Counters have as many bits as radius + 1 needs, with one sticky word for overflow.
    ``place``: where each query itself stands in the blocks; the lanes of its block up to its own are then left out.
    """
    bits = len(blocks)
    qbits = np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").T
    flip = np.ascontiguousarray(np.where(qbits, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)))
    depth = max(1, (radius + 1).bit_length())
    start = (1 << depth) - 1 - radius  # counters begin so high that the first distance beyond the radius overflows
    for qi, bi in items:
        counters = [np.full(len(qi), 0xFFFFFFFFFFFFFFFF if start >> d & 1 else 0, np.uint64) for d in range(depth)]
        over = np.zeros(len(qi), np.uint64)
        if place is not None:
            mine = place[qi] // 64 == bi
            over[mine] = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - place[qi[mine]] % 64).astype(np.uint64)
        for p in range(bits):
            carry = blocks[p][bi] ^ flip[p][qi]
            for d in range(depth):
                c = counters[d]
                counters[d] = c ^ carry
                carry = carry & c
            over |= carry
            if p > radius and p % 8 == 7:
                live = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
                if len(live) < 0.8 * len(qi):
                    qi, bi, over = qi[live], bi[live], over[live]
                    counters = [c[live] for c in counters]
                    if not len(qi):
                        break
        if len(qi):
            found = np.unpackbits((~over).view(np.uint8).reshape(len(qi), 8), axis=1, bitorder="little")
            row, lane = np.nonzero(found)
            yield qi[row], bi[row] * 64 + lane


class _Union:
    """Union by smallest index over numpy arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            split = ra != rb
            if not split.any():
                return
            a, b, ra, rb = a[split], b[split], ra[split], rb[split]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = root[root]
                if np.array_equal(jumped, root):
                    break
                root[:] = jumped


def _items(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row against its blocks first..last, ITEMS at a time."""
    counts = last - first + 1
    ends = np.cumsum(counts)
    for at in range(0, int(ends[-1]), ITEMS):
        n = np.arange(at, min(at + ITEMS, int(ends[-1])))
        q = np.searchsorted(ends, n, side="right")
        yield q, first[q] + n - (ends[q] - counts[q])


def _large(fps: np.ndarray, queries: np.ndarray, rows: np.ndarray, union: _Union, radius: int) -> None:
    """Unites all of ``queries`` with all of ``rows`` that are close, some queries at a time.

    Rows are laid out anew each time in the order of their groups; blocks that lie wholly in a query's own group
    are passed over, as they can add nothing. So a dense group costs little more than its first few queries.
    """
    for at in range(0, len(queries), LARGE_STEP):
        q = queries[at : at + LARGE_STEP]
        order = rows[np.argsort(union.root[rows], kind="stable")]
        padded = np.pad(order, (0, -len(order) % 64), mode="edge")
        roots = union.root[padded].reshape(-1, 64)
        pure = np.where(roots[:, 0] == roots[:, -1], roots[:, 0], -1)
        need = union.root[q][:, None] != pure[None, :]
        qi, bi = np.nonzero(need)
        if not len(qi):
            continue
        items = ((qi[i : i + ITEMS], bi[i : i + ITEMS]) for i in range(0, len(qi), ITEMS))
        for x, c in close_pairs(fps[q], _planes(fps[padded]), items, radius):
            union.add(q[x], padded[c])


def _groups(fps: np.ndarray, keys: np.ndarray, chunk: np.ndarray, tile: np.ndarray, radius: int) -> np.ndarray:
    """Local roots of rows sorted by key. ``tile``: -1 where all of a key's rows meet; 1 where those of chunk 0 meet
    those of chunk 1.

    The rows of small keys are laid out without gaps, so a block holds many of them; a row meets the blocks from its own to
    the last of its key. What stands before it has met it already; a hit on a neighbouring key's row is a close pair like any other.
    """
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(cuts, len(keys)))
    union = _Union(len(fps))
    sided = tile[cuts] == 1
    small = (sizes > 1) & (sizes <= LARGE) & ~sided
    if small.any():
        ends = np.cumsum(sizes[small])
        order = np.repeat(cuts[small] - (ends - sizes[small]), sizes[small]) + np.arange(ends[-1])
        place, last = np.arange(len(order)), np.repeat((ends - 1) // 64, sizes[small])
        for q, c in close_pairs(fps[order], _planes(fps[order]), _items(place // 64, last), radius, place):
            real = c < len(order)
            union.add(order[q[real]], order[c[real]])
    for s, n, two in zip(*(x[(sizes > 1) & ~small].tolist() for x in (cuts, sizes, sided))):
        middle = s + int(np.count_nonzero(chunk[s : s + n] == 0)) if two else s
        if not two:
            _large(fps, np.arange(s, s + n), np.arange(s, s + n), union, radius)
        elif s < middle < s + n:
            _large(fps, np.arange(s, middle), np.arange(middle, s + n), union, radius)
    return union.root


def _key(table_no: int, mask: tuple[int, ...], words: int):
    """A fingerprint column's bits under a mask, with the table's number, as one hash-free string-less key struct."""
    masks = [0] * words
    for b in mask:
        masks[b // 64] |= 1 << (b % 64)
    return F.struct(
        F.lit(table_no).alias("t"),
        *[F.col("fp")[k].bitwiseAND(F.lit(_signed(m)).cast("long")).alias(f"k{k}") for k, m in enumerate(masks) if m],
        *[F.lit(0).cast("long").alias(f"k{k}") for k, m in enumerate(masks) if not m],
    )


def links(distinct: DataFrame, radius: int, tables: list[tuple[int, ...]], words: int = 1, tile: int = TILE) -> DataFrame:
    """``a, b array<long>``: links that connect all fingerprints of ``distinct`` (column ``fp``, unique) that meet
    in a table and lie within ``radius``; a spanning forest for each key or tile, not all pairs."""
    names = [f"k{k}" for k in range(words)]

    def ordered(t: int, mask: tuple[int, ...]):
        key = _key(t, mask, words)
        return F.struct(key["t"].alias("t"), *[key[n].alias(n) for n in names])

    keyed = distinct.select("fp", F.explode(F.array(*[ordered(t, m) for t, m in enumerate(tables)])).alias("key"))
    keyed = keyed.select("fp", F.xxhash64("key.t", *[f"key.{n}" for n in names]).alias("key"))
    heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    heavy = checkpoint(heavy.select("key", F.ceil(F.col("n") * 1.05 / tile).cast("int").alias("chunks")))
    heavy = F.broadcast(heavy) if heavy.count() <= HEAVY else heavy.hint("merge")
    placed = keyed.join(heavy, "key", "left").withColumn(
        "mine", F.pmod(F.xxhash64("fp", F.lit(11)), F.coalesce("chunks", F.lit(1))).cast("int")
    )
    light = placed.where("chunks is null").select("fp", "key", F.lit(0).alias("part"), F.lit(-1).alias("tile"), F.lit(0).alias("chunk"))
    # chunk i meets chunk j in tile (i, j), i <= j; tile (i, i) is chunk i by itself
    hot = placed.where("chunks is not null").select(
        "fp", "key", "chunks", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    hot = hot.select(
        "fp", "key", (low * F.col("chunks") + high).cast("int").alias("part"),
        F.when(F.col("mine") == F.col("other"), -1).otherwise(1).alias("tile"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("chunk"),
    )
    both = light.unionByName(hot)
    spread = both.withColumn("dealt", F.xxhash64("key", "part"))
    parts = spread.repartition(F.col("dealt")).sortWithinPartitions("dealt", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_keys(batches, words):
            fps, dealt, chunk, kind = frame
            root = _groups(fps, dealt, chunk, kind, radius)
            far = np.flatnonzero(root != np.arange(len(root)))
            if len(far):
                yield pa.RecordBatch.from_arrays([_longs(fps[far]), _longs(fps[root[far]])], ["a", "b"])

    slim = parts.select("fp", "dealt", F.col("chunk").cast("byte").alias("chunk"), F.col("tile").cast("byte").alias("tile"))
    return slim.mapInArrow(run, "a array<long>, b array<long>")


def _longs(fps: np.ndarray) -> pa.ListArray:
    n, w = fps.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(fps.ravel().view(np.int64)))


def _whole_keys(batches: Iterator[pa.RecordBatch], words: int):
    """The sorted batches as numpy arrays cut only between keys; what is held is a batch and one key's rest."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        fps = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
        now = (fps, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
        if not len(now[1]):
            continue
        rest.append(now)
        if now[1][0] == now[1][-1] and rest[0][1][0] == now[1][0]:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*rest))
        cut = int(np.flatnonzero(whole[1] != whole[1][-1])[-1]) + 1
        yield tuple(np.ascontiguousarray(x[:cut]) for x in whole)
        rest = [tuple(x[cut:] for x in whole)]
    if rest:
        yield tuple(np.ascontiguousarray(np.concatenate(x)) for x in zip(*rest))


def exact_tables(n: int, bits: int, radius: int) -> list[tuple[int, ...]]:
    """The pigeonhole tables that are cheapest for n fingerprints. All choices find the same pairs: every one within the radius.

    More parts mean more tables, but wider keys: a row costs, in each table, its shuffle (about as much as meeting eight
    blocks) and the blocks of 64 rows that share its key by chance.
    """
    def cost(parts: int) -> float:
        width = bits * (parts - radius) // parts
        return math.comb(parts, radius) * (8 + n / 2.0**width / 64)

    return pigeonhole_tables(bits, radius, min(range(radius + 1, min(bits, 2 * radius + 2) + 1), key=cost))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1, radius: int = 4,
           recall: float | None = None, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, fp array<long>, root array<long>, component_id`` for every row of ``df``.

    component_id is the least doc_id of the rows whose fingerprints are linked, directly or through others; root is
    the component's least fingerprint. Without ``recall`` every pair within the radius is found; with it, pairs
    at the radius are found with that chance at least, nearer pairs more surely.
    Null and empty texts have fingerprint zero and are linked like any other. Null keys take part but do not name a
    component (component_id is null only if all its keys are); repeated rows stay; an empty table gives an empty
    table; other columns are not read.
    """
    docs = checkpoint(fingerprints(df, key, text, shingle, words))
    distinct = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    bits = 64 * words
    tables = exact_tables(distinct.count(), bits, radius) if recall is None else sampled_tables(bits, radius, width, recall)
    edges = links(distinct.select("fp"), radius, tables, words, tile)
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root").hint("merge")
    named = checkpoint(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = ids.where("n > 1").select("root", "component_id")
    # a component may hold any part of the fingerprints, a fingerprint any part of the rows: both are met by salts
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    named = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(ids, ["root", "salt"], "left")
    named = named.select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))
    return docs.join(named.hint("merge"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def shared_families(nodes: DataFrame, radius: int, tables: list[tuple[int, ...]], words: int, tile: int, weight: int) -> DataFrame:
    """``text_hash, null, number, family, chunks`` of the texts whose fingerprints are linked to another's or equal to it.

    A family holds all texts that SimHash may take for similar; ``chunks`` is into how many parts it is cut to be compared.
    """
    edges = links(checkpoint(nodes.select("fp").distinct()), radius, tables, words)
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root").hint("merge")
    named = nodes.join(roots, "fp", "left").select(
        "text_hash", "null", "number", "size", F.xxhash64(F.coalesce("root", "fp")).alias("family")
    )
    named = checkpoint(named)
    shared = named.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("sum")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / tile, F.col("sum") / weight)).cast("int")
    shared = shared.select("family", F.greatest(F.lit(1), F.least(chunks, F.col("n").cast("int"))).alias("chunks"))
    # a family may hold any part of the texts: it is met by salts, not in one task
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    named = named.withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.lit(SALTS)).cast("int"))
    return named.join(shared, ["family", "salt"]).select("text_hash", "null", "number", "family", "chunks")


def _similar(sets: list[np.ndarray], side: np.ndarray | None, share: Fraction) -> np.ndarray:
    """Local roots of sets (sorted unique numbers) linked by a Jaccard similarity of at least ``share``, each with any
    other, or, with ``side``, only with those of the other side.

    From each set those not yet reached are searched, so a group of similar sets costs little more than its first search.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values) + 1, np.int64)
    root, rest = np.arange(len(sets)), np.arange(len(sets))
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            low, high = np.minimum(sizes[rest], sizes[q]), np.maximum(sizes[rest], sizes[q])
            fits = share.denominator * low >= share.numerator * high
            x = rest[fits if side is None else fits & (side[rest] != side[q])]
            if not len(x):
                continue
            own = ids[starts[q] : starts[q] + sizes[q]]
            mark[own] = 1
            ends = np.cumsum(sizes[x])
            at = np.repeat(starts[x] - ends + sizes[x], sizes[x]) + np.arange(ends[-1])
            sums = np.append(0, np.cumsum(mark[ids[at]]))
            mark[own] = 0
            common = sums[ends] - sums[ends - sizes[x]]
            hit = x[share.denominator * common >= share.numerator * (sizes[x] + sizes[q] - common)]
            if len(hit):
                root[hit] = first
                queue.extend(hit.tolist())
                rest = rest[root[rest] != first]
    return root


def verified(sets: DataFrame, share: Fraction) -> DataFrame:
    """``a, b``: text hashes linked by the exact similarity of their sets; a spanning forest for each family or tile of it.

    ``sets``: text_hash, family, chunks, set (unique shingle hashes as bytes). A family of several chunks is compared as
    tiles, each chunk with itself and with every other, so all its pairs meet.
    """
    mine = F.pmod(F.xxhash64("text_hash", F.lit(11)), F.col("chunks")).cast("int")
    every = sets.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    part = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    spread = every.select(F.xxhash64("family", part).alias("dealt"), side.cast("int").alias("side"), "text_hash", "set")
    parts = spread.repartition(F.col("dealt")).sortWithinPartitions("dealt")

    def linked(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        side = np.array([s for s, _, _ in rows])
        root = _similar([np.frombuffer(x, np.uint64) for _, _, x in rows], None if side[0] < 0 else side, share)
        for i in np.flatnonzero(root != np.arange(len(rows))).tolist():
            yield rows[i][1], rows[root[i]][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for piece in slices(batch) for r in zip(*(c.to_pylist() for c in piece.columns)))
        for _, tile in groupby(rows, key=itemgetter(0)):
            found = list(linked([r[1:] for r in tile]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return parts.mapInArrow(run, "a long, b long")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, words: int = 4, radius: int = 64,
             differ: int = 45, recall: float = 0.98, similarity: float = 0.8, tile: int = 1024, weight: int = 1 << 19, width: int = WIDTH) -> DataFrame:
    """The rows of ``df``, one for each group of near duplicates: that with the least key, of equal keys the least text
    hash, of equal rows any. All columns stay as they are.

    Near duplicates are texts whose sets of shingles (as 64-bit hashes) have a Jaccard similarity of ``similarity`` or more, directly or
    through others. SimHash, here over each shingle once, only proposes: texts that meet in a mask (a pair ``differ`` bits apart with chance ``recall``) and lie
    within ``radius`` bits, directly or through others, are a family, and within it every pair is held to the exact
    similarity. At 0.8 over sets of equal size the expected difference is 39 of 256 bits with a deviation of 6, so that about 1 of 100
    such pairs is not proposed, at 0.9 about 1 of 10,000. The masks are fixed by the parameters and do not depend on the table.
    """
    held, null, number, hashed = (fresh(df, x) for x in ("row", "null", "number", "hash"))
    whole, number_of = F.col(f"`{text}`").cast("string"), F.col(f"`{key}`").cast("long")

    def described(i, h, t):
        hashes = np.unique(shingle_hashes(t, shingle))  # a repeated line must not outweigh the rest
        return i, h, [_signed(x) for x in _fingerprint(hashes, words)], len(hashes)

    docs = df.select(number_of.alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    docs = map_rows(docs, lambda: described, "doc_id long, text_hash long, fp array<long>, size long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("number"))).alias("x")
    nodes = docs.groupBy("text_hash").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"))
    nodes = checkpoint(nodes.select("text_hash", "x.null", "x.number", "fp", "size"))
    tables = sampled_tables(64 * words, differ, width, recall)
    shared = shared_families(nodes, radius, tables, words, tile, weight)

    texts = df.select(number_of.isNull().alias("null"), F.coalesce(number_of, F.lit(0)).alias("number"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    texts = texts.join(shared, ["null", "number", "text_hash"]).dropDuplicates(["text_hash"])
    sets = map_rows(
        texts.select("text_hash", "family", "chunks", "text"),
        lambda: lambda h, f, c, t: (h, f, c, np.unique(shingle_hashes(t, shingle)).tobytes()),
        "text_hash long, family long, chunks int, set binary",
    )
    roots = connected_components(verified(sets, Fraction(str(similarity)))).select(F.col("node").alias("text_hash"), "root").hint("merge")
    least = nodes.join(roots, "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("root"))
    least = least.agg(F.min(F.struct("null", "number", "text_hash")).alias("x"))
    chosen = least.select(F.col("x.null").alias(null), F.col("x.number").alias(number), F.col("x.text_hash").alias(hashed))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(held), number_of.isNull().alias(null),
        F.coalesce(number_of, F.lit(0)).alias(number), F.xxhash64(whole).alias(hashed),
    )
    kept = rows.join(chosen, [null, number, hashed]).dropDuplicates([null, number, hashed])
    return kept.select(f"{held}.*")


def hex_of(fp: Column) -> Column:
    """A fingerprint of one word as 16 hex digits."""
    return F.lower(F.lpad(F.hex(fp[0]), 16, "0"))
