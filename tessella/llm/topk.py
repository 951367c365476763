"""Exact top-k search by inner product, with vectors bucketed by length.

Method: vectors are grouped by length: a cell holds those whose norm lies within a factor 2^(1/8), and large cells are dealt into
buckets of about ``bucket_rows`` by a hash of the id, so equal lengths and copies spread. Queries form blocks of about
``query_rows``; each (bucket, block) is one task group. First the bucket of the greatest lengths gives every query its k-th
best score so far, theta. In any other bucket, the local cosine threshold t = theta / (|q| max |p|) decides:

* t > 1: no vector of the bucket can reach theta, the query passes the bucket over; a bucket is sent only to blocks with a query left;
* t >= ``COORDINATE_AT``: coordinate pruning: a unit vector within cosine t of the query's has each coordinate in an
  interval around the query's; the bucket is cut by the sorted values of the query's largest coordinates;
* else length pruning: the vectors, sorted by norm, are cut where |p| |q| < theta.

What is left is verified by exact integer products. The buckets' best k are ranked for each query by (score, vec_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import checkpoint

SCALE, BUCKET_ROWS, QUERY_ROWS = 1024, 16384, 2048
COORDINATE_AT, FOCUS = 0.6, 3
SLACK = 1e-9
#: Scaled components are longs: greater ones cannot be held.
MOST = float(2**63 // SCALE)


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v array<long>, norm``: each component x as floor(SCALE * x); each distinct (id, vector) once.

    Rows with a null id, a null vector, a null or non-finite component, or one that scaled is no long (from 2^53 on) are left out.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    sound = rows.where("vec_id is not null and x is not null and forall(x, e -> e is not null and not isnan(e))")
    sound = sound.where(F.forall("x", lambda e: F.abs(e) < MOST))
    ints = sound.select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("long")).alias("v")).distinct()
    return ints.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products; in doubles where every sum stays below 2^53, else in 64-bit integers.

    Sums that wrap around are right where the product itself is a long; pairs for which doubles cannot tell are computed in
    Python integers, in an object array.
    """
    big = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if big < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    found = q @ c.T
    if big >= 2**62:
        a, b = q.astype(np.float64), c.astype(np.float64).T
        error = (np.abs(a) @ np.abs(b)) * (q.shape[1] + 4) * 2.0**-52
        unsure = np.argwhere(np.abs(a @ b) + error >= 2**62).tolist()
        if unsure:
            found = found.astype(object)
            for i, j in unsure:
                found[i, j] = sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist()))
    return found


def search(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query row, candidate row, score) arrays of each query's best k candidates that can reach its theta.

    theta: each query's k-th best score so far, as a double, -inf if unknown. Ties go to the smaller id; a query's own id is no candidate.
    """
    qn, cn = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((c.astype(np.float64) ** 2).sum(1))
    by_norm = np.lexsort((ids, -cn))
    ids, c, cn = ids[by_norm], c[by_norm], cn[by_norm]
    top = cn[0] if len(cn) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(qn * top > 0, theta / (qn * top), np.where(theta > 0, np.inf, -np.inf))
    out = []

    def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (ids[rows] != q_ids[i]) & (scores.astype(np.float64) >= theta[i])
        rows, scores = rows[ok], scores[ok]
        if scores.dtype == object:
            best = sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))[:k]
            rows, scores = rows[best], scores[best]
            if any(not -(2**63) <= x < 2**63 for x in scores):
                raise OverflowError("a score among a bucket's best does not fit in a long")
            scores = scores.astype(np.int64)
        if len(rows) > k:
            edge = np.partition(scores, -k)[-k]
            rows, scores = rows[scores >= edge], scores[scores >= edge]
        order = np.lexsort((ids[rows], -scores))[:k]
        out.append((np.full(len(order), i), by_norm[rows[order]], scores[order]))

    narrow = np.flatnonzero((t >= COORDINATE_AT) & (t <= 1 + SLACK))
    if len(narrow):
        unit = c / np.where(cn == 0, 1, cn)[:, None]
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in narrow.tolist():
            u, x = q[i] / qn[i], min(1.0, t[i])
            best = np.arange(len(c))
            spans = []
            for f in np.argsort(-np.abs(u))[:FOCUS].tolist():
                if f not in sorted_by:
                    order = np.argsort(unit[:, f], kind="stable")
                    sorted_by[f] = (order, unit[order, f])
                reach = np.sqrt((1 - x * x) * max(0.0, 1 - u[f] * u[f])) + SLACK
                low, high = u[f] * x - reach, u[f] * x + reach
                # beyond the cap's edge the interval reaches to the pole
                high = 1.0 if u[f] >= x else high
                low = -1.0 if -u[f] >= x else low
                a, b = np.searchsorted(sorted_by[f][1], [low - SLACK, high + SLACK])
                spans.append((b - a, f, a, b, low - SLACK, high + SLACK))
            _, f, a, b, *_ = min(spans)
            best = sorted_by[f][0][a:b]
            for _, g, _, _, low, high in spans:
                if g != f:
                    best = best[(unit[best, g] >= low) & (unit[best, g] <= high)]
            keep(i, best, _products(q[i : i + 1], c[best])[0])
    wide = np.flatnonzero(t < COORDINATE_AT)
    for at in range(0, len(wide), 256):
        some = wide[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(theta[some] > 0, theta[some] / qn[some], -np.inf)
        cut = int(np.searchsorted(-cn, -(shortest.min() * (1 - SLACK)), side="right"))
        scores = _products(q[some], c[:cut])
        for i, row, low in zip(some.tolist(), scores, shortest.tolist()):
            n = int(np.searchsorted(-cn[:cut], -(low * (1 - SLACK)), side="right"))
            keep(i, np.arange(n), row[:n])
    return out


def _hits(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the groups of (dim, bucket, block); queries bring their theta."""
    keys = ["dim", "bucket", "block"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids = left["vec_id"].to_numpy()
        q_ids = right["query_id"].to_numpy()
        theta = right["theta"].to_numpy()
        found = [] if not len(ids) or not len(q_ids) else search(q_ids, _matrix(right["q"], dim), theta, ids, _matrix(left["v"], dim), k)
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q_ids[a] if len(a) else a, "vec_id": ids[b] if len(b) else b, "score": s.astype(np.int64)})

    return (
        rows.select(*[F.col(c).alias(f"r_{c}") for c in keys], "vec_id", "v").groupBy(*[f"r_{c}" for c in keys])
        .cogroup(queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], "query_id", "q", "theta").groupBy(*[f"q_{c}" for c in keys]))
        .applyInArrow(run, "query_id long, vec_id long, score long")
    )


def top_k(rows: DataFrame, is_query: Column, k: int = 10, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank int, vec_id, score long`` for the rows of ``rows`` (as from ``quantized``) that pass ``is_query``.

    All other ids are candidates, of the same number of components; scores are inner products, ties go to the
    smaller vec_id, and a query with fewer than k candidates gets them all. An empty table gives an empty table.
    """
    cell = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(-1).cast("int")
    rows = checkpoint(rows.withColumn("dim", F.size("v")).withColumn("cell", cell))
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    sizes = checkpoint(counts.select("dim", "cell", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    name = (F.col("cell").cast("long") * F.lit(2**32) + F.col("part")).alias("bucket")
    placed = rows.join(sizes, ["dim", "cell"]).withColumn("part", part).select("dim", name, "vec_id", "v", "norm")
    asked = rows.where(is_query)
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    blocks = checkpoint(blocks)
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int")
    asked = asked.join(blocks, "dim").select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "norm", block.alias("block"))
    buckets = checkpoint(placed.groupBy("dim", "bucket").agg(F.max("norm").alias("top")))
    heads = buckets.groupBy("dim").agg(F.max("bucket").alias("bucket"))
    first = asked.join(heads, "dim").withColumn("theta", F.lit(float("-inf")))
    every = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "block")
    heads_rows = placed.join(heads.join(every, "dim"), ["dim", "bucket"])
    begun = checkpoint(_hits(first, heads_rows, k))
    kth = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("s")).otherwise(float("-inf")).alias("theta"))
    rest = buckets.join(heads, ["dim", "bucket"], "left_anti")
    # a bucket that no query of a block can still gain from (t > 1) is passed over before its vectors are sent there
    bars = asked.join(kth, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    open_ = F.col("theta") <= F.col("norm") * F.col("top") * (1 + SLACK)
    meet = checkpoint(bars.select("dim", "block", "query_id", "norm", "theta").join(rest, "dim").where(open_).select("query_id", "theta", "dim", "bucket", "block"))
    more = asked.select("query_id", "q").join(meet, "query_id")
    alive = meet.select("dim", "bucket", "block").distinct()
    found = begun.union(_hits(more, placed.join(alive, ["dim", "bucket"]), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
