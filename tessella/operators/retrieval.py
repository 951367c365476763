"""Ranking and fusion, batched over queries: BM25, exact cosine search, reciprocal rank fusion, span look-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.functions.text import tokens
from tessella.session import checkpoint

K1, B, EPSILON = 1.5, 0.75, 0.25
K_RRF = 60
#: So many weighted query tokens are broadcast; more are joined by a shuffle.
SMALL = 100_000


def term_counts(units: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """``unit_id, token, tf, size``: token counts and the unit's number of tokens, in one shuffle on the unit."""
    found = units.select(F.col(key).alias("unit_id"), tokens(F.col(text)).alias("found"))
    words = found.select("unit_id", F.size("found").alias("size"), F.explode("found").alias("token"))
    return words.groupBy("unit_id", "token").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def idf(counts: DataFrame, n_units: Column | int) -> DataFrame:
    """``token, df, idf``: ln((n - df + .5) / (df + .5)); negative ones become EPSILON times the mean over the vocabulary."""
    return idf_of(counts.groupBy("token").agg(F.count("*").alias("df")), n_units)


def idf_of(df: DataFrame, n_units: Column | int) -> DataFrame:
    """The same from ``token, df``."""
    raw = df.withColumn("raw", F.log(n_units - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("token", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, unit_id, score`` of the units that share a token with a query; scores of 0 are left to the tail.

    ``units``: unit_id, text; ``queries``: query_id, text. Repeated query tokens count as often as they stand. Scores are rounded
    to 9 places. Texts are tokenised once; only postings of query tokens are joined, so the data that move are bounded
    by matching postings.
    """
    counts = checkpoint(term_counts(units))
    n = units.count()
    mean_size = (counts.agg(F.sum("tf")).first()[0] or 0) / max(n, 1) or 1.0
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qn"))
    weighted = checkpoint(asked.join(idf(counts, n), "token"))
    weighted = F.broadcast(weighted) if weighted.count() <= SMALL else weighted
    norm = K1 * (1 - B + B * F.col("size") / mean_size)
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scores = counts.join(weighted, "token").groupBy("query_id", "unit_id").agg(F.round(F.sum(part), 9).alias("score"))
    return scores.where("score <> 0")


def bm25(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, unit_id, score, rank``: the first k of all units for each query that is not null.

    Units without a query token score 0 and stand, by unit, behind positive scores and before negative ones. A null text counts as empty.
    """
    scores = checkpoint(bm25_scores(units, queries))
    by = scores.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") < 0).alias("below"))
    every = checkpoint(queries.select("query_id").distinct().join(by, "query_id", "left").fillna(0, ["above", "below"]))
    short = every.where(F.col("above") < k)
    # the lowest units are enough: of each query they lose only those that have a negative score
    spare = short.agg(F.max("below")).first()[0] or 0
    zeros = short.select("query_id", _lowest(units, k + spare)).join(scores.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")
    return ranked(scores.unionByName(zeros.withColumn("score", F.lit(0.0))), k)


def _lowest(units: DataFrame, n: int) -> Column:
    """The n least units, for each row: a literal list, as n is a rank asked for and some."""
    ids = [r["unit_id"] for r in units.select("unit_id").orderBy("unit_id").limit(n).collect()]
    return F.explode(F.array(*map(F.lit, ids)).cast(f"array<{dict(units.dtypes)['unit_id']}>")).alias("unit_id")


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", held: bool = False) -> DataFrame:
    """Adds each row's number from 1 within ``by``, however many rows a group has; ``held`` rows are a checkpointed table already.

    Rows are dealt out by ranges of group and order, numbered within each part, and each part adds what stands before it: a
    table of a row for each group and part.
    """
    placed = checkpoint((rows if held else checkpoint(rows)).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    offsets = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    return placed.withColumn("__own", own).join(offsets, [*by, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


class Lexical:
    """The lexical ranking of all units for each query, of which only units with a query token are held."""

    def __init__(self, units: DataFrame, queries: DataFrame):
        self.units = units.select("unit_id")
        scores = checkpoint(bm25_scores(units, queries))
        sizes = scores.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("above"), F.count("*").alias("held"))
        self.sizes = checkpoint(queries.select("query_id").distinct().join(sizes, "query_id", "left").fillna(0, ["above", "held"]))
        n = self.units.count()
        ranks = numbered(scores, ["query_id"], [F.desc("score"), F.col("unit_id")], "own", held=True).join(self.sizes, "query_id")
        rank = F.when(F.col("score") > 0, F.col("own")).otherwise(F.col("own") + n - F.col("held"))
        self.held = checkpoint(ranks.select("query_id", "unit_id", rank.alias("rank")))

    def top(self, k: int) -> DataFrame:
        """The first k units of each query: ``query_id, unit_id, rank``."""
        spare = self.sizes.agg(F.max(F.when(F.col("above") < k, F.col("held")))).first()[0] or 0
        short = self.sizes.where(F.col("above") < k).select("query_id", _lowest(self.units, k + spare))
        return self.ranks(short).unionByName(self.held).distinct().where(F.col("rank") <= k)

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """The rank of each pair (query_id, unit_id), of units without a query token too.

        Such a unit stands behind the positive scores and the units before it that have no query token either: its number among all
        units less the number of held ones before it.
        """
        pairs = checkpoint(pairs.select("query_id", "unit_id").distinct())
        known = pairs.join(self.held, ["query_id", "unit_id"])
        tail = pairs.join(self.held.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti").join(self.sizes.select("query_id"), "query_id", "left_semi")
        marked = tail.withColumn("asked", F.lit(1)).unionByName(self.held.select("query_id", "unit_id", F.lit(0).alias("asked")))
        marked = marked.join(tail.select("query_id").distinct(), "query_id", "left_semi")
        upto = numbered(marked, ["query_id"], [F.col("unit_id")], "upto").where("asked = 1")
        own = Window.partitionBy("query_id").orderBy("unit_id")
        place = numbered(self.units, [], [F.col("unit_id")], "place")
        found = upto.withColumn("own", F.row_number().over(own)).join(place, "unit_id").join(self.sizes, "query_id")
        rank = F.col("above") + F.col("place") - (F.col("upto") - F.col("own"))
        return known.select("query_id", "unit_id", "rank").unionByName(found.select("query_id", "unit_id", rank.alias("rank")))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` within each query by falling score, then unit; keeps the first k if that is given (Spark's group limit
    keeps k rows for each query and partition before the shuffle)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    if k is None:
        return numbered(scores, ["query_id"], [F.desc("score"), F.col("unit_id")])
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unit_vector(vector: Column) -> Column:
    """The vector in doubles, of length 1; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def every_pair(units: DataFrame, queries: DataFrame, rows: int = 4096) -> DataFrame:
    """``query_id, unit_id`` of every unit with every query, as an equi-join of parts of the units and blocks of the queries."""
    parts, blocks = max(8, -(-units.count() // rows)), max(1, -(-queries.count() // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = units.select("unit_id", own("unit_id", parts).alias("part"), every(blocks).alias("block"))
    b = queries.select("query_id", own("query_id", blocks).alias("block"), every(parts).alias("part"))
    return a.join(b, ["part", "block"]).select("query_id", "unit_id")


def _blocks(units: DataFrame, queries: DataFrame, rows: int, make, schema: str) -> DataFrame:
    """Runs ``make(unit ids, unit vectors, query rows)`` for each part of the units and block of queries; every unit meets every query.

    What is copied grows with the number of blocks, not with the pairs.
    """
    parts, blocks = max(8, -(-units.count() // rows)), max(1, -(-queries.count() // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = units.withColumn("part", own("unit_id", parts)).withColumn("block", every(blocks))
    b = queries.withColumn("block", own("query_id", blocks)).withColumn("part", every(parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        u, q = (np.stack([np.asarray(v, np.float64) for v in t.column("vector").to_pylist()]) for t in (left, right))
        return pa.table(make(left["unit_id"].to_numpy(), right, np.round(q @ u.T, 9)), schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return a.groupBy("part", "block").cogroup(b.groupBy("part", "block")).applyInArrow(run, schema)


def cosine_ranks(units: DataFrame, queries: DataFrame, k: int, itself: bool = False, rows: int = 4096) -> DataFrame:
    """``query_id, unit_id, score, rank``: the first k of all units by cosine; a stated query set against all rows.

    ``units``: unit_id, vector; ``queries``: query_id, vector. Null vectors take no part; scores are rounded to 9 places before ranking, ties go
    to the smaller unit. Blocks of units and queries meet as matrices, and each keeps its k best of each query.
    """
    a, b = _unit_vectors(units, "unit_id"), _unit_vectors(queries, "query_id")

    def best(ids: np.ndarray, asked: pa.Table, scores: np.ndarray) -> dict:
        q_ids = asked["query_id"].to_numpy()
        if not itself:
            scores[q_ids[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
        kept = np.take_along_axis(scores, order, 1)
        row, col = np.nonzero(kept > -np.inf)
        return {"query_id": q_ids[row], "unit_id": ids[order[row, col]], "score": kept[row, col]}

    return ranked(_blocks(a, b, rows, best, "query_id long, unit_id long, score double"), k)


def cosine_rank_of(units: DataFrame, queries: DataFrame, pairs: DataFrame, rows: int = 4096) -> DataFrame:
    """``query_id, unit_id, rank``: where each pair stands in the ranking of all units by cosine (each query's own unit included).

    Every block counts how many of its units stand before each asked one, so no ranking is ever written out.
    """
    a, b = _unit_vectors(units, "unit_id"), _unit_vectors(queries, "query_id")
    pairs = pairs.select("query_id", "unit_id").distinct().join(a.withColumnRenamed("vector", "u"), "unit_id").join(b, "query_id")
    dot = F.aggregate(F.zip_with("u", "vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = pairs.select("query_id", F.struct(F.round(dot, 9).alias("score"), "unit_id").alias("x")).groupBy("query_id").agg(F.collect_list("x").alias("asked"))

    def before(ids: np.ndarray, right: pa.Table, scores: np.ndarray) -> dict:
        out = ([], [], [])
        for q, wanted, row in zip(right["query_id"].to_pylist(), right["asked"].to_pylist(), scores):
            order = np.lexsort((ids, -row))
            score, unit = -row[order], ids[order]
            for x in wanted:
                lo, hi = np.searchsorted(score, -x["score"] - 5e-10, "left"), np.searchsorted(score, -x["score"] + 5e-10, "right")
                for column, value in zip(out, (q, x["unit_id"], int(lo + np.searchsorted(unit[lo:hi], x["unit_id"], "left")))):
                    column.append(value)
        return dict(zip(("query_id", "unit_id", "n"), out))

    counted = _blocks(a, b.join(asked, "query_id"), rows, before, "query_id long, unit_id long, n long")
    return counted.groupBy("query_id", "unit_id").agg((F.sum("n") + 1).alias("rank"))


def _unit_vectors(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("vector is not null").select(F.col(key).cast("long").alias(key), unit_vector(F.col("vector")).alias("vector"))


def depth_for(k: int, lists: int = 2, k_rrf: int = K_RRF) -> int:
    """How far down ranked lists the first k of their fusion can stand.

    The k-th fused score is at least 1 / (k_rrf + k), from any one list; what stands beyond depth d in all lists has at most
    lists / (k_rrf + d + 1).
    """
    return lists * (k_rrf + k) - k_rrf


def rrf(lists: list[DataFrame], k_rrf: int = K_RRF, k: int | None = None) -> DataFrame:
    """``query_id, unit_id, score, rank``: the sum of 1 / (k_rrf + rank) over ranked lists (query_id, unit_id, rank).

    Ties go to the unit that comes first in the earliest list.
    """
    every = None
    for at, one in enumerate(lists):
        named = one.select("query_id", "unit_id", "rank", F.lit(at).alias("list"))
        every = named if every is None else every.unionByName(named)
    fused = every.groupBy("query_id", "unit_id").agg(
        F.round(F.sum(1.0 / (k_rrf + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    order = [F.desc("score"), F.col("seen.list"), F.col("seen.rank")]
    if k is None:
        return numbered(fused, ["query_id"], order).drop("seen")
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("seen")


def span_rrf(legs: DataFrame, k: int, k_rrf: int = K_RRF) -> DataFrame:
    """Fuses legs by span and keeps the first k: ``query_id, doc_id, start, end, score, unit_id, rank``.

    ``legs``: query_id, leg, rank, unit_id, doc_id, start, end. A leg counts once for a span, with its best rank over all
    its units; the representative is the first unit seen, by leg and rank.
    """
    span = ["query_id", "doc_id", "start", "end"]
    best = legs.groupBy(*span, "leg").agg(F.min(F.struct("rank", "unit_id")).alias("best"))
    fused = best.groupBy(*span).agg(
        F.round(F.sum(1.0 / (k_rrf + F.col("best.rank"))), 12).alias("score"),
        F.min(F.struct("leg", F.col("best.rank").alias("rank"), F.col("best.unit_id").alias("unit_id"))).alias("seen"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen.leg", "seen.rank")
    first = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.select(*span, "score", F.col("seen.unit_id").alias("unit_id"), "rank")


def naive_rrf(legs: DataFrame, k: int, k_rrf: int = K_RRF) -> DataFrame:
    """The baseline fusion, its first k: every unit keeps its own 1 / (k_rrf + rank); ties go to the earlier leg."""
    scored = legs.withColumn("score", F.round(1.0 / (k_rrf + F.col("rank")), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "leg", "rank")
    return scored.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)


def corpus_union(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """The first k spans of two rankings (query_id, doc_id, start, end, rank, text), each span once, the first list's first.

    ``pos`` numbers what is left from 0.
    """
    both = first.where(F.col("rank") <= k).withColumn("list", F.lit(0)).unionByName(second.where(F.col("rank") <= k).withColumn("list", F.lit(1)))
    return first_seen(both, ["query_id"], ["doc_id", "start", "end"], ["list", "rank"], "pos")


def first_seen(rows: DataFrame, by: list[str], identity: list[str], order: list[str], name: str) -> DataFrame:
    """Each identity once within ``by``, where it comes first, numbered from 0 in that order."""
    own = Window.partitionBy(*by, *identity).orderBy(*order)
    kept = rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    return kept.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def containing_rank(ranks: DataFrame, spans: DataFrame) -> DataFrame:
    """``query_id, span_id, rank``: the best rank of a unit that contains a span (null if none does).

    ``ranks``: query_id, doc_id, start, end, rank; ``spans``: query_id, span_id, doc_id, a, b. An equi-join on query and document
    with a range condition.
    """
    unit = ranks.select("query_id", "doc_id", "start", "end", F.col("rank").alias("unit_rank"))
    hit = spans.join(unit, ["query_id", "doc_id"], "left").withColumn(
        "unit_rank", F.when((F.col("start") <= F.col("a")) & (F.col("b") <= F.col("end")), F.col("unit_rank"))
    )
    return hit.groupBy("query_id", "span_id").agg(F.min("unit_rank").alias("rank"))


def containment(a: Column, b: Column, start: Column, end: Column) -> Column:
    """The part of span a..b that lies in start..end, in lines."""
    common = F.greatest(F.lit(0), F.least(b, end) - F.greatest(a, start) + 1)
    return F.when(b >= a, common / (b - a + 1)).otherwise(0.0)


def snippet(text: Column, most: int) -> Column:
    """White space collapsed to single spaces, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)
