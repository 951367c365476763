"""Connected components over an edge DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.session import checkpoint

#: So many edges, and so at most twice as many nodes, one task may settle.
FEW = 1 << 16


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of the edges in ``batches`` by union-find, each node hooked below the lesser root."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        listed = pa.types.is_list(kind)
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = (find(tuple(u)), find(tuple(v))) if listed else (find(u), find(v))
            parent[max(x, y)] = min(x, y)
    if parent:
        roots = [find(x) for x in list(parent)]
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array(roots, kind)], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW) -> DataFrame:
    """``node, root`` for every node of ``edges``; root is the least node of its component.

    Each round every root that sees a smaller neighbouring root hooks onto the smallest one, and hooks are then shortened by
    pointer jumping until they end in roots; edges inside one tree disappear. Once no more than ``few`` edges are left (they are
    counted), one task of bounded size settles them by union-find; the roots are the same either way. Every round is written
    to the shared checkpoint folder, so plans stay short and a lost executor costs one round at most. All joins are
    sort-merge joins: nothing is broadcast, and the adaptive planner can split the rows of a giant component's root.
    """
    edges = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    schema = StructType([StructField(x, edges.schema["u"].dataType) for x in ("node", "root")])
    labels = None
    for _ in range(rounds):
        left = edges.count()
        if not left:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if labels is None else labels
        if left <= few:
            settled = checkpoint(edges.coalesce(1).mapInArrow(_settled, schema))
            if labels is None:
                return settled
            last = settled.select(F.col("node").alias("root"), F.col("root").alias("new")).hint("merge")
            return checkpoint(labels.join(last, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).where("v < u")
        hooks = checkpoint(hooks.select(F.col("u").alias("old"), F.col("v").alias("new")))
        while True:
            nxt = hooks.select(F.col("old").alias("new"), F.col("new").alias("further")).hint("merge")
            jumped = checkpoint(
                hooks.join(nxt, "new", "left").select(
                    "old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")
                )
            )
            hooks = jumped.select("old", "new")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
            labels = nodes.select("node", F.col("node").alias("root"))
        named = hooks.select(F.col("old").alias("root"), "new").hint("merge")
        labels = checkpoint(labels.join(named, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        for side in ("u", "v"):
            named = hooks.select(F.col("old").alias(side), "new").hint("merge")
            edges = edges.join(named, side, "left").select(
                *[F.coalesce("new", side).alias(side) if c == side else F.col(c) for c in ("u", "v")]
            )
        edges = checkpoint(edges.where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def identifier_clusters(assets: DataFrame, key: str = "asset", identifiers: str = "identifiers") -> DataFrame:
    """``key, canonical, slugs`` by assets that share any identifier, directly or through others.

    Identifiers are slugged, blank ones and ``unknown`` dropped; an asset's cluster is named by the least slug in it.
    """
    from tessella.functions.text import slug

    rows = assets.select(key, F.explode(identifiers).alias("name")).select(key, slug(F.col("name")).alias("slug"))
    rows = checkpoint(rows.where("slug <> '' and slug <> 'unknown'").distinct())
    first = rows.groupBy(key).agg(F.min("slug").alias("first"))
    edges = rows.join(first, key).select(F.col("first").alias("a"), F.col("slug").alias("b"))
    roots = connected_components(edges)
    named = first.join(roots, first["first"] == roots["node"], "left")
    return named.select(key, F.coalesce("root", "first").alias("canonical"))
