"""Mixing sources to target weights, with DataFrame functions only.

Method: sources form a tree domain - language - source. A budget of tokens goes down the tree: at each node the
children share it by their weights, but none takes more than its subtree holds (its tokens times ``max_epochs``).
What a child cannot take goes to its siblings, again by weight, and leaves their parent only if all siblings are
full: shortages are settled among siblings before ancestors. The shares are closed forms over windows of the few
nodes (sorted by capacity over weight, the first child that is not full sets the level for the rest).

Each leaf then takes the prefix of its token stream that its budget reaches. The stream is a sequence of epochs;
in epoch e the leaf's documents stand in the order of a seeded hash of (e, doc_id), so whole epochs take every
document once, and the last epoch is cut inside a document if need be. No leaf is ever sorted as a whole: token sums by (leaf, slice
of the hash range) give the slice in which the budget ends, documents in earlier slices are in, later ones out, and only
the documents of that slice are ordered. The number of slices grows with the documents, so slices stay small.

Tokens are runs of non-space characters. The weight tables have one row for each named node; unnamed nodes get
``DEFAULT_WEIGHT``. Weights are integers, so that sums and shares are exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh
from tessella.session import checkpoint

LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHT, SEED, MAX_EPOCHS, SLICE_DOCS = 10, 5, 2, 2000
#: Production weights by node path; a source's domain is given by ``domain_of``.
WEIGHTS = {
    ("web",): 60, ("books",): 30, ("code",): 10,
    ("web", "en"): 50, ("web", "de"): 20, ("web", "fr"): 20, ("web", "es"): 10,
    ("books", "en"): 40, ("books", "de"): 20, ("books", "fr"): 20, ("books", "es"): 20,
}
#: Which sources belong to which domain; all others are web.
DOMAINS = {"books": ["src1", "src4", "src7", "src10", "src13", "src16", "src19"], "code": ["src2", "src11"]}


def domain_of(source: Column) -> Column:
    out = F.lit("web")
    for name, sources in DOMAINS.items():
        out = F.when(source.isin(sources), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def prefix_of(text: Column, tokens: Column) -> Column:
    """The shortest prefix of ``text`` with so many tokens."""
    parts = F.split(text, r"(?<=[^ \t\n\r\f\x0B])(?=[ \t\n\r\f\x0B])")
    return F.array_join(F.slice(parts, F.lit(1), tokens.cast("int")), "")


def leaves(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id, domain, lang, source, tokens``: null languages and sources are nodes named ``none``."""
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("none"))
    return df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        domain_of(name).alias("domain"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("none")).alias("lang"),
        name.alias("source"),
        tokens_of(F.col(f"`{text}`").cast("string")).alias("tokens"),
    )


def _weight(depth: int, weights: dict[tuple[str, ...], int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for path, weight in weights.items():
        if len(path) == depth:
            same = F.lit(True)
            for level, name in zip(LEVELS, path):
                same = same & (F.col(level) == name)
            out = F.when(same, weight).otherwise(out)
    return out.cast("double")


def _share(nodes: DataFrame, by: tuple[str, ...], given: str, name: str) -> DataFrame:
    """Adds ``name``: each node's part of its parent's ``given``, by weight up to its capacity ``cap``."""
    ratio = F.col("cap") / F.col("w")
    name_of = LEVELS[len(by)]
    order = Window.partitionBy(*by).orderBy(ratio, name_of)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = nodes.withColumn("left", F.col(given) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("level", F.col("left") / F.sum("w").over(rest)).withColumn("open", ratio > F.col("level"))
    whole = Window.partitionBy(*by)
    out = out.withColumn("level", F.min(F.when(F.col("open"), F.struct(ratio.alias("r"), name_of, F.col("level").alias("x")))).over(whole)["x"])
    part = F.least("cap", F.floor(F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).cast("double"))
    return out.withColumn(name, part).drop("left", "level", "open")


def budgets(sums: DataFrame, total: Column | int | float, weights: dict[tuple[str, ...], int], max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, docs, budget`` for each leaf of ``sums`` (the same without the budget).

    ``total`` is a number of tokens, or a fraction (below 1) of what the tree holds. Budgets are whole tokens, rounded down.
    """
    leaf = sums.where("tokens > 0").withColumn("cap", (F.col("tokens") * max_epochs).cast("double")).withColumn("w", _weight(3, weights))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(2, weights))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(1, weights))
    held = F.sum("cap").over(Window.partitionBy())
    wish = F.floor(held / max_epochs * total) if isinstance(total, float) and total < 1 else F.lit(total)
    domain = _share(domain.withColumn("given", F.least(held, wish.cast("double"))), (), "given", "part_d")
    lang = _share(lang.join(domain.select("domain", "part_d"), "domain"), ("domain",), "part_d", "part_l")
    leaf = _share(leaf.join(lang.select("domain", "lang", "part_l"), ["domain", "lang"]), ("domain", "lang"), "part_l", "budget")
    return leaf.select(*LEVELS, "tokens", "docs", F.col("budget").cast("long").alias("budget"))


def order_key(epoch: Column, key: Column, seed: int) -> Column:
    """The place of a document in a leaf's epoch: 15 hex digits of a seeded hash, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.substring(F.md5(text.cast("binary")), 1, 15)


#: Leaves up to this number are broadcast (about 20 MB); beyond it they are joined by leaf and salt.
BROADCAST_LEAVES, SALTS = 100_000, 64


def with_leaf(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf; a leaf that holds much of the rows is not gathered in one task.

    ``planned`` is a checkpointed table, so counting it is cheap.
    """
    if planned.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(planned), list(LEVELS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = planned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*LEVELS, "salt"]).drop("salt")


def plan(stats: DataFrame, total: int | float, weights: dict[tuple[str, ...], int] | None = None, max_epochs: int = MAX_EPOCHS,
         seed: int = SEED, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """One row for each leaf: its budget, the whole epochs in it, and where the last epoch ends.

    ``full``: whole epochs; ``want``: tokens of the last epoch; ``slices``: slices of the hash range; ``edge``: the slice in which the
    budget ends; ``ahead``: tokens in the slices before it.
    """
    sums = stats.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    budget = budgets(sums, total, WEIGHTS if weights is None else weights, max_epochs).select(
        *LEVELS, "budget",
        F.expr("budget div tokens").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("want"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / slice_docs)).cast("long").alias("slices"),
    )
    budget = checkpoint(budget)
    placed = with_leaf(stats, budget).where("want > 0").withColumn("slice", slice_of("slices", "full", "doc_id", seed))
    by_slice = placed.groupBy(*LEVELS, "want", "slice").agg(F.sum("tokens").alias("t"))
    running = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_slice.withColumn("ahead", F.coalesce(F.sum("t").over(running), F.lit(0)))
    edge = ahead.where("ahead < want and ahead + t >= want").select(*LEVELS, F.col("slice").alias("edge"), "ahead")
    return checkpoint(budget.join(edge, list(LEVELS), "left"))


def slice_of(slices: str, epoch: str, key: str, seed: int) -> Column:
    first = F.conv(F.substring(order_key(F.col(epoch), F.col(key), seed), 1, 8), 16, 10).cast("long")
    return F.floor(first * F.col(slices) / F.lit(2**32)).cast("long")


def take(rows: DataFrame, planned: DataFrame, seed: int = SEED, tie: Column | None = None) -> DataFrame:
    """``rows`` (with LEVELS, doc_id and tokens) as often as they are drawn, with ``epoch`` and ``taken``, their tokens.

    Rows without tokens are not drawn. ``tie`` orders rows of one id; rows alike in everything may stand for each other.
    """
    joined = with_leaf(rows.where("tokens > 0"), planned).where("budget > 0")
    joined = joined.withColumn("slice", slice_of("slices", "full", "doc_id", seed))
    whole = F.col("full") + F.when((F.col("want") > 0) & (F.col("slice") < F.col("edge")), 1).otherwise(0)
    certain = joined.where(whole > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    certain = certain.withColumn("taken", F.col("tokens"))
    last = Window.partitionBy(*LEVELS, "slice").orderBy(
        order_key(F.col("full"), F.col("doc_id"), seed), "doc_id", *([tie] if tie is not None else []), "tokens"
    )
    edge = joined.where((F.col("want") > 0) & (F.col("slice") == F.col("edge"))).withColumn("epoch", F.col("full"))
    before = F.coalesce(F.sum("tokens").over(last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("taken", F.least(F.col("tokens"), F.col("want") - F.col("ahead") - before)).where("taken > 0")
    return certain.unionByName(edge).drop("budget", "full", "want", "slices", "edge", "ahead", "slice")


def mix(df: DataFrame, total: int | float, weights: dict[tuple[str, ...], int] | None = None, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, epoch, taken``: the draws of documents that fill the budgets.

    ``taken`` is below ``tokens`` for at most one draw of each leaf. Null texts and texts without tokens are never
    drawn, and leaves without tokens get no budget; null ids order as the empty text; repeated rows are drawn
    each; an empty table gives an empty table; other columns are not read.
    """
    stats = checkpoint(leaves(df))
    return take(stats, plan(stats, total, weights, max_epochs, seed), seed)


def mix_documents(df: DataFrame, total: int | float, weights: dict[tuple[str, ...], int] | None = None, max_epochs: int = MAX_EPOCHS,
                  seed: int = SEED, text: str = "text") -> DataFrame:
    """The drawn documents with all columns of ``df``; a text that the budget cuts is its prefix of ``taken`` tokens."""
    stats = checkpoint(leaves(df))
    planned = plan(stats, total, weights, max_epochs, seed)
    held = fresh(df, "row")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(held))
    name = F.coalesce(F.col(f"{held}.source").cast("string"), F.lit("none"))
    rows = rows.select(
        held, F.col(f"{held}.doc_id").cast("long").alias("doc_id"), domain_of(name).alias("domain"),
        F.coalesce(F.col(f"{held}.lang").cast("string"), F.lit("none")).alias("lang"), name.alias("source"),
        tokens_of(F.col(f"{held}.{text}").cast("string")).alias("tokens"),
    )
    drawn = take(rows, planned, seed, tie=F.xxhash64(F.col(f"{held}.{text}")))
    cut = F.when(F.col("taken") < F.col("tokens"), prefix_of(F.col(f"{held}.{text}"), F.col("taken"))).otherwise(F.col(f"{held}.{text}"))
    return drawn.select(*[(cut if c == text else F.col(f"{held}.`{c}`")).alias(c) for c in df.columns])


def oracle(total: float, weights: dict[tuple[str, ...], int] | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL with the rows of ``mix`` over the table documents, from one window over each whole leaf."""
    weights = WEIGHTS if weights is None else weights

    def weight(depth: int) -> str:
        cases = " ".join(
            "when " + " and ".join(f"{a} = '{b}'" for a, b in zip(LEVELS, p)) + f" then {w}" for p, w in weights.items() if len(p) == depth
        )
        return f"(case {cases} else {DEFAULT_WEIGHT} end)::double" if cases else f"{DEFAULT_WEIGHT}::double"

    def share(name: str, source: str, by: str, given: str, part: str, last: str) -> str:
        over = f"partition by {by} order by cap / w, {last}" if by else f"order by cap / w, {last}"
        whole = f"partition by {by}" if by else ""
        return f"""{name}_a as (select *, {given} - coalesce(sum(cap) over ({over} rows between unbounded preceding and 1 preceding), 0) as rem,
          sum(w) over ({over} rows between current row and unbounded following) as wsum from {source}),
        {name}_b as (select *, min(case when cap / w > rem / wsum then struct_pack(r := cap / w, n := {last}, x := rem / wsum) end) over ({whole}) as lev from {name}_a),
        {name} as (select * exclude (rem, wsum, lev), least(cap, floor(coalesce(lev.x * w, cap))) as {part} from {name}_b)"""

    domains = " ".join(f"when source in ({', '.join(repr(x) for x in names)}) then '{d}'" for d, names in reversed(DOMAINS.items()))
    return f"""with rows_ as (select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
          case {domains} else 'web' end as domain,
          len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::bigint as tokens from documents),
        leaf0 as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * {max_epochs})::double as cap, {weight(3)} as w
          from rows_ group by domain, lang, source having sum(tokens) > 0),
        lang0 as (select domain, lang, sum(cap) as cap, {weight(2)} as w from leaf0 group by domain, lang),
        domain0 as (select domain, sum(cap) as cap, {weight(1)} as w from lang0 group by domain),
        domain1 as (select *, least(sum(cap) over (), floor(sum(cap) over () / {max_epochs} * {total})) as given from domain0),
        {share("domain2", "domain1", "", "given", "part_d", "domain")},
        lang1 as (select lang0.*, part_d from lang0 join domain2 using (domain)),
        {share("lang2", "lang1", "domain", "part_d", "part_l", "lang")},
        leaf1 as (select leaf0.*, part_l from leaf0 join lang2 using (domain, lang)),
        {share("leaf2", "leaf1", "domain, lang", "part_l", "budget", "source")},
        leaf as (select domain, lang, source, (budget::bigint // tokens) as full_, (budget::bigint % tokens) as want from leaf2),
        placed as (select r.*, full_, want, coalesce(sum(r.tokens) over (partition by domain, lang, source order by
            substr(md5(concat_ws('|', '{seed}', full_::varchar, coalesce(doc_id::varchar, ''))), 1, 15), doc_id, r.tokens
            rows between unbounded preceding and 1 preceding), 0)::bigint as before_
          from rows_ r join leaf using (domain, lang, source) where r.tokens > 0)
        select doc_id, domain, lang, source, tokens, unnest(range(full_))::bigint as epoch, tokens as taken from placed
        union all
        select doc_id, domain, lang, source, tokens, full_ as epoch, least(tokens, want - before_)::bigint as taken from placed where before_ < want"""
