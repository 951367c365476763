"""From texts to lines, sections, breadcrumbs and chunks, with exact line ranges.

Everything is per document: lines explode in place, windows are partitioned by document, and packing folds an array of
the document's sections, so no step moves more than one document's sections to a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import strip

#: Default sizes, and what a header line looks like.
SIZE, OVERLAP = 1500, 200
HEADER = r"(?U)^(#{1,6})\s+(.*\S)\s*$"


def check_config(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and larger than the overlap")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` with line numbers from 1; a null text has no lines."""
    at = F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line")
    return docs.select(F.col(key).alias("doc_id"), at).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def headers(rows: DataFrame) -> DataFrame:
    """Adds ``level`` (0 for other lines) and ``title`` to lines."""
    clean = strip(F.col("line"))
    return rows.withColumn("level", F.length(F.regexp_extract(clean, HEADER, 1))).withColumn(
        "title", F.when(F.col("level") > 0, F.regexp_extract(clean, HEADER, 2))
    )


def in_sections(rows: DataFrame) -> DataFrame:
    """Adds ``level``, ``title`` and ``section`` to lines: a section runs from a header to the next, what precedes the first is 0."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return headers(rows).withColumn("section", F.sum((F.col("level") > 0).cast("long")).over(order))


def sections(rows: DataFrame) -> DataFrame:
    """``doc_id, section, start, end, level, title, chars`` of lines.

    What precedes the first header is section 0 with level 0. ``chars`` counts the lines joined by line ends.
    """
    return in_sections(rows).groupBy("doc_id", "section").agg(
        F.min("line_no").alias("start"),
        F.max("line_no").alias("end"),
        F.max("level").alias("level"),
        F.max("title").alias("title"),
        (F.sum(F.length("line")) + F.count("*") - 1).alias("chars"),
    )


def breadcrumbs(parts: DataFrame) -> DataFrame:
    """Adds ``path array<string>``: the titles of the headers above a section, and its own.

    The header of a level is on the path if it comes after every shallower header that has come up since: for each
    level the last position is a window value, and it counts while it exceeds those of all shallower levels.
    """
    order = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = [
        F.max(F.when(F.col("level") == n, F.struct("section", "title"))).over(order) for n in range(1, 7)
    ]
    named = parts.withColumns({f"h{n}": x for n, x in enumerate(last, 1)})
    path = []
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"h{m}.section"), F.lit(-1)) for m in range(1, n)]
        live = F.col(f"h{n}").isNotNull()
        for a in above:
            live = live & (F.col(f"h{n}.section") > a)
        path.append(F.when(live, F.col(f"h{n}.title")))
    return named.withColumn("path", F.filter(F.array(*path), lambda x: x.isNotNull())).drop(*[f"h{n}" for n in range(1, 7)])


def section_label(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > "))


def chunk_of_section(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, section, chunk``: sections packed greedily up to ``size`` characters; one that is itself too long stands alone.

    The fold over a document's sections keeps only the running size and the chunk number of each section.
    """
    check_config(size, 0)
    item = F.struct("section", F.col("chars").cast("long").alias("chars"))
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(-1).cast("long").alias("used"), F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<long>").alias("of"))

    def step(acc: Column, x: Column) -> Column:
        joined = acc["used"] + 1 + x["chars"]
        fits = (acc["used"] >= 0) & (joined <= size)
        big = x["chars"] > size
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        used = F.when(big, F.lit(-1).cast("long")).when(fits, joined).otherwise(x["chars"])
        return F.struct(used.alias("used"), chunk.alias("chunk"), F.concat(acc["of"], F.array(chunk)).alias("of"))

    of = F.aggregate("items", start, step)["of"]
    flat = rows.select("doc_id", F.explode(F.arrays_zip(F.transform("items", lambda x: x["section"]).alias("section"), of.alias("chunk"))).alias("z"))
    return flat.select("doc_id", "z.section", "z.chunk")


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, chunk, first, last, start, end, chars, whole`` of the packed sections; what is not ``whole`` is to be cut into windows."""
    return (
        parts.join(chunk_of_section(parts, size), ["doc_id", "section"])
        .groupBy("doc_id", "chunk")
        .agg(
            F.min("section").alias("first"), F.max("section").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
            (F.sum("chars") + F.count("*") - 1).alias("chars"),
        )
        .withColumn("whole", F.col("chars") <= size)
    )


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, window, begin, finish, start, end, text``: windows of ``size`` characters with their line ranges.

    ``begin`` and ``finish`` are offsets (the end exclusive); ``start`` and ``end`` the lines, from 1, of the first and last character; a line
    end belongs to the line it ends. A null text has no windows, an empty one has one. The text is cut into pieces of a stride once and
    line ends are counted once for each piece, so the work grows with the text's length.
    """
    check_config(size, overlap)
    stride, n = size - overlap, F.length(text)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), 0)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), n.alias("n"), pieces.alias("pieces"))
    rows = rows.withColumn("before", _running(F.transform("pieces", _breaks)))
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / stride)).cast("int")
    part = lambda w: F.substring(F.array_join(F.slice("pieces", w + 1, -(-size // stride)), ""), 1, size)
    made = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(w.alias("window"), F.coalesce(F.get("before", w), F.lit(0)).alias("before"), part(w).alias("text")))
    rows = rows.select("doc_id", "n", F.inline(made))
    begin = F.col("window") * stride
    return rows.select(
        "doc_id", "window", begin.alias("begin"), F.least(begin + size, F.col("n")).alias("finish"), (F.col("before") + 1).cast("int").alias("start"),
        (F.col("before") + 1 + _breaks(F.substring("text", F.lit(1), F.greatest(F.length("text") - 1, F.lit(0))))).cast("int").alias("end"), "text",
    )


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _running(numbers: Column, block: int = 256) -> Column:
    """The sum before each number of an array: within blocks, and over the blocks, so that no long array is copied often."""
    long = lambda x: x.cast("long")

    def sums(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + long(x)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(xs, start, step)["out"]

    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")))
    blocks = F.transform(cuts, lambda b: F.slice(numbers, b * block + 1, block))
    whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + long(x)))
    return F.flatten(F.zip_with(blocks, sums(whole, F.lit(0).cast("long")), sums))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``document_id, chunk_index, section_path, line_range, text``: packed sections, and windows of those too long.

    The breadcrumb of a chunk is that of its first section. Lines meet their chunk by document and section.
    """
    rows = in_sections(lines(docs))
    parts = breadcrumbs(sections(lines(docs)))
    chunk = chunk_of_section(parts, size)
    own = parts.join(chunk, ["doc_id", "section"])
    heads = own.groupBy("doc_id", "chunk").agg(F.min_by("path", "section").alias("path"), ((F.sum("chars") + F.count("*") - 1) <= size).alias("whole"))
    texts = rows.join(chunk, ["doc_id", "section"]).groupBy("doc_id", "chunk").agg(
        F.min("line_no").alias("start"), F.max("line_no").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    ).join(heads, ["doc_id", "chunk"])
    fit = texts.where("whole").select("doc_id", "chunk", F.lit(0).alias("window"), "path", "start", "end", "text")
    cut = windows(texts.where("not whole").withColumn("id", F.struct("doc_id", "chunk", "path", F.col("start").alias("base"))), "id", "text", size, overlap)
    cut = cut.select("doc_id.doc_id", "doc_id.chunk", "window", "doc_id.path", (F.col("start") + F.col("doc_id.base") - 1).alias("start"), (F.col("end") + F.col("doc_id.base") - 1).alias("end"), "text")
    order = Window.partitionBy("doc_id").orderBy("chunk", "window")
    every = fit.unionByName(cut).withColumn("chunk_index", F.row_number().over(order) - 1)
    return every.select(
        F.col("doc_id").alias("document_id"), "chunk_index", F.col("path").alias("section_path"),
        F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("line_range"), "text",
    )


def source_ref(most: int | None = None) -> Column:
    """A citation of a chunk row; the snippet is cut to ``most`` characters if that is given."""
    text = F.col("text") if most is None else F.substring("text", 1, most)
    return F.struct(
        F.col("document_id"), F.lit(None).cast("int").alias("page"), section_label(F.col("section_path")).alias("section"),
        F.col("line_range"), text.alias("snippet"), F.lit(None).cast("string").alias("as_of_date"),
    )


def subset(chunks: DataFrame, indices: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """The chunks of the given indices, each once, or each document's first ``limit`` chunks; an index that no document has is an error."""
    if indices is not None:
        most = chunks.agg(F.max("chunk_index")).first()[0]
        wrong = sorted({i for i in indices if i < 0 or most is None or i > most})
        if wrong:
            raise ValueError(f"chunk indices {wrong} are not between 0 and {most}")
        return chunks.where(F.col("chunk_index").isin(sorted(set(indices))))
    return chunks if limit is None else chunks.where(F.col("chunk_index") < limit)


def running_totals(counts: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Adds ``total_<c>``: the sum of each column up to and with the row."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({f"total_{c}": F.sum(c).over(upto) for c in columns})
