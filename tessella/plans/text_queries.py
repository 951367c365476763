"""Ingestion and chunking over ``documents``.

The documents have no headers and no dirt, so both engines inject the same: line n is an H1 if n % 7 = 1, an H2
if n % 7 = 4, an H3 if n % 11 = 5; every line gets trailing blanks and a CRLF, and the text a byte-order mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.plans.registry import query
from tessella.session import spread, table

_LINES = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents where text is not null)"""
_HEADED = _LINES + """, headed as (select doc_id, line_no, case when line_no % 7 = 1 then '# ' when line_no % 7 = 4 then '## '
  when line_no % 11 = 5 then '### ' else '' end || line as line from lines)"""
_SECTIONS = _HEADED + r""", marked as (select *, length(regexp_extract(trim(line), '^(#{1,6})\s+(.*\S)\s*$', 1)) as lev,
    regexp_extract(trim(line), '^(#{1,6})\s+(.*\S)\s*$', 2) as title0 from headed),
  numbered as (select *, sum((lev > 0)::int) over (partition by doc_id order by line_no) as section from marked),
  sections as (select doc_id, section::bigint as section, min(line_no)::bigint as start_line, max(line_no)::bigint as end_line, max(lev)::bigint as level,
    max(case when lev > 0 then title0 end) as title, (sum(length(line)) + count(*) - 1)::bigint as chars from numbered group by doc_id, section)"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with injected headers."""
    rows = C.lines(spread(table(spark, sf_dir, "documents")).where("text is not null"))
    n = F.col("line_no")
    mark = F.when(n % 7 == 1, "# ").when(n % 7 == 4, "## ").when(n % 11 == 5, "### ").otherwise("")
    return rows.withColumn("line", F.concat(mark, "line"))


@query(
    r"""select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, md5(text) as text_md5 from
    (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), chr(10)) as text from documents where text is not null)"""
)
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", " \t\r\n"), F.lit("\r"))
    docs = spread(table(spark, sf_dir, "documents")).where("text is not null")
    clean = docs.select("doc_id", T.normalize_lines(dirty).alias("t"))
    body = F.regexp_replace("t", "\n$", "")  # the injected last CR
    return clean.select("doc_id", F.size(F.split(body, "\n", -1)).cast("long").alias("n_lines"), F.md5(body.cast("binary")).alias("text_md5"))


@query(
    "with " + _HEADED + r""", pick as (select doc_id, min(case when trim(line) like '# %' then line_no end) as h1,
      min(case when trim(line) <> '' then line_no end) as f from headed group by doc_id)
    select p.doc_id, case when h1 is not null then trim(substr(trim(a.line), 3)) when f is null then '(untitled)'
      when trim(b.line) like '#%' then trim(regexp_replace(trim(b.line), '^#+', '')) else trim(b.line) end as title
    from pick p left join headed a on a.doc_id = p.doc_id and a.line_no = h1 left join headed b on b.doc_id = p.doc_id and b.line_no = f"""
)
def derive_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headed(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return rows.select("doc_id", T.title_of(F.transform("x", lambda r: r["line"])).alias("title"))


@query(
    r"""select doc_id, case when regexp_matches(stem, '[_-][A-Za-z]{2}$') then lower(right(stem, 2)) end as language from
    (select doc_id, case when doc_id % 3 = 0 then 'doc-' || doc_id || '_' || upper(lang) when doc_id % 3 = 1 then 'doc_' || lang || '-' || doc_id
      else 'doc_' || doc_id || '-' || lang end as stem from documents)"""
)
def infer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    stem = F.when(i % 3 == 0, F.concat(F.lit("doc-"), i, F.lit("_"), F.upper("lang"))).when(
        i % 3 == 1, F.concat(F.lit("doc_"), F.col("lang"), F.lit("-"), i)
    ).otherwise(F.concat(F.lit("doc_"), i, F.lit("-"), F.col("lang")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.language_of(stem).alias("language"))


@query("with " + _SECTIONS + " select * from sections")
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.sections(headed(spark, sf_dir))
    return s.select(
        "doc_id", "section", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"),
        F.col("level").cast("long").alias("level"), "title", F.col("chars").cast("long").alias("chars"),
    )


_LABELS = """last as (select *,
      max(case when level = 1 then section end) over w as s1, max(case when level = 2 then section end) over w as s2,
      max(case when level = 3 then section end) over w as s3 from sections window w as (partition by doc_id order by section)),
    labels as (select l.doc_id, l.section, nullif(concat_ws(' > ', a.title, b.title, c.title), '') as label from last l
    left join sections a on a.doc_id = l.doc_id and a.section = l.s1
    left join sections b on b.doc_id = l.doc_id and b.section = l.s2 and l.s2 > coalesce(l.s1, -1)
    left join sections c on c.doc_id = l.doc_id and c.section = l.s3 and l.s3 > coalesce(l.s1, -1) and l.s3 > coalesce(l.s2, -1))"""


@query("with " + _SECTIONS + ", " + _LABELS + " select * from labels")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = C.breadcrumbs(C.sections(headed(spark, sf_dir)))
    return paths.select("doc_id", "section", C.section_label(F.col("path")).alias("label"))


_FOLD = "with recursive " + _SECTIONS + """, ordered as (select *, row_number() over (partition by doc_id order by section) as n from sections),
    fold as (select doc_id, n, section, chars, start_line, end_line, 0::bigint as chunk, case when chars > 1500 then -1 else chars end as used from ordered where n = 1
      union all
      select o.doc_id, o.n, o.section, o.chars, o.start_line, o.end_line,
        (case when f.used >= 0 and f.used + 1 + o.chars <= 1500 then f.chunk else f.chunk + 1 end)::bigint,
        case when o.chars > 1500 then -1 when f.used >= 0 and f.used + 1 + o.chars <= 1500 then f.used + 1 + o.chars else o.chars end
      from fold f join ordered o on o.doc_id = f.doc_id and o.n = f.n + 1)"""


@query(
    _FOLD + """ select doc_id, chunk, min(start_line)::bigint as start_line, max(end_line)::bigint as end_line, (sum(chars) + count(*) - 1)::bigint as chars,
      sum(chars) + count(*) - 1 <= 1500 as whole from fold group by doc_id, chunk"""
)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.pack(C.sections(headed(spark, sf_dir)))
    return p.select(
        "doc_id", "chunk", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"),
        F.col("chars").cast("long").alias("chars"), "whole",
    )


_WINDOWS = """w as (select doc_id, text, unnest(range(case when length(text) <= 1500 then 1 else ceil((length(text) - 1500) / 1300.0)::bigint + 1 end)) as win
    from documents where text is not null),
  spans as (select *, win * 1300 as b, least(win * 1300 + 1500, length(text)) as e from w)"""


@query(
    "with " + _WINDOWS + """ select doc_id, win::bigint as win, b::bigint as begin_at, e::bigint as end_at,
      md5(substr(text, (b + 1)::bigint, (e - b)::bigint)) as text_md5 from spans"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.windows(spread(table(spark, sf_dir, "documents")))
    return w.select(
        "doc_id", F.col("window").cast("long").alias("win"), F.col("begin").cast("long").alias("begin_at"),
        F.col("finish").cast("long").alias("end_at"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query(
    "with " + _WINDOWS + """ select doc_id, win::bigint as win,
      (length(substr(text, 1, b::bigint)) - length(replace(substr(text, 1, b::bigint), chr(10), '')) + 1)::bigint as start_line,
      (length(substr(text, 1, greatest(e - 1, b)::bigint)) - length(replace(substr(text, 1, greatest(e - 1, b)::bigint), chr(10), '')) + 1)::bigint as end_line from spans"""
)
def chunk_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.windows(spread(table(spark, sf_dir, "documents")))
    return w.select("doc_id", F.col("window").cast("long").alias("win"), F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"))


@query(
    _FOLD + ", " + _LABELS + """, held as (select doc_id, chunk, min(section) as first, max(section) as last_, min(start_line) as base, sum(chars) + count(*) - 1 <= 1500 as whole,
      max(end_line) as last_line from fold group by doc_id, chunk),
    body as (select f.doc_id, f.chunk, string_agg(n.line, chr(10) order by n.line_no) as text from fold f join numbered n on n.doc_id = f.doc_id and n.section = f.section group by f.doc_id, f.chunk),
    cut as (select h.*, text, unnest(range(case when whole or length(text) <= 1500 then 1 else ceil((length(text) - 1500) / 1300.0)::bigint + 1 end)) as win from held h join body using (doc_id, chunk)),
    spans as (select *, (win * 1300)::bigint as b, case when whole then length(text) else least(win * 1300 + 1500, length(text)) end::bigint as e from cut)
    select s.doc_id as document_id, (row_number() over (partition by s.doc_id order by s.chunk, win) - 1)::bigint as chunk_index, label as section,
      case when whole then base else base + length(substr(text, 1, b)) - length(replace(substr(text, 1, b), chr(10), '')) end::bigint as start_line,
      case when whole then last_line else base + length(substr(text, 1, greatest(e - 1, b))) - length(replace(substr(text, 1, greatest(e - 1, b)), chr(10), '')) end::bigint as end_line,
      md5(substr(text, b + 1, e - b)) as text_md5
    from spans s join labels l on l.doc_id = s.doc_id and l.section = s.first"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headed(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    docs = rows.select("doc_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
    return C.chunk_documents(docs).select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), C.section_label(F.col("section_path")).alias("section"),
        F.col("line_range.start").cast("long").alias("start_line"), F.col("line_range.end").cast("long").alias("end_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query(
    "with " + _WINDOWS + """, c as (select doc_id, win::bigint as win, (e - b)::bigint as chars from spans)
    select doc_id, win, sum(chars) over (partition by doc_id order by win)::bigint as total_chars,
      count(*) over (partition by doc_id order by win)::bigint as total_chunks from c"""
)
def running_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.windows(spread(table(spark, sf_dir, "documents")))
    counts = w.select("doc_id", F.col("window").cast("long").alias("win"), (F.col("finish") - F.col("begin")).cast("long").alias("chars"), F.lit(1).cast("long").alias("chunks"))
    return C.running_totals(counts, "doc_id", "win", ["chars", "chunks"]).drop("chars", "chunks")


@query(
    "select source, lang, count(*)::bigint as docs, sum(n_chars)::bigint as chars from documents group by rollup (source, lang)"
)
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
