"""Report writers: tables as JSON lines and one markdown page, on whatever store Spark writes to.

Reports hold scores and counts, a bounded number of rows (``MOST`` for each table, or an error): they are read by people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MOST = 10_000


class GuardsFailed(Exception):
    """A figure does not repeat what was published; nothing was written."""


def markdown_table(rows: list[Row], columns: list[str]) -> str:
    def cell(x) -> str:
        shown = "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
        return shown.replace("|", "\\|").replace("\n", " ")

    return "\n".join([f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *(f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows)])


def _rows(table: DataFrame) -> list[Row]:
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report holds at most {MOST} rows of a table")
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def render(title: str, tables: dict[str, DataFrame]) -> str:
    """The report as markdown: a section and a table for each name, rows in the order of their texts."""
    parts = [f"# {title}"]
    for name, table in tables.items():
        parts += ["", f"## {name}", "", markdown_table(_rows(table), table.columns)]
    return "\n".join(parts) + "\n"


def write_report(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame], guards: DataFrame | None = None) -> str:
    """Writes ``<path>/<name>`` as JSON lines for each table and ``<path>/report`` as markdown; returns the markdown.

    ``guards`` (as from ``recall.guards``): if any row is not ok, GuardsFailed is raised before anything is written.
    """
    if guards is not None:
        failed = [r["name"] for r in guards.where(~F.coalesce(F.col("ok"), F.lit(False))).limit(MOST).collect()]
        if failed:
            raise GuardsFailed(", ".join(sorted(map(str, failed))))
    page = render(title, tables)
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    spark.createDataFrame([(page[:-1],)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/report")
    return page
