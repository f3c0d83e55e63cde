"""Exports of reconstructed tables. Rows carry (keys, row_idx, cells array<string>); row 0 of a table is its header where one is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _joined(rows: DataFrame, keys: list[str], line, between: str, name: str) -> DataFrame:
    lines = rows.select(*keys, F.struct("row_idx", line.alias("line")).alias("r")).groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return lines.select(*keys, F.array_join("rs.line", between).alias(name))


def csv(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quoted where needed, rows parted by CR LF, none at the end."""
    return _joined(rows, keys, T.csv_row(F.col("cells")), "\r\n", "csv")


def markdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    head = F.concat(F.lit("\n|"), F.array_join(F.transform("cells", lambda c: F.lit(" :--- |")), ""))
    line = F.concat(T.markdown_row(F.col("cells")), F.when(F.col("row_idx") == 0, head).otherwise(""), F.lit("\n"))
    return _joined(rows, keys, line, "", "markdown")


def html(rows: DataFrame, keys: list[str]) -> DataFrame:
    cell = lambda tag: F.array_join(F.transform("cells", lambda c: F.concat(F.lit(f"      <{tag}>"), T.html_text(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>\n"))), "")
    head = F.concat(F.lit('<table class="pdf-extracted-table" border="1">\n  <thead>\n    <tr>\n'), cell("th"), F.lit("    </tr>\n  </thead>\n  <tbody>\n"))
    line = F.when(F.col("row_idx") == 0, head).otherwise(F.concat(F.lit("    <tr>\n"), cell("td"), F.lit("    </tr>\n")))
    return _joined(rows, keys, line, "", "html").withColumn("html", F.concat("html", F.lit("  </tbody>\n</table>")))


def matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """table_cells (keys, row_idx, col_idx, text) -> (keys, row_idx, cells), with empty strings where a row has no cell."""
    width = cells.groupBy(*keys).agg((F.max("col_idx") + 1).alias("__w"))
    rows = cells.groupBy(*keys, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("__m"))
    full = F.transform(F.sequence(F.lit(0), F.col("__w") - 1), lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit("")))
    return rows.join(width, keys).select(*keys, "row_idx", full.alias("cells"))
