"""Tables and sheets: rendering, header detection, head-and-tail sampling, CSV reading, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from leafstack.session import new_folder


def render(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of ``cells`` of each table as text: cells joined by bars, rows by line ends. Null cells are empty."""
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    made = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return made.select(group, F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("rendered"))


def headers(sheets: DataFrame) -> DataFrame:
    """The first row of each sheet and whether it is a header: under half of its filled cells are numbers."""
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.contains(" | ")), F.lit(0))
    rows = sheets.select("doc_id", "chunk_index", first.alias("header")).where("header IS NOT NULL")
    filled = F.filter(F.split("header", " \\| "), lambda x: F.trim(x) != "")
    numeric = F.filter(filled, lambda x: F.regexp_replace(F.trim(x), "[.,-]", "").rlike("^[0-9]+$"))
    return rows.select("doc_id", "chunk_index", "header", (F.size(numeric) / F.greatest(F.size(filled), F.lit(1)) < 0.5).alias("is_header"))


def head_tail(rows: DataFrame, group: list[str], order: list[str], n: int = 300) -> DataFrame:
    """The first and last ``n`` rows of each group; a group of at most twice as many comes whole. Null keys are a group.

    Two bounded ranks, each cut before the shuffle, so a hot group sends ``n`` rows a task.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    joined = rows.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]).select("r.*", "__n")
    big = joined.where(F.col("__n") > 2 * n)
    cut = lambda w: big.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    head = cut(W.partitionBy(*group).orderBy(*(F.asc(c) for c in order)))
    tail = cut(W.partitionBy(*group).orderBy(*(F.desc(c) for c in order)))
    return joined.where(F.col("__n") <= 2 * n).union(head).union(tail).drop("__n")


def csv_round_trip(rows: DataFrame) -> DataFrame:
    """The rows written as CSV and read again with types, profiled."""
    path = new_folder(rows.sparkSession, "csv")
    rows.write.csv(path, header=True)
    back = rows.sparkSession.read.schema(rows.schema).csv(path, header=True)
    return back.agg(F.count("*").alias("n"), F.count("o_totalprice").alias("filled"), F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.max("o_totalprice"), 2).alias("most"), F.countDistinct("o_orderpriority").alias("kinds"))


def apply_edits(cells: DataFrame, edits: Sequence[dict]) -> DataFrame:
    """Sheet edits on rows of ``sheet, row, column, value``: rename_column, set_cell_value, rename_sheet, add_column, delete_row.

    Edits apply in order over all rows of the sheet; an unknown edit is refused.
    """
    for e in edits:
        kind = e["op"]
        here = F.col("sheet") == F.lit(e.get("sheet"))
        if kind == "rename_column":
            cells = cells.withColumn("column", F.when(here & (F.col("column") == e["old"]), e["new"]).otherwise(F.col("column")))
        elif kind == "set_cell_value":
            cells = cells.withColumn("value", F.when(here & (F.col("row") == e["row"]) & (F.col("column") == e["column"]), e["value"]).otherwise(F.col("value")))
        elif kind == "rename_sheet":
            cells = cells.withColumn("sheet", F.when(here, e["new"]).otherwise(F.col("sheet")))
        elif kind == "add_column":
            new = cells.where(here).select("sheet", "row").distinct().select("sheet", "row", F.lit(e["column"]).alias("column"), F.lit(e.get("default", "")).alias("value"))
            cells = cells.unionByName(new)
        elif kind == "delete_row":
            cells = cells.where(~(here & (F.col("row") == e["row"])))
        else:
            raise ValueError(f"unknown edit {kind}")
    return cells
