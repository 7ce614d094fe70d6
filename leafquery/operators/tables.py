"""HTML tables as rows of cells, and the options of TO TABLE. Everything stays inside the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquery.functions import text as fn
from leafquery.lang.lexer import QueryError


def cells_of(table: Column, nodes: Column) -> Column:
    """The rows of a table node: its tr that stand in no other tr of it, and of each the td and th that stand in no
    other cell. Rows without cells are left out."""
    inside = lambda n: F.slice(nodes, n["doc_order"].cast("int") + 2, (n["subtree_end"] - n["doc_order"]).cast("int"))
    rows = F.filter(inside(table), lambda r: (r["tag"] == "tr") & F.coalesce(r["near_tr"] < table["doc_order"], F.lit(True)))
    cells = F.transform(
        rows,
        lambda r: F.transform(F.filter(inside(r), lambda c: c["tag"].isin("td", "th") & F.coalesce(c["near_cell"] < r["doc_order"], F.lit(True))), lambda c: fn.trim(c["text"])),
    )
    return F.filter(cells, lambda r: F.size(r) > 0)


def _empty(how: str):
    def test(c: Column) -> Column:
        blank = c.isNotNull() & c.rlike(r"^[\s ]*$")
        return c.isNull() if how == "NULL_ONLY" else blank if how == "BLANK_ONLY" else c.isNull() | blank

    return test


def shaped(rows: Column, options: dict) -> Column:
    """rows after STOP_AFTER_EMPTY_ROWS, TRIM_EMPTY_ROWS and TRIM_EMPTY_COLS; all rows are padded with NULL."""
    empty = _empty(options.get("EMPTY_IS", "BLANK_OR_NULL"))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    rows = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: F.get(r, k - 1)))
    void = lambda r: F.forall(r, empty)
    trim_rows = options.get("TRIM_EMPTY_ROWS", "OFF") == "ON"
    stop = int(options.get("STOP_AFTER_EMPTY_ROWS", 0))
    if stop:
        start = F.struct(F.slice(rows, 1, 0).alias("kept"), F.lit(0).alias("run"), F.lit(False).alias("done"))

        def step(a: Column, r: Column) -> Column:
            run = F.when(void(r), a["run"] + 1).otherwise(F.lit(0))
            keep = ~a["done"] & (~void(r) if trim_rows else F.lit(True))
            return F.struct(F.when(keep, F.concat(a["kept"], F.array(r))).otherwise(a["kept"]).alias("kept"), run.cast("int").alias("run"), (a["done"] | (run >= stop)).alias("done"))

        rows = F.aggregate(rows, start, step, lambda a: a["kept"])
    elif trim_rows:
        rows = F.filter(rows, lambda r: ~void(r))
    cols = options.get("TRIM_EMPTY_COLS", "OFF")
    if cols != "OFF":
        places = F.sequence(F.lit(1), F.greatest(width, F.lit(1)))
        full = F.filter(places, lambda k: F.exists(rows, lambda r: ~empty(F.get(r, k - 1))))
        keep = full if cols == "ALL" else F.filter(places, lambda k: k <= F.coalesce(F.array_max(full), F.lit(0)))
        rows = F.transform(rows, lambda r: F.transform(keep, lambda k: F.get(r, k - 1)))
    return rows


def header_name(text: Column) -> Column:
    """White space collapsed and a word that repeats the one before it dropped."""
    words = F.split(fn.spaces(F.coalesce(text, F.lit(""))), " ")
    once = F.aggregate(words, F.array().cast("array<string>"), lambda a, w: F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), a), -1) == w, F.lit(False)), a).otherwise(F.concat(a, F.array(w))))
    return F.array_join(once, " ")


def headers_of(rows: Column, options: dict) -> Column:
    """The first row's names (normalized if asked for), later ones of a kind numbered _2, _3 …; NULL without a header."""
    if options.get("HEADER", "ON") == "OFF" or "NOHEADER" in options:
        return F.lit(None).cast("array<string>")
    first = F.get(rows, 0)
    if options.get("HEADER_NORMALIZE") == "ON":
        first = F.transform(first, lambda c, i: F.when(header_name(c) == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(header_name(c)))
    first = F.transform(first, lambda c: F.coalesce(c, F.lit("")))
    return F.transform(first, lambda c, i: F.when(F.size(F.filter(F.slice(first, F.lit(1), i), lambda b: b == c)) > 0, F.concat(c, F.lit("_"), (F.size(F.filter(F.slice(first, F.lit(1), i), lambda b: b == c)) + 1).cast("string"))).otherwise(c))


def to_table(tables: DataFrame, options: dict) -> DataFrame:
    """tables (doc_id, node_id, cells): RECT gives row_index and cells; SPARSE LONG row_index, col_index[, header],
    value; SPARSE WIDE row_index and a map from header to value."""
    sparse = options.get("FORMAT", "RECT") == "SPARSE"
    if "SPARSE_SHAPE" in options and not sparse:
        raise QueryError("SEM-0402", "SPARSE_SHAPE needs FORMAT=SPARSE")
    shape = options.get("SPARSE_SHAPE", "LONG")
    head = not (options.get("HEADER", "ON") == "OFF" or "NOHEADER" in options)
    df = tables.withColumn("__rows", shaped(F.col("cells"), options)).withColumn("__head", headers_of(F.col("__rows"), options))
    body = F.slice("__rows", 2, F.greatest(F.size("__rows") - 1, F.lit(0))) if head else F.col("__rows")
    if not sparse:
        return df.select("doc_id", "node_id", F.posexplode("__rows").alias("row_index", "cells")).withColumn("row_index", (F.col("row_index") + 1).cast("long"))
    empty = _empty(options.get("EMPTY_IS", "BLANK_OR_NULL"))
    rows = df.select("doc_id", "node_id", "__head", F.posexplode(body).alias("row_index", "__cells")).withColumn("row_index", (F.col("row_index") + 1).cast("long"))
    key = F.coalesce(F.get("__head", F.col("col_index") - 1), F.concat(F.lit("col_"), F.col("col_index").cast("string")))
    if shape == "LONG":
        out = rows.select("doc_id", "node_id", "row_index", "__head", F.posexplode("__cells").alias("col_index", "value")).withColumn("col_index", F.col("col_index") + 1).where(~empty(F.col("value")))
        return out.select("doc_id", "node_id", "row_index", F.col("col_index").cast("long").alias("col_index"), *([key.alias("header")] if head else []), "value")
    names = F.transform("__cells", lambda c, i: F.coalesce(F.get("__head", i), F.concat(F.lit("col_"), (i + 1).cast("string"))))
    pairs = F.filter(F.arrays_zip(names.alias("k"), F.col("__cells").alias("v")), lambda x: ~empty(x["v"]))
    return rows.select("doc_id", "node_id", "row_index", F.map_from_entries(pairs).alias("cells"))
