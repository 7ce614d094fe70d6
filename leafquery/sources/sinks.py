"""CSV, JSON, NDJSON, Parquet and list output. Spark writes the files, so they come from all executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquery.lang.lexer import QueryError


def text_of(df: DataFrame, name: str) -> Column:
    """A column as exported text; attributes as {k=v,...} in the order of the keys."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind.startswith("map"):
        pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.to_json(c) if kind.startswith(("array", "struct")) else c.cast("string")


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[text_of(df, c).alias(c) for c in columns])


def csv_line(columns: list[Column]) -> Column:
    quoted = [F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in columns]
    return F.concat_ws(",", *quoted)


def header_line(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in columns)


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """Every part that has lines begins with the header, as readers of a folder of CSV files expect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    return lines.mapInArrow(run, "value string")


def _one_part(lines: DataFrame, top: str) -> DataFrame:
    """kind (0 top, 1 line) and value in one part, the lines in the order they had. A union alone does not keep
    order when its partitions are gathered by where they lie."""
    at = lambda k, x: lines.sparkSession.createDataFrame([(k, 0, x)], "kind int, at long, value string")
    body = lines.select(F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("at"), "value")
    return at(0, top).union(body).coalesce(1).sortWithinPartitions("kind", "at").select("kind", "value")


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_array(rows: DataFrame, path: str) -> None:
    """JSON texts as the lines of one array in one part. Tasks write the lines, each after a comma, and the files are then
    put together as bytes in their order."""
    spark, jvm = rows.sparkSession, rows.sparkSession._jvm
    parts = f"{path.rstrip('/')}-lines-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit(","), "value").alias("value")).write.option("compression", "none").text(parts)
    fs, at = _files(spark, path)
    _, lines = _files(spark, parts)
    try:
        found = [f for f in fs.listStatus(lines) if f.getPath().getName().startswith("part-") and f.getLen()]
        found.sort(key=lambda f: int(f.getPath().getName().split("-")[1]))
        fs.delete(at, True)
        fs.mkdirs(at)
        hidden = jvm.org.apache.hadoop.fs.Path(at, "_part-00000")
        out = fs.create(hidden)
        try:
            out.write(bytearray(b"[\n"))
            for k, f in enumerate(found):
                from_ = fs.open(f.getPath())
                try:
                    from_.seek(0 if k else 1)  # no comma before the first line
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(from_, out, 1 << 20, False)
                finally:
                    from_.close()
            out.write(bytearray(b"]\n"))
        finally:
            out.close()
        fs.rename(hidden, jvm.org.apache.hadoop.fs.Path(at, f"part-00000-{uuid.uuid4()}-c000.txt"))
        fs.create(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")).close()
    finally:
        fs.delete(lines, True)


def write(df: DataFrame, columns: list[str], kind: str, path: str, single: bool = False) -> None:
    """Write the rows as text columns below path: a folder of part files, one part if single. CSV parts have a header;
    JSON is one array in one part, NDJSON an object a line."""
    out = as_text(df, columns)
    if kind == "PARQUET":
        (out.coalesce(1) if single else out).write.mode("overwrite").parquet(path)
    elif kind == "CSV":
        lines = out.select(csv_line([F.col(f"`{c}`") for c in columns]).alias("value"))
        if not single:
            _headed(lines, header_line(columns)).write.mode("overwrite").text(path)
        if single or not df.sparkSession.read.text(path).limit(1).count():  # without rows a header is all there is
            _one_part(lines, header_line(columns)).select("value").write.mode("overwrite").text(path)
    elif kind == "JSON":
        _write_array(json_lines(df, columns), path)
    elif kind == "NDJSON":
        lines = json_lines(df, columns)
        (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
    else:
        raise QueryError("SEM-0401", f"cannot write {kind}")


def write_table(df: DataFrame, kind: str, path: str, header: bool) -> None:
    """The one table of a result: its cells as columns, in one part. A rectangular CSV takes its first row as the header
    or, without one, col1, col2 …; a long table has its own columns."""
    if "cells" in df.columns and dict(df.dtypes)["cells"].startswith("map"):
        raise QueryError("SEM-0402", "a WIDE table cannot be exported")
    if kind not in ("CSV", "PARQUET"):
        raise QueryError("SEM-0402", "tables are written as CSV or PARQUET")
    keys = [c for c in ("doc_id", "node_id") if c in df.columns]
    found = df.select(*keys).distinct().limit(2).count()
    if found != 1:
        raise QueryError("SEM-0402", "the export takes exactly one table; add a filter" if found else "the table has no rows")
    df = df.coalesce(1)  # one table of one document
    if "cells" not in df.columns:
        order = [c for c in ("row_index", "col_index") if c in df.columns]
        return write(df.sortWithinPartitions(*order), [c for c in df.columns if c not in ("doc_id", "node_id")], kind, path, True)
    df = df.sortWithinPartitions("row_index")
    width = df.agg(F.max(F.size("cells"))).first()[0]
    names = [f"col{k + 1}" for k in range(width)]
    cells = df.select(*[F.get("cells", k).alias(c) for k, c in enumerate(names)])
    if kind == "PARQUET" or not header:
        return write(cells, names, kind, path, True)
    cells.select(csv_line([F.col(c) for c in names]).alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return as_text(df, columns).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).alias("value"))
