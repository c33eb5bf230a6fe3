"""Files of JSON lines with a manifest beside them: what is missing, changed or cut short, and appends that go on after a partial write.

A file's manifest row is its group, bytes, whole lines and SHA-256. Files are read by Spark's binary reader, so each is one
record; writers bound them by rows. A last line without its line end was cut while it was written: it is set aside and
never parsed, so its row counts as not written. A file without bytes counts as missing. A key whose whole lines differ in their values is in conflict and rejected as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 100_000


def lines_of(rows: DataFrame, group: str) -> DataFrame:
    """group, value: one JSON line a row, fields in the order of their names."""
    fields = sorted(c for c in rows.columns if c != group)
    return rows.select(group, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str, group: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Rows as JSON lines, in files of their group; lines are sorted, so equal rows give equal files."""
    lines_of(rows, group).repartition(group).sortWithinPartitions(group, "value").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(group).text(path)


def files_of(spark: SparkSession, path: str, group: str) -> DataFrame:
    """group, file, bytes, content of every file."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return rows.select(F.regexp_extract("path", f"/{group}=([^/]*)/", 1).alias(group), name.alias("file"), F.col("length").alias("bytes"), "content")


def whole_end(content: Column) -> Column:
    """Whether the content ends with a line end (or is empty)."""
    return (F.octet_length(content) == 0) | (F.substring(content, -1, 1) == F.unhex(F.lit("0A")))


def manifest(spark: SparkSession, path: str, group: str) -> DataFrame:
    """group, file, bytes, lines, sha256 of the files as they are."""
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return files_of(spark, path, group).select(group, "file", "bytes", lines.cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))


def compared(found: DataFrame, stated: DataFrame, group: str) -> DataFrame:
    """group, file, status, stated_lines, lines of every file stated or found: ok, changed, truncated, missing or unknown."""
    content = F.col("content")
    own = found.select(group, "file", F.sha2(content, 256).alias("own"), whole_end(content).alias("whole"), (F.size(F.split(content.cast("string"), "\n")) - 1).cast("long").alias("lines"))
    rows = stated.select(group, "file", "sha256", F.col("lines").alias("stated_lines")).join(own, [group, "file"], "full")
    status = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("own") == F.col("sha256"), "ok").when(~F.col("whole"), "truncated").otherwise("changed")
    return rows.select(group, "file", status.alias("status"), "stated_lines", "lines")


def checked(spark: SparkSession, path: str, stated: DataFrame, group: str) -> DataFrame:
    """``compared`` for the files under ``path``."""
    return compared(files_of(spark, path, group), stated, group)


def whole_lines(spark: SparkSession, path: str, group: str) -> DataFrame:
    """group, value of every line with its end."""
    lines = F.split(F.col("content").cast("string"), "\n")
    return files_of(spark, path, group).select(group, F.explode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("value"))


def read_lines(spark: SparkSession, path: str, group: str, schema: str) -> DataFrame:
    """The rows of all whole lines."""
    return whole_lines(spark, path, group).select(group, F.from_json("value", schema).alias("r")).select(group, "r.*")


def without_conflicts(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of agreed keys, one each; keys whose rows differ)."""
    values = [c for c in rows.columns if c not in keys]
    seen = rows.groupBy(*keys).agg(F.min(F.struct(*values)).alias("low"), F.max(F.struct(*values)).alias("high"))
    agreed = seen.where(F.col("low") == F.col("high")).select(*keys, "low.*")
    return agreed.select(*rows.columns), seen.where(F.col("low") != F.col("high")).select(*keys)


def resume(rows: DataFrame, path: str, group: str, keys: Sequence[str], schema: str) -> None:
    """Appends the rows whose keys have no whole line yet; run again after a stop it goes on where it was."""
    written = read_lines(rows.sparkSession, path, group, schema).select(*keys).distinct()
    write_lines(rows.join(written, list(keys), "left_anti"), path, group)
