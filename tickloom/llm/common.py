"""What the text operators share: table access, the shared folder and word rules."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is missing, a temporary folder of this machine serves local masters only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tickloom-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and gives the planner real sizes."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the word rule wants; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``; the same ones in every run.

    Only rows under twice the share that is needed enter the sort, so all tasks together send about
    ``2 * most`` rows, however many tasks there are.
    """
    whole, n = 1 << 40, rows.count()
    rows = rows.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(whole)))
    if n > 2 * most:
        rows = rows.where(F.col("__h") < whole * 2 * most // n)
    return rows.orderBy("__h", key).limit(most).drop("__h")


def slices(texts, most_rows: int = 512, most_bytes: int = 3 << 20):
    """(first, end) of runs of an Arrow array of texts, of so many rows and bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    ends, at = pc.cumulative_sum(pc.binary_length(texts).cast("int64")).to_numpy(zero_copy_only=False), 0
    while at < len(ends):
        far = int(ends.searchsorted((ends[at - 1] if at else 0) + most_bytes, side="right"))
        yield at, (end := max(at + 1, min(far, at + most_rows)))
        at = end


def give_back() -> None:
    """Returns the free memory of this Python worker to the system; workers outlive their tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """``run`` over batches, with ``give_back`` at its end."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out
