"""Calendar archives: planning which files a range needs, reading zipped CSV files, and validating them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources that exist only in monthly or only in daily files.
MONTHLY_ONLY = ("fundingRate",)
DAILY_ONLY = ("metrics",)


def plan(ranges: DataFrame, sources: list[str], current_month: str) -> DataFrame:
    """source, symbol, period, grain, path for every file that [start, end) of each row (symbol, start, end) needs.

    Closed months take monthly files, the current month daily ones; funding has no file for the current
    month, metrics always has daily files. Months and days of a range are made by ``sequence``.
    """
    last = F.col("end") - F.expr("interval 1 microsecond")
    month = F.explode(F.sequence(F.trunc("start", "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))).alias("month")
    rows = ranges.where("start < end").select("symbol", "start", "end", month, F.explode(F.array(*(F.lit(s) for s in sources))).alias("source"))
    current = F.date_format("month", "yyyy-MM") >= current_month
    daily = F.col("source").isin(*DAILY_ONLY) | (current & ~F.col("source").isin(*MONTHLY_ONLY))
    rows = rows.where(~(F.col("source").isin(*MONTHLY_ONLY) & current)).withColumn("daily", daily)
    first_day = F.greatest(F.to_date("start"), F.col("month"))
    last_day = F.least(F.to_date(last), F.last_day("month"))
    days = F.when(F.col("daily"), F.sequence(first_day, last_day)).otherwise(F.array("month"))
    rows = rows.withColumn("day", F.explode(days))
    period = F.when(F.col("daily"), F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy-MM"))
    rows = rows.select("source", "symbol", period.alias("period"), F.when(F.col("daily"), "daily").otherwise("monthly").alias("grain")).distinct()
    return rows.withColumn("path", path_of())


def path_of() -> Column:
    return F.concat_ws("/", "grain", "source", "symbol", F.concat_ws("-", "symbol", "source", "period"))


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, raw: the text lines of zipped files, numbered from 0; files are the unit of work.

    Bytes are unpacked piece by piece, so memory holds a piece and the lines made from it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, packed in zip(f["path"], f["content"], strict=True):
                first = 0
                for lines in unpacked(where, packed):
                    yield pd.DataFrame({"path": where, "line": range(first, first + len(lines)), "raw": lines})
                    first += len(lines)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, line long, raw string")


def unpacked(where: str, packed: bytes, piece: int = 4 << 20) -> Iterator[list[str]]:
    """Runs of whole lines of the only table that a zip file holds."""
    box = zipfile.ZipFile(io.BytesIO(packed))
    tables = [i for i in box.infolist() if not i.is_dir()]
    if [i.filename[-4:].lower() for i in tables] != [".csv"]:
        raise ValueError(f"{where}: expected one CSV table, found {', '.join(i.filename for i in tables) or 'nothing'}")
    left = b""
    with box.open(tables[0]) as member:
        while data := member.read(piece):
            *whole, left = (left + data).split(b"\n")
            yield [x.rstrip(b"\r").decode() for x in whole]
    if left:
        yield [left.rstrip(b"\r").decode()]


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """path, line and the ``columns`` as strings; cells are cut by Spark's CSV parser.

    A first line whose first cell is no whole number is a header; a byte-order mark before it does not count,
    blank lines are left out, and cells cannot hold line ends.
    """
    rows = packed_lines(spark, path).withColumn("raw", F.regexp_replace("raw", "^\ufeff", "")).where(F.trim("raw") != "")
    header = (F.col("line") == 0) & ~F.col("raw").rlike(r'^\s*"?[+-]?[0-9]+"?\s*(,|$)')
    cells = F.from_csv("raw", ", ".join(f"{c} string" for c in columns), {"mode": "PERMISSIVE"})
    return rows.where(~header).withColumn("cells", cells).select("path", "line", "cells.*")


#: The feature that each reference-price source gives; a premium may be zero or negative.
PRICE_FEATURES = {"markPriceKlines": "mark_price", "indexPriceKlines": "index_price", "premiumIndexKlines": "premium_index"}


def price_klines(rows: DataFrame) -> DataFrame:
    """source, minute_end, feature, value, broken of klines (source, open_time, close as strings) of reference prices."""
    value, opened = F.expr("try_cast(close as double)"), F.expr("try_cast(open_time as bigint)")
    feature = F.create_map(*(F.lit(x) for kv in PRICE_FEATURES.items() for x in kv))[F.col("source")]
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    broken = F.when(feature.isNull(), "unknown_source").when(opened.isNull() | (opened < 0), "bad_time").when(~finite, "not_finite").when((F.col("source") != "premiumIndexKlines") & (value <= 0), "not_positive")
    return rows.select("source", (F.timestamp_millis(opened) + F.expr("interval 1 minute")).alias("minute_end"), feature.alias("feature"), value.alias("value"), broken.alias("broken"))


def funding_rows(rows: DataFrame) -> DataFrame:
    """funding_at, rate, broken of JSON texts (column ``raw``): objects in either naming, or lists [time, hours, rate]."""
    first = lambda *paths: F.coalesce(*(F.get_json_object("raw", p) for p in paths))
    time = first("$.fundingTime", "$.calc_time", "$[0]")
    rate = first("$.fundingRate", "$.last_funding_rate", "$[2]")
    at, value = F.try_to_number(time, F.lit("9999999999999")).cast("bigint"), rate.try_cast("double")
    broken = F.when(time.isNull() | rate.isNull(), "missing").when(at.isNull(), "bad_time").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not_finite")
    return rows.withColumn("funding_at", F.timestamp_millis(at)).withColumn("rate", value).withColumn("broken", broken)


def content_hash(rows: DataFrame, keys: list[str], line: Column, order: list[str]) -> DataFrame:
    """keys, rows, sha256 of the lines of each group in order; a group is a file of bounded length."""
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(items, lambda x: x["line"]), "\n"), 256).alias("sha256"))


def checked(found: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: ok, changed, missing (only in the manifest) or unlisted (only found)."""
    both = found.select(*keys, F.col("sha256").alias("found")).join(manifest.select(*keys, F.col("sha256").alias("listed")), keys, "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") == F.col("listed"), "ok").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def klines(rows: DataFrame) -> DataFrame:
    """Typed klines: symbol-less rows of open_time (ms), prices, volumes; taker sell and imbalance derived."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    out = rows.select("path", "line", F.expr("timestamp_millis(try_cast(open_time as bigint))").alias("opened_at"), *(number(c).alias(c) for c in ("open", "high", "low", "close", "volume")), number("taker_buy_volume").alias("taker_buy"))
    out = out.withColumn("minute_end", F.col("opened_at") + F.expr("interval 1 minute")).withColumn("taker_sell", F.col("volume") - F.col("taker_buy"))
    return out.withColumn("taker_imbalance", F.when(F.col("volume") != 0, (F.col("taker_buy") - F.col("taker_sell")) / F.col("volume")).otherwise(0.0))


def violations(bars: DataFrame) -> DataFrame:
    """Rows that break the rules of a bar, with the rules' names; a clean table gives none."""
    p = [F.col(c) for c in ("open", "high", "low", "close")]
    finite = [x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in p]
    bad = finite[0] | finite[1] | finite[2] | finite[3]
    rules = {
        "not_finite": bad,
        "not_positive": F.coalesce(F.least(*p) <= 0, F.lit(False)),
        "outside_range": F.coalesce((F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low")), F.lit(False)),
        "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(True)),
    }
    if "taker_buy" in bars.columns:
        rules["taker_above_total"] = F.coalesce(F.col("taker_buy") > F.col("volume"), F.lit(False))
    names = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return bars.withColumn("broken", names).where(F.size("broken") > 0)


def assert_clean(bars: DataFrame) -> DataFrame:
    """The bars themselves; raises at the first broken one."""
    first = violations(bars).limit(1).collect()
    if first:
        raise ValueError(f"bar breaks {first[0].broken}: {first[0].asDict()}")
    return bars
