"""Queries over files that they write first: checks against a manifest and appends after a partial write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as a
from ..sources import manifests as m
from ..streaming.jobs import folder
from . import fragments as f
from .registry import query

SCHEMA = "close double, opened_at timestamp, trades long"


def bars(spark, sf):
    return a.bars_1h(spark, sf).select("symbol", "opened_at", "close", "trades")


def cut_short(rows, path: str) -> None:
    """One file a symbol that stops inside its last line: after the last comma of its text."""
    text = F.array_join(F.sort_array(F.collect_list("value")), "\n")
    whole = m.lines_of(rows, "symbol").groupBy("symbol").agg(text.alias("value"))
    whole.select("symbol", F.regexp_extract("value", "(?s)^(.*),[^,]*$", 1).alias("value")).repartition("symbol").write.mode("append").option("lineSep", ",").partitionBy("symbol").text(path)


@query(
    "s12_file_check",
    f"""WITH {f.BARS}, s AS (SELECT symbol, count(*) AS n, row_number() OVER (ORDER BY symbol) AS k FROM bars GROUP BY symbol) ---
SELECT symbol, CASE k WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'truncated' ELSE 'ok' END AS status, n AS stated_lines, CASE k WHEN 2 THEN NULL WHEN 3 THEN n - 1 ELSE n END AS lines FROM s""",
)
def _(spark, sf):
    """Bars are written with their manifest and received in a second folder: one symbol's file changed, one missing, one cut short."""
    rows, sent, received = bars(spark, sf), f"{folder(spark)}/sent", f"{folder(spark)}/received"
    m.write_lines(rows, sent, "symbol")
    stated = m.manifest(spark, sent, "symbol")
    place = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(r.symbol for r in place.collect())  # a few symbols
    first, gone, cut = (names + [None] * 3)[:3]
    kept = rows.where(~F.col("symbol").isin(*[n for n in (gone, cut) if n]))
    m.write_lines(kept.withColumn("close", F.when((F.col("symbol") == first) & (F.col("trades") > 0), F.col("close") + 1).otherwise(F.col("close"))), received, "symbol")
    cut_short(rows.where(F.col("symbol") == cut), received)
    # File names are given anew when a file is sent; a symbol has one file here.
    one = lambda df: df.withColumn("file", F.lit("bars"))
    found = m.files_of(spark, received, "symbol")
    return m.compared(one(found), one(stated), "symbol").drop("file")


@query("k2_resumed_lines", f"WITH {f.BARS} --- SELECT symbol, opened_at, close, trades FROM bars", ["close"])
def _(spark, sf):
    """A first write that stopped inside a line, resumed twice: every bar is there once."""
    rows, path = bars(spark, sf), folder(spark)
    cut_short(rows.where(F.dayofmonth("opened_at") % 2 == 0), path)
    for _ in range(2):
        m.resume(rows, path, "symbol", ["symbol", "opened_at"], SCHEMA)
    agreed, _ = m.without_conflicts(m.read_lines(spark, path, "symbol", SCHEMA), ["symbol", "opened_at"])
    return agreed.select("symbol", "opened_at", "close", "trades")
