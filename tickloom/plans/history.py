"""Queries over raw rows, manifests, fingerprints, and the history of states and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts
from ..sources import adapters as a
from ..sources import archives
from . import fragments as f
from .registry import query


@query(
    "s7_price_klines",
    f"""WITH {f.BARS}, x AS (SELECT opened_at, (['markPriceKlines', 'indexPriceKlines', 'premiumIndexKlines'])[1 + length(symbol) % 3] AS source, CASE WHEN length(symbol) % 3 = 2 THEN close - 50 ELSE close - 5 END AS v FROM bars) ---
SELECT source, opened_at + INTERVAL '1 minute' AS minute_end, CASE source WHEN 'markPriceKlines' THEN 'mark_price' WHEN 'indexPriceKlines' THEN 'index_price' ELSE 'premium_index' END AS feature, v AS value, CASE WHEN source <> 'premiumIndexKlines' AND v <= 0 THEN 'not_positive' END AS broken FROM x""",
    ["value"],
)
def _(spark, sf):
    kinds = F.array(*(F.lit(s) for s in archives.PRICE_FEATURES))
    kind = F.length("symbol") % 3
    raw = a.bars_1h(spark, sf).select(F.get(kinds, kind).alias("source"), F.unix_millis("opened_at").cast("string").alias("open_time"), (F.col("close") - F.when(kind == 2, 50).otherwise(5)).cast("string").alias("close"))
    return archives.price_klines(raw)


@query(
    "s8_funding_rows",
    f"""WITH {f.TICKS}, {f.FUNDING} --- SELECT symbol, date_trunc('millisecond', funding_at) AS funding_at, rate, CAST(NULL AS VARCHAR) AS broken FROM funding""",
    ["rate"],
)
def _(spark, sf):
    rows = a.funding(spark, sf).withColumn("ms", F.unix_millis("funding_at"))
    new = F.to_json(F.struct(F.col("ms").alias("fundingTime"), F.col("rate").cast("string").alias("fundingRate")))
    old = F.to_json(F.struct(F.col("ms").cast("string").alias("calc_time"), F.col("rate").alias("last_funding_rate")))
    listed = F.concat(F.lit("["), F.col("ms").cast("string"), F.lit(", 8, "), F.col("rate").cast("string"), F.lit("]"))
    raw = F.when(F.length("symbol") % 3 == 0, new).when(F.length("symbol") % 3 == 1, old).otherwise(listed)
    return archives.funding_rows(rows.select("symbol", raw.alias("raw"))).select("symbol", "funding_at", "rate", "broken")


#: Rows of the ledger a task joins and groups by order at a time: bounds its memory whatever the table.
TASK_ROWS = 500_000

FILES = """lines AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, string_agg(CAST(event_id AS VARCHAR) || ',' || CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR), chr(10) ORDER BY event_id) AS content, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL),
found AS (SELECT symbol, day, n, sha256(content) AS hash FROM lines)"""


def day_files(spark, sf):
    rows = a.read(spark, sf, "events").where("value > 0").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), "event_id", "value")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.round(F.col("value") * 1000000).cast("bigint").cast("string"))
    return archives.content_hash(rows, ["symbol", "day"], line, ["event_id"])


@query(
    "s12_manifest",
    f"""WITH {FILES}, listed AS (SELECT symbol, day, CASE WHEN n % 7 = 0 THEN sha256('other') ELSE hash END AS hash FROM found WHERE n % 5 > 0) ---
SELECT symbol, day, CASE WHEN l.hash IS NULL THEN 'unlisted' WHEN l.hash = f.hash THEN 'ok' ELSE 'changed' END AS status FROM found f LEFT JOIN listed l USING (symbol, day)""",
)
def _(spark, sf):
    found = day_files(spark, sf)
    listed = found.where("rows % 5 > 0").withColumn("sha256", F.when(F.col("rows") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    return archives.checked(found, listed, ["symbol", "day"])


@query(
    "k1_content_hash",
    f"WITH {FILES} --- SELECT symbol, day, n AS rows, hash AS sha256 FROM found",
)
def _(spark, sf):
    return day_files(spark, sf)


@query(
    "c5_fingerprint",
    f"""WITH {f.VECTORS}, c AS (SELECT label, dim, CAST(round(avg(x) * 1000000 + 0.0000001) AS BIGINT) AS mean, CAST(round(var_pop(x) * 1000000 + 0.0000001) AS BIGINT) AS spread FROM vectors GROUP BY label, dim) ---
SELECT label, sha256(string_agg(dim || ':' || mean || ':' || spread, ';' ORDER BY dim)) AS fingerprint FROM c GROUP BY label""",
)
def _(spark, sf):
    whole = lambda c: F.round(c * 1000000 + 0.0000001).cast("bigint")
    rows = a.vectors(spark, sf).groupBy("label", "dim").agg(whole(F.avg("x")).alias("mean"), whole(F.var_pop("x")).alias("spread"))
    items = F.array_sort(F.collect_list(F.struct("dim", F.concat_ws(":", "dim", "mean", "spread").alias("line"))))
    return rows.groupBy("label").agg(F.sha2(F.array_join(F.transform(items, lambda x: x["line"]), ";"), 256).alias("fingerprint"))


@query(
    "u5_name_conflicts",
    """WITH x AS (SELECT p_brand AS name, 'part' AS source, min(p_size) AS value FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'type', max(p_size) FROM part WHERE p_size < 45 GROUP BY p_brand) ---
SELECT name, count(*) AS sources, CAST(min(value) AS BIGINT) AS least, CAST(max(value) AS BIGINT) AS most, min(value) <> max(value) AS conflict FROM x GROUP BY name""",
)
def _(spark, sf):
    part = a.read(spark, sf, "part")
    one = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("value"))
    two = part.where("p_size < 45").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("value"))
    rows = one.unionByName(two).groupBy("name").agg(F.count(F.lit(1)).alias("sources"), F.min("value").cast("long").alias("least"), F.max("value").cast("long").alias("most"))
    return rows.withColumn("conflict", F.col("least") != F.col("most"))


@query(
    "q4_trade_lookups",
    f"""WITH {f.LEDGER} --- SELECT candidate_id, count(*) FILTER (status = 'F' AND exit_ts >= TIMESTAMP '1995-01-01') AS closed_since, count(*) FILTER (status = 'O') AS open_positions, max(CASE WHEN status = 'F' THEN trade_id END) AS last_closed,
  count(DISTINCT order_id) AS orders FROM ledger GROUP BY candidate_id""",
)
def _(spark, sf):
    closed = F.col("status") == "F"
    parts = max(1, a.read(spark, sf, "lineitem").count() // TASK_ROWS)
    return a.ledger(spark, sf, parts=parts).groupBy("candidate_id").agg(  # distinct orders are told apart in the join's tasks
        F.count(F.when(closed & (F.col("exit_ts") >= F.lit("1995-01-01").cast("timestamp")), 1)).alias("closed_since"), F.count(F.when(F.col("status") == "O", 1)).alias("open_positions"),
        F.max(F.when(closed, F.col("trade_id"))).alias("last_closed"), F.countDistinct("order_id").alias("orders"),
    )


@query(
    "q8_jobs",
    """WITH j AS (SELECT o_custkey % 50 AS worker, o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS made_at FROM orders) ---
SELECT worker, arg_max(job_id, (made_at, job_id)) AS newest, arg_min(CASE WHEN status = 'O' THEN job_id END, CASE WHEN status = 'O' THEN (made_at, job_id) END) AS oldest_open, count(*) FILTER (status = 'O' AND made_at < TIMESTAMP '1996-01-01') AS stale FROM j GROUP BY worker""",
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("worker"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    is_open = F.col("status") == "O"
    return rows.groupBy("worker").agg(
        F.max_by("job_id", F.struct("at", "job_id")).alias("newest"), F.min_by("job_id", F.when(is_open, F.struct("at", "job_id"))).alias("oldest_open"),
        F.count(F.when(is_open & (F.col("at") < F.lit("1996-01-01").cast("timestamp_ntz")), 1)).alias("stale"),
    )


@query(
    "q9_history",
    """WITH s AS (SELECT o_custkey AS owner, o_orderkey AS state_id, o_orderdate AS made_at, CASE WHEN o_orderpriority = '5-LOW' THEN 'N' ELSE 'Y' END AS use_yn FROM orders) ---
SELECT owner, state_id, row_number() OVER (PARTITION BY owner ORDER BY made_at, state_id) AS version, lag(state_id) OVER (PARTITION BY owner ORDER BY made_at, state_id) AS before, lead(state_id) OVER (PARTITION BY owner ORDER BY made_at, state_id) IS NULL AS latest FROM s WHERE use_yn = 'Y'""",
)
def _(spark, sf):
    use = F.when(F.col("o_orderpriority") == "5-LOW", "N").otherwise("Y")
    rows = a.read(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("state_id"), F.col("o_orderdate").alias("at"), use.alias("use_yn")).where("use_yn = 'Y'")
    order = Window.partitionBy("owner").orderBy("at", "state_id")
    return rows.select("owner", "state_id", F.row_number().over(order).alias("version"), F.lag("state_id").over(order).alias("before"), F.lead("state_id").over(order).isNull().alias("latest"))


@query("fn_normal_key", """--- SELECT p_name, regexp_replace(regexp_replace(lower(trim(p_type || ' (' || p_name || ')')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part""")
def _(spark, sf):
    return a.read(spark, sf, "part").select("p_name", texts.normal_key(F.concat("p_type", F.lit(" ("), "p_name", F.lit(")"))).alias("key"))


@query(
    "fn_canonical_json",
    """WITH x AS (SELECT event_id, '{"event":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '","user":"' || user_id || '"}' AS json FROM events) --- SELECT event_id, json, sha256(json) AS hash FROM x""",
)
def _(spark, sf):
    entries = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type"))
    rows = a.read(spark, sf, "events").select("event_id", texts.canonical_json(entries).alias("json"))
    return rows.withColumn("hash", texts.content_hash(F.col("json")))
