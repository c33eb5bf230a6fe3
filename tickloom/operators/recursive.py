"""Recursive smoothing per symbol without one task a symbol.

A mean's step v + alpha * (x - v) is an affine map of v, and maps of consecutive rows compose to one map (a, b). Rows
are folded to the map of their block, blocks to the map of their span, spans to one row a symbol; then what each span, block and
row starts from is carried down again. So a symbol's rows lie in as many tasks as it has blocks, and only
maps, a few numbers a block, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and blocks of a span are held together: days of bars, months of days.
BLOCK, SPAN = "DAY", "MONTH"
_NOTHING = "CAST(NULL AS DOUBLE)"


def _stepped(v: Column, x: Column, alpha: float) -> Column:
    """The mean after a value: the first value starts it, a null leaves it."""
    return F.when(x.isNull(), v).otherwise(F.coalesce(v + alpha * (x - v), x))


def _map_of(rows: str, column: str, alpha: float) -> Column:
    """The map of a block: a and b for a mean v that comes in, s where none does yet; n values."""

    def step(m, r):
        x = r["row"][column].cast("double")
        none = x.isNull()
        keep = lambda c, value: F.when(none, m[c]).otherwise(value)
        return F.struct(
            keep("a", m["a"] * (1 - alpha)).alias("a"), keep("b", m["b"] * (1 - alpha) + alpha * x).alias("b"), _stepped(m["s"], x, alpha).alias("s"), keep("n", m["n"] + 1).alias("n")
        )

    return F.aggregate(rows, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.expr(_NOTHING).alias("s"), F.lit(0).alias("n")), step)


def _composed(parts: str, name: str) -> Column:
    """One map for consecutive maps."""

    def step(m, p):
        q = p[name]
        return F.struct((m["a"] * q["a"]).alias("a"), (m["b"] * q["a"] + q["b"]).alias("b"), F.when(m["s"].isNull(), q["s"]).otherwise(q["a"] * m["s"] + q["b"]).alias("s"), (m["n"] + q["n"]).alias("n"))

    return F.aggregate(parts, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.expr(_NOTHING).alias("s"), F.lit(0).alias("n")), step)


_START = lambda: F.struct(F.expr(_NOTHING).alias("v"), F.lit(0).alias("n"))


def _starts(parts: str, name: str, start: Column) -> Column:
    """What each of consecutive maps starts from: an array of (v, n)."""

    def step(acc, p):
        q, now = p[name], acc["now"]
        after = F.struct(F.when(now["v"].isNull(), q["s"]).otherwise(q["a"] * now["v"] + q["b"]).alias("v"), (now["n"] + q["n"]).alias("n"))
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(parts, F.struct(start.alias("now"), F.array().cast("array<struct<v:double,n:int>>").alias("out")), step, lambda acc: acc["out"])


def _values(rows: str, column: str, alpha: float, least: int, start: Column) -> Column:
    """The means after each row of a block; null before ``least`` values."""

    def step(acc, r):
        x, now = r["row"][column].cast("double"), acc["now"]
        after = F.struct(_stepped(now["v"], x, alpha).alias("v"), (now["n"] + x.isNotNull().cast("int")).alias("n"))
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(F.when(after["n"] >= least, after["v"]))).alias("out"))

    return F.aggregate(rows, F.struct(start.alias("now"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])


def smooth(df: DataFrame, specs: dict[str, tuple[str, float, int]], key: str = "symbol", order: str = "opened_at", block: str = BLOCK, span: str = SPAN) -> DataFrame:
    """Adds exponential means: name -> (column, alpha, least rows). No bias correction; nulls before ``least`` values.

    Means over the same rows belong in one call: each call reads its rows twice, so calls on calls' results double the plan.
    A null input leaves the mean as it is and does not count. Rows of a symbol have distinct times in ``order``.
    """
    names = list(specs)
    rows = df.select(F.col(key).alias("__k"), F.date_trunc(block, order).alias("__b"), F.date_trunc(span, order).alias("__s"), F.struct(F.col(order).alias("at"), F.struct(*df.columns).alias("row")).alias("__r"))
    blocks = rows.groupBy("__k", "__s", "__b").agg(F.sort_array(F.collect_list("__r")).alias("__rows"))
    maps = blocks.select("__k", "__s", F.struct("__b", *(_map_of("__rows", specs[n][0], specs[n][1]).alias(n) for n in names)).alias("__m"))
    spans = maps.groupBy("__k", "__s").agg(F.sort_array(F.collect_list("__m")).alias("__ms"))
    tops = spans.select("__k", F.struct("__s", *(_composed("__ms", n).alias(n) for n in names)).alias("__m")).groupBy("__k").agg(F.sort_array(F.collect_list("__m")).alias("__all"))
    down = tops.select("__k", F.explode(F.arrays_zip(F.transform("__all", lambda m: m["__s"]).alias("__s"), *(_starts("__all", n, _START()).alias(n) for n in names))).alias("z"))
    down = down.select("__k", F.col("z.__s").alias("__s"), F.struct(*(F.col(f"z.{n}").alias(n) for n in names)).alias("__from"))
    inside = spans.join(down, ["__k", "__s"])
    inside = inside.select("__k", "__s", F.explode(F.arrays_zip(F.transform("__ms", lambda m: m["__b"]).alias("__b"), *(_starts("__ms", n, F.col("__from")[n]).alias(n) for n in names))).alias("z"))
    inside = inside.select("__k", "__s", F.col("z.__b").alias("__b"), F.struct(*(F.col(f"z.{n}").alias(n) for n in names)).alias("__from"))
    found = blocks.join(inside, ["__k", "__s", "__b"])
    values = F.arrays_zip(F.col("__rows"), *(_values("__rows", specs[n][0], specs[n][1], specs[n][2], F.col("__from")[n]).alias(n) for n in names))
    out = found.select(F.explode(values).alias("z"))
    return out.select(*(F.col("z.__rows.row")[c].alias(c) for c in df.columns), *(F.col(f"z.{n}").alias(n) for n in names))


def ema_alpha(w: int) -> float:
    return 2 / (w + 1)


def hysteresis(df: DataFrame, raw: str, out: str, need: int = 2, key: str = "symbol", order: str = "opened_at") -> DataFrame:
    """A state that follows ``raw`` only after ``need`` equal values in a row; the first value starts it."""
    by = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("__new", (~F.col(raw).eqNullSafe(F.lag(raw).over(by))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(by))
    rows = rows.withColumn("__in_run", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)))
    first = F.first(raw).over(by.rowsBetween(Window.unboundedPreceding, 0))
    settled = F.when(F.col("__in_run") >= need, F.col(raw))
    state = F.last(settled, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(state, first)).drop("__new", "__run", "__in_run")
