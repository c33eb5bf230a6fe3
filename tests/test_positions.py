"""Positions folded from fills: against a plain loop, in parts, and as a stream that is stopped and run again."""

import os
import random
from datetime import datetime, timedelta

import pytest

from tickloom.operators.positions import folded
from tickloom.streaming import jobs

START = datetime(2024, 2, 27)
SCHEMA = "symbol string, ts timestamp, trade_id long, price double, qty double, buy boolean"


def fills(seed, n, hours=5):
    draw = random.Random(seed)
    return [(draw.choice("AB"), START + timedelta(hours=draw.randrange(hours * n // 2)), i, float(draw.randrange(50, 150)), float(draw.choice([1, 1, 2, 3, 0.5])), draw.random() < 0.5) for i in range(n)]


def by_hand(rows):
    out = {}
    for symbol in sorted({r[0] for r in rows}):
        n, q, e, r = 0, 0.0, 0.0, 0.0
        for _, at, _, price, qty, buy in sorted((x for x in rows if x[0] == symbol), key=lambda x: (x[1], x[2])):
            x, n = qty if buy else -qty, n + 1
            if q == 0 or (q > 0) == (x > 0):
                e = (abs(q) * e + abs(x) * price) / (abs(q) + abs(x))
                q += x
            else:
                r += min(abs(x), abs(q)) * (price - e) * (1 if q > 0 else -1)
                crossed = abs(x) > abs(q)
                q += x
                e = price if crossed else 0.0 if q == 0 else e
            last = at
        out[symbol] = (n, q, e, r, last)
    return out


def check(got, rows):
    want = by_hand(rows)
    assert {r.symbol for r in got} == set(want)
    for r in got:
        n, q, e, profit, last = want[r.symbol]
        assert (r.fills, r.last_at) == (n, last)
        assert (r.quantity, r.entry, r.realized) == pytest.approx((q, e, profit))


@pytest.mark.parametrize(("seed", "n", "hours"), [(1, 300, 5), (2, 80, 60), (3, 1, 2), (4, 200, 1)])
def test_against_a_loop(spark, seed, n, hours):
    rows = fills(seed, n, hours)
    check(folded(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), rows)


def test_in_parts(spark):
    rows = sorted(fills(7, 240), key=lambda r: (r[1], r[2]))
    state = None
    for k in range(0, 240, 60):
        new = folded(spark.createDataFrame(rows[k : k + 60], SCHEMA), state)
        state = new if state is None else new.unionByName(state.join(new, "symbol", "left_anti"))
    check(state.collect(), rows)
    assert folded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_zero_quantity_and_flat_positions(spark):
    rows = [("A", START, 1, 10.0, 2.0, True), ("A", START, 2, 12.0, 2.0, False), ("B", START, 1, 5.0, 1.0, False), ("B", START, 2, 4.0, 0.0, False), ("B", START, 3, 3.0, 3.0, True)]
    got = {r.symbol: r for r in folded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["A"].quantity, got["A"].entry, got["A"].realized) == (0.0, 0.0, 4.0)
    assert (got["B"].quantity, got["B"].entry, got["B"].realized) == (2.0, 3.0, 2.0)


def test_a_stream_that_is_stopped_and_run_again(spark, tmp_path):
    """New files continue from the states; a batch whose commit was lost is run again and counts once."""
    rows, source, path = sorted(fills(11, 150), key=lambda r: (r[1], r[2])), f"{tmp_path}/in", f"{tmp_path}/job"

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{source}")
        jobs.run_positions(stream, f"file://{path}")
        return jobs.positions(spark, f"file://{path}").collect()

    def signed(got):
        return [type(r)(**{**r.asDict(), "quantity": r.quantity if r.side != "short" else -r.quantity}) for r in got]

    arrive(rows[:60])
    check(signed(run()), rows[:60])
    arrive(rows[60:110])
    check(signed(run()), rows[:110])
    check(signed(run()), rows[:110])
    commits = sorted(int(f) for f in os.listdir(f"{path}/state/commits") if f.isdigit())
    assert commits == [0, 1]
    for f in (f"{path}/state/commits/1", f"{path}/state/commits/.1.crc"):
        if os.path.exists(f):
            os.remove(f)
    arrive(rows[110:])
    check(signed(run()), rows)
