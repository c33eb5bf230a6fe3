"""All twelve chart patterns, bar by bar, against plain loops over each bar's own window."""

import random
from datetime import datetime, timedelta

import pytest

from tickloom.operators import patterns as op

START = datetime(2024, 1, 1)
NEAR, BUFFER = 0.02, 0.003


def pivots(prices, k, above):
    out = []
    for i in range(k, len(prices) - k):
        near = prices[i - k : i] + prices[i + 1 : i + k + 1]
        if all(prices[i] >= p if above else prices[i] <= p for p in near):
            if not out or i - out[-1][0] > k:
                out.append((i, prices[i]))
            elif prices[i] > out[-1][1] if above else prices[i] < out[-1][1]:
                out[-1] = (i, prices[i])
    return out


def by_hand(rows, k, lookback, least):
    """(pattern, signal, confidence, stop) of the last row, or None."""
    w = rows[-lookback:]
    if len(w) < 2 * k + 3:
        return None
    hs, ls = pivots([r["h"] for r in w], k, True), pivots([r["l"] for r in w], k, False)
    close, now = w[-1]["c"], len(w) - 1
    P = lambda a: [p for _, p in a]
    flat = lambda a: min(P(a)) > 0 and max(P(a)) / min(P(a)) - 1 <= NEAR
    up = lambda a: all(q > p for p, q in zip(P(a), P(a)[1:], strict=False))
    down = lambda a: all(q < p for p, q in zip(P(a), P(a)[1:], strict=False))
    mean = lambda a: sum(P(a)) / len(a)
    slope = lambda a: (a[-1][1] - a[0][1]) / (a[-1][0] - a[0][0])
    line = lambda a: a[-1][1] + slope(a[-2:]) * (now - a[-1][0])
    between = lambda a, own: [x for x in a if own[0][0] < x[0] < own[-1][0]]
    found, h3, l3 = {}, hs[-3:], ls[-3:]
    if len(hs) >= 2 and len(ls) >= 2:
        gaps = h3[0][1] - l3[0][1], h3[-1][1] - l3[-1][1]
        closing, n = gaps[0] > gaps[1] > 0, len(h3) + len(l3)
        if flat(h3) and up(l3):
            found["ascending_triangle"] = mean(h3), None, l3[-1][1], n
        if flat(l3) and down(h3):
            found["descending_triangle"] = None, mean(l3), h3[-1][1], n
        if down(h3) and up(l3) and closing:
            found["symmetrical_triangle"] = line(hs), line(ls), l3[-1][1], n
        if flat(hs[-4:]) and flat(ls[-4:]):
            found["box_range"] = mean(hs[-4:]), mean(ls[-4:]), ls[-1][1], len(hs[-4:]) + len(ls[-4:])
        if down(h3) and down(l3) and slope(h3) < slope(l3) and closing:
            found["falling_wedge"] = line(hs), None, l3[-1][1], n
        if up(h3) and up(l3) and slope(l3) > slope(h3) and closing:
            found["rising_wedge"] = None, line(ls), h3[-1][1], n
    for n, name in ((2, "double"), (3, "triple")):
        if len(hs) >= n and flat(hs[-n:]) and len(b := between(ls, hs[-n:])) >= n - 1:
            found[f"{name}_top"] = None, min(P(b)), max(P(hs[-n:])), n + len(b)
        if len(ls) >= n and flat(ls[-n:]) and len(b := between(hs, ls[-n:])) >= n - 1:
            found[f"{name}_bottom"] = max(P(b)), None, min(P(ls[-n:])), n + len(b)
    if len(h3) == 3 and h3[1][1] > max(h3[0][1], h3[2][1]) and flat([h3[0], h3[2]]) and len(b := between(ls, h3)) >= 2:
        found["head_and_shoulders"] = None, mean(b), h3[2][1], 3 + len(b)
    if len(l3) == 3 and l3[1][1] < min(l3[0][1], l3[2][1]) and flat([l3[0], l3[2]]) and len(b := between(hs, l3)) >= 2:
        found["inverse_head_and_shoulders"] = mean(b), None, l3[2][1], 3 + len(b)
    if not found:
        return None
    loud = len(w) >= 20 and w[-1]["v"] > sum(r["v"] for r in w[-20:]) / 20 * 1.3
    hi, lo = max(r["h"] for r in w), min(r["l"] for r in w)
    spans = [(r["h"] - r["l"]) / r["c"] for r in w[-20:]]
    options = []
    for name in op.SHAPES:
        if name in found:
            above, below, stop, many = found[name]
            side = 2 if below is not None and close < below * (1 - BUFFER) else 1 if above is not None and close > above * (1 + BUFFER) else 0
            trend = len(w) >= 5 and (side == 1 and close >= w[-5]["c"] or side == 2 and close <= w[-5]["c"])
            score = 0.65 + (0.15 if side else 0) + (0.15 if loud else -0.1) + (0.1 if trend else 0) + (0.05 if many >= 4 else 0) - (0.1 if (hi - lo) / hi < BUFFER else 0) - (0.1 if sum(spans) / len(spans) > 0.08 else 0)
            options.append((side, round(min(1, max(0, score)), 6), name, stop))
    side = max(o[0] for o in options)
    best = max((o for o in options if o[0] == side), key=lambda o: o[1])
    return best[2], ["wait", "long", "short"][side if best[1] >= least else 0], best[1], best[3]


def walk(seed, n, step, pull):
    draw, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price += draw.choice([-2, -1, 0, 1, 2]) * step + (100 - price) * pull
        o, c = price, price + draw.choice([-1, 0, 1]) * step
        rows.append({"at": START + timedelta(hours=i), "o": o, "c": c, "h": max(o, c) + draw.choice([0, step]), "l": min(o, c) - draw.choice([0, step]), "v": float(draw.choice([1, 2, 3, 9]))})
    return rows


SEEN: set[str] = set()


@pytest.mark.parametrize(("seed", "step", "pull", "lookback"), [(1, 0.8, 0.02, 120), (2, 0.3, 0.05, 60), (3, 2.5, 0.01, 45), (4, 1.2, 0.0, 30)])
def test_against_loops(spark, seed, step, pull, lookback):
    rows = walk(seed, 420, step, pull)
    df = spark.createDataFrame([("A", r["at"], r["o"], r["h"], r["l"], r["c"], r["v"]) for r in rows], "symbol string, opened_at timestamp, open double, high double, low double, close double, volume double")
    got = {r.opened_at: r for r in op.chart_patterns(df.repartition(3), lookback=lookback, near=NEAR).collect()}
    for i, r in enumerate(rows):
        want = by_hand(rows[: i + 1], 3, lookback, 0.6)
        if want is None:
            assert r["at"] not in got
            continue
        g = got[r["at"]]
        SEEN.add(g.pattern)
        assert (g.pattern, g.signal, g.confidence) == (*want[:2], pytest.approx(want[2])), i
        if g.signal == "long":
            assert g.stop_loss == pytest.approx(min(want[3], r["c"]) * (1 - BUFFER)) and g.take_profit == pytest.approx(r["c"] + 2 * (r["c"] - g.stop_loss))
        elif g.signal == "short":
            assert g.stop_loss == pytest.approx(max(want[3], r["c"]) * (1 + BUFFER)) and g.take_profit == pytest.approx(r["c"] - 2 * (g.stop_loss - r["c"]))


def test_every_pattern_occurred():
    assert set(op.SHAPES) >= SEEN and len(SEEN) >= 10, set(op.SHAPES) - SEEN
