import hashlib
import random
import zlib

import pytest

from tickloom.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, ids string"


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, text[:64], mark, text))
    convs = {c: [(t[2], t[5]) for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(convs.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(path)))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, shards):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op.prefix_trie(op.rebuilt_paths(df), shards).collect()), key=str)


def talk(seed, n, wide, deep):
    """Conversations over few turns, so that many share prefixes of all depths; each hundred has one or no head."""
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(-150, 900), n):
        for k in range(draw.randrange(1, deep)):
            rows.append((c, k, draw.choice(["user", "bot"]), f"{draw.randrange(wide)} é" * draw.randrange(1, 3)))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_against_brute_force(spark, shards):
    rows = talk(5, 260, 2, 9)
    assert run(spark, rows, shards) == by_hand(rows)


def test_nulls_ties_copies_and_long_texts(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, "", ""), (2, 5, "user", "x" * 300_000), (2, 5, "user", "x" * 300_000), (None, 1, "user", "lost")]
    rows += [(c, k, "user", f"same {k}") for c in range(3000, 3040) for k in range(8)] + [(5007, 1, "user", "alone"), (100, 3, "a", "bc"), (103, 3, "ab", "c")]
    for shards in (1, 4):
        assert run(spark, rows, shards) == by_hand(rows)


def test_hot_conversation_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 8)
    rows = [(c, k, "user", f"turn {k}") for c in range(200, 290) for k in range(7)] + talk(2, 40, 3, 4)
    assert run(spark, rows, 5) == by_hand(rows)


def test_deep_conversation_and_empty_table(spark):
    rows = [(c, k, "user", str(k if k < 150 + c else -c)) for c in (1, 2, 3) for k in range(300)]
    assert run(spark, rows, 3) == by_hand(rows)
    assert run(spark, [], 3) == []


def test_splitters_are_distinct_in_order_and_make_a_small_skeleton(spark):
    df = spark.createDataFrame([(*r, "", 1, "") for r in talk(9, 400, 3, 9)], SCHEMA)
    paths = op.chunked_ids(op.rebuilt_paths(df))
    splitters = op.splitters_of(paths, 20)
    assert splitters == sorted(set(splitters)) and 5 < len(splitters) < 20
    whole = {bytes(r.path) for r in paths.select("path").collect()}
    for s in op.skeleton_of(splitters):
        assert s == b"" or any(p.startswith(s) and p != s for p in whole)
