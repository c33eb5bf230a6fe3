import re
from itertools import permutations

import pytest

from tickloom.llm import filter_audit as op

DOCS = "doc_id long, text string, lang string, bits int, digest string, part string, n long"
LABELS = "doc_id long, quality int, toxic int, text string"


def by_hand(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    rows = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [e for e, u, _ in docs if (u or "") == text and e is not None]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(e < d for e in same),
        }
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = sum(r[1][f] for r in rows if r[0] == part)
                left = [r for r in left if not r[1][f]]
                alone = sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                shares[f] += len(gone)
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shares[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def long(n, word="w{}"):
    return " ".join(word.format(i) for i in range(n))


CASES = [
    (1, long(250), "en"), (2, long(250), "de"), (3, long(250), "en"), (3, long(250), "en"), (4, "short", "en"), (5, "SHOUT & more", "en"),
    (6, None, None), (7, "", ""), (8, "a " * 400, "en"), (9, long(300) + "\x0b\x0c#", "de"), (None, "short", "en"), (None, None, "en"),
    (10, "É" * 50 + " " + "x", "fr"), (11, long(120000, "Word{}"), "fr"), (12, long(120000, "Word{}"), "fr"), (-1, "SHOUT & more", "fr"),
]
KNOWN = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, 1, None), (4, 1, 1), (5, None, 1), (99, 1, 1), (None, 1, 1), (6, 1, 0), (12, 2, 1)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, lang, 7, "clash", "clash", 9) for d, t, lang in CASES], DOCS).repartition(3)
    labels = spark.createDataFrame([(*r, "clash") for r in KNOWN], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in op.filter_audit(docs, labels).collect()}
    assert got == by_hand(CASES, KNOWN)
    assert len(got) == 120 * 5 * len({lang or "" for _, _, lang in CASES})


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    docs = spark.createDataFrame([(d, t, lang, 7, "", "", 9) for d, t, lang in CASES[:n]], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert op.filter_audit(docs, labels).count() == 600 * n


def test_hot_part_and_hot_copies(spark):
    docs = [(i, "the same short text", "en") for i in range(2000)] + [(5000 + i, long(210, f"v{i}-{{}}"), "en") for i in range(5)]
    rows = op.filter_audit(spark.createDataFrame([(d, t, lang, 7, "", "", 9) for d, t, lang in docs], DOCS), spark.createDataFrame([], LABELS))
    first = {(r.filter_order, r.step): r for r in rows.collect()}
    assert first["EABCD", 1].removed == 1999
    assert first["EABCD", 2].removed == 1
    assert first["ABCDE", 5].kept == 5
    assert first["ABCDE", 5].redundant == 1999
