"""Files against their manifest, lines cut short, conflicting keys and resumed appends."""

import os

from tickloom.sources import manifests as m

SCHEMA = "k long, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, k long, v string")


def files(path):
    return {os.path.basename(d).split("=")[1]: os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_every_kind_of_damage_is_named(spark, tmp_path):
    path = f"{tmp_path}/data"
    rows = [(g, k, None if k == 3 else f"{g}{k}\n\"é") for g in "abcde" for k in range(5)]
    m.write_lines(table(spark, rows), f"file://{path}", "g")
    stated = spark.createDataFrame(m.manifest(spark, f"file://{path}", "g").collect())
    assert {r.lines for r in stated.collect()} == {5}
    assert {r.status for r in m.checked(spark, f"file://{path}", stated, "g").collect()} == {"ok"}
    at = files(path)
    text = open(at["a"]).read()
    open(at["a"], "w").write(text.replace("a1", "a9"))
    short = open(at["b"]).read()[:-7]
    open(at["b"], "w").write(short)
    os.rename(at["c"], f"{tmp_path}/elsewhere")
    open(at["d"].replace("part-", "part-x"), "w").write(text)
    for name in ("a", "b", "c"):
        crc = os.path.join(os.path.dirname(at[name]), f".{os.path.basename(at[name])}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    got = {(r.g, r.status): (r.stated_lines, r.lines) for r in m.checked(spark, f"file://{path}", stated, "g").collect()}
    assert got == {("a", "changed"): (5, 5), ("b", "truncated"): (5, 4), ("c", "missing"): (5, None), ("d", "ok"): (5, 5), ("d", "unknown"): (None, 5), ("e", "ok"): (5, 5)}
    assert m.read_lines(spark, f"file://{path}", "g", SCHEMA).where("g = 'b'").count() == 4


def test_equal_rows_give_equal_files(spark, tmp_path):
    rows = [(g, k, f"{g}{k}") for g in "ab" for k in range(200)]
    for n in (1, 7):
        m.write_lines(table(spark, rows).repartition(n), f"file://{tmp_path}/{n}", "g")
    one, other = ({(r.g, r.sha256) for r in m.manifest(spark, f"file://{tmp_path}/{n}", "g").collect()} for n in (1, 7))
    assert one == other and len(one) == 2


def test_resume_after_a_partial_write_and_conflicts(spark, tmp_path):
    path = f"{tmp_path}/data"
    rows = [("a", k, f"v{k}") for k in range(20)]
    m.write_lines(table(spark, rows[:12]), f"file://{path}", "g")
    at = files(path)["a"]
    short = open(at).read()[:-4]
    open(at, "w").write(short)
    os.remove(os.path.join(os.path.dirname(at), f".{os.path.basename(at)}.crc"))
    for _ in range(2):
        m.resume(table(spark, rows), f"file://{path}", "g", ["g", "k"], SCHEMA)
    assert sorted(map(tuple, m.read_lines(spark, f"file://{path}", "g", SCHEMA).collect())) == sorted(rows)
    m.write_lines(table(spark, [("a", 3, "other"), ("a", 4, "v4")]), f"file://{path}", "g")
    agreed, refused = m.without_conflicts(m.read_lines(spark, f"file://{path}", "g", SCHEMA), ["g", "k"])
    assert [tuple(r) for r in refused.collect()] == [("a", 3)]
    assert sorted(r.k for r in agreed.collect()) == [k for k in range(20) if k != 3]
