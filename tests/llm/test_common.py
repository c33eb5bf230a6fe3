from pyspark.sql import functions as F

from tickloom.llm import bits, common


def test_sample_is_bounded_and_the_same_each_time(spark):
    rows = spark.range(5000).select((F.col("id") * 3).alias("k"))
    one, two = ({r.k for r in common.hashed_sample(df, "k", 300).collect()} for df in (rows, rows.repartition(7)))
    assert one == two and len(one) == 300
    assert common.hashed_sample(rows.limit(5), "k", 300).count() == 5
    assert common.hashed_sample(rows.limit(0), "k", 300).count() == 0


def test_bit_filter_keeps_every_member(spark, monkeypatch):
    import numpy as np

    values = [-5, 0, 7, 1 << 40, -(1 << 62), bits.SIZE, bits.SIZE - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    held = bits.filled(df)
    assert bits.test(held, np.array(values, np.int64)).all()
    assert not bits.test(held, np.array([1, 2, 3], np.int64)).any()
    monkeypatch.setattr(bits, "SIZE", 8 * 4)
    assert bits.filled(df) is None


def test_components_of_chains_and_stars(spark):
    from tickloom.llm.graph import components

    links = [(i, i + 1) for i in range(40, 60)] + [(5, k) for k in range(6, 30)] + [(100, 100), (70, 71), (71, 70)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(40, 61)} == {40} and {got[k] for k in range(5, 30)} == {5} and got[71] == got[70] == 70
