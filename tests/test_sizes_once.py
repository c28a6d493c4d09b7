"""Each set of size texts is read once, however many rows have it."""

from pyspark.sql import Observation, functions as F

from shelfscope.operators import refresh as P


def test_sizes_of_equal_texts_are_read_once(spark, monkeypatch):
    seen, real = Observation(), P.read_sizes
    monkeypatch.setattr(P, "read_sizes", lambda texts: real(texts.observe(seen, F.count(F.lit(1)).alias("n"))))
    texts = [("soap 500mL×2個", "soap", "500mL×3個"), (None, "soap", "500mL×3個"), ("soap", "soap", None)]
    rows = [(i, *texts[i % 3], 100 + i, "old", 200 + i, True, False) for i in range(60)]
    df = spark.createDataFrame(
        rows, "i long, item_name string, name string, capacity string, price long, price_per_unit string, item_price long, exact boolean, frozen boolean")
    got = {r.i: (r.rule, r.after_price, r.after_capacity) for r in P.decide_fields(df).collect()}
    assert seen.get["n"] == 3
    assert got == {i: (("size_update", "no_size", "no_size")[i % 3], 200 + i, ("500mL×3個", "500mL×3個", None)[i % 3]) for i in range(60)}
