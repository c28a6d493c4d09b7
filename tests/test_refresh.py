"""Field decisions: one row per rule, in rule order."""

from pyspark.sql import functions as F

from shelfscope.operators import refresh as P

ROWS = [
    # stored size, item name, exact, frozen -> rule, price, size, unit price, review
    ("500mL", "茶 600mL", True, True, "frozen", 120, "500mL", "約0.24円/mL", False),
    ("5kg", "米 2kg 5kg", True, False, "variants", 100, "5kg", "old", True),
    ("500mL×2本", "水 3本", True, False, "new_count", 120, "500mL×2本", "約0.12円/mL", True),
    ("500mL×2本", "水 500mL", True, False, "same_piece", 120, "500mL×2本", "約0.12円/mL", True),
    ("10枚", "布 12枚", True, False, "count_update", 120, "10枚", "約12円/枚", True),
    ("500mL", "水 3本", True, False, "keep_measure", 120, "500mL", "約0.24円/mL", True),
    ("5巻", "紐 3本 20g", True, False, "misread", 120, "5巻", "約24円/巻", True),
    ("500ml", "水 600mL", True, False, "size_update", 120, "500ml", "約0.24円/ml", True),
    ("500mL", "水 500mL", True, False, "keep", 120, "500mL", "約0.24円/mL", False),
    ("500mL", "水", True, False, "no_size", 120, "500mL", "約0.24円/mL", True),
    ("詰替用", "水 500mL", True, False, "replace_unreadable", 120, "500mL", "約0.24円/mL", False),
    ("500mL", "水 600mL", False, False, "keep", 120, "500mL", "約0.24円/mL", True),
]


def _decided(spark, **options):
    rows = [(i, "品", r[0], 100, "old", r[1], 120, r[2], r[3]) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(
        rows, "i int, name string, capacity string, price long, price_per_unit string, item_name string, "
              "item_price long, exact boolean, frozen boolean")
    return P.decide_fields(df, F.lit(None).cast("string"), **options).orderBy("i").collect()


def test_rules(spark):
    for got, want in zip(_decided(spark), ROWS):
        seen = (got.rule, got.after_price, got.after_capacity, got.after_price_per_unit, got.needs_review)
        assert seen == want[4:], (want[:4], seen, got.review_reasons)


def test_sizes_apply_on_request(spark):
    after = [r.after_capacity for r in _decided(spark, auto_apply_size=True)]
    assert after[2] == "500mL×3本" and after[4] == "12枚" and after[6] == "-" and after[7] == "600ml"


def test_unit_price_keeps_skipped_and_unreadable(spark):
    df = spark.createDataFrame([(1, "5枚", "old", True), (2, "5枚", "old", False), (3, "?", "old", False)],
                               "i int, capacity string, price_per_unit string, skip boolean").withColumn("price", F.lit(10))
    got = {r.i: r.price_per_unit for r in P.sync_unit_prices(df, None, F.col("skip")).collect()}
    assert got == {1: "old", 2: "約2.0円/枚", 3: "old"}
