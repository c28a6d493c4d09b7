"""Pack sizes, unit prices and item names: one row per rule."""

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import capacity as C
from shelfscope.functions import names as N

SIZES = [
    ("12枚×3箱（36枚）", 36, "枚"), ("330mL×4本", 1320, "mL"), ("10組×7箱", 70, "組"),
    ("5枚×2箱×3セット", 30, "枚"), ("1,500mL", 1500, "mL"), ("2.5kg×2袋", 5, "kg"),
    ("３００ｇ＊２", 600, "g"), ("20枚（携帯×2）", 20, "枚"), ("8ロール×4パック", 32, "ロール"),
    ("7ロール", 7, "ロール"), ("不明", None, None), ("-", None, None), ("", None, None),
]


def test_totals(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SIZES)], "i int, t string")
    rows = C.with_total(df, "t", "z").orderBy("i").collect()
    for row, (_, total, unit) in zip(rows, SIZES):
        assert (row.z is None) == (total is None), row
        if total is not None:
            assert (row.z.total, row.z.unit) == (total, unit)


PRICES = [
    # price, size, target, label: digits by magnitude, ties on the binary value
    (145, "100g", None, "約1.4円/g"), (125, "100枚", None, "約1.3円/枚"), (996, "100枚", None, "約10.0円/枚"),
    (2550, "100枚", None, "約26円/枚"), (1, "200枚", None, "約0.01円/枚"), (3, "4000g", "g", "約0.00円/g"),
    (300, "2kg", "g", "約0.15円/g"), (300, "2kg", None, "約150円/kg"), (100, "50枚", "組", "約4.0円/組"),
    (0, "50枚", None, None), (100, "なし", None, None),
]


def test_unit_price_text(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)],
                               "i int, price long, t string, target string, label string")
    df = C.with_unit_price(C.with_total(df, "t", "z"), "price", "z", "u", F.col("target"))
    for row in df.orderBy("i").collect():
        assert (row.u.label if row.u else None) == row.label, row


NAMES = [
    ("紙タオル 150枚×6箱", "150枚×6箱"), ("布巾 40枚（960枚）", "（960枚）"), ("石けん液 250mL", "250mL"),
    ("【3個】石けん液 250mL", "250mL×3個"), ("【6個】おしぼり 80枚×6P", "80枚×6"),
    ("ごみ袋 30L 1組（600枚：60枚×10冊）", "（600枚）"), ("ラップ 22cm×20m(1コ入*4コセット)", "20m×4個"),
    ("ティシュ 180枚（90組）×5箱", "180枚（90組）×5箱"), ("紙 90m 6ロール×8パック", "90m×6ロール×8パック"),
    ("紙 60m まとめ(6ロール×4パック入)", "60m×6ロール×4パック"),
    ("6ロール(白) 6ロール×8パック(48ロール) 80m", "80m×6ロール×8パック"), ("綿 40枚の5個セット", "40枚×5個"),
    ("液 300mL 2個セット", "300mL×2個"), ("紙 45m 24ロール 白", "45m×24ロール"), ("紙 36ロール", "36ロール"),
    ("60m×24ロール×2ロール×12パック", "60m×24ロール（2ロール×12パック）"), ("4kgまで64枚入", "64枚"),
    ("赤ちゃん〜4000g 紙", None), ("型番 HX1234 2本", "2本"), ("傷パッチ 36粒", "36枚"),
    ("120mmフィルター 8枚", "8枚"), ("原液１.５L", "1.5L"), ("なまえだけ", None),
    ("50枚(25枚束×2セット)", "50枚"), ("防カビくん煙剤 4g 2個パック×3セット", "2個×3セット"),
]


def test_names(spark):
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "i int, n string, want string")
    for row in N.with_name_capacity(df, "n", "got").orderBy("i").collect():
        assert row.got == row.want, row


def test_filter_on_result_does_not_blow_up(spark):
    df = spark.createDataFrame([("a 5枚×2箱",), ("b",)], "n string")
    parsed = N.with_name_capacity(df, "n", "got")
    kept = parsed.filter("got IS NOT NULL")
    assert kept.count() == 1

    def size(frame):
        return len(frame._jdf.queryExecution().optimizedPlan().toString())

    assert size(kept) < 1.1 * size(parsed)


def test_analysis(spark):
    df = spark.createDataFrame([("水 500mL×2本",), ("洗剤 2kg 5kg",), ("選べる 30枚",), ("x",)], "n string")
    got = {r.n: r for r in N.with_capacity_analysis(df, "n").collect()}
    assert got["洗剤 2kg 5kg"].confidence == "low" and "複数の実容量候補を含む" in got["洗剤 2kg 5kg"].reasons
    assert got["選べる 30枚"].reasons == ["曖昧語を含む: 選べる"] or got["選べる 30枚"].confidence == "low"
    assert got["x"].found is None and not got["x"].auto_update


@pytest.mark.parametrize("old, new, want", [
    ("500mL×3本", "5本", "500mL×5本"), ("500mL×3本", "5個", None), ("1,200g x 2袋", "4袋", "1,200g x 4袋"), ("500mL", "5本", None),
])
def test_merge(spark, old, new, want):
    df = C.with_total(spark.createDataFrame([(old, new)], "o string, n string"), "n", "t")
    assert df.select(C.merged_quantity(F.col("o"), F.col("n"), F.col("t"))).first()[0] == want


def test_name_fix_guards(spark):
    rows = [("茶 300mL", "290mL", "茶 290mL"), ("茶 300mL×2本", "290mL", None), ("茶 300mL", "2本×3", None),
            ("茶 300mL", "300mL", None), ("茶 300mL", "290g", None)]
    df = N.with_name_capacity(spark.createDataFrame(rows, "n string, c string, want string"), "n", "e")
    df = C.with_total(C.with_total(df, "e", "et"), "c", "ct")
    fixed = N.fixed_name(F.col("n"), F.col("e"), F.col("et"), F.col("c"), F.col("ct"))
    for r in df.withColumn("got", fixed).collect():
        assert r.got == r.want, r
