import random
import shutil

from pyspark.sql import functions as F

from shelfscope.operators import refresh_run as N
from shelfscope.streaming import ledger

PRODUCT = ("article_id string, orig_idx long, rank long, name string, price long, capacity string, price_per_unit string, "
           "review_count long, rating double, base_url string, image_url string")
HIT = ("orig_idx long, stage int, pos int, name string, price long, review_count long, rating double, item_url string, "
       "affiliate_url string, image_url string, shop_url string, shop_name string")
ITEM = "https://item.rakuten.co.jp/s/{}/"


def catalogue(spark, rnd):
    rows = []
    for a in range(12):
        for i in range(rnd.randint(1, 14)):
            k = 100 * a + i
            url = rnd.choice([ITEM.format(k), ITEM.format(k), ITEM.format(k), ""])
            size = rnd.choice(["10g", "200g×3個", "1L", "", "-", "5枚"])
            rows.append((f"a{a}", k, i + 1, f"soap{k} plain {size}".strip(), rnd.randint(100, 900), size, "-", rnd.randint(0, 50), 4.0, url, "i"))
    return spark.createDataFrame(rows, PRODUCT), rows


def responses(rnd, rows, missing=0.15):
    out = []
    for r in rows:
        if rnd.random() < missing:
            continue
        size = rnd.choice([r[5], r[5], "300g", "2L×2個"])
        name = f"soap{r[1]} {size}" if rnd.random() < 0.9 else "something else"
        out.append((r[1], 1, 1, name, rnd.randint(100, 900), rnd.randint(0, 60), 3.5, r[9] or ITEM.format("x"), None, "j", "https://x.example/", "s"))
        out.append((r[1], 0, 0, "ふるさと納税 soap", 1, 1, 1.0, r[9] or ITEM.format("y"), None, "j", "https://x.example/", "s"))
    return out


def test_reached_articles_give_the_full_recomputation(spark, tmp_path):
    rnd = random.Random(1)
    products, rows = catalogue(spark, rnd)
    articles = products.select("article_id", F.concat(F.lit("5選 "), "article_id").alias("title"),
                               F.when(F.col("article_id") == "a3", "review").alias("article_type"),
                               F.lit(None).cast("string").alias("target_unit")).distinct()
    frozen = products.select("article_id", "orig_idx").where("orig_idx % 9 = 0")
    day = F.lit("2024-03-10").cast("date")
    first = responses(rnd, rows)
    mine = {r[1] for r in rows if r[0] in ("a1", "a5")}  # later only some articles' responses differ
    last = [h for h in first if h[0] not in mine] + responses(rnd, [r for r in rows if r[1] in mine])
    first, last = (spark.createDataFrame(h, HIT) for h in (first, last))
    some, whole = str(tmp_path / "some"), str(tmp_path / "whole")
    ledger.create(products, some)
    N.refresh(spark, some, 1, articles, first, frozen, day)
    N.refresh(spark, some, 2, articles, first, frozen, day, earlier_hits=first)
    shutil.copytree(some, whole)
    N.refresh(spark, some, 3, articles, last, frozen, day, earlier_hits=first)
    N.refresh(spark, whole, 3, articles, last, frozen, day)
    a, b = (sorted(map(str, ledger.state(spark, r).collect())) for r in (whole, some))
    assert a == b
    assert not N.refresh(spark, some, 3, articles, last, frozen, day)
    read = [ledger.committed(spark, r, "judged").where("batch_id = 3").count() for r in (some, whole)]
    assert 0 < read[0] < 0.6 * read[1]
    state = ledger.state(spark, some)
    assert state.where("article_id <> 'a3'").groupBy("article_id").count().agg(F.max("count")).first()[0] <= 10
    assert {r.failure for r in ledger.committed(spark, some, "queue").collect()} <= {
        "own item not confirmed", "name of own item differs", "only excluded", "none found"}


def test_look_up_takes_the_earliest_stage_and_no_stand_in(spark):
    products = spark.createDataFrame([
        (1, "green tea", ITEM.format("a")), (2, "green tea", ITEM.format("b")), (3, "green tea", ITEM.format("c")),
        (4, "green tea", ""), (5, "green tea", "")], "orig_idx long, name string, base_url string")

    def hit(k, stage, pos, name, item):
        return (k, stage, pos, name, 10 * stage + pos, 0, 0.0, ITEM.format(item), None, None, "https://x.example/", "s")

    hits = spark.createDataFrame([
        hit(1, 2, 0, "green tea", "a"), hit(1, 1, 5, "green tea", "a"), hit(1, 1, 7, "green tea", "a"),
        hit(2, 0, 0, "green tea", "z"), hit(3, 0, 0, "black coffee", "c"), hit(4, 0, 3, "any", "q"), hit(4, 1, 2, "any", "r"),
        hit(5, 0, 0, "ふるさと納税", "q")], HIT)
    got = {r.orig_idx: (r.hit.price if r.hit else None, r.exact, r.failure) for r in N.look_up(products, hits).collect()}
    assert got == {1: (15, True, None), 2: (None, True, "own item not confirmed"), 3: (None, True, "name of own item differs"),
                   4: (12, False, None), 5: (None, False, "only excluded")}
