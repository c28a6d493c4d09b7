"""Behaviour that must hold whatever the partitioning or the skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import names as N
from shelfscope.operators import catalogue as K
from shelfscope.operators import decisions as D
from shelfscope.operators import matching as M
from shelfscope.operators import numbering as B
from shelfscope.operators import offers as O
from shelfscope.operators import phrases as P
from shelfscope.operators import quality as Q
from shelfscope.operators import ranking as R
from shelfscope.sources import jsonl as J
from shelfscope.sources import tables as W
from shelfscope.session import cut_lineage


def test_hot_key_numbers_equal_the_window(spark):
    # one key holds most rows; the distributed way is forced by a bound of 10
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 101).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    plain = B.row_numbers(df, ["k"], order, "n")
    spread = B.row_numbers(df, ["k"], order, "n", max_task_rows=10)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, spread.collect()), key=str)


def _ranked(spark, rows):
    df = spark.createDataFrame(rows, "article_id string, orig_idx long, price long, review_count long, "
                                     "unit_value double, unit string")
    return [r.orig_idx for r in R.rank_by_unit_price(df).orderBy("new_rank").collect()]


def test_rank_groups_by_size_then_reviews_then_unknown(spark):
    rows = [("a", 0, 10, 5, 2.0, "g"), ("a", 1, 10, 9, 1.0, "mL"), ("a", 2, 10, 1, None, None),
            ("a", 3, 10, 1, 1.0, "g"), ("a", 4, 10, 8, 3.0, "mL"), ("a", 5, 10, 1, 9.0, "枚")]
    # both pairs have two products; mL has more reviews at the first place
    assert _ranked(spark, rows) == [1, 4, 3, 0, 5, 2]


def test_rank_skips_places_without_reviews(spark):
    rows = [("a", 0, 10, None, 1.0, "g"), ("a", 1, 10, 3, 2.0, "g"),
            ("a", 2, 10, 50, 1.0, "mL"), ("a", 3, 10, 2, 2.0, "mL")]
    # the first place cannot be compared, the second can
    assert _ranked(spark, rows) == [0, 1, 2, 3]


def test_ranking_is_idempotent(spark):
    rows = [("a", i, 100 - i, i, float(i % 4 + 1), ["g", "mL", "枚"][i % 3]) for i in range(12)]
    once = _ranked(spark, rows)
    again = [(a, once.index(i), p, r, v, u) for a, i, p, r, v, u in rows]
    assert _ranked(spark, again) == list(range(12))


def test_unknown_last_in_both_directions(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 30), ("a", 2, 10)],
                               "article_id string, orig_idx long, lowest_price long")
    for down, want in ((False, [2, 1, 0]), (True, [1, 2, 0])):
        got = R.comparison_sort(df, "price", down).orderBy("place").collect()
        assert [r.orig_idx for r in got] == want


def _offer(key, provider, pos, price, url="https://s.example/1", status=None, available=True):
    return (key, provider, pos, price, url, status, available, None)


OFFER = ("orig_idx long, provider string, pos long, price long, url string, match_status string, "
         "available boolean, label string")


def test_fallbacks_differ_between_providers(spark):
    products = spark.createDataFrame([(1, "n a", 500, "https://b.example/1")], "orig_idx long, name string, price long, base_url string")
    offers = spark.createDataFrame([
        _offer(1, "yahoo", 0, 90, status="pending"), _offer(1, "amazon", 1, 10, status="rejected")], OFFER)
    seen = O.visible_offers(products, offers, "orig_idx", ["rakuten", "yahoo", "amazon"],
                            yahoo=("s", "p"), amazon_tag="t").collect()
    # a hidden offer of the last provider still suppresses its search link
    assert sorted(r.provider for r in seen) == ["rakuten", "yahoo"]


def test_price_labels(spark):
    products = spark.createDataFrame([(i, "n", 0, None) for i in (1, 2, 3)], "orig_idx long, name string, price long, base_url string")
    offers = spark.createDataFrame([
        _offer(1, "rakuten", 0, 1500), _offer(1, "yahoo", 1, 2900), _offer(2, "yahoo", 0, 70),
        _offer(2, "rakuten", 1, 70), _offer(3, "rakuten", 0, 5), _offer(3, "amazon", 1, 1)], OFFER)
    seen = O.visible_offers(products, offers, "orig_idx", ["rakuten", "yahoo", "amazon"])
    rows = {r.orig_idx: r for r in O.price_summary(O.comparable(seen), "orig_idx").collect()}
    assert rows[1].gap_label == "楽天が1,400円安い" and rows[2].gap_label == "同価格"
    assert rows[2].lowest_provider == "rakuten" and rows[3].gap_label is None and rows[3].price_rows == 1


STATE = ("k long, provider string, label string, url string, match_status string, price long, rating double, "
         "review_count long, image_url string, available boolean, updated_at string, catalogue_id string")


def _upsert(spark, status, same, had=True, provider="yahoo", **flags):
    cur = [(1, provider, "old", "u1", status, 10, 4.0, 3, "i", True, "d0", "C0")] if had else []
    new = [(1, provider, "new", "u1" if same else "u2", None, None, 4.5, None, None, False, "d1", "C1")]
    incoming = spark.createDataFrame(new, STATE).drop("match_status").withColumns(
        {f: F.lit(flags.get(f, False)) for f in ("verified", "strict", "force")})
    return O.upsert_offers(spark.createDataFrame(cur, STATE), incoming, ["k"]).first()


def test_upsert_truth_table(spark):
    r = _upsert(spark, None, False, had=False)
    assert (r.match_status, r.price, r.available, r.changed) == ("pending", None, False, True)
    for status in ("review", "rejected"):
        r = _upsert(spark, status, True, verified=True, strict=True, force=True)
        assert (r.match_status, r.changed, r.url) == (status, False, "u1") and r.reason
    r = _upsert(spark, "matched", True)
    assert (r.match_status, r.price, r.rating, r.label, r.available) == ("matched", 10, 4.5, "old", False)
    assert _upsert(spark, None, False).reason and not _upsert(spark, None, False).changed
    r = _upsert(spark, "matched", False, force=True)
    assert (r.match_status, r.url, r.price, r.catalogue_id) == ("pending", "u2", None, "C0")
    assert _upsert(spark, "pending", True, verified=True, strict=True).match_status == "matched"
    assert _upsert(spark, "pending", True, verified=True).match_status == "pending"
    assert not _upsert(spark, "pending", False).changed
    r = _upsert(spark, "pending", False, verified=True, strict=True)
    assert (r.match_status, r.url, r.review_count, r.catalogue_id) == ("pending", "u2", None, "C1")
    r = _upsert(spark, "matched", True, provider="amazon")
    assert (r.price, r.rating, r.available, r.updated_at) == (None, None, None, "d1")


def _related_by_force(rows):
    live = [r for r in rows if not r[4]]
    want = set()
    for a in live:
        def order(b):
            if b[1] == a[1]:
                tier, shared = 1, 0
            else:
                shared = len(set(a[2] or ()) & set(b[2] or ()))
                tier = 2 if shared else 3
            return (tier, -shared, -b[3].toordinal(), b[0])
        best = sorted((b for b in live if b[0] != a[0]), key=order)[:3]
        want |= {(a[0], p + 1, b[0]) for p, b in enumerate(best)}
    return want


ARTICLE = "article_id string, category_id string, tags array<string>, published_at date, draft boolean"


@pytest.mark.parametrize("hot", [[], ["all"], ["all", "most"]])
def test_related_matches_brute_force(spark, hot):
    """Few and many tags, missing ones, and tags that (nearly) all articles hold."""
    rnd = random.Random(3)
    rows = []
    for i in range(90):
        tags = rnd.sample([f"t{j}" for j in range(16)], 12 if i % 9 == 0 else rnd.randint(0, 4))
        tags += [t for t in hot if t == "all" or i % 7]
        rnd.shuffle(tags)
        rows.append((f"a{i:02d}", f"c{i // 2}", tags if i % 11 else None, dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(0, 40)), i % 10 == 0))
    got = {(r.article_id, r.place, r.related_id) for r in K.related_articles(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert got == _related_by_force(rows)


def test_related_with_a_tag_on_all_articles_makes_no_pairs(spark):
    """The rows that reach the ranking grow with the articles, not with their square."""
    def rows(n):
        return [(f"a{i:04d}", f"c{i}", ["all", f"s{i % (n // 4)}"], dt.date(2024, 1, 1) + dt.timedelta(i * 7 % 400), False) for i in range(n)]

    counts = []
    for n in (200, 800):
        df = spark.createDataFrame(rows(n), ARTICLE)
        counts.append(K._most_shared(df, df, 3).count())
    assert counts[0] < 12 * 200 and counts[1] < 5 * counts[0]


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"n": {i}, "pad": "{"x" * (i % 37)}"}}' for i in range(4000)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_bytes(b"{}\r\n\r\nbad\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = J.tolerant(J.read_lines(spark, str(tmp_path)))
        big = rows.filter(F.col("file").endswith("a.jsonl")).orderBy("line_no").select("line_no", "raw").collect()
        small = rows.filter(F.col("file").endswith("b.jsonl")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.line_no, r.raw) for r in big] == list(enumerate(lines, 1))
    assert [(r.line_no, r.is_empty, r.is_ok) for r in small] == [(1, False, True), (2, True, True), (3, False, False)]


def test_lint_priorities(spark):
    body = "\n".join(["intro", "| a | 1,200円 |", "約3円/枚と1,200円", "円錐 100", "2,500円 <!-- lint-allow-number -->", "9,800円から", "約3年"])
    got = Q.lint_prose(spark.createDataFrame([("a", 5, body)], "article_id string, first_line int, body string")).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.severity) for r in got] == [(7, "price-table", "error"), (8, "unit-price", "error"), (11, "price", "warn")]
    assert Q.errors_only(Q.lint_prose(spark.createDataFrame([("a", 0, "1,000円")], "article_id string, first_line int, body string"), True)).count() == 1


def test_questions_in_three_notations(spark):
    def section(text):
        return f"## 前\n\n### q\n\nno\n\n## よくある質問（FAQ）\n\n{text}\n\n## 後\n\n### z\n\nno"

    rows = [
        ("new", section("**Q. 一つ目？**\n\nA. 答え\n二行\n\n**Q：二つ目**\n**A.** 次")),
        ("old", section("### 一つ目\n\n答え\n二行\n\n### 二つ目\n\n次")),
        ("bold", section("**一つ目？**\n\nA. 答え\n\n**ただの太字**\n\n**二つ目?**\n\n次")),
        ("none", section("文だけ")), ("off", "### q\n\na"),
    ]
    got = {r.k: [(f.question, f.answer) for f in r.f] for r in
           Q.with_faqs(spark.createDataFrame(rows, "k string, body string"), "f").collect()}
    assert got["new"] == [("一つ目？", "答え\n二行"), ("二つ目", "次")]
    assert got["old"] == [("一つ目", "答え"), ("二つ目", "次")]
    assert got["bold"] == [("一つ目？", "答え"), ("二つ目?", "次")]
    assert got["none"] == [] and got["off"] == []


def test_append_twice_equals_once(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = spark.createDataFrame([("a",), ("b",), ("a",)], "line string")
    W.append_missing(lines, path)
    W.append_missing(lines.union(spark.createDataFrame([("c",)], "line string")), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a", "b", "c"]


def test_snapshot_keeps_earlier_runs(spark, tmp_path):
    path = str(tmp_path / "s")
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(1, 10), (2, 25)], "k int, v int")
    day = F.lit("2024-03-02").cast("date")
    W.append_snapshot(a.withColumn("updated_at", F.lit("2024-03-01").cast("date")), path, "2024-03-01")
    for _ in range(2):
        W.append_snapshot(W.changed_rows(a, b, ["k"], ["v"], day), path, "2024-03-02")
    assert spark.read.parquet(path).count() == 3
    got = {r.k: (r.v, str(r.updated_at)) for r in W.latest_snapshot(spark.read.parquet(path), ["k"]).collect()}
    assert got == {1: (10, "2024-03-01"), 2: (25, "2024-03-02")}


def test_last_product_stays(spark):
    products = spark.createDataFrame([("a", i, i + 1, f"n{i}", 5, 1, None, "u") for i in range(2)],
                                     "article_id string, orig_idx long, rank long, name string, price long, review_count long, capacity string, base_url string")
    raw = [(f'{{"articleFile":"src/content/articles/a.md","rank":{i + 1},"action":"review","decision":"delete","currentName":"n{i}"}}',) for i in range(2)]
    lines = J.tolerant(spark.createDataFrame(raw, "raw string").withColumns({"file": F.lit("f"), "line_no": F.monotonically_increasing_id()}))
    routed = D.route_decisions(lines, products.select("article_id").distinct(), products)
    state, deleted = D.apply_decisions(products, routed)
    # the higher rank goes first, the last one stays
    assert [r.name for r in deleted.collect()] == ["n1"] and [r.name for r in state.collect()] == ["n0"]
    assert all(r.outcome == "processed" for r in routed.collect())


def test_partitioning_does_not_change_results(spark):
    import __spark_entry__ as entry

    from .conftest import SF

    old = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("price_ranking", "dedupe_first", "offer_display_order", "same_product_ngram"):
        seen = []
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(str, entry.queries()[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", old)
        assert seen[0] == seen[1], name


def test_rank_units_in_a_circle(spark):
    """Missing reviews make three units beat each other in turn; ranks still run from 1 to 9."""
    reviews = {"g": (None, 2, 1), "mL": (1, None, 2), "枚": (2, 1, None)}
    rows = [("a", 3 * i + j, 10, r, float(j), u) for i, (u, rs) in enumerate(reviews.items()) for j, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "article_id string, orig_idx long, price long, review_count long, "
                                     "unit_value double, unit string")
    assert sorted(r.new_rank for r in R.rank_by_unit_price(df).collect()) == list(range(1, 10))


def test_upsert_takes_the_first_offer_only(spark):
    cur = [(1, "yahoo", "a", "u1", "matched", 10, None, None, None, True, "d0", None, 0),
           (1, "yahoo", "b", "u2", "matched", 20, None, None, None, True, "d0", None, 1)]
    new = [(1, "yahoo", "n", "u1", None, 11, None, None, None, True, "d1", None, 0),
           (1, "yahoo", "m", "u1", None, 12, None, None, None, True, "d1", None, 1)]
    incoming = spark.createDataFrame(new, STATE + ", pos long").drop("match_status").withColumns(
        {f: F.lit(False) for f in ("verified", "strict", "force")})
    got = O.upsert_offers(spark.createDataFrame(cur, STATE + ", pos long"), incoming, ["k"]).collect()
    assert sorted((r.label, r.url, r.price, r.changed) for r in got) == [("a", "u1", 11, True), ("b", "u2", 20, False)]


@pytest.fixture(scope="module")
def one_article(spark):
    articles = spark.createDataFrame([("a", "T", "D", ["t"], "c")],
                                     "article_id string, title string, description string, tags array<string>, category_id string")
    categories = spark.createDataFrame([("c", "C")], "category_id string, name string")

    def place(rows):
        products = spark.createDataFrame(rows, "article_id string, orig_idx long, name string, brand string")
        placed = cut_lineage(K.placed_entries(K.search_entries(articles, products, categories)))
        return placed, cut_lineage(P.gram_index(placed, "article_id"))

    return place


def test_search_finds_phrases_at_any_size(spark, one_article):
    names = [f"n{i:04d}" for i in range(3000)]
    placed, index = one_article([("a", i, n, f"b{i}") for i, n in enumerate(names)])
    # over the end of an entry, over many names, from the last name to the first brand, of any length
    for phrase in (" ".join(names[995:1005]), " ".join(names[1985:2018]), "n2999 b0", "D C t N0000", "b999 b1000", " ".join(names)):
        assert [r.hits for r in K.article_hits(placed, index, phrase).collect()] == [1], phrase
    assert K.article_hits(placed, index, "n0001 n0000").count() == 0
    assert K.article_hits(placed, index, "  ").count() == 0
    tiny, tiny_index = one_article([("a", i, "x", None) for i in range(3000)])
    assert [r.hits for r in K.article_hits(tiny, tiny_index, " ".join("x" * 90)).collect()] == [2911]


@pytest.mark.parametrize("n", [3, 400, 700, 3000])
def test_search_with_missing_brands_at_any_size(one_article, n):
    """Brands far apart, null or empty in between, stand side by side; the hit is the same at each size."""
    brands = {0: "Alpha", n - 1: "Beta"}
    placed, index = one_article([("a", i, "n", brands.get(i, "" if i % 2 else None)) for i in range(n)])
    hit = K.article_hits(placed, index, "ALPHA beta").collect()
    assert [(r.hits, r.field, r.place, r.text) for r in hit] == [(1, "6 brand", 0, "Alpha")]


def test_search_equals_plain_text(spark, one_article):
    rnd = random.Random(3)
    rows = [("a", i, "".join(rnd.choice("ab 語İ😀") for _ in range(rnd.randint(0, 4))), rnd.choice(["a", "b a", None, "😀"])) for i in range(80)]
    placed, index = one_article(rows)
    text = "".join(r.piece for r in placed.orderBy("at").collect())
    for _ in range(25):
        i = rnd.randrange(len(text))
        phrase = text[i: i + rnd.randint(1, 12)].strip()
        want = [i for i in range(len(text)) if text.startswith(phrase, i)] if phrase else []
        assert sorted(r.at for r in P.phrase_starts(index, "article_id", phrase).collect()) == want


def test_prefix_sums_of_a_hot_key(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 > 0, "k").alias("k"),
                                  (F.col("id") * 7919 % 4001).alias("v"), "id")
    got = B.prefix_sums(df.repartition(7), ["k"], [F.col("v").desc()], F.col("id"), "before").collect()
    want, sums = {}, {}
    for r in sorted(got, key=lambda r: -r.v):
        want[r.id] = sums.get(r.k, 0)
        sums[r.k] = want[r.id] + r.id
    assert {r.id: r.before for r in got} == want and len(got) == 4000


def test_yaml_scalars_of_the_json_schema(spark):
    from shelfscope.sources import articles as A

    front = "title: yes\ncategory: on\ntags: [no, off, '1']\npublishedAt: 2024-01-02\nproducts:\n" \
            "  - {name: 12:30, rank: 010, brand: null, price: 0x10, rating: .inf, recommendedFor: ~, pros: [on]}"
    files = spark.createDataFrame([("x/one.md", f"---\n{front}\n---\nbody"), ("x/two.md", "---\na: [\n---\n")],
                                  "path string, content string")
    good, bad = A.parse_front_matter(files)
    d = good.first().data
    assert (d.title, d.category, d.tags, d.publishedAt) == ("yes", "on", ["no", "off", "1"], "2024-01-02")
    p = d.products[0]
    assert (p.name, p.rank, p.brand, p.price, p.rating, p.recommendedFor, p.pros) == ("12:30", 10, None, 16, None, None, ["on"])
    assert [r.path for r in bad.collect()] == ["x/two.md"]
    assert good.select("data")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_questions_over_lines_and_questions_as_answers(spark):
    rows = [
        ("long", "## よくある質問\n**Q. 一行目\n二行目？**\n\n答え"),
        ("list", "## よくある質問 (FAQ)\n- **Q: 項目**\nA： はい\n- **Q: 次**"),
        ("again", "## よくある質問\n**Q. 一**\n**Q. 二**\n答え\n**Q. 三**\nA"),
        ("old", "## よくある質問\n### 一\n### 二\n\n  答え\n##"),
        ("last", "## よくある質問\n**一？**"), ("null", None), ("empty", ""), ("late", "### よくある質問\n### q\na"),
    ]
    got = {r.k: [(f.question, f.answer) for f in r.f] for r in
           Q.with_faqs(spark.createDataFrame(rows, "k string, body string"), "f").collect()}
    assert got["long"] == [("一行目\n二行目？", "答え")]
    assert got["list"] == [("項目", "はい\n- **Q: 次**")]
    assert got["again"] == [("一", "**Q. 二**\n答え"), ("三", "A")]
    assert got["old"] == [("一", "### 二")]
    assert all(got[k] == [] for k in ("last", "null", "empty", "late"))


def test_lint_reads_what_stands_beside_an_amount(spark):
    kinds = {
        "12円 と 99円": None, "1,20円": "price", ",,1円": None, "３００ 円": "price", "円 ／ 枚": "unit-price", "円/km": None,
        "| 5円 |": "price-table", " | 円 / x |": "price-table", "| 5円": None, "|円錐| 1,000円": "price", "x | 5円 |": None,
        "1,000円<!--lint-allow-number-->": None, "1,000円 <!-- other -->": "price", "円": None, "": None, None: None,
    }
    rows = [(i, 0, line) for i, line in enumerate(kinds)]
    found = {r.article_id: r.kind for r in
             Q.lint_prose(spark.createDataFrame(rows, "article_id int, first_line int, body string")).collect()}
    assert {line: found.get(i) for i, line in enumerate(kinds)} == kinds


def test_piece_counts_by_precedence(spark):
    line = "お風呂カビーヌ "
    want = {
        line + "4個 パック×2セット (3個入×5セット 箱)": "3個×5セット", line + "6個入 2個パック(7セット)": "2個×7セット",
        line + "2個パック×7セット": "2個×7セット", line + "1,200 個 セット": "1,200個", line + "3個": None,
        line + "3個×5セット": None, "その他 3個入": None, line: None,
    }
    rows = [(t,) for t in want]
    got = spark.createDataFrame(rows, "t string").select("t", N.sales_count(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want


def test_sorted_rows_go_to_as_many_tasks_as_their_count_asks_for(spark, monkeypatch, tmp_path):
    """Rows of one key that compress to almost nothing are not merged into one task by their bytes."""
    from shelfscope.operators import numbering as B
    from shelfscope.operators import phrases as P

    monkeypatch.setattr(B, "PIECE_ROWS", 100)
    df = spark.range(2000).select(F.lit("k").alias("k"), "id", F.lit("low").alias("text"))
    placed = P.place_entries(df, "k", [F.col("id")])
    assert placed.agg(F.max("at")).first()[0] == 1999 * 4 - 1
    index = P.write_index(P.gram_index(placed, "k"), str(tmp_path / "grams"))
    rows = index.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 2000 * 4 - 1 and max(r["count"] for r in rows) < 200
    cut = []
    real = B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda d: cut.append(real(d)) or cut[-1])
    B.prefix_sums(df, ["k"], [F.col("id")], F.lit(1), "n")
    assert max(r["count"] for r in cut[-1].groupBy("_piece").count().collect()) < 200


def test_products_with_offers_parse_each_article_once(spark):
    import __spark_entry__ as entry
    from shelfscope.sources import articles as A

    from .conftest import SF

    plan = entry.queries()["explode_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    front = "products:\n  - {name: a, offers: [{url: u}, {url: v}]}\n  - {name: b, offers: []}\n  - {name: c}\ntitle: \tt"
    files = spark.createDataFrame([(f"{d}/one.md", f"---\n{front}\n---\n") for d in "xy"], "path string, content string")
    rows = A.product_offers(A.explode_products(A.article_table(A.parse_front_matter(files)[0]))).collect()
    assert sorted((r.name, r.offer and r.offer.url or "") for r in rows) == sorted([("a", "u"), ("a", "v"), ("b", ""), ("c", "")] * 2)


def test_reconciled_products_are_not_broadcast(spark):
    import __spark_entry__ as entry

    from .conftest import SF

    df = entry.queries()["reconcile_urls"](spark, SF)
    assert df.count() == 200
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
