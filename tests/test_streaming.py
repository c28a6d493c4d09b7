import json
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import fold as L
from shelfscope.sources.jsonl import tolerant
from shelfscope.streaming import drop_folder as S
from shelfscope.streaming import ledger

PRODUCT = ("article_id string, orig_idx long, rank long, name string, price long, review_count long, capacity string, "
           "base_url string, price_per_unit string")


def product(article, i, name, rank=None):
    return (article, i, i + 1 if rank is None else rank, name, 5, 1, "5枚", f"https://item.rakuten.co.jp/s/{article}{i}/", "-")


def line(article, rank, name, action="replace", **more):
    return {"articleFile": f"src/content/articles/{article}.md", "rank": rank, "currentName": name, "action": action,
            "selectedAffiliateUrl": "https://x.example/", **more}


def replay(products, files):
    """The ordered replay of files of lines, in plain Python over whole article lists."""
    shelves, seen = {}, []
    for a, i, r, n, *_ in products:
        shelves.setdefault(a, []).append({"id": i, "rank": r, "name": n, "price": 5})
    for name in sorted(files):
        by_article = {}
        for no, x in enumerate(files[name], 1):
            by_article.setdefault(x["articleFile"].split("/")[-1][:-3], []).append((no, x))
        for a, lines in by_article.items():
            cls = {"replace": 0, "review": 1}
            lines.sort(key=lambda t: (cls.get(t[1]["action"], 2), -t[1]["rank"] if t[1]["action"] == "review" else 0, t[0]))
            for no, x in lines:
                shelf = shelves.get(a)
                if shelf is None:
                    seen.append((name, no, "failed", None))
                    continue
                if x["action"] == "review" and x.get("decision") != "delete":
                    seen.append((name, no, "processed", "review"))
                    continue
                at = next((p for p in shelf if p["rank"] == x["rank"]), None)
                if x["action"] not in cls or at is None or at["name"] != x["currentName"]:
                    seen.append((name, no, "failed", None))
                    continue
                first = next(p for p in shelf if p["name"] == at["name"])
                if x["action"] == "review":
                    if sum(p["name"] == at["name"] for p in shelf) > 1 or len(shelf) == 1:
                        seen.append((name, no, "processed", "review"))
                        continue
                    shelf.remove(first)
                    for k, p in enumerate(shelf, 1):
                        p["rank"] = k
                    seen.append((name, no, "processed", "delete"))
                    continue
                first["name"] = x.get("newName") or first["name"]
                first["price"] = x.get("newPrice", first["price"])
                seen.append((name, no, "processed", "replace"))
    return ({(a, p["id"]): (p["rank"], p["name"], p["price"]) for a, s in shelves.items() for p in s}, sorted(seen, key=str))


def some_files(rnd):
    """Lines that often name what earlier lines have made of a product."""
    names = ["n0", "n1", "n2", "n3", "x", "y"]
    products = [product(a, i, rnd.choice(names[:4])) for a in "abcd" for i in range(rnd.randint(1, 6))]
    files = {f"f{k}.jsonl": [
        line(rnd.choice("abcde"), rnd.randint(1, 6), rnd.choice(names), *rnd.choice([("replace",), ("review",), ("review",), ("noop",)]),
             **rnd.choice([{}, {"decision": "delete"}]), **rnd.choice([{}, {"newName": rnd.choice(names)}, {"newPrice": rnd.randint(0, 99)}]))
        for _ in range(rnd.randint(0, 40))] for k in range(3)}
    return products, files


def test_fold_equals_ordered_replay(spark):
    products, lines, want, seen = [], [], {}, []
    for n in range(30):  # thirty catalogues side by side, told apart by their article ids
        some, files = some_files(random.Random(n))
        state, outcomes = replay(some, files)
        want |= {(f"{a}{n}", i): v for (a, i), v in state.items()}
        products += [(f"{r[0]}{n}", *r[1:]) for r in some]
        for f, xs in files.items():
            for no, x in enumerate(xs, 1):
                x = x | {"articleFile": x["articleFile"].replace(".md", f"{n}.md")}
                lines.append((f, 1000 * n + no, json.dumps(x)))
        seen += [(f, 1000 * n + no, o, e) for f, no, o, e in outcomes]
    df = spark.createDataFrame(products, PRODUCT)
    rows = tolerant(spark.createDataFrame(lines, "file string, line_no long, raw string"))
    folded = L.fold_decisions(rows, df.select("article_id").distinct(), df).cache()
    got = L.outcomes(folded).select("file", "line_no", "outcome", "effect").collect()
    assert sorted(map(tuple, got), key=str) == sorted(seen, key=str)
    changed = L.changed_products(folded, df)
    state = df.join(changed, ["article_id", "orig_idx"], "left_anti").unionByName(changed.where("NOT gone").drop("gone"))
    assert {(r.article_id, r.orig_idx): (r.rank, r.name, r.price) for r in state.collect()} == want


def test_fold_keeps_products_of_lines_only():
    """State grows with the lines of an article, not with its products."""
    x = {"action": "review", "decision": "delete", "current_name": "n7", "new_name": None, "rank": 7}
    article = L.Article([x, x | {"action": "replace", "decision": None, "rank": 100, "current_name": "same"}])
    for i in range(1, 100_001):
        article.add(i, i, "n7" if i == 7 else "same")
    assert article.n == 100_000 and len(article.names) < 10 and article.same["same"] == 99_999


@pytest.fixture
def drop(spark, tmp_path):
    root, folder, mark = (str(tmp_path / n) for n in ("root", "drop", "mark"))
    (tmp_path / "drop").mkdir()

    def put(name, *records):
        (tmp_path / "drop" / name).write_text("".join(json.dumps(r) + "\n" for r in records) + "broken\n")

    def run(articles, derive=None):
        S.run_decisions(spark, folder, root, mark, S.match_judge(articles), derive or S.match_tables(F.lit("2024-03-10").cast("date"))).awaitTermination()

    return root, put, run


def as_state(spark, root):
    return {(r.article_id, r.orig_idx): (r.rank, r.name, r.price) for r in ledger.state(spark, root).collect()}


def test_batches_give_the_ordered_replay_though_one_fails_half_way(spark, drop):
    root, put, run = drop
    products = [product(a, i, f"n{i}") for a in "ab" for i in range(4)]
    df = spark.createDataFrame(products, PRODUCT)
    articles = df.select("article_id").distinct()
    ledger.create(df, root)
    files = {"one.jsonl": [line("a", 2, "n1", "review", decision="delete"), line("a", 1, "n0", newName="m0", newPrice=9),
                           line("b", 4, "n3", newPrice=7)],
             "two.jsonl": [line("a", 2, "n2", newPrice=8), line("a", 1, "m0", "review", decision="delete"), line("b", 9, "n3")]}
    put("one.jsonl", *files["one.jsonl"])
    run(articles)
    assert as_state(spark, root) == replay(products, {"one.jsonl": files["one.jsonl"]})[0]

    tables = S.match_tables(F.lit("2024-03-10").cast("date"))
    fails = [True]

    def half_way(judged, now):
        found = tables(judged, now)
        tables_ = {k: found[k] for k in ("changes", "outcomes", "deleted", "files")}
        if fails.pop():
            fails.append(False)
            tables_["files"] = tables_["files"].select(F.raise_error(F.lit("lost")).alias("file"))
        return tables_

    put("two.jsonl", *files["two.jsonl"])
    with pytest.raises(Exception, match="lost"):
        run(articles, half_way)
    # what the failed batch has written is not in force
    assert as_state(spark, root) == replay(products, {"one.jsonl": files["one.jsonl"]})[0]
    run(articles, half_way)
    want, seen = replay(products, files)
    assert as_state(spark, root) == want
    outcomes = ledger.committed(spark, root, "outcomes").where("raw <> 'broken'")
    got = [(r.file.split("/")[-1], r.line_no, r.outcome, r.effect) for r in outcomes.collect()]
    assert sorted(got, key=str) == seen
    assert ledger.committed(spark, root, "deleted").count() == 2
    assert {(r.file.split("/")[-1], r.status) for r in ledger.committed(spark, root, "files").collect()} == {
        ("one.jsonl", "failed"), ("two.jsonl", "failed")}

    # nothing new: nothing changes; a committed batch asked for again is not applied again
    run(articles)
    assert not ledger.apply_batch(spark, root, 1, lambda now: 1 / 0, tables)
    ledger.compact(spark, root)
    ledger.compact(spark, root)
    assert as_state(spark, root) == want
    put("three.jsonl", line("a", 1, "n2", newPrice=3))
    run(articles)
    assert as_state(spark, root)[("a", 2)] == (1, "n2", 3) and len(as_state(spark, root)) == len(want)


def test_size_decisions_reach_the_catalogue(spark, tmp_path):
    root, folder, mark = (str(tmp_path / n) for n in ("root", "drop", "mark"))
    ledger.create(spark.createDataFrame([product("a", i, f"n{i}") for i in range(3)], PRODUCT), root)
    (tmp_path / "drop").mkdir()
    url = "https://item.rakuten.co.jp/s/a0/"
    good = {"articleFile": "src/content/articles/a.md", "rank": 1, "decision": "apply", "newCapacity": "10枚",
            "current": {"name": "n0", "capacity": "5枚", "price": 5, "rakutenUrl": url},
            "basis": {"apiPrice": 5, "itemUrl": url, "affiliateUrl": url}}
    stale = good | {"rank": 2, "current": good["current"] | {"name": "n1", "price": 6}}
    (tmp_path / "drop" / "one.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(stale) + "\n")
    for _ in range(2):
        S.run_decisions(spark, folder, root, mark, S.size_judge(), S.size_tables).awaitTermination()
    assert {r.orig_idx: r.capacity for r in ledger.state(spark, root).collect()} == {0: "10枚", 1: "5枚", 2: "5枚"}
    outcomes = ledger.committed(spark, root, "outcomes")
    assert sorted(r.outcome for r in outcomes.collect()) == ["processed", "review"]
    assert [r.name for r in ledger.committed(spark, root, "frozen").collect()] == ["n0"]
