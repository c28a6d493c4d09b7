import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from shelfscope.llm import chat_format as cf, url_reputation as ur
from tests.conftest import SF
from tools.check import TABLES, bag


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_chat_format", "op6_warc_bundles"])
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(cur.fetchall(), names)


def test_url_parts_and_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "http://a.net"), (3, None), (4, "no scheme"), (5, "x://b.example.com/de/?/"),
            (6, "https://k.org/fr/a#b"), (7, "https://notexample.net/en/"), (8, "h://é.ORG?x://y"), (8, "h://é.ORG?x://y"), (None, "")]
    pages = spark.createDataFrame([(i, u, "p") for i, u in rows], "page_id long, url string, host string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    none = spark.createDataFrame([], "page_id long, bad int")
    got = [(r.page_id, r.host, r.path, r.rule) for r in ur.judge_urls(pages, none, rules, ["example.com"]).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/"), (2, "a.net", "", None), (3, "", "", None), (4, "", "", None),
        (5, "b.example.com", "/de/", "example.com/de/"), (6, "k.org", "/fr/a", "org/fr/"),
        (7, "notexample.net", "/en/", "net/"), (8, "é.org", "", None), (8, "é.org", "", None), (None, "", "", None)], key=str)
    assert ur.judge_urls(pages.limit(0), none, rules, []).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://h{i % 10}.bad.example.com/") for i in range(200)]
    rows += [(1000 + i, f"http://h{i % 50}.good.example.com/") for i in range(500)] + [(5000, "http://new.bad.example.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1 if i < 200 else 0) for i, _ in rows[:-1]] + [(None, 1), (7, None)], "page_id long, bad int")
    got = {r.page_id: r for r in ur.judge_urls(pages, outcomes, [], ["example.com"]).collect()}
    assert all(got[i].verdict == "block" for i in range(200))
    assert all(got[1000 + i].verdict == "allow" for i in range(500))
    # a host without outcomes leans on its registered domain
    assert got[5000].bad_rate > 0.5 > got[1000].bad_rate


def test_chats_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\<|end|>\\n \\[INST] <|<|text|>"),
            (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, None), (None, 1, "user", "😀\x00"),
            (4, 0, "system", ""), (4, 1, "user", "q\n"), (4, 2, "assistant", "a<|end|" + "y" * 100_000), (5, 0, "<|text|>", "<|turn|>")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = cf.format_chats(turns)
    out = out.withColumn("read", cf.read_turns(out["formatted"])).withColumn("loss", cf.loss_text(out["segments"]))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.read] for c, r in got.items()} == want
    assert {c: r.loss for c, r in got.items()} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    assert {c for c, r in got.items() if r.valid} == {1, 4}
    assert all("[INST]" not in r.formatted and "</s>" not in r.formatted for r in got.values())
    assert cf.format_chats(turns.limit(0)).count() == 0


def test_chat_digest_of_probe(spark):
    row = entry.queries()["op4_chat_format"](spark, SF).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
