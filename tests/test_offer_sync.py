"""Offer sync against the same rules applied product by product."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import offer_sync as S

OFFER = ("k long, pos long, provider string, label string, url string, match_status string, match_notes string, price long,"
         " rating double, review_count long, image_url string, available boolean, updated_at date, catalogue_id string")
HIT = ("k long, query_idx int, pos int, url string, ok boolean, reason string, strict boolean, name string, price long,"
       " rating double, review_count long, image_url string")
OLD, NOW = dt.date(2024, 1, 1), dt.date(2024, 3, 10)


def offer(k, pos, url, status="matched", provider="yahoo"):
    return (k, pos, provider, "old", url, status, None, 100, None, None, None, True, OLD, None)


def hit(k, query, pos, url, ok, price=120):
    return (k, query, pos, url, ok, "fits" if ok else "capacity不一致", True if ok else None, f"{k}-{query}-{pos}", price, 4.0, 3, None)


def run(spark, hits, offers):
    evaluated, stored = spark.createDataFrame(hits, HIT), spark.createDataFrame(offers, OFFER)
    decided = S.decide(evaluated, stored, "k")
    synced = S.apply_decisions(decided, stored, "k", F.lit(NOW), "new")
    return synced.collect(), {r.k: r for r in S.report(evaluated, decided, synced, "k").collect()}


CASES = {
    # hits, offers of product 1 -> (provider, pos, url, status, available, action) of each
    "insert after the last": ([hit(1, 0, 0, "u", True)], [offer(1, 4, "a", provider="amazon")],
                              {("amazon", 4, "a", "matched", True, "keep"), ("yahoo", 5, "u", "pending", True, "insert")}),
    "insert as the first": ([hit(1, 0, 0, "u", True)], [], {("yahoo", 0, "u", "pending", True, "insert")}),
    "refresh": ([hit(1, 0, 0, "u", True)], [offer(1, 0, "u")], {("yahoo", 0, "u", "matched", True, "refresh")}),
    "pending and proven": ([hit(1, 0, 0, "u", True)], [offer(1, 0, "u", "pending")], {("yahoo", 0, "u", "matched", True, "refresh")}),
    "other link keeps": ([hit(1, 0, 0, "v", True)], [offer(1, 0, "u")], {("yahoo", 0, "u", "matched", True, "other_url")}),
    "rejected before: replace": ([hit(1, 0, 0, "u", False), hit(1, 1, 0, "v", True)], [offer(1, 0, "u")],
                                 {("yahoo", 0, "v", "pending", True, "replace")}),
    "rejected after the accepted one: not looked at": ([hit(1, 0, 0, "v", True), hit(1, 0, 1, "u", False)], [offer(1, 0, "u")],
                                                       {("yahoo", 0, "u", "matched", True, "other_url")}),
    "a link counts once": ([hit(1, 0, 0, "u", False), hit(1, 1, 0, "u", True)], [offer(1, 0, "u")],
                           {("yahoo", 0, "u", "review", False, "review")}),
    "downgrade all of the provider": ([hit(1, 0, 0, "u", False)], [offer(1, 0, "u"), offer(1, 1, "w", "pending"), offer(1, 2, "x", "rejected"),
                                                                   offer(1, 3, "y", provider="amazon")],
                                      {("yahoo", 0, "u", "review", False, "review"), ("yahoo", 1, "w", "review", False, "review"),
                                       ("yahoo", 2, "x", "rejected", True, "keep"), ("amazon", 3, "y", "matched", True, "keep")}),
    "locked": ([hit(1, 0, 0, "u", True)], [offer(1, 0, "u", "review")], {("yahoo", 0, "u", "review", True, "locked")}),
    "rejected, not the matched one": ([hit(1, 0, 0, "z", False)], [offer(1, 0, "u")], {("yahoo", 0, "u", "matched", True, "keep")}),
    "empty status is matched": ([hit(1, 0, 0, "u", False)], [offer(1, 0, "u", "")], {("yahoo", 0, "u", "review", False, "review")}),
}


def test_each_way_an_offer_can_go(spark):
    """All cases in one table, one product each."""
    hits, offers, want = [], [], {}
    for k, (h, o, rows) in enumerate(CASES.values(), 1):
        hits += [(k, *x[1:]) for x in h]
        offers += [(k, *x[1:]) for x in o]
        want[k] = rows
    synced, _ = run(spark, hits, offers)
    got = {}
    for r in synced:
        got.setdefault(r.k, set()).add((r.provider, r.pos, r.url, r.match_status, r.available, r.action))
    for k, name in enumerate(CASES, 1):
        assert got[k] == want[k], name
    for r in synced:
        written = r.action in ("insert", "refresh", "replace")
        assert r.changed == (written or r.action == "review")
        assert r.updated_at == (NOW if written else OLD)
        assert (r.match_notes == "capacity不一致: capacity不一致") == (r.action == "review")


def test_report_stops_at_the_accepted_hit(spark):
    hits = [hit(1, 0, i, f"r{i}", False) for i in range(7)] + [hit(1, 1, 0, "u", True), hit(1, 1, 1, "late", False)]
    hits += [hit(2, 0, 0, "u", False), hit(2, 0, 1, None, False), hit(2, 0, 1, None, False)]
    _, report = run(spark, hits, [offer(1, 0, "other"), offer(2, 0, "u"), offer(3, 0, "unsearched")])
    assert set(report) == {1, 2}
    one, two = report[1], report[2]
    assert (one.decision, one.candidates, one.candidate, one.url, one.change) == ("auto", 8, "1-1-0", "u", None)
    assert [r.name for r in one.rejected] == [f"1-0-{i}" for i in range(5)] and one.write_skipped == "matched offer keeps its link"
    assert (two.decision, two.candidates, two.change, two.candidate) == ("review", 2, "downgrade", None)


@pytest.mark.parametrize("hits, offers, rows", [([], [], 0), ([], [offer(1, 0, "u"), offer(None, 0, None, None, None)], 2)])
def test_empty_tables_and_null_keys(spark, hits, offers, rows):
    synced, report = run(spark, hits, offers)
    assert len(synced) == rows and not any(r.changed for r in synced) and not report


def test_hot_product(spark):
    """One product with a third of all hits and offers."""
    hits = [hit(i % 1000 if i % 3 else 7, 0, i, f"u{i}", i % 50 == 49) for i in range(3000)]
    offers = [offer(i % 1000 if i % 3 else 7, i, f"u{i}") for i in range(3000)]
    synced, report = run(spark, hits, offers)
    assert len(synced) >= 3000 and len({(r.k, r.pos) for r in synced}) == len(synced)
    assert set(report) == {h[0] for h in hits}
