"""What grows with products and candidates is not broadcast, however small Spark takes it to be."""

import pytest

from shelfscope.operators import additions as A
from shelfscope.operators import same_products as SP
from shelfscope.plans import matching
from shelfscope.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture
def broadcast_joins(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")

    def found(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan
        return [x for x in plan.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]

    yield found
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_listed_deleted_and_covered_candidates(spark, broadcast_joins, monkeypatch):
    joins, cut = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: joins.extend(broadcast_joins(df)) or cut(df))
    judged = matching.judged(spark, SF)
    joins.extend(broadcast_joins(judged))
    assert not [x for x in joins if "direct_url" in x or "row_id" in x]
    assert judged.count() == judged.select("row_id").distinct().count() > 0


def test_pieces_and_grams_of_names(spark, broadcast_joins):
    columns = "block string, _dkey string, _sig string, _tokens array<string>"
    names = [("a", "green tea plus", "?", ["*"]), ("a", "black coffee", "?", ["*"])]
    left = cut_lineage(spark.createDataFrame(names, columns))
    right = cut_lineage(spark.createDataFrame([("a", "green tea", "?", ["?", "*"])], columns))
    mine, theirs = SP._pair_rows(left, right, "block")
    pieces = SP._covered_by_piece(left, right, "block")
    for df in (pieces, mine, theirs):
        # the lengths of names, a few for each block, may go to all tasks
        assert not [x for x in broadcast_joins(df) if any(c in x.split("]")[0] for c in ("_piece", "_gram", "_dkey"))]
    assert [r._dkey for r in pieces.collect()] == ["green tea plus"]
