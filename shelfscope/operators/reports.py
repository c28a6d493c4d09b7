"""Analytics reports over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_ROWS = 10_000


def row_bound(row_limit: int) -> int:
    """A report is asked for by at most ``MAX_ROWS`` rows; more is refused, not cut."""
    if not 0 < row_limit <= MAX_ROWS:
        raise ValueError(f"a report has 1 to {MAX_ROWS} rows")
    return row_limit


def traffic_metrics() -> dict[str, Column]:
    """Metric name to aggregate over ``event_type, user_id, day, value``."""
    kind = F.col("event_type")
    sessions = F.count_distinct("user_id", "day")
    engaged = F.count_distinct(F.when(kind.isin("click", "purchase"), F.col("user_id")),
                               F.when(kind.isin("click", "purchase"), F.col("day")))
    # cents: sums of whole numbers do not depend on their order
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return {
        "screenPageViews": F.count_if(kind == "view"),
        "activeUsers": F.count_distinct("user_id"),
        "newUsers": F.count_distinct(F.when(kind == "signup", F.col("user_id"))),
        "sessions": sessions,
        "engagedSessions": engaged,
        "engagementRate": engaged / sessions,
        "averageSessionDuration": cents / 100 / sessions,
        "eventCount": F.count("*"),
    }


def resolve_day(text: str, as_of: str) -> Column:
    """ISO day, ``today``, ``yesterday`` or ``NdaysAgo`` relative to ``as_of``."""
    base = F.lit(as_of).cast("date")
    if text == "today":
        return base
    if text == "yesterday":
        return F.date_sub(base, 1)
    if text.endswith("daysAgo"):
        return F.date_sub(base, int(text[: -len("daysAgo")]))
    return F.lit(text).cast("date")


def in_days(events: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Events of whole days, as a range on ``ts`` that reaches the scan."""
    first, last = resolve_day(start, as_of), resolve_day(end, as_of)
    return events.filter(
        (F.col("ts") >= first.cast("timestamp")) & (F.col("ts") < F.date_add(last, 1).cast("timestamp")))


def traffic_report(
    events: DataFrame, start: str, end: str, as_of: str, dimensions: list[str],
    metrics: list[str] | None = None, row_limit: int = 100,
) -> DataFrame:
    known = traffic_metrics()
    wanted = metrics or ["screenPageViews", "activeUsers", "sessions"]
    rows = in_days(events, start, end, as_of).groupBy(*dimensions).agg(*[known[m].alias(m) for m in wanted])
    return rows.orderBy(F.col(wanted[0]).desc(), *dimensions).limit(row_bound(row_limit))


def search_analytics(
    events: DataFrame, start: str, end: str, dimensions: list[str], row_limit: int = 100,
    page: str | None = None,
) -> DataFrame:
    """Clicks, impressions, CTR in percent and mean position per dimension."""
    rows = in_days(events, start, end, end)
    if page is not None:
        rows = rows.filter(F.col("page") == page)
    clicks, shown = F.count_if(F.col("event_type") == "click"), F.count("*")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    out = rows.groupBy(*dimensions).agg(
        clicks.alias("clicks"), shown.alias("impressions"),
        (F.floor(clicks / shown * 10000 + 0.5) / 100).alias("ctr"),
        (F.floor(cents / 100 / shown * 10 + 0.5) / 10).alias("position"))
    return out.orderBy(F.col("clicks").desc(), *dimensions).limit(row_bound(row_limit))
