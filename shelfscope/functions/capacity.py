"""Pack sizes and unit prices as column expressions.

A pack size is ``STRUCT<total DOUBLE, unit STRING>``; NULL means that no size
could be read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .patterns import (
    BASE_UNITS, CAPACITY_UNITS, MEASURE_UNITS, NUMBER, PACK_UNITS, SALES_UNITS, TIMES,
    VARIANT_DELIMITERS, VARIANT_UNITS, WS,
)

_HALF = "".join(map(chr, [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x30, 0x3A)]))
_FULL = "".join(chr(ord(c) + 0xFEE0) for c in _HALF)

_BRACKET = rf"[（(]({NUMBER}){WS}*({CAPACITY_UNITS})[）)]"
_BASE = rf"(?s)^({NUMBER}){WS}*({BASE_UNITS})([^\n]*).*$"
_PACK = rf"(?s)^([\d,]+){WS}*({PACK_UNITS})([^\n]*).*$"
_FACTOR = rf"[{TIMES}]{WS}*([\d,]+)"
_NOTE = r"[（(][^）)]*[）)]"
_MEASURE = rf"(?i)\d[\d,]*{WS}*({MEASURE_UNITS})"
SIZE_TYPE = "struct<total:double,unit:string>"


def half_width(text: Column) -> Column:
    """Full-width letters and digits (only those) to half width."""
    return F.when(text.rlike("[ａ-ｚＡ-Ｚ０-９]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it.

    Spark merges a chain of expressions into one text and computes a part anew for each place that names it,
    and within a lambda for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut_at(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that covers the whole text as an array, NULL without a match.

    One regex pass for all groups.
    """
    marks = "\u0001".join(f"${g}" for g in range(1, groups + 1))
    parts = F.split(F.regexp_replace(text, pattern, marks), "\u0001")
    return bound(parts, lambda p: F.when(F.size(p) == groups, p))


def number(text: Column) -> Column:
    """Digits with optional thousands separators to a double.

    An empty text, the usual miss of a search, is not cast: each failed cast to a double raises an error inside Spark.
    """
    return bound(text, lambda t: F.when(t != "", F.replace(t, F.lit(","), F.lit("")).try_cast("double")))


def size(total: Column, unit: Column) -> Column:
    return F.struct(total.alias("total"), unit.alias("unit"))


def product_of(factors: Column) -> Column:
    return F.aggregate(factors, F.lit(1.0), lambda acc, f: acc * number(f))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    A later filter or join key on them stays above the generator; pushed
    through the stages it would repeat their regexes once per use.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(one))


def with_total(df: DataFrame, text: str | Column, out: str) -> DataFrame:
    """Add the total amount of a pack-size text as ``STRUCT<total, unit>``.

    Bracketed total; else leading amount times every factor outside brackets;
    else the leading amount; else a leading pack count times its factors.

    Staged, so that each regex runs once per row: Catalyst does not merge a
    projection whose result is used several times.
    """
    t, n, head, b, f = (f"_{out}_{c}" for c in ("t", "n", "head", "b", "f"))
    source = F.col(text) if isinstance(text, str) else text
    parts = F.col(head)
    outside = F.regexp_replace(parts[2], _NOTE, "")
    # notes in brackets are no factors of an amount, but they are of a pack count
    rest = F.when(parts[1].rlike(f"^({PACK_UNITS})$"), parts[2]).otherwise(outside)
    bracketed = F.col(t).rlike("[（(]")
    staged = (
        df.withColumn(t, half_width(source))
        .withColumns({
            n: F.when(bracketed, number(F.regexp_extract(t, _BRACKET, 1))),
            head: F.coalesce(cut_at(F.col(t), _BASE, 3), cut_at(F.col(t), _PACK, 3)),
        })
        .withColumns({
            b: number(parts[0]),
            f: F.when(rest.rlike(f"[{TIMES}]"), product_of(F.regexp_extract_all(rest, F.lit(_FACTOR), 1))),
        })
    )
    total = F.when(F.col(n) > 0, size(F.col(n), F.regexp_extract(t, _BRACKET, 2))).when(
        F.col(b) > 0, size(F.col(b) * _above_one(f), parts[1]))
    return settled(staged, {out: total}).drop(t, n, head, b, f)


def _above_one(factor: str) -> Column:
    return F.when(F.col(factor) > 1, F.col(factor)).otherwise(1.0)


def with_norm(df: DataFrame, text: str | Column, out: str) -> DataFrame:
    """Add the total in its base unit."""
    raw = f"_{out}_raw"
    return with_total(df, text, raw).withColumn(out, normalized(F.col(raw))).drop(raw)


def plain_amount(text: Column) -> Column:
    """Total of a bare ``number unit`` text."""
    bare = f"^([\\d,]+)({BASE_UNITS}|{PACK_UNITS})$"
    amount = number(F.regexp_extract(text, bare, 1))
    return F.when(amount > 0, size(amount, F.regexp_extract(text, bare, 2)))


def normalized(total: Column) -> Column:
    """kg to g and L to mL; NULL unless the total is a positive number."""
    def base(t: Column) -> Column:
        unit, amount = F.trim(t["unit"]), t["total"]
        return F.when(amount > 0, bound(F.lower(unit), lambda low: (
            F.when(low == "kg", size(amount * 1000, F.lit("g")))
            .when(low == "g", size(amount, F.lit("g")))
            .when(low == "l", size(amount * 1000, F.lit("mL")))
            .when(low == "ml", size(amount, F.lit("mL")))
            .otherwise(size(amount, unit)))))

    return bound(total, base)


def same_total(a: Column, b: Column) -> Column:
    """Equal amount in the same unit; False when either is unknown."""
    return F.coalesce(
        (a["total"] == b["total"]) & (F.lower(a["unit"]) == F.lower(b["unit"])), F.lit(False)
    )


def plain_number(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _one_decimal(value: Column) -> Column:
    # exact comparison of the binary value with the tie, scaled by 2^52
    guess = F.floor(value * 10 + 0.5)
    scaled = (value * float(2**52)).cast("bigint") * 20
    tie = (guess * 2 - 1) * 2**52
    tenths = F.when(scaled < tie, guess - 1).when(scaled >= tie + 2**53, guess + 1).otherwise(guess)
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def _two_decimals(value: Column) -> Column:
    wide = "decimal(20,0)"
    guess = F.floor(value * 100 + 0.5)
    scaled = (value * float(2**62)).cast("bigint").cast(wide) * F.lit(200).cast("decimal(3,0)")

    def tie(n: Column) -> Column:
        return (n * 2 - 1).cast("decimal(4,0)") * F.lit(2**62).cast(wide)

    cents = (
        F.when(scaled < tie(guess), guess - 1).when(scaled >= tie(guess + 1), guess + 1)
        .otherwise(guess)
    )
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def price_text(value: Column) -> Column:
    """0, 1 or 2 decimals by magnitude of the unrounded value.

    Ties are decided on the exact binary value, larger digit first.
    """
    return (
        F.when(value >= 10, F.floor(value + 0.5).cast("string"))
        .when(value >= 1, _one_decimal(value))
        .otherwise(_two_decimals(value))
    )


def sized_for(total: Column, target_unit: Column) -> Column:
    """The total in the target unit where it converts, else as written."""
    norm = normalized(total)
    picked = F.when(norm["unit"] == target_unit, norm).otherwise(total)
    # fixed conversion: one 組 holds two 枚
    return F.when(
        (target_unit == "組") & (picked["unit"] == "枚"),
        size(picked["total"] / 2, F.lit("組")),
    ).otherwise(picked)


def with_unit_price(
    df: DataFrame, price: str | Column, total: str, out: str, target_unit: Column | None = None
) -> DataFrame:
    """Add ``STRUCT<value, unit, label>`` of a price for a parsed total."""
    p, z, v = f"_{out}_p", f"_{out}_z", f"_{out}_v"
    source = F.col(price) if isinstance(price, str) else price
    sized = F.col(total) if target_unit is None else sized_for(F.col(total), target_unit)
    value, unit = F.col(v), F.col(z)["unit"]
    staged = df.withColumns({p: source, z: sized}).withColumn(
        v, F.when(F.col(p) > 0, F.col(p).cast("double") / F.col(z)["total"]))
    label = F.concat(F.lit("約"), price_text(value), F.lit("円/"), unit)
    price_per_unit = F.when(value.isNotNull(), F.struct(
        value.alias("value"), unit.alias("unit"), label.alias("label")))
    return settled(staged, {out: price_per_unit}).drop(p, z, v)


# -- kinds of pack size ------------------------------------------------------

def _real(text: Column) -> Column:
    return text.isNotNull() & (text != "") & (text != "-")


def is_sales_unit(unit: Column) -> Column:
    return F.coalesce(unit.rlike(f"^({SALES_UNITS})$"), F.lit(False))


def is_sales_quantity(text: Column, total: Column) -> Column:
    return F.coalesce(
        _real(text) & is_sales_unit(total["unit"]) & ~half_width(text).rlike(_MEASURE), F.lit(False))


def has_measure(text: Column) -> Column:
    return F.coalesce(_real(text) & half_width(text).rlike(_MEASURE), F.lit(False))


def is_likely_misread(item_name: Column, extracted: Column, total: Column) -> Column:
    """The name prints a measure but only a count was read from it."""
    return F.coalesce(
        is_sales_unit(total["unit"])
        & ~half_width(extracted).rlike(_MEASURE) & half_width(item_name).rlike(_MEASURE),
        F.lit(False),
    )


def merged_quantity(existing: Column, extracted: Column, total: Column) -> Column:
    """The stored ``measure × count`` with the count of the extracted size, or NULL.

    ``total`` is the total of ``extracted``.  The counts must carry the same
    unit; the first such place is rewritten.
    """
    old = half_width(existing)
    place = (rf"(?is)^(.*?\d[\d,]*{WS}*(?:{MEASURE_UNITS}){WS}*[{TIMES}]{WS}*)"
             rf"(\d[\d,]*)({WS}*)(SALES)(.*)$")
    merged = F.lit(None).cast("string")
    for unit in SALES_UNITS.split("|"):
        at = place.replace("SALES", unit)
        merged = F.when(
            (total["unit"] == unit) & (number(F.regexp_extract(old, at, 2)) > 0),
            F.concat(F.regexp_extract(old, at, 1), plain_number(total["total"]),
                     F.regexp_extract(old, at, 3), F.lit(unit), F.regexp_extract(old, at, 5)),
        ).otherwise(merged)
    return F.when(_real(existing) & is_sales_quantity(extracted, total), merged)


def same_measure_base(existing: Column, extracted: Column) -> Column:
    """Extracted size equals one piece of the stored ``measure × count``."""
    old, new = half_width(existing), half_width(extracted)
    whole = rf"(?i)^([\d,]+){WS}*({MEASURE_UNITS}){WS}*$"
    counted = rf"(?i)^([\d,]+){WS}*({MEASURE_UNITS}){WS}*[{TIMES}]{WS}*\d"

    def amount(text: Column, pattern: str) -> Column:
        return normalized(
            size(number(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2))
        )

    return F.coalesce(
        _real(existing) & _real(extracted)
        & same_total(amount(new, whole), amount(old, counted)), F.lit(False))


def is_count_choice(name: Column) -> Column:
    """The name lists different counts of one unit to choose from."""
    t = half_width(name)
    pair = (rf"(?i)(\d[\d,]*){WS}*({VARIANT_UNITS}){WS}*[{VARIANT_DELIMITERS}]{WS}*"
            rf"(\d[\d,]*){WS}*({VARIANT_UNITS})")
    hits = F.regexp_extract_all(t, F.lit(pair), 0)
    return F.exists(
        hits,
        lambda h: (F.lower(F.regexp_extract(h, pair, 2)) == F.lower(F.regexp_extract(h, pair, 4)))
        & (number(F.regexp_extract(h, pair, 1)) != number(F.regexp_extract(h, pair, 3))),
    )


def is_multi_measure(name: Column) -> Column:
    """Two or more distinct amounts of one measured unit in a name."""
    hits = F.regexp_extract_all(half_width(name), F.lit(_MEASURE), 0)
    amounts = F.transform(hits, lambda h: size(
        number(F.regexp_extract(h, r"^([\d,]+)", 1)), F.regexp_extract(h, _MEASURE, 1)))
    amounts = F.transform(amounts, normalized)
    distinct = F.array_distinct(F.filter(amounts, lambda a: a.isNotNull()))
    units = F.transform(distinct, lambda a: a["unit"])
    return bound(units, lambda u: F.size(u) > F.size(F.array_distinct(u)))
