"""Item codes, canonical links and site paths.

Parts are taken by regular expression: the JVM's strict URI parser rejects
links that browsers accept.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import trimmed

# Fixed values
ITEM_HOST = "item.rakuten.co.jp"
AFFILIATE_HOST = "hb.afl.rakuten.co.jp"
_URL = r"(?i)^\s*(?:[a-z][a-z0-9+.\-]*):/{2,}(?:[^/?#@]*@)?([^/?#:\s]+)(?::\d+)?([^?#]*)(\?[^#]*)?"
_ASIN = r"(?i)^[A-Z0-9]{10}$"
_ASIN_PLACES = [r"(?i)/dp/([A-Z0-9]{10})", r"(?i)/gp/product/([A-Z0-9]{10})", r"(?i)[?&]ASIN=([A-Z0-9]{10})"]


def is_url(url: Column) -> Column:
    return F.coalesce(
        url.rlike(_URL) | url.rlike(r"(?i)^\s*(?!https?:|ftp:|wss?:)[a-z][a-z0-9+.\-]*:"), F.lit(False))


def is_web_url(url: Column) -> Column:
    return is_url(url) & url.rlike(r"(?i)^\s*https?:")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def parameter(url: Column, name: str) -> Column:
    """Decoded query parameter, NULL when absent."""
    pattern = rf"[?&]{name}=([^&#]*)"
    return F.when(url.rlike(pattern), F.try_url_decode(F.regexp_extract(url, pattern, 1)))


def item_parts(url: Column) -> Column:
    """``STRUCT<shop, item>`` of a direct or affiliate item link, else NULL."""
    inner = F.when(host(url) == AFFILIATE_HOST, F.try_url_decode(parameter(url, "pc"))).otherwise(url)
    two = r"^/([^/]+)/([^/]+)/?$"
    return F.when(
        (host(inner) == ITEM_HOST) & path(inner).rlike(two),
        F.struct(F.regexp_extract(path(inner), two, 1).alias("shop"),
                 F.regexp_extract(path(inner), two, 2).alias("item")),
    )


def direct_item_url(url: Column) -> Column:
    """Canonical item link; other links of the item host stay, the rest is NULL."""
    parts = item_parts(url)
    return F.when(
        parts.isNotNull(),
        F.concat(F.lit(f"https://{ITEM_HOST}/"), parts["shop"], F.lit("/"), parts["item"], F.lit("/")),
    ).when(host(url) == ITEM_HOST, url)


def item_key(url: Column) -> Column:
    """One comparable key per item: shop and item in lower case, else the trimmed link."""
    parts = item_parts(url)
    return F.coalesce(F.lower(F.concat(parts["shop"], F.lit(":"), parts["item"])), trimmed(url))


def same_item(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (item_key(a) == item_key(b)), F.lit(False))


def affiliate_code(url: Column) -> Column:
    """``shop:item`` of the link wrapped in an affiliate link, else NULL."""
    inner = path(parameter(url, "pc"))
    two = r"^/*([^/]+)/+([^/]+)"
    return F.when(inner.rlike(two), F.concat(
        F.regexp_extract(inner, two, 1), F.lit(":"), F.regexp_extract(inner, two, 2)))


def listed_code(url: Column) -> Column:
    """``shop:item`` found anywhere in a direct or unwrapped link (reconciliation)."""
    wrapped = F.when(url.contains(AFFILIATE_HOST), F.try_url_decode(parameter(url, "pc")))
    target = F.coalesce(wrapped, url)
    two = r"item\.rakuten\.co\.jp/([^/]+)/([^/?#]+)"
    return F.when(target.rlike(two), F.concat(
        F.regexp_extract(target, two, 1), F.lit(":"), F.regexp_extract(target, two, 2)))


def last_segment(url: Column, wrapper: str, suffix: str = "") -> Column:
    """Last of at least two path segments of the link or the link it wraps."""
    last = r"^/*[^/]+/+(?:[^/]+/+)*([^/]+)/*$"
    # the segment is never empty, so an empty text means that there is none
    code = F.regexp_extract(path(F.coalesce(parameter(url, wrapper), url)), last, 1)
    return F.nullif(F.regexp_replace(code, suffix, "") if suffix else code, F.lit(""))


def base_item_code(url: Column) -> Column:
    return F.lower(last_segment(url, "pc"))


def offer_item_code(url: Column) -> Column:
    return F.lower(last_segment(url, "vc_url", r"(?i)\.html$"))


def same_code(base_url: Column, offer_url: Column) -> Column:
    return is_same_code(base_item_code(base_url), offer_item_code(offer_url))


def is_same_code(base_code: Column, offer_code: Column) -> Column:
    return F.coalesce((base_code == offer_code) & ~base_code.rlike(r"^\d+$"), F.lit(False))


def quantity_multiplier(url: Column) -> Column:
    """``x{N}`` behind an article number of eight or more digits, else 1."""
    wrapped = F.when(url.rlike("vc_url=[^&]+"),
                     F.try_url_decode(F.regexp_extract(url, "vc_url=([^&]+)", 1)))
    n = F.regexp_extract(F.coalesce(wrapped, url), r"/\d{8,}x(\d+)\.html", 1).try_cast("int")
    return F.greatest(n, F.lit(1))


def catalogue_id(text: Column) -> Column:
    bare = trimmed(text)
    options = [F.when(bare.rlike(_ASIN), F.upper(bare))]
    options += [F.when(text.rlike(p), F.upper(F.regexp_extract(text, p, 1))) for p in _ASIN_PLACES]
    return F.coalesce(*options)


def tagged_url(text: Column, tag: str) -> Column:
    """Link with the tag parameter; a bare catalogue id becomes a link."""
    bare = trimmed(text)
    parts = r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$"
    query = F.regexp_extract(text, parts, 2)
    joined = F.when(query == "", F.lit("?")).when(query == "?", query).otherwise(F.concat(query, F.lit("&")))
    added = F.concat(F.regexp_extract(text, parts, 1), joined, F.lit(f"tag={tag}"),
                     F.regexp_extract(text, parts, 3))
    return (
        F.when(bare.rlike(_ASIN), F.concat(
            F.lit("https://www.amazon.co.jp/dp/"), F.upper(bare), F.lit(f"?tag={tag}")))
        .when(is_url(text) & ~query.rlike("[?&]tag(?:=|&|$)"), added)
        .otherwise(text)
    )


def encode_component(text: Column) -> Column:
    """Percent-encoding of a query value as browsers do it."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def yahoo_search_url(keyword: Column, sid: str, pid: str) -> Column:
    inner = F.concat(F.lit("https://shopping.yahoo.co.jp/search?p="), encode_component(keyword))
    return F.concat(
        F.lit(f"https://ck.jp.ap.valuecommerce.com/servlet/referral?sid={sid}&pid={pid}&vc_url="),
        encode_component(inner))


def amazon_search_url(keyword: Column, tag: str) -> Column:
    return F.concat(F.lit("https://www.amazon.co.jp/s?k="), encode_component(keyword),
                    F.lit("&tag="), encode_component(F.lit(tag)))


def site_path(target: Column, base: str = "") -> Column:
    """Trailing slash on pages; query, fragment and files untouched."""
    full = F.when(target.startswith("/"), F.concat(F.lit(base), target)).otherwise(
        F.concat(F.lit(f"{base}/"), target))
    parts = r"(?s)^([^#?]*)(.*)$"
    page = F.regexp_extract(full, parts, 1)
    rest = F.regexp_extract(full, parts, 2)
    is_file = F.regexp_extract(page, r"([^/]*)$", 1).contains(".")
    slash = ~is_file & (page != "") & ~page.endswith("/")
    return F.when(target == "/", F.lit(f"{base}/")).otherwise(
        F.concat(page, F.when(slash, F.lit("/")).otherwise(F.lit("")), rest))


def article_path(relative: Column, root: str = "src/content/articles/") -> Column:
    clean = F.replace(relative, F.lit("\\"), F.lit("/"))
    at = F.instr(clean, F.lit(root))
    return F.when(at > 0, F.substring(clean, at, F.length(clean))).otherwise(
        F.concat(F.lit(root), clean))


def status_of(file: Column) -> Column:
    clean = F.replace(file, F.lit("\\"), F.lit("/"))
    return (
        F.when(clean.contains("review/done/"), "review_done")
        .when(clean.contains("/review/"), "review")
        .when(clean.contains("/processed/"), "processed")
        .when(clean.contains("/failed/"), "failed")
        .otherwise("unknown")
    )


def is_article_file(file: Column, root: str = "src/content/articles/", extension: bool = False) -> Column:
    """Below the article folder and never out of it; optionally a Markdown file."""
    clean = F.lower(F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""))
    safe = clean.startswith(root.lower()) & ~clean.rlike(r"(^|/)\.\.(/|$)") & (F.length(clean) > len(root))
    if extension:
        safe = safe & file.rlike(r"\.(md|mdx)$")
    return F.coalesce(safe, F.lit(False))
