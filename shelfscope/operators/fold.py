"""Decision lines applied one after another: each line sees the products as the lines before it left them.

Lines and products of an article meet in one sorted shuffle.  A task streams its rows article by article:
first the lines, then the products, of which only those are kept that a line can address.  So its state grows
with the lines of an article, not with its products.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..session import cut_lineage
from .decisions import match_fields
from .numbering import row_numbers

# what a replacement may set, and the product column it goes to; numbers may be zero, texts must not be empty
FIELDS = {"new_name": "name", "new_price": "price", "new_rating": "rating", "new_review_count": "review_count",
          "new_url": "base_url", "new_image": "image_url", "new_capacity": "capacity",
          "new_price_per_unit": "price_per_unit"}
_KINDS = {"new_price": "long", "new_rating": "double", "new_review_count": "long"}
OUTCOME = "file string, line_no long, raw string, article_id string, outcome string, effect string, message string"
CHANGE = "orig_idx long, gone boolean, " + ", ".join(f"{f} {_KINDS.get(f, 'string')}" for f in FIELDS)
ARTICLE, LINE, PRODUCT = range(3)


class Article:
    """The addressed products of one article while its lines are applied."""

    def __init__(self, lines: list[dict]):
        deletes = sum(x["action"] == "review" and x["decision"] == "delete" for x in lines)
        self.asked = Counter(n for x in lines for n in (x["current_name"], x["new_name"]) if n is not None)
        self.ranks = {x["rank"] for x in lines}
        # after deletions a rank is a position, and one deletion moves it by one
        self.reach = [(r, r + deletes) for r in sorted(r for r in self.ranks if r is not None)] if deletes else []
        self.n = 0
        self.at_rank: dict[int, int] = {}
        self.names: dict[int, str | None] = {}
        self.ids: dict[int, int] = {}
        self.same: Counter = Counter()
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.gone: list[int] = []
        self.changes: dict[int, dict] = {}
        self._next = 0

    def add(self, orig_idx: int, rank: int | None, name: str | None) -> None:
        """The next product in list order."""
        self.n += 1
        p = self.n
        while self._next < len(self.reach) and self.reach[self._next][1] < p:
            self._next += 1
        wanted = self._next < len(self.reach) and self.reach[self._next][0] <= p
        if rank in self.ranks and rank not in self.at_rank:
            self.at_rank[rank] = p
            wanted = True
        if name in self.asked:
            self.same[name] += 1
            # each line takes at most one of them away
            if len(self.places[name]) <= self.asked[name]:
                self.places[name].append(p)
                wanted = True
        if wanted:
            self.names[p], self.ids[p] = name, orig_idx

    def find(self, rank: int | None) -> int | None:
        if rank is None:
            return None
        if not self.gone:
            return self.at_rank.get(rank)
        p = rank
        for d in self.gone:
            p += d <= p
        return p if 1 <= rank and p <= self.n else None

    def _leave(self, p: int) -> None:
        name = self.names[p]
        if name in self.asked:
            self.same[name] -= 1
            spots = self.places[name]
            at = bisect_left(spots, p)
            if at < len(spots) and spots[at] == p:
                del spots[at]

    def apply(self, line: dict) -> tuple[str, str | None, str | None]:
        """Outcome, effect and message of the next line; changes the products."""
        action, current = line["action"], line["current_name"]
        delete = action == "review" and line["decision"] == "delete"
        if action == "review" and not delete:
            return "processed", "review", line["reason"] or "review"
        if not delete and action != "replace":
            return "failed", None, f"unsupported action: {action or '-'}"
        if not delete and not line["url_ok"]:
            return "failed", None, "replace requires selectedAffiliateUrl"
        p = self.find(line["rank"])
        if p is None or not current:
            return "failed", None, ("review delete requires rank and current.name" if delete
                                    else "rank and current.name are required for replace")
        if self.names[p] != current:
            return "failed", None, f'rank/current.name mismatch: rank {line["rank"]} is "{self.names[p]}", JSONL current is "{current}"'
        if delete:
            if self.same[current] > 1:
                return "processed", "review", f'duplicate name "{current}": skipped deletion'
            if self.n - len(self.gone) <= 1:
                return "processed", "review", f'last product: cannot delete "{current}"'
            self._leave(p)
            insort(self.gone, p)
            self.changes.setdefault(p, {})["gone"] = True
            return "processed", "delete", line["reason"]
        p = self.places[current][0]  # the update goes by name, to the first product that has it
        new = {f: line[f] for f in FIELDS if line[f] is not None and line[f] != ""}
        self.changes.setdefault(p, {}).update(new)
        if "new_name" in new and new["new_name"] != current:
            self._leave(p)
            self.names[p] = new["new_name"]
            self.same[new["new_name"]] += 1
            insort(self.places[new["new_name"]], p)
        return "processed", "replace", line["reason"]


def _output(article_id: str, known: bool, lines: list[dict], products: Article) -> Iterator[dict]:
    for x in lines:
        if x["pre"] is not None:
            found = x["pre"], None, x["pre_message"]
        elif not known:
            found = "failed", None, "article file not found"
        else:
            found = products.apply(x)
        yield {k: x[k] for k in ("file", "line_no", "raw", "article_id")} | dict(zip(("outcome", "effect", "message"), found))
    for p, change in products.changes.items():
        yield {"article_id": article_id, "orig_idx": products.ids[p], "gone": False} | change


def fold_decisions(lines: DataFrame, articles: DataFrame, products: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Outcomes of match-decision lines and the product changes they add up to, as rows of one table.

    Files count in order of their paths; within a file, an article's replacements come first, then its reviews
    by falling rank, then the rest.  Outcome rows have ``file, line_no, raw, article_id, outcome, effect,
    message``; change rows have ``article_id, orig_idx, gone`` and the new fields.  ``lines`` are tolerant lines,
    ``products`` need ``article_id, orig_idx, rank, name``.  Rows move once, by article, sorted; lines that belong
    to no article are spread by their number.  The lines are parsed once into a written table.
    """
    df = match_fields(lines)
    c = F.col
    skipped = F.lit(False) if wanted is None else ~F.coalesce(wanted, F.lit(False))
    pre = (
        F.when(c("is_empty"), F.struct(F.lit("noop").alias("o"), F.lit(None).cast("string").alias("m")))
        .when(~c("is_ok"), F.struct(F.lit("failed").alias("o"), F.lit("JSON parse failed").alias("m")))
        .when(~c("is_object"), F.struct(F.lit("failed").alias("o"), F.lit("line is not an object").alias("m")))
        .when(~F.coalesce(U.is_article_file(c("article_file")), F.lit(False)),
              F.struct(F.lit("failed").alias("o"), F.lit("invalid articleFile").alias("m")))
        .when(skipped, F.struct(F.lit("pending").alias("o"), F.lit(None).cast("string").alias("m"))))
    df = df.withColumn("_pre", pre)
    no_article = F.concat_ws("\u0001", F.lit(""), F.pmod(F.xxhash64("file", "line_no"), F.lit(4096)).cast("string"))
    texts = [f for f in FIELDS if f not in _KINDS]
    # read for the articles they ask for, and as lines
    asked = cut_lineage(df.select(
        F.when(c("_pre.o").isNull() | (c("_pre.o") == "pending"), c("article_id")).otherwise(no_article).alias("key"),
        F.lit(LINE).alias("tag"), "file",
        F.when(c("action") == "replace", 0).when(c("action") == "review", 1).otherwise(2).alias("cls"),
        F.when(c("action") == "review", -F.coalesce("rank", F.lit(0))).otherwise(0).cast("long").alias("place"),
        c("line_no").cast("long").alias("line_no"), "raw", "article_id", c("_pre.o").alias("pre"), c("_pre.m").alias("pre_message"),
        c("rank").cast("long").alias("rank"), "action", "decision", F.nullif("current_name", F.lit("")).alias("current_name"),
        "reason", F.coalesce(U.is_web_url(c("new_url")), F.lit(False)).alias("url_ok"),
        *[c(f).cast(_KINDS.get(f, "string")).alias(f) for f in (*texts, *_KINDS)]))
    # only articles that lines ask for move
    touched = asked.where("pre IS NULL").select("key").distinct()
    there = articles.select(F.col("article_id").alias("key"), F.lit(ARTICLE).alias("tag")).join(touched, "key", "left_semi")
    held = products.select(
        F.col("article_id").alias("key"), F.lit(PRODUCT).alias("tag"), F.col("orig_idx").cast("long").alias("place"),
        F.col("rank").cast("long").alias("rank"), F.col("name").alias("current_name")).join(touched, "key", "left_semi")
    rows = asked.unionByName(there, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
    order = ["key", "tag", "file", "cls", "place", "line_no"]
    rows = rows.repartition("key").sortWithinPartitions(*order)
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in f"{OUTCOME}, {CHANGE}".split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, mine, state, out = None, False, [], None, []
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            keys, tags = column["key"].to_pylist(), column["tag"].to_pylist()
            place, rank, name = (column[x].to_pylist() for x in ("place", "rank", "current_name"))
            said = iter(batch.filter(pc.equal(column["tag"], LINE)).to_pylist())
            for i, (k, tag) in enumerate(zip(keys, tags)):
                if k != key:
                    if mine:
                        out.extend(_output(key, known, mine, state or Article(mine)))
                    key, known, mine, state = k, False, [], None
                if tag == ARTICLE:
                    known = True
                elif tag == LINE:
                    mine.append(next(said))
                elif mine:
                    state = state or Article(mine)
                    state.add(place[i], rank[i], name[i])
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if mine:
            out.extend(_output(key, known, mine, state or Article(mine)))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, f"{OUTCOME}, {CHANGE}")


def outcomes(folded: DataFrame) -> DataFrame:
    return folded.where("outcome IS NOT NULL").select(*[x.split()[0] for x in OUTCOME.split(", ")])


def changed_products(folded: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of ``products`` that the lines change, with ``gone`` for deleted ones.

    An article that loses a product is numbered anew, so all its rows are there; else the changed rows only.
    """
    changes = folded.where("outcome IS NULL").select("article_id", "orig_idx", "gone", *FIELDS)
    cut = changes.where("gone").select("article_id").distinct().withColumn("_cut", F.lit(True))
    touched = changes.select("article_id").distinct()
    mine = products.join(touched, "article_id", "left_semi").join(changes, ["article_id", "orig_idx"], "left").join(
        cut, "article_id", "left")
    gone = F.coalesce("gone", F.lit(False))
    new = {old: F.coalesce(F.col(f).cast(products.schema[old].dataType), F.col(old))
           for f, old in FIELDS.items() if old in products.columns}
    is_changed = F.col("gone").isNotNull()
    # counted, numbered and read for the deleted rows
    mine = cut_lineage(mine.withColumns({**new, "gone": gone, "_changed": is_changed}).where("_changed OR _cut"))
    left = row_numbers(mine.where("NOT gone"), ["article_id"], [F.col("orig_idx")], "_new")
    left = left.withColumn("rank", F.when(F.col("_cut"), F.col("_new").cast(products.schema["rank"].dataType)).otherwise(F.col("rank")))
    columns = [*products.columns, "gone"]
    return left.select(*columns).unionByName(mine.where("gone").select(*columns))
