"""The registered queries of these operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (best_fit, chat_format, deobfuscate, decision_list, hmm_lm, lanczos_whiten, odd_sketch, periodic_runs, piece_chunks,
               popcount_dedup, url_reputation, vp_tree, warc_bundles)
from .common import crc_fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL_SUFFIXES = ["example.com", "example.net", "example.org"]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))
    def fits(r: str) -> str:
        host, path = r.split("/", 1)
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"
    names = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    suffix = " ".join(f"WHEN host = '{s}' OR ends_with(host, '.{s}') THEN '{s}'" for s in URL_SUFFIXES)
    strength = "CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 10.0 ELSE round(1 / least(greatest((sum(n * (k / n - p) * (k / n - p) / (p * (1 - p))) - count(*)) / (sum(n) - count(*)), 1e-3), 0.9) - 1, 6) END AS s"
    return f"""
WITH u0 AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u0),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u1),
seen AS (SELECT host, count(*) AS n, sum(1 - quality) AS k FROM u JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
  CASE {suffix} ELSE split_part(host, '.', -1) END AS suffix
  FROM (SELECT DISTINCT host FROM u) LEFT JOIN seen USING (host)),
base AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -(len(string_split(suffix, '.')) + 1), -1), '.') AS domain FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM base GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
tops_p AS (SELECT *, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM tops) AS p FROM tops),
s0 AS (SELECT {strength} FROM tops_p WHERE n > 0),
domains_p AS (SELECT d.*, (t.k + s * t.p) / (t.n + s) AS p FROM domains d JOIN tops_p t USING (suffix), s0),
s1 AS (SELECT {strength} FROM domains_p WHERE n > 0),
base_p AS (SELECT b.*, (d.k + s * d.p) / (d.n + s) AS p FROM base b JOIN domains_p d USING (domain), s1),
s2 AS (SELECT {strength} FROM base_p WHERE n > 0),
post AS (SELECT host, (k + s * p) / (n + s) AS m, n + s AS w FROM base_p, s2),
judged AS (SELECT page_id, host, path, CASE {names} END AS rule, m - 1.645 * sqrt(m * (1 - m) / (w + 1)) AS low FROM u JOIN post USING (host))
SELECT page_id, host, path, rule, CASE {verdicts} WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM judged"""


@query("op1_url_filter", _url_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the label of quality that carries the page's number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, URL_SUFFIXES).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op2_piece_encoding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_chunks.encode_documents(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


PROBE = "</s>[INST] ok [/INST]"


def _escaped(c: str) -> str:
    t = chat_format.Template()
    out = f"replace({c}, '\\', '\\\\')"
    for s in (t.turn, t.body, t.end, *t.control):
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return f"length({out})"


_MARKS = sum(map(len, (chat_format.Template().turn, chat_format.Template().body, chat_format.Template().end)))


@query("op4_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_MARKS} + {_escaped('role')} + {_escaped('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(turns.unionByName(probe))
    chats = chats.withColumn("read", chat_format.read_turns(F.col("formatted")))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", chat_format.loss_text(F.col("segments")))
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_warc_bundles", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT h, list_aggregate(list_transform(range(1, 41), lambda i: substr(
  '0000000100100011010001010110011110001001101010111100110111101111',
  (4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1)::INT, 4)), 'string_agg', '') AS bits FROM d),
e AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + 16 * substr(bits, (5 * j + 1)::INT, 1)::INT + 8 * substr(bits, (5 * j + 2)::INT, 1)::INT
  + 4 * substr(bits, (5 * j + 3)::INT, 1)::INT + 2 * substr(bits, (5 * j + 4)::INT, 1)::INT
  + substr(bits, (5 * j + 5)::INT, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (h) JOIN e USING (h)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_bundles.write_bundles(table(spark, sf_dir, "pages"))
    return warc_bundles.read_bundles(index).drop("payload")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = deobfuscate.fit(docs, labels.where(crc_fold("doc_id") != 0))
    out = deobfuscate.score(docs, scorer)
    return out.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", "predicted")


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vp_tree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op9_hmm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm_lm.score(table(spark, sf_dir, "documents"), crc_fold("doc_id") != 1)
    return out.select("doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popcount_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query("op11_odd_sketches", f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT way.b, seen FROM reach JOIN way ON way.a = reach.doc_id),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_lanczos_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lanczos_whiten.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


# crc32 of a short decimal text, bit by bit
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda r, c: list_reduce(list_concat([xor(r, c)], range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""


@query("op13_periodic_runs", f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w, xor({_CRC}, 4294967295) AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
  list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
i AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM i GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
runs AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM o ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(runs.text, '')) AS runs_sha256, sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM t LEFT JOIN runs USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in ten becomes periodic from some word on, by the hash of its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.array_join(F.concat(
        F.slice("w", F.lit(1), F.col("a").cast("int")),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1),
                    lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")))), " ")
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs, carry=["doc_id"])
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.when(F.size("runs") > 0, F.reduce("runs", F.element_at("runs", 1), lambda x, y: F.when(more(y, x), y).otherwise(x)))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
