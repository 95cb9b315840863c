"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import chat, decontaminate, exact_dedup, language_id, mixing, ngram_join, pii, pseudo_likelihood, quality, secret_scan, url_filter, vector_codes, zone_clusters
from trailmark.llm.common import held_out, table
from trailmark.plans.registry import Plan, Query
from trailmark.session import configure

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Plan) -> Plan:
        QUERIES[name] = Query(lambda spark, folder: plan(configure(spark), folder), sql)
        return plan

    return add


@query("op1_decontaminate")
def decontaminate_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    longest = F.array_max(F.transform("tiles", lambda t: t["length"]))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"), longest.alias("longest_tile"))


TEMPLATE_TEXT = "\\### Assistant: </turn> ok"
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(4 + length(role) + length(role) - length(regexp_replace(role, '[\\#<:\n]', '', 'g')) + 2
             + length(text) + length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) + 8) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM told"""


@query("op2_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TEMPLATE_TEXT), (-7, 1, "assistant", TEMPLATE_TEXT)], rows.schema)
    formatted = chat.format_paths(chat.turns_as_tree(rows.unionByName(extra)))
    read = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, coalesce(sum(source_size * 3e0) OVER w, 0) AS sizes, coalesce(sum(weight) OVER w, 0) AS weights,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weight
  FROM totals WINDOW w AS (ORDER BY source_size * 3e0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, source_size * 3e0 * (all_weight - weights) < (words - sizes) * weight AS stopped FROM ordered),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN source_size * 3e0 ELSE least(
           (words - coalesce(sum(source_size * 3e0) FILTER (stopped) OVER (), 0)) * weight
           / (all_weight - coalesce(sum(weight) FILTER (stopped) OVER (), 0)), source_size * 3e0) END AS target
  FROM marked),
budgets AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets),
ranked AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken,
       CAST(epochs AS BIGINT) AS epochs
FROM ranked"""


@query("op3_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op4_score_language_model")
def score_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, folder, "documents"))


@query("op5_find_pii")
def find_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("found")).alias("spans"),
    )


@query("op6_quality")
def rate_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    rated = quality.rate(docs.select("doc_id", "text"), model)
    fold = held_out(F.col("doc_id"), quality.FOLDS, quality.HELD).alias("held_out")
    return rated.select("doc_id", fold, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_ngram_join")
def join_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"), n=3, percent=90)


#: the listed rules of the contract: action, host, path
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BLOCKED_WORDS = ("spam-farm", "cheap-pills", "casino", "xxx", "click-bait")
URL_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS n
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT n, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS place
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
words(word) AS (VALUES ('spam-farm'), ('cheap-pills'), ('casino'), ('xxx'), ('click-bait')),
worded AS (
  SELECT n, word, row_number() OVER (PARTITION BY n ORDER BY length(word) DESC, word DESC) AS place
  FROM cut JOIN words ON regexp_matches(host || path, '(?i)(^|[^\pL\pN])' || word || '($|[^\pL\pN])'))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL AND word IS NOT NULL THEN '*' || word || '*' END AS pattern_rule
FROM cut LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n) LEFT JOIN (SELECT n, word FROM worded WHERE place = 1) USING (n)"""


@query("op8_filter_urls", URL_SQL)
def filter_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = [url_filter.prefix_rule(*r) for r in LISTED] + [url_filter.word_rule("block", w) for w in BLOCKED_WORDS]
    return url_filter.judge_urls(table(spark, folder, "pages"), url_filter.rule_table(spark, rules))


DEDUP_SQL = """
WITH named AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body,
         row_number() OVER () AS n
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST, n) = 1 AS kept, sha256(body) AS text_sha256
FROM named WINDOW g AS (PARTITION BY body)"""


@query("op9_exact_dedup", DEDUP_SQL)
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


@query("op10_language")
def identify_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.train(docs)
    told = docs.select("doc_id", language_id.predict(model, F.col("text")).alias("p"))
    fold = held_out(F.col("doc_id"), language_id.FOLDS, language_id.HELD).alias("held_out")
    return told.select("doc_id", fold, "p.lang_pred", "p.score", "p.rejected")


CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS = 8, 16, 6
FINITE_SQL = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    """Codebooks and codes by comparing every part with every entry, round after round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS n, len(embedding) // {CODE_PARTS} AS width,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {FINITE_SQL})""",
        """parts AS MATERIALIZED (SELECT n, (i - 1) // width AS part, (i - 1) % width AS place, v[i] AS x
  FROM (SELECT n, width, v, unnest(generate_series(1, len(v))) AS i FROM kept))""",
        f"book0 AS (SELECT part, n AS entry, place, x FROM parts WHERE n < {CODE_ENTRIES})",
    ]
    for r in range(CODE_ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT n, part, entry, away FROM (
  SELECT *, row_number() OVER (PARTITION BY n, part ORDER BY away, entry) AS nth FROM (
    SELECT p.n, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS away FROM parts p JOIN book{r} b USING (part, place) GROUP BY ALL)) WHERE nth = 1)""")
        if r < CODE_ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM parts JOIN near{r} USING (n, part) GROUP BY ALL) m USING (part, entry, place))""")
    return "WITH " + ",\n".join(steps) + f""",
told AS (SELECT n, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{CODE_ROUNDS} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{CODE_ROUNDS}) AS codebooks_sha256
FROM told JOIN kept USING (n)"""


@query("op11_vector_codes", _codes_sql())
def vector_code_table(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"), parts=CODE_PARTS, entries=CODE_ENTRIES, rounds=CODE_ROUNDS)


@query("op12_secret_scan")
def scan_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS)),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
        "layers",
    )


CLUSTERS, CLUSTER_ROUNDS = 16, 3


def _clusters_sql() -> str:
    """Lloyd rounds by comparing every vector with every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS n,
  list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE_SQL})""",
        "cells AS MATERIALIZED (SELECT n, i, v[i] AS x FROM (SELECT n, v, unnest(generate_series(1, 64)) AS i FROM kept))",
        f"point0 AS (SELECT n AS cluster, i, x FROM cells WHERE n < {CLUSTERS})",
    ]
    for r in range(CLUSTER_ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT n, cluster, away FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY away, cluster) AS nth FROM (
    SELECT c.n, p.cluster, sum((c.x - p.x) * (c.x - p.x)) AS away FROM cells c JOIN point{r} p USING (i) GROUP BY ALL)) WHERE nth = 1)""")
        if r < CLUSTER_ROUNDS:
            steps.append(f"""point{r + 1} AS MATERIALIZED (SELECT p.cluster, p.i, coalesce(m.x, p.x) AS x FROM point{r} p LEFT JOIN (
    SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM cells JOIN near{r} USING (n) GROUP BY ALL) m USING (cluster, i))""")
    return "WITH " + ",\n".join(steps) + f""",
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM point{CLUSTER_ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(away AS BIGINT) AS distance, CAST(sum(away) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(away) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{CLUSTER_ROUNDS} JOIN kept USING (n) JOIN digests USING (cluster)"""


@query("op13_zone_clusters", _clusters_sql())
def cluster_zones(spark: SparkSession, folder: str) -> DataFrame:
    return zone_clusters.cluster(table(spark, folder, "embeddings"), centroids=CLUSTERS, rounds=CLUSTER_ROUNDS)
