"""Registered queries: item properties, point-in-time joins and the value grammar."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import grammar, temporal
from trailmark.plans import sql as q
from trailmark.plans.registry import query
from trailmark.sources.driver_tables import category_tree, clicks, part_values, property_changes
from trailmark.storage import materialise

DIGITS = 6

# events with the property rows known at their time; the latest change wins, equal times by change id
ASOF = """categories AS (SELECT itemid, timestamp AS t, arg_max(value, change_id) AS v FROM changes WHERE property = 'categoryid' GROUP BY 1, 2),
flags AS (SELECT itemid, timestamp AS t, arg_max(value, change_id) AS v FROM changes WHERE property = 'available' GROUP BY 1, 2),
known AS (
  SELECT ev.*, c.v AS categoryid_asof, c.t AS categoryid_asof_time, a.v AS available_asof, a.t AS available_asof_time
  FROM ev ASOF LEFT JOIN categories c ON ev.itemid = c.itemid AND ev.timestamp >= c.t
  ASOF LEFT JOIN flags a ON ev.itemid = a.itemid AND ev.timestamp >= a.t)"""
SUPER = f"""{q.EV},
{q.CHANGES},
{q.TREE},
{ASOF},
super AS (
  SELECT row_number() OVER (ORDER BY timestamp, visitorid, itemid, event, event_id) AS event_id, timestamp, visitorid, event, itemid,
    transactionid, CAST(event = 'transaction' AS INTEGER) AS target_transaction,
    CAST(event IN ('addtocart', 'transaction') AS INTEGER) AS target_addtocart_or_transaction,
    strftime(make_timestamp(timestamp * 1000), '%Y-%m') AS event_month,
    CAST(isodow(make_timestamp(timestamp * 1000)) - 1 AS INTEGER) AS event_dayofweek,
    CAST(hour(make_timestamp(timestamp * 1000)) AS INTEGER) AS event_hour,
    CAST(categoryid_asof AS BIGINT) AS categoryid_asof, categoryid_asof_time, tree.parentid AS category_parentid,
    CAST(available_asof AS BIGINT) AS available_asof, available_asof_time,
    row_number() OVER u - 1 AS user_events_before, (timestamp - lag(timestamp) OVER u) / 60000e0 AS user_minutes_since_previous,
    row_number() OVER i - 1 AS item_events_before, (timestamp - lag(timestamp) OVER i) / 60000e0 AS item_minutes_since_previous
  FROM known LEFT JOIN tree ON CAST(categoryid_asof AS BIGINT) = tree.categoryid
  WINDOW u AS (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id),
         i AS (PARTITION BY itemid ORDER BY timestamp, visitorid, event, event_id))"""


def _super(spark, folder):
    events = clicks(spark, folder).withColumnRenamed("event_id", "source_id")
    return temporal.super_event_table(events, property_changes(spark, folder), category_tree(spark, folder))


@query("asof_property", f"WITH {q.EV}, {q.CHANGES}, {ASOF} SELECT event_id, categoryid_asof, categoryid_asof_time, available_asof, available_asof_time FROM known", doubles=("categoryid_asof_time", "available_asof_time"))
def _(spark, folder):
    rows = temporal.asof_properties(clicks(spark, folder), property_changes(spark, folder))
    return rows.select("event_id", "categoryid_asof", "categoryid_asof_time", "available_asof", "available_asof_time")


@query("latest_property", f"WITH {q.CHANGES} SELECT itemid, arg_max(value, (timestamp, change_id)) AS categoryid FROM changes WHERE property = 'categoryid' GROUP BY 1")
def _(spark, folder):
    return temporal.latest_property(property_changes(spark, folder), "categoryid", "categoryid")


@query(
    "super_event_table",
    f"""WITH {SUPER} SELECT * EXCLUDE (user_minutes_since_previous, item_minutes_since_previous),
    round(user_minutes_since_previous, 6) AS user_minutes_since_previous, round(item_minutes_since_previous, 6) AS item_minutes_since_previous FROM super""", doubles=("transactionid", "categoryid_asof", "category_parentid", "available_asof", "categoryid_asof_time", "available_asof_time"))
def _(spark, folder):
    table = _super(spark, folder).drop("event_time")
    return table.withColumns({c: F.round(c, 6) for c in ("user_minutes_since_previous", "item_minutes_since_previous")})


@query(
    "super_table_preview",
    f"""WITH {SUPER}, a AS (SELECT event_id FROM super WHERE categoryid_asof IS NOT NULL OR available_asof IS NOT NULL ORDER BY event_id LIMIT 10),
    b AS (SELECT event_id FROM super ORDER BY event_id LIMIT 10)
    SELECT event_id, timestamp, visitorid, itemid, categoryid_asof, available_asof FROM super
    WHERE event_id IN (SELECT event_id FROM a UNION SELECT event_id FROM b)""", doubles=("categoryid_asof", "available_asof"))
def _(spark, folder):
    table = materialise(_super(spark, folder), "super")
    return temporal.preview(table).select("event_id", "timestamp", "visitorid", "itemid", "categoryid_asof", "available_asof")


@query(
    "join_audit",
    f"""WITH {SUPER} SELECT count(*) AS event_rows, CAST(count(*) = count(DISTINCT event_id) AS INTEGER) AS event_id_unique,
    round(100e0 * count(categoryid_asof) / count(*), 6) AS categoryid_asof_filled_pct,
    round(100e0 * count(available_asof) / count(*), 6) AS available_asof_filled_pct,
    count(*) FILTER (categoryid_asof_time > timestamp) AS categoryid_asof_future_rows,
    count(*) FILTER (available_asof_time > timestamp) AS available_asof_future_rows,
    round(100e0 * count(*) FILTER (categoryid_asof IN (SELECT categoryid FROM tree)) / count(categoryid_asof), 6) AS category_in_tree_pct FROM super""",
)
def _(spark, folder):
    return temporal.join_audit(materialise(_super(spark, folder), "super"), category_tree(spark, folder), DIGITS)


_FIELDS = ("transactionid", "categoryid_asof", "category_parentid", "available_asof", "user_minutes_since_previous", "item_minutes_since_previous")


@query(
    "missing_share",
    f"WITH {SUPER} " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(100e0 * (count(*) - count({c})) / count(*), 6) AS null_pct FROM super" for c in _FIELDS),
)
def _(spark, folder):
    return temporal.missing_share(_super(spark, folder).select(*_FIELDS), DIGITS)


_HISTORY = """h AS (SELECT row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id) - 1 AS u,
  row_number() OVER (PARTITION BY itemid ORDER BY timestamp, visitorid, event, event_id) - 1 AS i FROM ev)"""


@query(
    "feature_readiness",
    f"""WITH {q.EV}, {_HISTORY} SELECT count(*) AS events, round(100e0 * count(*) FILTER (u = 0) / count(*), 6) AS no_user_history_pct,
    round(100e0 * count(*) FILTER (i = 0) / count(*), 6) AS no_item_history_pct,
    round(100e0 * count(*) FILTER (u > 0 AND i > 0) / count(*), 6) AS both_histories_pct,
    round(quantile_cont(u, 0.95), 6) AS p95_user_events_before, round(quantile_cont(i, 0.95), 6) AS p95_item_events_before FROM h""",
)
def _(spark, folder):
    result = temporal.feature_readiness(clicks(spark, folder), digits=DIGITS)
    return result.withColumns({c: F.round(c, 6) for c in ("p95_user_events_before", "p95_item_events_before")})


@query(
    "category_conversion",
    f"""WITH {q.EV}, {q.CHANGES}, {q.TREE},
    latest AS (SELECT itemid, CAST(arg_max(value, (timestamp, change_id)) AS BIGINT) AS categoryid FROM changes WHERE property = 'categoryid' GROUP BY 1),
    c AS (SELECT categoryid, count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'addtocart') AS addtocart,
      count(*) FILTER (event = 'transaction') AS transaction, count(*) AS total FROM ev JOIN latest USING (itemid) GROUP BY 1)
    SELECT c.*, round(coalesce(CAST(transaction AS DOUBLE) / nullif(view, 0), 0), 6) AS transaction_per_view,
      round(100e0 * total / (SELECT count(*) FROM ev), 6) AS events_pct, tree.parentid AS category_parentid
    FROM c LEFT JOIN tree USING (categoryid)""",
)
def _(spark, folder):
    return temporal.category_conversion(clicks(spark, folder), property_changes(spark, folder), category_tree(spark, folder), DIGITS)


def _member_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS metric, round(100e0 * count(*) FILTER (itemid IN (SELECT itemid FROM changes {where})) / count(*), 6) AS value FROM ev"""


@query(
    "coverage",
    f"""WITH {q.EV}, {q.CHANGES}, {q.TREE} SELECT 'items_in_events' AS metric, CAST(count(DISTINCT itemid) AS DOUBLE) AS value FROM ev
    UNION ALL SELECT 'items_in_properties', count(DISTINCT itemid) FROM changes
    UNION ALL SELECT 'items_with_categoryid', count(DISTINCT itemid) FROM changes WHERE property = 'categoryid'
    UNION ALL SELECT 'items_with_available', count(DISTINCT itemid) FROM changes WHERE property = 'available'
    UNION ALL {_member_sql('events_item_in_properties_pct', '')}
    UNION ALL {_member_sql('events_item_with_categoryid_pct', "WHERE property = 'categoryid'")}
    UNION ALL {_member_sql('events_item_with_available_pct', "WHERE property = 'available'")}
    UNION ALL SELECT 'categories_in_tree', count(DISTINCT categoryid) FROM tree
    UNION ALL SELECT 'visitors', count(DISTINCT visitorid) FROM ev""",
)
def _(spark, folder):
    return temporal.coverage_summary(clicks(spark, folder), property_changes(spark, folder), category_tree(spark, folder), DIGITS)


# ---------------------------------------------------------------- value grammar

VALUES = """vals AS (
  SELECT CAST(p_size AS BIGINT) AS timestamp, p_partkey AS itemid, unnest([p_brand, p_brand, p_type, p_type, 'categoryid', 'available', 'raw_' || p_type, 'raw_' || p_type]) AS property,
    unnest([CAST(p_partkey AS VARCHAR), printf('n%.3f', p_retailprice), concat(p_partkey, ' ', p_size),
      concat(p_partkey, ' ', printf('n%.3f', p_retailprice)), CAST(p_size AS VARCHAR), CAST(p_partkey % 2 AS VARCHAR),
      concat('n', p_size), p_brand]) AS value FROM part),
tok AS (SELECT vals.*, list_filter(string_split_regex(coalesce(value, ''), '\\s+'), lambda x: x <> '') AS toks FROM vals),
counted AS (SELECT *, CAST(len(toks) AS INTEGER) AS token_count,
  CAST(len(list_filter(toks, lambda x: regexp_full_match(x, 'n-?[0-9]+\\.[0-9]{3}'))) AS INTEGER) AS encoded_numeric_tokens,
  CAST(len(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, 'Brand#[0-9]+'))) AS INTEGER) AS plain_hash_tokens FROM tok),
classified AS (SELECT *, token_count > 1 AS is_multitoken, CASE WHEN property = 'categoryid' THEN 'special_categoryid' WHEN property = 'available' THEN 'special_available'
  WHEN encoded_numeric_tokens > 0 AND plain_hash_tokens > 0 THEN 'mixed_hashed_text_and_numeric'
  WHEN plain_hash_tokens = token_count AND token_count > 1 THEN 'multi_hashed_text_tokens'
  WHEN plain_hash_tokens = token_count AND token_count = 1 THEN 'single_hashed_text_token'
  WHEN encoded_numeric_tokens = token_count THEN 'encoded_numeric_only' ELSE 'other_or_unexpected' END AS value_grammar FROM counted)"""
TOKENS = VALUES + """,
rows AS (SELECT property, value_grammar, unnest(toks) AS token FROM classified),
tokens AS (SELECT *, CASE WHEN regexp_full_match(lower(token), 'n-?[0-9]+\\.[0-9]{3}') THEN 'encoded_numeric_token'
  WHEN regexp_full_match(token, '[0-9]+') THEN 'hashed_text_token'
  WHEN regexp_full_match(lower(token), 'n-?[0-9]+(\\.[0-9]+)?') THEN 'numeric_token_variant' ELSE 'unexpected_token' END AS token_type FROM rows)"""


def _values(spark, folder):
    return grammar.classify_values(part_values(spark, folder))


def _tokens(spark, folder):
    return grammar.value_token_rows(_values(spark, folder))


@query(
    "value_grammar",
    f"WITH {VALUES} SELECT itemid, property, value, token_count, encoded_numeric_tokens, plain_hash_tokens, value_grammar FROM classified",
)
def _(spark, folder):
    return _values(spark, folder).select("itemid", "property", "value", "token_count", "encoded_numeric_tokens", "plain_hash_tokens", "value_grammar")


@query(
    "grammar_summary",
    f"""WITH {VALUES} SELECT value_grammar, count(*) AS rows, count(DISTINCT property) AS properties, count(DISTINCT itemid) AS items,
    round(avg(token_count), 6) AS avg_tokens, round(100e0 * count(*) / (SELECT count(*) FROM classified), 6) AS pct FROM classified GROUP BY 1""",
)
def _(spark, folder):
    return grammar.grammar_summary(_values(spark, folder), DIGITS)


@query(
    "token_types",
    f"""WITH {TOKENS} SELECT token_type, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, count(DISTINCT property) AS properties,
    round(100e0 * count(*) / (SELECT count(*) FROM tokens), 6) AS pct FROM tokens GROUP BY 1""",
)
def _(spark, folder):
    return grammar.token_summary(_tokens(spark, folder), DIGITS)


@query(
    "top_tokens",
    f"""WITH {TOKENS}, c AS (SELECT token_type, token, count(*) AS frequency FROM tokens GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY token_type ORDER BY frequency DESC, token) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""",
)
def _(spark, folder):
    return grammar.top_tokens(_tokens(spark, folder))


@query(
    "decoded_numbers",
    f"""WITH {TOKENS} SELECT property, count(*) AS tokens, round(sum(CAST(substr(token, 2) AS DOUBLE)), 3) AS total FROM tokens
    WHERE token_type = 'encoded_numeric_token' GROUP BY 1""",
)
def _(spark, folder):
    numbers = _tokens(spark, folder).filter("token_type = 'encoded_numeric_token'")
    return numbers.groupBy("property").agg(F.count("*").alias("tokens"), F.round(F.sum("number"), 3).alias("total"))


PROFILE = VALUES + """,
g AS (SELECT property, value_grammar, count(*) AS n FROM classified GROUP BY 1, 2),
best AS (SELECT property, value_grammar AS dominant_format, round(100e0 * n / sum(n) OVER (PARTITION BY property), 6) AS dominant_pct FROM g
  QUALIFY row_number() OVER (PARTITION BY property ORDER BY n DESC, value_grammar) = 1),
ex AS (SELECT property, string_agg(value, ' | ' ORDER BY value) AS examples FROM (SELECT property, value FROM (SELECT DISTINCT property, value FROM classified)
  QUALIFY row_number() OVER (PARTITION BY property ORDER BY value) <= 5) GROUP BY 1),
profile AS (SELECT property, count(*) AS rows, count(DISTINCT itemid) AS items, count(DISTINCT value) AS distinct_values, round(avg(token_count), 6) AS avg_tokens,
  round(100e0 * count(*) FILTER (is_multitoken) / count(*), 6) AS multitoken_pct,
  round(100e0 * count(*) FILTER (encoded_numeric_tokens > 0) / count(*), 6) AS encoded_numeric_pct,
  round(100e0 * count(*) FILTER (plain_hash_tokens > 0) / count(*), 6) AS plain_hash_pct, min(timestamp) AS first_ms, max(timestamp) AS last_ms,
  round(CAST(count(DISTINCT value) AS DOUBLE) / count(*), 6) AS values_per_row, any_value(dominant_format) AS dominant_format, any_value(dominant_pct) AS dominant_pct,
  any_value(examples) AS examples FROM classified JOIN best USING (property) JOIN ex USING (property) GROUP BY 1),
held AS (SELECT property, itemid, count(DISTINCT value) AS held FROM vals GROUP BY 1, 2),
changed AS (SELECT property, count(*) AS pairs, round(100e0 * count(*) FILTER (held > 1) / count(*), 6) AS changed_pct FROM held GROUP BY 1)"""


@query("property_profile", f"WITH {PROFILE} SELECT * FROM profile")
def _(spark, folder):
    return grammar.property_profile(_values(spark, folder), DIGITS)


@query(
    "stability",
    f"""WITH {q.CHANGES}, held AS (SELECT property, itemid, count(DISTINCT value) AS held FROM changes GROUP BY 1, 2)
    SELECT property, count(*) AS pairs, round(100e0 * count(*) FILTER (held > 1) / count(*), 6) AS changed_pct FROM held GROUP BY 1""",
)
def _(spark, folder):
    return grammar.stability(property_changes(spark, folder), DIGITS)


@query(
    "candidate_features",
    f"""WITH {PROFILE}, told AS (
      SELECT property, dominant_format, changed_pct, values_per_row,
        CASE WHEN property = 'categoryid' THEN 'tree_key' WHEN property = 'available' THEN 'flag'
          WHEN dominant_format = 'encoded_numeric_only' THEN 'number' WHEN dominant_format = 'single_hashed_text_token' THEN 'code'
          WHEN dominant_format = 'multi_hashed_text_tokens' THEN 'code_set'
          WHEN dominant_format = 'mixed_hashed_text_and_numeric' THEN 'code_set_and_number' ELSE 'unread' END AS reading,
        CASE WHEN property = 'available' OR changed_pct > 10 THEN 'high' WHEN values_per_row > 0.5 THEN 'medium' ELSE 'low' END AS leakage_risk
      FROM profile JOIN changed USING (property))
    SELECT *, CASE reading WHEN 'tree_key' THEN 'join' WHEN 'flag' THEN 'filter' WHEN 'number' THEN 'scale' WHEN 'code' THEN 'encode'
      WHEN 'code_set' THEN 'embed' WHEN 'code_set_and_number' THEN 'split' ELSE 'inspect' END AS potential_use FROM told""",
)
def _(spark, folder):
    values = _values(spark, folder)
    rows = grammar.candidate_features(grammar.property_profile(values, DIGITS), grammar.stability(values, DIGITS))
    return rows.select("property", "dominant_format", "changed_pct", "values_per_row", "reading", "leakage_risk", "potential_use")


@query(
    "property_crosstab",
    f"""WITH {PROFILE} SELECT property, """
    + ", ".join(
        f"count(*) FILTER (value_grammar = '{name}') AS {name}"
        for name in "special_categoryid special_available mixed_hashed_text_and_numeric multi_hashed_text_tokens single_hashed_text_token encoded_numeric_only other_or_unexpected".split()
    )
    + " FROM classified GROUP BY property",
)
def _(spark, folder):
    return grammar.grammar_crosstab(_values(spark, folder))


@query(
    "special_properties",
    f"""WITH {q.CHANGES}, {q.TREE}, c AS (SELECT CAST(value AS BIGINT) AS categoryid FROM changes WHERE property = 'categoryid'),
    a AS (SELECT value FROM changes WHERE property = 'available')
    SELECT 'category_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'categories', count(DISTINCT categoryid) FROM c
    UNION ALL SELECT 'category_in_tree_pct', round(100e0 * count(*) FILTER (categoryid IN (SELECT categoryid FROM tree)) / count(*), 6) FROM c
    UNION ALL SELECT 'available_rows', count(*) FROM a
    UNION ALL SELECT 'available_0_pct', round(100e0 * count(*) FILTER (value = '0') / count(*), 6) FROM a
    UNION ALL SELECT 'available_1_pct', round(100e0 * count(*) FILTER (value = '1') / count(*), 6) FROM a""",
)
def _(spark, folder):
    return grammar.special_properties(property_changes(spark, folder), category_tree(spark, folder), DIGITS)


@query(
    "value_frequencies",
    f"""WITH {q.CHANGES} SELECT property, value, count(*) AS n FROM changes GROUP BY 1, 2""",
)
def _(spark, folder):
    return property_changes(spark, folder).groupBy("property", "value").agg(F.count("*").alias("n"))
