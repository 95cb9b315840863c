"""SQL fragments shared by the check queries."""

from __future__ import annotations

RAW = """raw AS (
  SELECT epoch_us(ts) // 1000 AS timestamp, user_id AS visitorid,
         CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS itemid,
         CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid, event_id
  FROM events)"""
EV = RAW + """,
ev AS (SELECT * FROM raw WHERE event IN ('view', 'addtocart', 'transaction'))"""
OL = """ol AS (
  SELECT epoch_us(o_orderdate) // 1000 AS timestamp, o_custkey AS visitorid,
         CASE l_returnflag WHEN 'A' THEN 'addtocart' WHEN 'R' THEN 'transaction' ELSE 'view' END AS event,
         l_partkey AS itemid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CHANGES = """changes AS (
  SELECT epoch_us(ts) // 1000 AS timestamp, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS itemid,
         CASE WHEN event_type = 'signup' THEN 'categoryid' ELSE 'available' END AS property,
         CAST(CAST(floor(value) AS BIGINT) % CASE WHEN event_type = 'signup' THEN 25 ELSE 2 END AS VARCHAR) AS value,
         event_id AS change_id
  FROM events WHERE event_type IN ('signup', 'error'))"""
TREE = """tree AS (SELECT CAST(n_nationkey AS BIGINT) AS categoryid, CAST(n_regionkey AS BIGINT) AS parentid FROM nation)"""
GAPS = """gaps AS (
  SELECT *, lag(timestamp) OVER w AS previous_timestamp, lag(event) OVER w AS previous_event,
         (timestamp - lag(timestamp) OVER w) / 60000e0 AS minutes
  FROM ev WINDOW w AS (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id))"""
NEXT = """following AS (
  SELECT *, lead(event) OVER w AS next_event, lead(itemid) OVER w AS next_itemid, lead(timestamp) OVER w AS next_timestamp
  FROM ev WINDOW w AS (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id))"""
PAIRS = """pairs AS (
  SELECT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id, min(timestamp) AS timestamp
  FROM ev GROUP BY 1, 2)"""
OPAIRS = """pairs AS (
  SELECT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id, min(timestamp) AS timestamp
  FROM ol GROUP BY 1, 2)"""
SPLIT3 = """numbered AS (
  SELECT *, row_number() OVER (ORDER BY timestamp, user_id, item_id) - 1 AS pos, count(*) OVER () AS n FROM pairs),
sized AS (SELECT *, greatest(1, floor(n * 0.15e0)) AS held FROM numbered),
split AS (
  SELECT user_id, item_id, timestamp,
         CASE WHEN pos < greatest(1, n - 2 * held) THEN 'train'
              WHEN pos < greatest(1, n - 2 * held) + held THEN 'validation' ELSE 'test' END AS split
  FROM sized),
train AS (SELECT user_id, item_id, timestamp FROM split WHERE split = 'train'),
truth AS (
  SELECT user_id, item_id FROM split WHERE split = 'test'
  AND user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)),
users AS (SELECT DISTINCT user_id FROM truth)"""
HOLDOUT = f"{EV},\n{PAIRS},\n{SPLIT3}"
OHOLDOUT = f"{OL},\n{OPAIRS},\n{SPLIT3}"
WEIGHT = "CASE event WHEN 'view' THEN 1e0 WHEN 'addtocart' THEN 3e0 WHEN 'transaction' THEN 5e0 ELSE 0e0 END"


def draw(seed: int, *parts: str) -> str:
    """The 60-bit md5 draw over seed and parts."""
    text = "concat_ws('|', " + ", ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)]) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def popular(source: str, k: int) -> str:
    """Top k items of a pair table for every user of ``users``."""
    return f"""counts AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM {source} GROUP BY 1),
top AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM counts),
recs AS (SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM users CROSS JOIN top WHERE rank <= {k})"""


def metric_ctes(ks: tuple[int, ...]) -> str:
    """Per-user metrics of ``recs`` against ``truth``."""
    grid = ", ".join(f"({k})" for k in ks)
    return f"""grid(k) AS (VALUES {grid}),
hits AS (
  SELECT r.user_id, r.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM (SELECT user_id, item_id, min(rank) AS rank FROM recs GROUP BY 1, 2) r
  LEFT JOIN (SELECT DISTINCT user_id, item_id FROM truth) t USING (user_id, item_id)),
running AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS seen_hits FROM hits),
relevant AS (SELECT user_id, count(DISTINCT item_id) AS relevant FROM truth GROUP BY 1),
ideal AS (
  SELECT CAST(n AS BIGINT) AS n, sum(1e0 / log2(n + 1)) OVER (ORDER BY n) AS gain FROM range(1, {max(ks) + 1}) t(n)),
per_user AS (
  SELECT user_id, k, CAST(sum(hit) AS DOUBLE) / k AS precision, CAST(sum(hit) AS DOUBLE) / relevant AS recall,
         sum(hit / log2(rank + 1e0)) / any_value(gain) AS ndcg,
         sum(CASE WHEN hit = 1 THEN seen_hits / CAST(rank AS DOUBLE) ELSE 0 END) / least(relevant, k) AS map,
         CAST(max(hit) AS DOUBLE) AS hit_rate
  FROM grid JOIN running ON rank <= k JOIN relevant USING (user_id) JOIN ideal ON n = least(relevant, k)
  GROUP BY user_id, k, relevant)"""
