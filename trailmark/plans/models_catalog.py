"""Registered queries: splits, encoding, sampling, recommenders, metrics and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.models import ease, latent, logistic, neighbours, neural, pairwise, simple
from trailmark.models.common import ITEM, USER
from trailmark.operators import cleaning, encoding, profiling, ranking_metrics, sampling, splits
from trailmark.plans import comparison, stages
from trailmark.plans import sql as q
from trailmark.plans.registry import query
from trailmark.sources.driver_tables import clicks, purchases, table
from trailmark.storage import materialise

DIGITS = 6
KS = (5, 10, 20)
MODELS_AT_ONCE = 2  # models that share the driver: each adds its plans, threads and buffers to the driver's memory
PAIR_ORDER = ["timestamp", USER, ITEM]
EVENT_ORDER = ["timestamp", "visitorid", "itemid", "event", "event_id"]


def event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.load_pairs(clicks(spark, folder))


def order_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.load_pairs(purchases(spark, folder))


def holdout(spark: SparkSession, folder: str, orders: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, warm truth and the users to serve, each stored once."""
    source = purchases(spark, folder) if orders else clicks(spark, folder)
    pairs = materialise(cleaning.load_pairs(source), "pairs")
    split = materialise(splits.split_three_way(pairs, PAIR_ORDER), "split", replaces=pairs)
    train = splits.part(split, "train")
    truth = materialise(splits.warm_truth(train, splits.part(split, "test")), "truth")
    return train, truth, truth.select(USER).distinct()


def rounded(recommendations: DataFrame) -> DataFrame:
    return recommendations.select(USER, ITEM, F.round("score", DIGITS).alias("score"), F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- splits


@query(
    "split_positional",
    f"""WITH {q.EV}, p AS (SELECT event_id, row_number() OVER (ORDER BY timestamp, visitorid, itemid, event, event_id) - 1 AS pos, count(*) OVER () AS n FROM ev),
    b AS (SELECT *, greatest(1, floor(n * 0.7e0)) AS te FROM p), c AS (SELECT *, least(greatest(te + 1, floor(n * (0.7e0 + 0.15e0))), n - 1) AS ve FROM b)
    SELECT event_id, CASE WHEN pos < te THEN 'train' WHEN pos < ve THEN 'validation' ELSE 'test' END AS split FROM c""",
)
def _(spark, folder):
    return splits.split_positional(clicks(spark, folder), EVENT_ORDER).select("event_id", "split")


@query(
    "split_holdout",
    f"""WITH {q.EV}, p AS (SELECT event_id, row_number() OVER (ORDER BY timestamp, visitorid, itemid, event, event_id) - 1 AS pos, count(*) OVER () AS n FROM ev)
    SELECT event_id, CASE WHEN pos < n - greatest(1, floor(n * 0.15e0)) THEN 'train' ELSE 'test' END AS split FROM p""",
)
def _(spark, folder):
    return splits.split_holdout(clicks(spark, folder), EVENT_ORDER).select("event_id", "split")


@query("split_three_way", f"WITH {q.HOLDOUT} SELECT user_id, item_id, timestamp, split FROM split")
def _(spark, folder):
    return splits.split_three_way(event_pairs(spark, folder), PAIR_ORDER)


@query("split_three_way_orders", f"WITH {q.OHOLDOUT} SELECT user_id, item_id, timestamp, split FROM split")
def _(spark, folder):
    return splits.split_three_way(materialise(order_pairs(spark, folder), "pairs"), PAIR_ORDER)


@query(
    "split_repeated_rows",
    f"""WITH {q.OL}, p AS (SELECT *, row_number() OVER (ORDER BY timestamp, visitorid, itemid) - 1 AS pos, count(*) OVER () AS n FROM ol)
    SELECT timestamp, visitorid, itemid, count(*) AS rows, count(*) FILTER (pos < n - greatest(1, floor(n * 0.15e0))) AS train_rows FROM p GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    rows = materialise(purchases(spark, folder).select("timestamp", "visitorid", "itemid"), "rows")
    split = splits.split_holdout(rows, ["timestamp", "visitorid", "itemid"])
    return split.groupBy("timestamp", "visitorid", "itemid").agg(
        F.count("*").alias("rows"), F.count_if(F.col("split") == "train").alias("train_rows")
    )


RANGE = """b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM ev),
ranged AS (SELECT ev.*, CASE WHEN timestamp < lo + (hi - lo) * 0.7e0 THEN 'train'
  WHEN timestamp < (lo + (hi - lo) * 0.7e0) + (hi - lo) * 0.15e0 THEN 'validation' ELSE 'test' END AS split FROM ev CROSS JOIN b)"""


@query("split_time_range", f"WITH {q.EV}, {RANGE} SELECT event_id, split FROM ranged")
def _(spark, folder):
    return splits.split_time_range(clicks(spark, folder)).select("event_id", "split")


@query(
    "split_user_tail",
    f"""WITH {q.EV}, p AS (SELECT event_id, row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, event_id) AS nth,
      count(*) OVER (PARTITION BY visitorid) AS n FROM ev)
    SELECT event_id, CASE WHEN nth > n - greatest(1, floor(n * 0.2e0)) THEN 'validation' ELSE 'train' END AS split FROM p""",
)
def _(spark, folder):
    return splits.split_user_tail(clicks(spark, folder), ["timestamp", "event_id"]).select("event_id", "split")


@query(
    "split_summary",
    f"""WITH {q.EV}, {RANGE} SELECT split, min(timestamp) AS start_ms, max(timestamp) AS end_ms, count(*) AS events,
    count(DISTINCT visitorid) AS users, count(DISTINCT itemid) AS items FROM ranged GROUP BY 1""",
)
def _(spark, folder):
    return splits.split_summary(splits.split_time_range(clicks(spark, folder)))


@query("split_cutoffs", f"WITH {q.HOLDOUT} SELECT split, max(timestamp) AS cutoff FROM split WHERE split <> 'test' GROUP BY 1")
def _(spark, folder):
    return splits.cutoffs(splits.split_three_way(event_pairs(spark, folder), PAIR_ORDER))


@query("warm_truth", f"WITH {q.OHOLDOUT} SELECT * FROM truth")
def _(spark, folder):
    return holdout(spark, folder, orders=True)[1]


@query(
    "evaluable_truth",
    f"""WITH {q.EV}, {RANGE}, tr AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ranged WHERE split = 'train'),
    te AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ranged WHERE split = 'test')
    SELECT user_id, item_id FROM te WHERE user_id IN (SELECT user_id FROM tr) AND item_id IN (SELECT item_id FROM tr)
    AND (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM tr)""".replace("(SELECT (user_id, item_id) FROM tr)", "(SELECT user_id, item_id FROM tr)"),
)
def _(spark, folder):
    split = splits.split_time_range(clicks(spark, folder))
    named = split.select(F.col("visitorid").cast("string").alias(USER), F.col("itemid").cast("string").alias(ITEM), "split")
    return splits.evaluable_truth(splits.part(named, "train"), splits.part(named, "test"))


WEIGHTED_TRUTH = f"""wt AS (SELECT split, visitorid, itemid, sum({q.WEIGHT}) AS weight FROM ranged WHERE split <> 'train' GROUP BY 1, 2, 3),
gt AS (SELECT * FROM wt WHERE weight >= {{min}} AND visitorid IN (SELECT visitorid FROM ranged WHERE split = 'train')
  AND itemid IN (SELECT itemid FROM ranged WHERE split = 'train'))"""


@query("weighted_truth", f"WITH {q.EV}, {RANGE}, {WEIGHTED_TRUTH.format(min=3)} SELECT visitorid, itemid, weight FROM gt WHERE split = 'test'")
def _(spark, folder):
    split = splits.split_time_range(clicks(spark, folder))
    return splits.weighted_truth(splits.part(split, "train"), splits.part(split, "test"), 3)


@query(
    "truth_summary",
    f"""WITH {q.EV}, {RANGE}, {WEIGHTED_TRUTH.format(min=1)}, u AS (SELECT split, visitorid, count(*) AS n FROM gt GROUP BY 1, 2)
    SELECT split, count(*) AS users, round(avg(n), 6) AS avg_items FROM u GROUP BY 1""",
)
def _(spark, folder):
    split = splits.split_time_range(clicks(spark, folder))
    train = splits.part(split, "train")
    return splits.truth_summary({p: splits.weighted_truth(train, splits.part(split, p)) for p in ("validation", "test")})


@query(
    "cold_warm",
    f"""WITH {q.OL}, cut AS (SELECT min(timestamp) + (max(timestamp) - min(timestamp)) * 0.1e0 AS c FROM ol),
    tr AS (SELECT DISTINCT visitorid FROM ol, cut WHERE timestamp < c), te AS (SELECT DISTINCT visitorid FROM ol, cut WHERE timestamp >= c)
    SELECT count(*) FILTER (visitorid IN (SELECT visitorid FROM tr)) AS warm_users,
      count(*) FILTER (visitorid NOT IN (SELECT visitorid FROM tr)) AS cold_users, count(*) AS users,
      round(100e0 * count(*) FILTER (visitorid IN (SELECT visitorid FROM tr)) / count(*), 6) AS warm_pct FROM te""",
)
def _(spark, folder):
    split = splits.split_time_range(purchases(spark, folder), 0.1, 0.9)
    return splits.warm_cold_users(splits.part(split, "train"), split.filter("split <> 'train'"), digits=DIGITS)


@query("first_users", f"WITH {q.HOLDOUT} SELECT * FROM truth WHERE user_id IN (SELECT user_id FROM users ORDER BY user_id LIMIT 40)")
def _(spark, folder):
    return splits.first_users(holdout(spark, folder)[1], 40)


# ---------------------------------------------------------------- encoding and sampling

ENCODED = f"""{q.EV}, ids AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS id FROM ev), uid AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM ids),
iids AS (SELECT DISTINCT CAST(itemid AS VARCHAR) AS id FROM ev), iid AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM iids),
enc AS (SELECT event_id, timestamp, u.idx AS user_index, i.idx AS item_index FROM ev JOIN uid u ON u.id = CAST(visitorid AS VARCHAR) JOIN iid i ON i.id = CAST(itemid AS VARCHAR)),
seen AS (SELECT DISTINCT user_index, item_index FROM enc), catalogue AS (SELECT count(*) AS n FROM iid)"""


@query("encode_ids", f"WITH {ENCODED} SELECT event_id, user_index, item_index FROM enc")
def _(spark, folder):
    return encoding.encode_ids(clicks(spark, folder))[0].select("event_id", "user_index", "item_index")


@query("id_table_orders", f"WITH {q.OL}, d AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS id FROM ol) SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM d")
def _(spark, folder):
    return encoding.id_table(purchases(spark, folder), "visitorid")


@query("entity_counts", f"WITH {q.OL} SELECT count(DISTINCT visitorid) AS users, count(DISTINCT itemid) AS items FROM ol")
def _(spark, folder):
    rows = purchases(spark, folder)
    return encoding.entity_counts(encoding.id_table(rows, "visitorid"), encoding.id_table(rows, "itemid"))


@query("decode_ids", f"WITH {q.EV} SELECT event_id, CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ev")
def _(spark, folder):
    encoded, users, items = encoding.encode_ids(clicks(spark, folder))
    rows = encoded.select("event_id", "user_index", "item_index")
    return encoding.decode(encoding.decode(rows, users, "user_index", USER), items, "item_index", ITEM)


def _seen(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    encoded, users, items = encoding.encode_ids(clicks(spark, folder))
    return materialise(sampling.seen_items(encoded), "seen"), users.count(), items.count()


PER_USER = f"""free AS (SELECT user_index, (SELECT n FROM catalogue) - count(*) AS free FROM seen GROUP BY 1),
draws AS (SELECT user_index, CAST(d AS INTEGER) AS draw, {q.draw(42, 'user_index', 'd')} % free AS r FROM free CROSS JOIN range(1, 5) t(d) WHERE free > 0),
unseen AS (SELECT user_index, idx, row_number() OVER (PARTITION BY user_index ORDER BY idx) - 1 AS pos
  FROM free CROSS JOIN iid WHERE (user_index, idx) NOT IN (SELECT user_index, item_index FROM seen)),
negatives AS (SELECT d.user_index, d.draw, u.idx AS item_index FROM draws d JOIN unseen u ON u.user_index = d.user_index AND u.pos = d.r)"""


@query("negatives_per_user", f"WITH {ENCODED}, {PER_USER} SELECT * FROM negatives")
def _(spark, folder):
    seen, _, items = _seen(spark, folder)
    return sampling.negatives_per_user(seen, items)


@query(
    "labelled_pairs",
    f"""WITH {ENCODED}, {PER_USER}, rows AS (SELECT user_index, item_index, CAST(1 AS FLOAT) AS label FROM seen
      UNION ALL SELECT user_index, item_index, CAST(0 AS FLOAT) FROM negatives)
    SELECT user_index, item_index, label, count(*) AS n FROM rows GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    seen, _, items = _seen(spark, folder)
    return sampling.labelled_pairs(seen, items).groupBy("user_index", "item_index", "label").agg(F.count("*").alias("n"))


@query(
    "pairwise_triplets",
    f"""WITH {ENCODED}, d AS (SELECT user_index, item_index AS positive_index, t, {q.draw(42, 'user_index', 'item_index', 't')} % (SELECT n FROM catalogue) AS negative_index
      FROM seen CROSS JOIN range(1, 41) r(t)),
    k AS (SELECT * FROM d WHERE (user_index, negative_index) NOT IN (SELECT user_index, item_index FROM seen))
    SELECT user_index, positive_index, negative_index, CAST(row_number() OVER (PARTITION BY user_index, positive_index ORDER BY t) AS INTEGER) AS draw
    FROM k QUALIFY draw <= 4""",
)
def _(spark, folder):
    seen, _, items = _seen(spark, folder)
    return sampling.negatives_bounded(seen, items)


@query(
    "random_negatives",
    f"""WITH {ENCODED}, sizes AS (SELECT (SELECT count(*) FROM uid) AS nu, (SELECT n FROM catalogue) AS ni, (SELECT count(*) FROM seen) AS np),
    d AS (SELECT t AS draw, {q.draw(42, "'user'", 't')} % nu AS user_index, {q.draw(42, "'item'", 't')} % ni AS item_index FROM sizes CROSS JOIN range(1, 400001) r(t) WHERE t <= 10 * np)
    SELECT draw, user_index, item_index FROM d WHERE (user_index, item_index) NOT IN (SELECT user_index, item_index FROM seen) ORDER BY draw LIMIT (SELECT np FROM sizes)""",
)
def _(spark, folder):
    seen, users, items = _seen(spark, folder)
    return sampling.random_negatives(seen, users, items, seen.count())


def _permuted_sql(x: str) -> str:
    """Four rounds that add a draw over one half of x = left * b + right to the other."""
    left, right = f"({x} // b)", f"({x} % b)"
    for turn in range(4):
        if turn % 2 == 0:
            left = f"(({left} + {q.draw(42, 'user_index', str(turn), right)}) % a)"
        else:
            right = f"(({right} + {q.draw(42, 'user_index', str(turn), left)}) % b)"
    return f"({left} * b + {right})"


def _negatives_sql(name: str, positives: str) -> str:
    """CTEs that end in ``name`` (user_index, item_index): four distinct unseen items per row of ``positives``."""
    return f"""{name}_seen AS (SELECT DISTINCT user_index, item_index FROM {positives}),
{name}_wish AS (SELECT user_index, free, least(rows * 4, free) AS want, a, (free + a - 1) // a AS b FROM (
  SELECT *, CAST(ceil(sqrt(CAST(free AS DOUBLE))) AS BIGINT) AS a FROM (
    SELECT user_index, count(*) AS rows, (SELECT n FROM catalogue) - count(DISTINCT item_index) AS free FROM {positives} GROUP BY 1) WHERE free > 0)),
{name}_walk AS (WITH RECURSIVE walk AS (
  SELECT user_index, free, a, b, {_permuted_sql('j')} AS x FROM (SELECT *, unnest(generate_series(0, want - 1)) AS j FROM {name}_wish)
  UNION ALL SELECT user_index, free, a, b, {_permuted_sql('x')} FROM walk WHERE x >= free) SELECT * FROM walk),
{name}_free AS (SELECT user_index, idx, row_number() OVER (PARTITION BY user_index ORDER BY idx) - 1 AS pos
  FROM {name}_wish CROSS JOIN iid WHERE (user_index, idx) NOT IN (SELECT user_index, item_index FROM {name}_seen)),
{name} AS (SELECT w.user_index, f.idx AS item_index FROM {name}_walk w JOIN {name}_free f ON f.user_index = w.user_index AND f.pos = w.x WHERE w.x < w.free)"""


@query("negatives_per_positive", f"WITH {ENCODED}, {_negatives_sql('drawn', 'seen')} SELECT * FROM drawn")
def _(spark, folder):
    seen, _, items = _seen(spark, folder)
    return sampling.negatives_per_positive(seen, items)


@query(
    "label_tables",
    f"""WITH {ENCODED}, tail AS (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY timestamp, event_id) AS nth, count(*) OVER (PARTITION BY user_index) AS n FROM enc),
    parts AS (SELECT user_index, item_index, CASE WHEN nth > n - greatest(1, floor(n * 0.2e0)) THEN 'validation' ELSE 'train' END AS split FROM tail),
    tr AS (SELECT user_index, item_index FROM parts WHERE split = 'train'), va AS (SELECT user_index, item_index FROM parts WHERE split = 'validation'),
    {_negatives_sql('tr_drawn', 'tr')}, {_negatives_sql('va_drawn', 'va')}
    SELECT user_index, item_index, CAST(1 AS INTEGER) AS label, split FROM parts
    UNION ALL SELECT user_index, item_index, 0, 'train' FROM tr_drawn UNION ALL SELECT user_index, item_index, 0, 'validation' FROM va_drawn""",
)
def _(spark, folder):
    encoded, _, items = encoding.encode_ids(clicks(spark, folder))
    count = items.count()
    train, validation = sampling.label_tables(materialise(encoded, "encoded"), count, order=("timestamp", "event_id"))
    return train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))


@query(
    "one_hot_pairs",
    f"""WITH {ENCODED}, sizes AS (SELECT (SELECT count(*) FROM uid) AS nu, (SELECT count(*) FROM iid) AS ni)
    SELECT user_index, item_index, concat('(', nu + ni, ',[', user_index, ',', nu + item_index, '],[1.0,1.0])') AS features FROM seen CROSS JOIN sizes""",
)
def _(spark, folder):
    seen, users, items = _seen(spark, folder)
    return encoding.one_hot_pairs(seen).select("user_index", "item_index", F.col("features").cast("string").alias("features"))


# ---------------------------------------------------------------- recommenders


@query("reco_popularity", f"WITH {q.HOLDOUT},\n{q.popular('train', 10)} SELECT * FROM recs")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(simple.popularity(train, users, 10))


UNSEEN_TOP = """ranked AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM users CROSS JOIN totals WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM {seen}))"""


@query(
    "reco_popularity_unseen",
    f"""WITH {q.OHOLDOUT}, totals AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), {UNSEEN_TOP.format(seen='train')}
    SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
)
def _(spark, folder):
    train, _, users = holdout(spark, folder, orders=True)
    return rounded(simple.popularity(train, users, 10, exclude_seen=True))


EVENT_WEIGHTS_SQL = f"""{q.EV}, {RANGE}, w AS (SELECT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id,
  least(sum({q.WEIGHT}), 50e0) AS weight FROM ranged WHERE split = 'train' GROUP BY 1, 2),
users AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id FROM ranged WHERE split = 'test'),
totals AS (SELECT item_id, sum(weight) AS score FROM w GROUP BY 1)"""


def train_weights(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Clipped weights of the training range and the users of the test range."""
    split = splits.split_time_range(clicks(spark, folder))
    weights = profiling.interaction_weights(splits.part(split, "train"))
    named = weights.select(F.col("visitorid").cast("string").alias(USER), F.col("itemid").cast("string").alias(ITEM), "weight")
    users = splits.part(split, "test").select(F.col("visitorid").cast("string").alias(USER)).distinct()
    return materialise(named, "weights"), materialise(users, "users")


@query(
    "reco_most_popular",
    f"""WITH {EVENT_WEIGHTS_SQL}, {UNSEEN_TOP.format(seen='w')}, have AS (SELECT u.user_id, count(r.item_id) AS n FROM users u LEFT JOIN ranked r ON r.user_id = u.user_id AND r.rank <= 60 GROUP BY 1),
    top AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS place FROM totals)
    SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 60
    UNION ALL SELECT user_id, item_id, score, CAST(n + place AS INTEGER) FROM have CROSS JOIN top WHERE n + place <= 60""",
)
def _(spark, folder):
    weights, users = train_weights(spark, folder)
    return rounded(simple.most_popular(weights, users, 60))


@query(
    "reco_recent",
    f"""WITH {q.HOLDOUT}, last AS (SELECT item_id, max(timestamp) AS t FROM train GROUP BY 1),
    top AS (SELECT item_id, t, row_number() OVER (ORDER BY t DESC, item_id) AS rank FROM last)
    SELECT user_id, item_id, CAST(t AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM users CROSS JOIN top WHERE rank <= 10""",
)
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(simple.recent_items(train, users, 10))


@query(
    "reco_random",
    f"""WITH {q.OHOLDOUT}, items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM train)),
p AS (WITH RECURSIVE p AS (SELECT user_id, 0 AS j, CAST([] AS BIGINT[]) AS drawn FROM users UNION ALL
      SELECT user_id, j, list_append(drawn, r + len(list_filter(list_sort(drawn), lambda s, i: s - (i - 1) <= r))) FROM (
        SELECT user_id, j + 1 AS j, drawn, {q.draw(42, 'user_id', 'j + 1')} % ((SELECT max(n) FROM items) - j) AS r FROM p WHERE j < 5))
      SELECT * FROM p)
    SELECT user_id, item_id, 0e0 AS score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT user_id, unnest(drawn) AS idx, generate_subscripts(drawn, 1) AS rank FROM p WHERE j = 5) JOIN items USING (idx)""",
)
def _(spark, folder):
    train, _, users = holdout(spark, folder, orders=True)
    return rounded(simple.random_items(train, users, 5))


def _knn_sql(head: str, weighted: bool, others: int, k: int) -> str:
    base = "w" if weighted else "hist"
    source = "" if weighted else "hist AS (SELECT DISTINCT user_id, item_id, 1e0 AS weight FROM train),"
    score = "CAST(sum(CAST(floor(o.weight * n.sim * 1e9 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e9" if weighted else "CAST(count(*) AS DOUBLE)"
    fallback = (
        "SELECT user_id, item_id, score, rank FROM (" + "SELECT u.user_id, t.item_id, t.score, row_number() OVER (PARTITION BY u.user_id ORDER BY t.score DESC, t.item_id) AS rank "
        "FROM users u CROSS JOIN totals t WHERE u.user_id NOT IN (SELECT user_id FROM best) AND (u.user_id, t.item_id) NOT IN (SELECT user_id, item_id FROM w))"
        if weighted
        else "SELECT user_id, item_id, score, rank FROM recs_pop WHERE user_id NOT IN (SELECT user_id FROM hist)"
    )
    popular = "" if weighted else (
        "pc AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1),"
        "pt AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pc),"
        "recs_pop AS (SELECT user_id, item_id, score, rank FROM users CROSS JOIN pt),"
    )
    return f"""WITH {head}, {source} {popular}
    norm AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM {base} GROUP BY 1),
    dots AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.weight * b.weight) AS dot FROM {base} a JOIN {base} b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
    sims AS (SELECT i, j, floor(dot / (ni.norm * nj.norm) * 1e12 + 0.5e0) / 1e12 AS sim
      FROM dots JOIN norm ni ON ni.item_id = i JOIN norm nj ON nj.item_id = j),
    near AS (SELECT i, j, sim FROM sims QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= {others}),
    own AS (SELECT * FROM {base} WHERE user_id IN (SELECT user_id FROM users)),
    scores AS (SELECT o.user_id, n.j AS item_id, {score} AS score FROM own o JOIN near n ON n.i = o.item_id GROUP BY 1, 2),
    fresh AS (SELECT * FROM scores WHERE score > 0 AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM own)),
    best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM fresh),
    served AS ({'SELECT DISTINCT user_id FROM best' if weighted else 'SELECT DISTINCT user_id FROM own'}),
    have AS (SELECT s.user_id, count(b.item_id) AS n FROM served s LEFT JOIN best b ON b.user_id = s.user_id AND b.rank <= {k} GROUP BY 1),
    cat AS (SELECT DISTINCT item_id FROM {base}),
    rest AS (SELECT h.user_id, c.item_id, h.n + row_number() OVER (PARTITION BY h.user_id ORDER BY c.item_id) AS rank FROM have h CROSS JOIN cat c
      WHERE h.n < {k} AND (h.user_id, c.item_id) NOT IN (SELECT user_id, item_id FROM own) AND (h.user_id, c.item_id) NOT IN (SELECT user_id, item_id FROM best))
    SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT user_id, item_id, score, rank FROM best UNION ALL SELECT user_id, item_id, 0e0, rank FROM rest UNION ALL {fallback}) WHERE rank <= {k}"""


@query("reco_item_knn", _knn_sql(q.OHOLDOUT, False, 19, 10))
def _(spark, folder):
    train, _, users = holdout(spark, folder, orders=True)
    return rounded(neighbours.item_knn(train, users, 10))


@query("reco_item_knn_weighted", _knn_sql(EVENT_WEIGHTS_SQL, True, 49, 30))
def _(spark, folder):
    weights, users = train_weights(spark, folder)
    return neighbours.item_knn_weighted(weights, users, 30).withColumn("rank", F.col("rank").cast("int"))


@query(
    "item_neighbours",
    f"""WITH {q.EV}, h AS (SELECT DISTINCT visitorid, itemid FROM ev), s AS (SELECT itemid, sqrt(CAST(count(*) AS DOUBLE)) AS norm FROM h GROUP BY 1),
    d AS (SELECT a.itemid AS item, b.itemid AS neighbour, CAST(count(*) AS DOUBLE) AS dot FROM h a JOIN h b ON a.visitorid = b.visitorid AND a.itemid <> b.itemid GROUP BY 1, 2)
    SELECT item, neighbour, floor(dot / (x.norm * y.norm) * 1e12 + 0.5e0) / 1e12 AS similarity,
      CAST(row_number() OVER (PARTITION BY item ORDER BY floor(dot / (x.norm * y.norm) * 1e12 + 0.5e0) / 1e12 DESC, neighbour) AS INTEGER) AS rank
    FROM d JOIN s x ON x.itemid = item JOIN s y ON y.itemid = neighbour QUALIFY rank <= 19""",
)
def _(spark, folder):
    from trailmark.operators.cooccurrence import cosine_neighbours

    history = clicks(spark, folder).select("visitorid", "itemid").distinct()
    return cosine_neighbours(history, "visitorid", "itemid", None, 19)


@query(
    "cooccurrence_orders",
    f"""WITH {q.OL}, h AS (SELECT DISTINCT visitorid, itemid FROM ol)
    SELECT item_i, count(*) AS partners, sum(dot) AS total, max(dot) AS largest FROM (
      SELECT a.itemid AS item_i, b.itemid AS item_j, CAST(count(*) AS DOUBLE) AS dot FROM h a JOIN h b ON a.visitorid = b.visitorid AND a.itemid < b.itemid GROUP BY 1, 2)
    GROUP BY 1""",
)
def _(spark, folder):
    from trailmark.operators.cooccurrence import cooccurrence

    history = materialise(purchases(spark, folder).select("visitorid", "itemid").distinct(), "history")
    pairs = cooccurrence(history, "visitorid", "itemid")
    return pairs.groupBy("item_i").agg(F.count("*").alias("partners"), F.sum("dot").alias("total"), F.max("dot").alias("largest"))


@query("reco_ease")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(ease.ease(train, users, 10))


@query("reco_ease_orders")
def _(spark, folder):
    train, _, users = holdout(spark, folder, orders=True)
    return rounded(ease.ease(train, users, 10))


@query("reco_ease_blended")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(ease.ease(train, users, 10, popularity_weight=0.1, block=32))


@query(
    "ease_residual",
    f"""WITH {q.HOLDOUT}, fitted AS (SELECT DISTINCT item_id FROM split WHERE split = 'train')
    SELECT item_id, 0e0 AS residual FROM fitted""",
)
def _(spark, folder):
    """Every column of the inverse by conjugate gradients, held against the raw interactions; G itself is not formed."""
    train, _, _ = holdout(spark, folder)
    model = ease.fit_ease(train, block=32, solver="conjugate")
    columns = materialise(ease.inverse_columns(model), "columns")
    residuals = ease.gram_residuals(model.history, columns, 250.0)
    return residuals.select(ITEM, F.round("residual", 9).alias("residual"))


@query("reco_ease_conjugate")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(ease.ease(train, users, 10, popularity_weight=0.1, solver="conjugate"))


@query("reco_logreg")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(logistic.logistic_regression(train, users, 10))


@query(
    "logreg_gradient",
    f"""WITH {q.HOLDOUT} SELECT DISTINCT 'user' AS kind, user_id AS id, 0e0 AS gradient FROM train
    UNION ALL SELECT DISTINCT 'item', item_id, 0e0 FROM train UNION ALL SELECT 'intercept', '', 0e0""",
)
def _(spark, folder):
    """Every weight of the fit is at the minimum: its derivative over all training rows rounds to 0."""
    train, _, _ = holdout(spark, folder)
    rows = materialise(logistic.training_rows(train), "rows")
    slopes = logistic.gradient(logistic.fit_logistic(rows, tolerance=1e-8), rows)
    return slopes.select("kind", "id", F.round("gradient", 4).alias("gradient"))


@query("reco_latent")
def _(spark, folder):
    weights, users = train_weights(spark, folder)
    return rounded(latent.recommend_latent(latent.fit_latent(weights), users, 10))


@query("reco_pairwise")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(latent.recommend_latent(pairwise.fit_pairwise(train), users, 10))


@query("reco_neural")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    return rounded(neural.recommend_neural(neural.fit_neural(train), users, 10))


@query("reco_rerank")
def _(spark, folder):
    train, _, users = holdout(spark, folder)
    weights = train.select(USER, ITEM, F.lit(1.0).alias("weight"))
    return rounded(latent.neural_rerank(train, weights, users, 10))


# ---------------------------------------------------------------- metrics


def _popular_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, truth, users = holdout(spark, folder, orders=True)
    return train, truth, simple.popularity(train, users, max(KS))


PER_USER_SQL = f"WITH {q.OHOLDOUT},\n{q.popular('train', 20)},\n{q.metric_ctes(KS)}"
MEAN_COLUMNS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking_metrics.METRICS)


@query(
    "metrics_per_user",
    PER_USER_SQL + " SELECT user_id, CAST(k AS INTEGER) AS k, " + ", ".join(f"round({m}, 6) AS {m}" for m in ranking_metrics.METRICS) + " FROM per_user",
)
def _(spark, folder):
    _, truth, lists = _popular_lists(spark, folder)
    scores = ranking_metrics.per_user_metrics(lists, truth, KS)
    return scores.select(USER, "k", *(F.round(m, 6).alias(m) for m in ranking_metrics.METRICS))


@query(
    "metrics_multi_k",
    PER_USER_SQL + f" SELECT CAST(k AS INTEGER) AS k, {MEAN_COLUMNS}, count(*) AS evaluated_users, (SELECT count(DISTINCT user_id) FROM truth) AS num_users FROM per_user GROUP BY k",
)
def _(spark, folder):
    _, truth, lists = _popular_lists(spark, folder)
    return ranking_metrics.mean_metrics(lists, truth, KS, digits=6)


@query(
    "metrics_long",
    PER_USER_SQL + " " + " UNION ALL ".join(
        f"SELECT concat('{m}@', k) AS metric, CAST(k AS INTEGER) AS k, round(avg({m}), 6) AS value FROM per_user GROUP BY k" for m in ranking_metrics.METRICS
    ) + " UNION ALL SELECT 'num_users', NULL, CAST(count(DISTINCT user_id) AS DOUBLE) FROM truth", doubles=("k",))
def _(spark, folder):
    _, truth, lists = _popular_lists(spark, folder)
    return ranking_metrics.long_metrics(ranking_metrics.mean_metrics(lists, truth, KS, digits=6))


@query(
    "coverage_at_k",
    f"""WITH {q.OHOLDOUT}, {q.popular('train', 20)}, g(k) AS (VALUES (5), (10), (20))
    SELECT CAST(k AS INTEGER) AS k, count(DISTINCT item_id) AS items, round(count(DISTINCT item_id) / CAST((SELECT count(DISTINCT item_id) FROM train) AS DOUBLE), 6) AS coverage
    FROM recs JOIN g ON rank <= k GROUP BY 1""",
)
def _(spark, folder):
    train, _, lists = _popular_lists(spark, folder)
    return ranking_metrics.catalogue_coverage(lists, train, KS, digits=6)


@query(
    "auc",
    f"""WITH {q.EV}, s AS (SELECT e.timestamp, v.value AS score, CAST(e.event = 'transaction' AS INTEGER) AS label FROM ev e JOIN events v USING (event_id)),
    r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM s),
    t AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(r) FILTER (label = 1) AS rs FROM r)
    SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, round((rs - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM t""",
)
def _(spark, folder):
    from trailmark.sources.driver_tables import table

    values = table(spark, folder, "events").select("event_id", F.col("value").alias("score"))
    scored = clicks(spark, folder).join(values, "event_id").select("score", F.expr("int(event = 'transaction')").alias("label"))
    return ranking_metrics.auc(scored, digits=6)


@query(
    "compare_lists",
    f"""WITH {q.HOLDOUT}, {q.popular('train', 10)}, last AS (SELECT item_id, max(timestamp) AS t FROM train GROUP BY 1),
    recent AS (SELECT item_id, row_number() OVER (ORDER BY t DESC, item_id) AS rank FROM last)
    SELECT a.user_id, a.rank, a.item_id AS item_a, CAST((a.user_id, a.item_id) IN (SELECT user_id, item_id FROM truth) AS INTEGER) AS in_truth_a,
      b.item_id AS item_b, CAST((a.user_id, b.item_id) IN (SELECT user_id, item_id FROM truth) AS INTEGER) AS in_truth_b
    FROM recs a JOIN recent b ON a.rank = b.rank""",
)
def _(spark, folder):
    train, truth, users = holdout(spark, folder)
    return ranking_metrics.compare_lists(simple.popularity(train, users, 10), simple.recent_items(train, users, 10), truth)


# ---------------------------------------------------------------- comparison


THREE_SQL = f"""{q.HOLDOUT},
counts AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1),
pop AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM counts),
last AS (SELECT item_id, max(timestamp) AS t FROM train GROUP BY 1),
rec AS (SELECT item_id, row_number() OVER (ORDER BY t DESC, item_id) AS rank FROM last),
lists AS (SELECT 'popularity' AS model, user_id, item_id, rank FROM users CROSS JOIN pop WHERE rank <= 20
  UNION ALL SELECT 'recent_items', user_id, item_id, rank FROM users CROSS JOIN rec WHERE rank <= 20),
grid(k) AS (VALUES (5), (10), (20)),
hits AS (SELECT l.model, l.user_id, l.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM lists l LEFT JOIN truth t USING (user_id, item_id)),
running AS (SELECT *, sum(hit) OVER (PARTITION BY model, user_id ORDER BY rank) AS seen_hits FROM hits),
relevant AS (SELECT user_id, count(*) AS relevant FROM truth GROUP BY 1),
ideal AS (SELECT CAST(n AS BIGINT) AS n, sum(1e0 / log2(n + 1)) OVER (ORDER BY n) AS gain FROM range(1, 21) t(n)),
per_user AS (SELECT model, user_id, k, CAST(sum(hit) AS DOUBLE) / k AS precision, CAST(sum(hit) AS DOUBLE) / relevant AS recall,
  sum(hit / log2(rank + 1e0)) / any_value(gain) AS ndcg, sum(CASE WHEN hit = 1 THEN seen_hits / CAST(rank AS DOUBLE) ELSE 0 END) / least(relevant, k) AS map,
  CAST(max(hit) AS DOUBLE) AS hit_rate
  FROM grid JOIN running ON rank <= k JOIN relevant USING (user_id) JOIN ideal ON n = least(relevant, k) GROUP BY model, user_id, k, relevant),
means AS (SELECT model, CAST(k AS INTEGER) AS k, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(map) AS map, avg(hit_rate) AS hit_rate FROM per_user GROUP BY model, k),
hm AS (SELECT *, CASE WHEN least(precision, recall, ndcg, map) > 0 THEN 4e0 / (1e0 / precision + 1e0 / recall + 1e0 / ndcg + 1e0 / map) ELSE 0e0 END AS harmonic_mean FROM means)"""
BASELINES = ("popularity", "recent_items")


def _baseline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    train, truth, _ = holdout(spark, folder)
    models = {n: m for n, m in comparison.model_registry().items() if n in BASELINES}
    return comparison.compare_models(train, truth, models, KS)


@query("flagship_evaluation", f"WITH {THREE_SQL} SELECT model, k, " + ", ".join(f"round({m}, 6) AS {m}" for m in (*ranking_metrics.METRICS, "harmonic_mean")) + " FROM hm")
def _(spark, folder):
    scored = _baseline_metrics(spark, folder).withColumn("harmonic_mean", comparison.harmonic_mean())
    return scored.select("model", "k", *(F.round(m, 6).alias(m) for m in (*ranking_metrics.METRICS, "harmonic_mean")))


@query(
    "model_ranking",
    f"""WITH {THREE_SQL}, r AS (SELECT model, harmonic_mean, row_number() OVER (ORDER BY harmonic_mean DESC, model) AS place, lead(harmonic_mean) OVER (ORDER BY harmonic_mean DESC, model) AS nxt FROM hm WHERE k = 10)
    SELECT model, CAST(place AS INTEGER) AS place, round(harmonic_mean, 6) AS harmonic_mean, round(harmonic_mean - nxt, 6) AS absolute_gain,
      round((harmonic_mean - nxt) / nullif(nxt, 0), 6) AS relative_gain FROM r""",
)
def _(spark, folder):
    ranked = comparison.rank_models(_baseline_metrics(spark, folder))
    return ranked.select("model", "place", *(F.round(c, 6).alias(c) for c in ("harmonic_mean", "absolute_gain", "relative_gain")))


@query(
    "comparison_table",
    f"WITH {THREE_SQL} SELECT model, round(max(harmonic_mean) FILTER (k = 10), 6) AS harmonic_mean_at_10, "
    + ", ".join(f"round(max({m}) FILTER (k = {k}), 6) AS {m}_at_{k}" for m in ("precision", "recall", "ndcg", "map", "hit_rate") for k in KS)
    + " FROM hm GROUP BY 1",
)
def _(spark, folder):
    table = comparison.comparison_table(_baseline_metrics(spark, folder), KS).drop("place")
    return table.select("model", *(F.round(c, 6).alias(c) for c in table.columns if c != "model"))


@query(
    "promotion_gate",
    f"""WITH {THREE_SQL}, o AS (SELECT max(harmonic_mean) FILTER (model = 'popularity') AS observed, max(harmonic_mean) FILTER (model = 'recent_items') AS reference FROM hm WHERE k = 10)
    SELECT round(observed, 6) AS observed, round(reference, 6) AS reference, round(CASE WHEN reference > 0 THEN abs(observed - reference) / reference END, 6) AS relative_diff,
      reference > 0 AND abs(observed - reference) / reference <= 0.05 AS passed, reference > 0 AND abs(observed - reference) / reference <= 0.05 AS promoted,
      CASE WHEN reference <= 0 THEN 'reference not positive' WHEN abs(observed - reference) / reference > 0.05 THEN 'outside tolerance' ELSE 'within tolerance' END AS reason FROM o""",
)
def _(spark, folder):
    ranked = comparison.rank_models(_baseline_metrics(spark, folder))
    reference = ranked.filter("model = 'recent_items'").first()["harmonic_mean"]
    gate = comparison.promotion_gate(ranked.filter("model = 'popularity'"), reference)
    return gate.withColumns({c: F.round(c, 6) for c in ("observed", "reference", "relative_diff")})


@query("model_comparison")
def _(spark, folder):
    train, truth, _ = holdout(spark, folder)
    metrics = comparison.compare_models(train, truth, comparison.model_registry(), KS, at_once=MODELS_AT_ONCE)
    return metrics.drop("seconds").withColumn("harmonic_mean", comparison.harmonic_mean())


@query(
    "batch_recommend",
    f"""WITH {q.HOLDOUT}, {q.popular('train', 10)}, lim AS (SELECT user_id, CASE WHEN count(*) <= 10 THEN count(*) ELSE 10 END AS n FROM truth GROUP BY 1)
    SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS recommendations FROM recs JOIN lim USING (user_id) WHERE rank <= n GROUP BY 1""",
)
def _(spark, folder):
    train, truth, _ = holdout(spark, folder)
    held = F.count("*")  # ask for as many items as were held out, ten by default
    asked = truth.groupBy(USER).agg(F.when(held <= 10, held).alias("limit"))
    answered = comparison.batch_recommend(asked, lambda u, k: simple.popularity(train, u, k))
    return answered.select(USER, F.array_join("recommendations", ",").alias("recommendations"))


@query(
    "batch_recommend_long",
    f"""WITH {q.HOLDOUT}, totals AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), {UNSEEN_TOP.format(seen='train')},
    lim AS (SELECT user_id, CASE WHEN user_id = (SELECT min(user_id) FROM users) THEN 50000 ELSE 10 END AS n FROM users),
    lists AS (SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS recommendations FROM ranked JOIN lim USING (user_id) WHERE rank <= n GROUP BY 1)
    SELECT user_id, coalesce(recommendations, '') AS recommendations FROM users LEFT JOIN lists USING (user_id)""",
)
def _(spark, folder):
    """One user asks for 50,000 items, the others for ten."""
    train, _, users = holdout(spark, folder)
    first = users.agg(F.min(USER)).scalar()
    asked = users.withColumn("limit", F.when(F.col(USER) == first, 50_000))
    answered = comparison.batch_recommend(asked, lambda wanted: simple.popularity_upto(train, wanted), limits_as_data=True)
    return answered.select(USER, F.array_join("recommendations", ",").alias("recommendations"))


def _four_sql(head: str) -> str:
    """Metrics at 10 of four models from lists that each model's own SQL makes, with coverage as share of the catalogue."""
    random_lists = f"""items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM train)),
p AS (WITH RECURSIVE p AS (SELECT user_id, 0 AS j, CAST([] AS BIGINT[]) AS drawn FROM users UNION ALL
      SELECT user_id, j, list_append(drawn, r + len(list_filter(list_sort(drawn), lambda s, i: s - (i - 1) <= r))) FROM (
        SELECT user_id, j + 1 AS j, drawn, {q.draw(42, 'user_id', 'j + 1')} % ((SELECT max(n) FROM items) - j) AS r FROM p WHERE j < least(10, (SELECT max(n) FROM items))))
      SELECT * FROM p),
rnd AS (SELECT user_id, item_id, rank FROM (SELECT user_id, unnest(drawn) AS idx, generate_subscripts(drawn, 1) AS rank FROM p
      WHERE j = least(10, (SELECT max(n) FROM items))) JOIN items USING (idx))"""
    return f"""{head}, {random_lists},
counts AS (SELECT item_id, count(*) AS c FROM train GROUP BY 1), pop AS (SELECT item_id, row_number() OVER (ORDER BY c DESC, item_id) AS rank FROM counts),
last AS (SELECT item_id, max(timestamp) AS t FROM train GROUP BY 1), rec AS (SELECT item_id, row_number() OVER (ORDER BY t DESC, item_id) AS rank FROM last),
knn AS ({_knn_sql(head, False, 19, 10)}),
lists AS (SELECT 'popularity' AS model, user_id, item_id, rank FROM users CROSS JOIN pop WHERE rank <= 10
  UNION ALL SELECT 'recent_items', user_id, item_id, rank FROM users CROSS JOIN rec WHERE rank <= 10
  UNION ALL SELECT 'random', user_id, item_id, rank FROM rnd UNION ALL SELECT 'item_knn', user_id, item_id, rank FROM knn),
covered AS (SELECT model, CAST(count(DISTINCT item_id) AS DOUBLE) / (SELECT count(*) FROM counts) AS coverage FROM lists GROUP BY 1),
hits AS (SELECT l.model, l.user_id, l.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM lists l LEFT JOIN truth t USING (user_id, item_id)),
running AS (SELECT *, sum(hit) OVER (PARTITION BY model, user_id ORDER BY rank) AS seen_hits FROM hits),
relevant AS (SELECT user_id, count(*) AS relevant FROM truth GROUP BY 1),
ideal AS (SELECT CAST(n AS BIGINT) AS n, sum(1e0 / log2(n + 1)) OVER (ORDER BY n) AS gain FROM range(1, 11) t(n)),
per_user AS (SELECT model, user_id, CAST(sum(hit) AS DOUBLE) / 10 AS precision, CAST(sum(hit) AS DOUBLE) / relevant AS recall,
  sum(hit / log2(rank + 1e0)) / any_value(gain) AS ndcg, sum(CASE WHEN hit = 1 THEN seen_hits / CAST(rank AS DOUBLE) ELSE 0 END) / least(relevant, 10) AS map,
  CAST(max(hit) AS DOUBLE) AS hit_rate FROM running JOIN relevant USING (user_id) JOIN ideal ON n = least(relevant, 10) GROUP BY model, user_id, relevant),
means AS (SELECT model, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(map) AS map, avg(hit_rate) AS hit_rate FROM per_user GROUP BY model),
hm AS (SELECT *, CASE WHEN least(precision, recall, ndcg, map) > 0 THEN 4e0 / (1e0 / precision + 1e0 / recall + 1e0 / ndcg + 1e0 / map) ELSE 0e0 END AS harmonic_mean
  FROM means JOIN covered USING (model))"""


CHECKED = ("popularity", "recent_items", "random", "item_knn")


def _checked_metrics(spark: SparkSession, folder: str) -> DataFrame:
    train, truth, _ = holdout(spark, folder)
    models = {n: m for n, m in comparison.model_registry().items() if n in CHECKED}
    return comparison.compare_models(train, truth, models, (10,))


@query(
    "baseline_comparison",
    f"WITH {_four_sql(q.HOLDOUT)} SELECT model, " + ", ".join(f"round({m}, 6) AS {m}" for m in (*ranking_metrics.METRICS, "coverage", "harmonic_mean")) + " FROM hm",
)
def _(spark, folder):
    scored = _checked_metrics(spark, folder).withColumn("harmonic_mean", comparison.harmonic_mean())
    return scored.select("model", *(F.round(m, 6).alias(m) for m in (*ranking_metrics.METRICS, "coverage", "harmonic_mean")))


@query(
    "trade_off",
    f"""WITH {_four_sql(q.HOLDOUT)} SELECT model, 'baseline' AS role, round(harmonic_mean, 6) AS harmonic_mean, round(1e0 - coverage, 6) AS unused,
      coalesce(max(harmonic_mean) OVER (ORDER BY 1e0 - coverage, harmonic_mean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > harmonic_mean, false) AS dominated FROM hm""",
)
def _(spark, folder):
    """Quality against the share of the catalogue that a model never shows; times differ from run to run."""
    metrics = _checked_metrics(spark, folder).withColumn("unused", F.lit(1.0) - F.col("coverage"))
    table = comparison.trade_off(metrics, cost="unused")
    return table.select("model", "role", F.round("harmonic_mean", 6).alias("harmonic_mean"), F.round("unused", 6).alias("unused"), "dominated")


@query(
    "champion_lookup",
    f"""WITH {THREE_SQL} SELECT 'compare_' || model AS run_name, round(harmonic_mean, 6) AS harmonic_mean FROM hm
    WHERE k = 20 AND model <> 'no_such' ORDER BY harmonic_mean DESC, model LIMIT 1""",
)
def _(spark, folder):
    """The best usable run of a run table: comparison runs with an artefact, among others that must not win."""
    scored = _baseline_metrics(spark, folder).filter("k = 20")
    logged = scored.select(F.concat(F.lit("compare_"), "model").alias("run_name"), F.lit(True).alias("has_artifact"), *ranking_metrics.METRICS)
    better = [F.lit(1.0).alias(m) for m in ranking_metrics.METRICS]
    others = scored.select(F.explode(F.array(F.lit("compare_lost"), F.lit("train_kept"))).alias("run_name"), *better)
    runs = logged.unionByName(others.select("run_name", (F.col("run_name") == "train_kept").alias("has_artifact"), *ranking_metrics.METRICS))
    return comparison.best_logged_run(runs).select("run_name", F.round("harmonic_mean", 6).alias("harmonic_mean"))


@query(
    "temporal_holdout",
    f"WITH {q.HOLDOUT} SELECT 'train' AS part, user_id, item_id FROM train UNION ALL SELECT 'truth', user_id, item_id FROM truth",
)
def _(spark, folder):
    train, truth = splits.temporal_holdout(clicks(spark, folder).select("visitorid", "itemid", "timestamp"))
    parts = [frame.select(F.lit(name).alias("part"), USER, ITEM) for name, frame in (("train", train), ("truth", truth))]
    return parts[0].unionByName(parts[1])


CUSTOMERS_SQL = q.HOLDOUT.replace("SELECT DISTINCT user_id FROM truth", "SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer")


@query("reco_cold_users", _knn_sql(CUSTOMERS_SQL, False, 19, 10))
def _(spark, folder):
    """All customers as users of the click model, which knows only some of them: the others get the popular items."""
    train, _, _ = holdout(spark, folder)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias(USER))
    return rounded(neighbours.item_knn(train, materialise(customers, "customers"), 10))


@query(
    "reco_ease_cold",
    f"""WITH {CUSTOMERS_SQL}, counts AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1),
    top AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM counts)
    SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM users CROSS JOIN top WHERE rank <= 10 AND user_id NOT IN (SELECT user_id FROM train)""",
)
def _(spark, folder):
    """What users unknown to the fit get from it."""
    train, _, _ = holdout(spark, folder)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias(USER))
    lists = ease.ease(train, materialise(customers, "customers"), 10)
    return rounded(lists.join(train.select(USER).distinct(), USER, "left_anti"))


# ---------------------------------------------------------------- stages


@query(
    "feature_stage",
    f"""WITH {q.EV}, seq AS (SELECT *, lag(timestamp) OVER w AS pt, lag(event) OVER w AS pe FROM ev WINDOW w AS
      (PARTITION BY visitorid ORDER BY timestamp, CAST(itemid AS VARCHAR), event, event_id)),
    st AS (SELECT *, CASE WHEN pt IS NULL OR timestamp - pt >= 1800000 OR (pe = 'transaction' AND event <> 'transaction') THEN 1 ELSE 0 END AS starts FROM seq),
    se AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY visitorid ORDER BY timestamp, CAST(itemid AS VARCHAR), event, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index,
      row_number() OVER (ORDER BY timestamp, CAST(visitorid AS VARCHAR), CAST(itemid AS VARCHAR), event, event_id) - 1 AS pos, count(*) OVER () AS n FROM st),
    b AS (SELECT *, greatest(1, floor(n * 0.7e0)) AS te FROM se), c AS (SELECT *, least(greatest(te + 1, floor(n * (0.7e0 + 0.15e0))), n - 1) AS ve FROM b)
    SELECT event_id, concat(visitorid, '_', session_index) AS session_id,
      dense_rank() OVER (ORDER BY CAST(visitorid AS VARCHAR)) - 1 AS user_index, dense_rank() OVER (ORDER BY CAST(itemid AS VARCHAR)) - 1 AS item_index,
      CASE WHEN pos < te THEN 'train' WHEN pos < ve THEN 'validation' ELSE 'test' END AS split FROM c""",
)
def _(spark, folder):
    features = stages.build_features(stages.preprocess(clicks(spark, folder), max_items=0, min_per_user=0))
    return features.events.select("event_id", "session_id", "user_index", "item_index", "split")


@query(
    "stage_evaluation",
    f"""WITH {q.EV}, {RANGE}, train AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ranged WHERE split = 'train'),
    te AS (SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ranged WHERE split = 'test'),
    ok AS (SELECT user_id, item_id FROM te WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)
      AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM train)),
    truth AS (SELECT * FROM ok), users AS (SELECT DISTINCT user_id FROM truth),
    totals AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), {UNSEEN_TOP.format(seen='train')},
    recs AS (SELECT * FROM ranked WHERE rank <= 10), {q.metric_ctes((10,))}
    SELECT """
    + ", ".join(f"round(avg({m}), 6) AS {m}_at_10" for m in ranking_metrics.METRICS)
    + ", CAST((SELECT count(*) FROM users) AS DOUBLE) AS evaluated_users FROM per_user",
)
def _(spark, folder):
    split = splits.split_time_range(clicks(spark, folder))
    named = split.select(F.col("visitorid").cast("string").alias(USER), F.col("itemid").cast("string").alias(ITEM), "split").distinct()
    stored = materialise(named, "split")
    row = stages.evaluate(
        lambda train, users, k: simple.popularity(train, users, k, exclude_seen=True), splits.part(stored, "train"), splits.part(stored, "test"), 10, 0
    )
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


@query(
    "metric_names",
    PER_USER_SQL + " " + " UNION ALL ".join(f"SELECT concat('{m}_at_', k) AS name, CAST(k AS INTEGER) AS k FROM grid" for m in ranking_metrics.METRICS),
)
def _(spark, folder):
    from trailmark.functions.columns import metric_column, metric_k

    _, truth, lists = _popular_lists(spark, folder)
    long = ranking_metrics.long_metrics(ranking_metrics.mean_metrics(lists, truth, KS))
    return long.filter("metric <> 'num_users'").select(metric_column("metric").alias("name"), metric_k("metric").alias("k"))


@query(
    "consolidated_results",
    PER_USER_SQL + f" SELECT 'popularity' AS model, 'test' AS split, CAST(k AS INTEGER) AS k, {MEAN_COLUMNS} FROM per_user GROUP BY k",
)
def _(spark, folder):
    _, truth, lists = _popular_lists(spark, folder)
    stacked = ranking_metrics.stack_results({("popularity", "test"): ranking_metrics.mean_metrics(lists, truth, KS, digits=6)})
    return stacked.select("model", "split", "k", *ranking_metrics.METRICS)
