"""Chat formatting, mixing, personal data, url rules and exact dedup on small tables with awkward rows."""

import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import base_row, tree_paths
from trailmark.llm import chat, exact_dedup, mixing, pii, queries, url_filter

LONG = "x" * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, _row long"


def documents(spark, rows):
    """Rows of (doc_id, text, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, 1, True, 5, 7) for i, t, s in rows], DOCS).repartition(3)


# ------------------------------------------------------------------ chat


def test_best_paths_of_trees(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for conv in (1, 2, None):
        tree = []
        for m in range(40):
            parent = rng.choice([None, 99_999] + list(range(m))) if m else None
            tree.append((m, parent, float(rng.randrange(4))))
        rows += [(conv, m, p, "user", f"t{m}", s) for m, p, s in tree]
        expected[conv] = tree_paths(tree)[:3]
    frame = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    got = {}
    for r in chat.best_paths(frame, 3).collect():
        got.setdefault((r.conv_id, r["rank"]), []).append((-r.height, r.msg, r.leaf, r.path_score))
    for conv, paths in expected.items():
        for rank, (score, leaf, path) in enumerate(paths, 1):
            told = sorted(got[conv, rank])
            assert [m for _, m, *_ in told] == path and told[0][2:] == (leaf, -score)
    assert len(got) == 9


def test_long_chain_and_circle(spark):
    chain = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("msg"), (F.col("id") - 1).alias("parent"), F.lit("assistant").alias("role"), F.lit("a").alias("text"), F.lit(1.0).alias("score"))
    row = chat.format_paths(chain).first()
    assert row.path_score == 300 and len(row.loss_spans) == 300 and len(chat_turns(spark, row.formatted)) == 300
    circle = spark.createDataFrame([(1, 1, 2, None), (1, 2, 1, None)], "conv_id long, msg long, parent long, score double")
    with pytest.raises(ValueError):
        chat.best_paths(circle)


def chat_turns(spark, formatted):
    return spark.createDataFrame([(formatted,)], "f string").select(chat.parse(F.col("f")).alias("t")).first().t


def test_format_reads_back(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "### x:\n</turn>\n", "\\h\\b#<\\", "é😀\n", "a" * 5000]
    roles = ["user", "assistant", "a:b\n#", None, "assistant"]
    rows = [(c, t, roles[(c + t) % 5], texts[(3 * c + t) % 7]) for c in range(1, 6) for t in range(6)] + [(None, None, None, None), (1, 0, "assistant", "tie")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, msg long")
    out = chat.format_paths(chat.turns_as_tree(frame)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    key = lambda r: tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in r[1:])
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: ((x[1] is not None, x[1] or 0), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or "")))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own], key
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert len(out) == 6
    assert chat.format_paths(chat.turns_as_tree(frame.limit(0))).count() == 0


# ------------------------------------------------------------------ mixing, dedup: against the registered SQL


def same_as_sql(frame, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"{name}_", table.toArrow())  # keeps nullable ids whole numbers
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    got, expected = frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)
    key = lambda t: t[order].astype(object).where(t[order].notna(), None).map(str).sort_values(order).reset_index(drop=True)
    assert len(got) == len(expected)
    for c in order:
        if pd.api.types.is_float_dtype(expected[c]) or pd.api.types.is_float_dtype(got[c]):
            got[c], expected[c] = got[c].astype(float).round(6), expected[c].astype(float).round(6)
        elif pd.api.types.is_numeric_dtype(expected[c]) and not pd.api.types.is_bool_dtype(expected[c]):
            got[c], expected[c] = got[c].astype(float), expected[c].astype(float)
    pd.testing.assert_frame_equal(key(got), key(expected))


def awkward_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "ef\x0bg", "h\ti"]) for _ in range(rng.randrange(30))), rng.choice(["hot"] * 6 + ["b", "Z", "é", None])) for i in range(300)]
    rows += [(i, t.upper(), s) for i, t, s in rows[:40]] + [(500, None, "b"), (501, "", None), (None, "ab", "hot"), (None, None, None), (7, LONG, "b"), (8, LONG[:-1] + "y", "b")]
    return rows + [rows[3], rows[3]]


def test_mix(spark):
    docs = documents(spark, awkward_rows())
    out = mixing.mix(docs)
    same_as_sql(out, queries.MIX_SQL, documents=docs.select("doc_id", "text", "source"))
    for r in out.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= 0.5 and r.over <= 0
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(documents(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [r.taken for r in empty] == [0, 0]


def test_mix_stops_at_three_times_the_source(spark):
    out = mixing.mix(documents(spark, [(1, "a b", "a"), (2, "a " * 100, "b"), (3, "a " * 50, "c")]))
    got = {r.doc_id: (r.target, r.taken) for r in out.collect()}
    assert got[1] == (6.0, 6) and sum(t for _, t in got.values()) == 152


def weak(block, seed):
    """Hashes that collide under the first seed."""
    first = F.octet_length(block).cast("long") % 3 if seed == 0 else F.xxhash64(F.lit(seed), block)
    return [first.alias("_a"), F.lit(0).cast("long").alias("_b")]


@pytest.mark.parametrize("order", [exact_dedup.block_order, weak])
def test_exact_groups(spark, order):
    docs = documents(spark, awkward_rows())
    out = exact_dedup.duplicate_groups(docs, block_bytes=16, order=order)
    same_as_sql(out, queries.DEDUP_SQL, documents=docs.select("doc_id", "text"))
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0


def test_drop_duplicates_keeps_columns_and_one_row(spark):
    rows = awkward_rows()
    docs = documents(spark, rows)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    bodies = {(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t, _ in rows}
    assert out.count() == len(bodies)


def test_drop_duplicates_with_clashing_names(spark):
    schema = "doc_id long, text string, _id string, _sha long, _copies int, copies int, row long, sha string, kept boolean, number int, kept_id long, id long"
    rows = [(1, "a", "x", 5, 6, 7, 8, "y", True, 9, 10, 11), (1, "a", "x", 5, 6, 7, 8, "y", True, 9, 10, 11), (2, "A", "z", 1, 1, 1, 1, "q", False, 1, 1, 1), (None, None, None, 5, 6, 7, 8, "y", True, 9, 10, 11), (3, "b", "x", 5, 6, 7, 8, "y", True, 9, 10, 11), (3, "b", "w", 5, 6, 7, 8, "y", True, 9, 10, 11)]
    docs = spark.createDataFrame(rows, schema)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == ["(2, 'A')", "(3, 'b')", "(None, None)"]
    single = exact_dedup.drop_duplicates(docs.filter("doc_id = 2 or doc_id is null"))
    assert single.columns == docs.columns and single.count() == 2


# ------------------------------------------------------------------ personal data

HARD = [
    "a@b.c_d@e.f.g", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1.1 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 9",
    "41111111111111111111111", "+1 (202) 555-0101", "+++++12345678901", "a" * 5000 + "@b.c", "1" * 30_000, "", None,
    "ip 0001.2.3.004", "a..b@c-.d-", "12 34-56 78901234567 4", "é@é.com x@é.com 1٣.2.3.4", "+1" + "(" * 50, "\n+49 30 1234567\n",
    "😀 x@y.zz 😀 +44 20 7946 0958", "1.1.1.1.2.2.2.2", "5500 0000 0000 0004-4111111111111111", "+1 555 0100 +1 555 010 0199",
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("19 .-+()@ab_%\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "x@y.com", None), (0, HARD[0], "s")])
    found = pii.find_pii(docs).select("doc_id", pii.spans_text(F.filter("found", lambda s: s["base"])).alias("base"), "found").collect()
    assert len(found) == len(texts) + 2
    for r in found:
        counts, digest = base_row(texts[r.doc_id] if r.doc_id is not None else "x@y.com")
        kinds = [sum(s.base and s.kind == k for s in r.found) for k in range(4)]
        assert kinds == counts, (r.doc_id, r.base)
        assert __import__("hashlib").sha256(r.base.encode()).hexdigest() == digest, (r.doc_id, r.base)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_labelers_add_spans(spark):
    rows = [(i, f"call me: (202) 555-{1000 + i}, card 4111 1111 1111 1111, +1 202 555 {1000 + i}, mail x{i}@y.com", "s") for i in range(60)]
    rows += [(100, "phone (202) 555-0123 or john (at) mail (dot) com", "s"), (101, "nothing here 12", "s")]
    found = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, rows)).select("doc_id", pii.spans_text(F.col("found")).alias("spans")).collect()}
    assert found[100].startswith("phone:6:20") and found[101] == ""
    assert found[0].count("phone") == 2


# ------------------------------------------------------------------ urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "x://COM/", "x://com/a?b", "x://example.com/en/?", "x://www.Example.com/en/1", "x://notexample.com/en/",
            "x://a.net/es/#", "x://a.net/ES/", "x://net/fr/x", "a://b://c.com/", "x://spam-farm.org/", "x://a.org/spam-farms", "x://a.org/q/Spam-Farm?x", "x://a.org:80/en/", "x:// .com/\n/a", "x://a.com/" + "b/" * 9000]
    frame = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] + [(1, urls[7], "h", "t"), (None, urls[6], None, None)], "page_id long, url string, html string, token string")
    rules = [url_filter.prefix_rule(*r) for r in queries.LISTED] + [url_filter.word_rule("block", w) for w in queries.BLOCKED_WORDS]
    out = url_filter.judge_urls(frame, url_filter.rule_table(spark, rules))
    same_as_sql(out, queries.URL_SQL, pages=frame.select("page_id", "url"))
    assert url_filter.judge_urls(frame.limit(0), url_filter.rule_table(spark, rules)).count() == 0


def test_rules_without_tokens_and_cut_tokens(spark):
    frame = spark.createDataFrame([(1, "x://a.b/foobar"), (2, "x://a.b/q"), (3, None)], "page_id long, url string")
    rules = [url_filter.prefix_rule("block", "a.b", "/foo"), url_filter.UrlRule("any", "block", "/q$", ())]
    got = {r.page_id: (r.rule, r.verdict, r.pattern_rule) for r in url_filter.judge_urls(frame, url_filter.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.b/foo", "block", None), 2: (None, "block", "any"), 3: (None, "allow", None)}


def test_many_rules_and_long_urls(spark):
    """Thousands of rules, of which a url only tries those it fetched; a url of very many tokens takes little longer."""
    path = "/".join(f"t{i}" for i in range(60_000))
    urls = [(i, f"x://h{i}.org/part{i}/x") for i in range(300)] + [(1_000, f"x://h7.org/{path}"), (1_001, f"x://long.net/{path}/bad-1999")]
    rules = [url_filter.prefix_rule("block", f"h{i}.org", f"/part{i}/") for i in range(0, 3_000, 2)]
    rules += [url_filter.word_rule("block", f"bad-{i}") for i in range(2_000)]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    start = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict, r.pattern_rule) for r in url_filter.judge_urls(frame, url_filter.rule_table(spark, rules)).collect()}
    assert time.perf_counter() - start < 60
    for i in range(300):
        assert got[i] == ((f"h{i}.org/part{i}/", "block", None) if i % 2 == 0 else (None, "allow", None))
    assert got[1_000] == (None, "allow", None) and got[1_001] == (None, "block", "*bad-1999*")
