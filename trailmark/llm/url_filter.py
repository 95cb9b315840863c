"""URL rules found by their rarest literal token; only fetched rules run their regular expression."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import LOWER, UPPER, ascii_lower
from trailmark.storage import materialise

TOKEN = r"[^\p{L}\p{N}]+"
RULE_SCHEMA = "rule string, action string, pattern string, literals array<string>, listed boolean, length int"


@dataclass(frozen=True)
class UrlRule:
    """``listed`` rules decide by length; the others are block or allow patterns for urls no listed rule fits.

    ``pattern`` is searched in host + path. ``literals`` are pieces of text that
    every matching url contains between characters that are neither letters nor
    digits; without any the rule is tried on every url.
    """

    rule: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    listed: bool = False


def _lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", _lower(text)) if t]


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E" if text else ""


def prefix_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for a host with its subdomains and every path that begins with ``path``."""
    tokens = _tokens(host)
    inner = _tokens(path)
    if inner and re.search(r"[^\W_]$", path):
        inner = inner[:-1]  # the url may go on within the last token
    if not path.startswith("/"):
        tokens, inner = tokens[:-1], []
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", tuple(tokens + inner), True)


def word_rule(action: str, words: str) -> UrlRule:
    """A rule for urls that contain ``words`` as whole tokens anywhere in host or path."""
    return UrlRule(f"*{words}*", action, rf"(?i)(?<![\p{{L}}\p{{N}}]){_quoted(words)}(?![\p{{L}}\p{{N}}])", tuple(_tokens(words)))


def rule_table(spark: SparkSession, rules: Iterable[UrlRule]) -> DataFrame:
    rows = [(r.rule, r.action, r.pattern, list(r.literals), r.listed, len(r.rule)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """The verdict on every url.

    A rule is indexed under the one of its tokens that the fewest urls hold (ties:
    the smaller token). A url looks its tokens up in the index and tests the
    rules it gets. Of the listed rules that fit the longest decides (ties: block
    before allow, then the greater rule); without one, any other matching rule,
    block before allow; else ``default``. Spark joins the index by its measured
    size, broadcast when small and shuffled with skew splitting when not.

    Returns one row per row of ``pages``: page_id, host, path, rule (the listed
    rule or null), verdict, pattern_rule (the other rule or null). Null urls and
    urls without ``://`` have empty host and path and get ``default``, unless a
    rule without tokens matches the empty string.
    """
    urls = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    urls = urls.select("_row", "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    urls = materialise(urls, "urls")  # rows are numbered once, as they are met again below
    # the empty token fetches the rules without tokens
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(F.concat("host", "path")), TOKEN)))
    probes = urls.select("_row", F.explode(tokens).alias("token"))

    named = rules.select(*(F.col(c) for c in ("rule", "action", "pattern", "literals", "listed", "length")))
    wanted = named.select("rule", "pattern", "action", "listed", "length", F.explode(F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = materialise(wanted, "rules")  # their size is known then, and decides how they are joined
    counts = probes.join(wanted.select("token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("_urls"))
    rarest = F.min(F.struct(F.coalesce("_urls", F.lit(0)).alias("n"), "token"))["token"]
    index = wanted.join(counts, "token", "left").groupBy("rule", "pattern", "action", "listed", "length").agg(rarest.alias("token"))
    index = materialise(index, "index")

    # a token carries its row number and nothing else; the url comes back for the rules that were fetched
    fetched = probes.join(index, "token").drop("token").join(urls.select("_row", F.concat("host", "path").alias("_text")), "_row")
    fits = fetched.filter(F.rlike("_text", F.col("pattern")))
    ranked = F.struct(F.col("length"), (F.col("action") == "block").alias("block"), "rule", "action")
    decided = fits.groupBy("_row").agg(
        F.max(F.when(F.col("listed"), ranked)).alias("_listed"),
        F.max(F.when(~F.col("listed"), F.struct((F.col("action") == "block").alias("block"), "length", "rule", "action"))).alias("_other"),
    )
    best = urls.join(decided, "_row", "left")
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("_listed.rule").alias("rule"),
        F.coalesce("_listed.action", "_other.action", F.lit(default)).alias("verdict"),
        F.when(F.col("_listed").isNull(), F.col("_other.rule")).alias("pattern_rule"),
    )
