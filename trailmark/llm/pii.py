"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the votes.

Candidates come from regular expressions: strict ones whose matches always
stay, and loose ones whose matches stay if the final classifier accepts them.
Regex, gazetteer and context labelers vote yes, no or nothing. All rows are
processed by DataFrame functions; what reaches the driver is one count per
pattern of votes, of which there are at most KINDS x 3^LABELERS x features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.storage import materialise

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 32  # code points before a candidate that the context labeler reads

_EMAIL_CHAR = "[A-Za-z0-9._%+-]"
#: Matches of these are the leftmost non-overlapping ones. A run of characters is entered at its start or where the
#: last match ended, and quantifiers are possessive, so that no run is scanned more than once.
STRICT = {
    "email": rf"(?:\G|(?<!{_EMAIL_CHAR})){_EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9][\x20-]?)[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[\p{L}0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9][\x20-]?)[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-]*[0-9])",
}
#: a text without these cannot match
NEEDS = {"email": "(?i)@|[(\\[{]at", "ip": "[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": "[0-9][\\x20-]?[0-9]", "phone": "[0-9]"}
#: words that announce a kind, searched in lower case before the candidate
CUES = {
    "email": r"mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": r"card|visa|master|credit|account|karte|carte|tarjeta|konto",
    "phone": r"phone|call|tel|fax|mobile|anruf|appel|llam",
}
#: endings and prefixes that real values of a kind have, tested on the candidate in lower case
GAZETTEER = {
    "email": r"(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|255\.|0:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}
LABELERS = ("strict", "gazetteer", "context", "edges", "digits")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    ordered = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substr(ordered, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(F.element_at(F.array(*(F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digit(i) + 1))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0)


def is_base(kind: Column, value: Column) -> Column:
    """The test that a strict match of each kind must pass."""
    digits = digits_of(value)
    small = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(small))
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(digits))
        .otherwise(F.length(digits).between(10, 15))
    )


def _matches(text: Column, kind: str, strict: bool) -> Column:
    """Array of match, code points between it and the match before, and the characters around it."""
    pattern = (STRICT if strict else LOOSE)[kind]
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(p, F.lit(1)).alias("after")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(pieces.alias("piece"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("next"), found.alias("value"))
    row = lambda z, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"), i.alias("at"), z["value"].alias("value"), z["piece"]["gap"].alias("gap"), z["piece"]["before"].alias("before"), z["next"]["after"].alias("after"))
    rows = F.filter(F.transform(zipped, row), lambda r: r["value"].isNotNull())
    return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All matches with positions and votes; a document without any has one row with null kind.

    Returns _row, doc_id, kind (place in KINDS), base, start, end and one column
    per labeler: 1 yes, -1 no, 0 no opinion. Loose matches that overlap a base
    span are left out, as are strict ones that fail their test.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), text.alias("_text"))
    every = [F.coalesce(_matches(F.col("_text"), k, s), F.array().cast(_MATCH)) for k in KINDS for s in (True, False)]
    found = rows.select("_row", "doc_id", F.explode_outer(F.flatten(F.array(*every))).alias("m")).select("_row", "doc_id", "m.*")
    upto = Window.partitionBy("_row", "kind", "strict").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    name = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    placed = placed.withColumn("base", F.coalesce(F.col("strict") & is_base(name, F.col("value")), F.lit(False)))
    # the furthest end of base spans that start earlier, and the nearest start of those that start later
    line = Window.partitionBy("_row").orderBy("start", F.desc("base"))
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    own = F.max(F.when(~F.col("strict"), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumns({"_reach": reach, "_ahead": ahead, "_own": own})
    clash = lambda c: F.coalesce(c, F.lit(False))
    overlaps = clash(F.col("_reach") > F.col("start")) | clash(F.col("_ahead") < F.col("end")) | clash(F.col("_own") > F.col("start"))
    keep = F.col("base") | (~F.col("strict") & ~overlaps)
    kept = placed.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    blank = ["kind", "start", "end"]
    kept = kept.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in blank})

    low, digits = F.lower("value"), F.length(digits_of(F.col("value")))
    by_kind = lambda patterns, text: sum((F.when((F.col("kind") == i) & text.rlike(patterns[k]), 1).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    others = lambda text: sum((F.when((F.col("kind") != i) & text.rlike(CUES[k]), 1).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    before = F.lower("before")
    open_edges = ~F.col("before").rlike(r"[\p{L}0-9]$") & ~F.coalesce(F.col("after"), F.lit("")).rlike(r"^[\p{L}0-9]")
    usual = F.when(F.col("kind") == 0, F.length("value").between(6, 64)).when(F.col("kind") == 1, digits.between(4, 32)).when(F.col("kind") == 2, luhn(digits_of(F.col("value")))).otherwise(digits.between(10, 13))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    named = by_kind(GAZETTEER, low) > 0
    votes = {
        "strict": vote(F.col("base"), F.lit(False)),
        "gazetteer": vote(named, ~named),
        "context": vote(by_kind(CUES, before) > 0, others(before) > 0),
        "edges": vote(open_edges, ~open_edges),
        "digits": vote(usual, ~usual),
    }
    return kept.select("_row", "doc_id", "kind", "base", "start", "end", *(v.cast("int").alias(n) for n, v in votes.items()))


_MATCH = "array<struct<kind:int,strict:boolean,at:int,value:string,gap:int,before:string,after:string>>"


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities per labeler from EM and the weights of the logistic span classifier."""

    prior: tuple[float, ...]
    says_yes: dict[str, tuple[tuple[float, float, float], ...]]
    weights: tuple[float, ...]
    iterations: int


def _features(kind: int, votes: Sequence[int]) -> list[float]:
    return [1.0 if kind == i else 0.0 for i in range(len(KINDS))] + [float(v == s) for v in votes for s in (1, -1)]


def fit(patterns: Sequence[Row], rounds: int = 50, steps: int = 400) -> SpanModel:
    """Dawid-Skene over counted vote patterns, then a logistic classifier on the posteriors.

    Each labeler has the probabilities of yes, nothing, no given a true and a
    false candidate; each kind its own prior. Counts are smoothed by one vote,
    the start is the majority, and rounds end when posteriors move by less than
    1e-6.
    """
    data = [(r["kind"], tuple(r[n] for n in LABELERS), float(r["count"])) for r in patterns]
    post = [1 / (1 + math.exp(-sum(v))) for _, v, _ in data]
    prior = [0.5] * len(KINDS)
    rates = {n: ((1 / 3,) * 3, (1 / 3,) * 3) for n in LABELERS}
    used = 0
    for used in range(1, rounds + 1):
        for k in range(len(KINDS)):
            whole = sum(c for kind, _, c in data if kind == k)
            prior[k] = (sum(c * p for (kind, _, c), p in zip(data, post) if kind == k) + 1) / (whole + 2)
        for i, n in enumerate(LABELERS):
            table = []
            for truth in (1, 0):
                share = [(v[i], c * (p if truth else 1 - p)) for (_, v, c), p in zip(data, post)]
                base = sum(w for _, w in share) + 3
                table.append(tuple((sum(w for v, w in share if v == s) + 1) / base for s in (1, 0, -1)))
            rates[n] = tuple(table)
        moved, fresh = 0.0, []
        for (kind, votes, _), old in zip(data, post):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(rates[n][0][1 - v] / rates[n][1][1 - v]) for n, v in zip(LABELERS, votes))
            new = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            moved, fresh = max(moved, abs(new - old)), [*fresh, new]
        post = fresh
        if moved < 1e-6:
            break
    total = sum(c for *_, c in data) or 1.0
    weights = [0.0] * len(_features(0, (0,) * len(LABELERS)))
    rows = [(_features(kind, votes), c / total, p) for (kind, votes, c), p in zip(data, post)]
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for x, share, p in rows:
            error = share * (1 / (1 + math.exp(-sum(w * f for w, f in zip(weights, x)))) - p)
            slope = [s + error * f for s, f in zip(slope, x)]
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return SpanModel(tuple(prior), rates, tuple(weights), used)


def probability(model: SpanModel) -> Column:
    """The classifier as an expression over the columns of :func:`candidates`."""
    w = model.weights
    score = sum((F.when(F.col("kind") == i, w[i]).otherwise(0.0) for i in range(len(KINDS))), F.lit(0.0))
    for i, name in enumerate(LABELERS):
        at = len(KINDS) + 2 * i
        score = score + F.when(F.col(name) == 1, w[at]).when(F.col(name) == -1, w[at + 1]).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Personal data of every document.

    Returns one row per row of ``docs``: doc_id and ``found``, an array of
    start, kind (place in KINDS), end, base, probability sorted by start and
    kind. Positions are code points, ends exclusive. Base spans are always
    there; a loose candidate is if its probability reaches ``threshold``. Null
    text counts as empty; repeated rows are separate; no rows give no rows.
    """
    marked = materialise(candidates(docs, id_col, text_col), "candidates")
    patterns = marked.filter("kind IS NOT NULL").groupBy("kind", *LABELERS).count().collect()
    model = fit(sorted(patterns))
    scored = marked.withColumn("probability", probability(model))
    stays = F.col("kind").isNotNull() & (F.col("base") | (F.col("probability") >= threshold))
    span = F.struct("start", "kind", "end", "base", "probability")
    spans = scored.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(F.when(stays, span))).alias("found"))
    return spans.select("doc_id", "found")


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
