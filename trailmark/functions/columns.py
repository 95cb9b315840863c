"""Column expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event names, weights and category orders of the data model.
FUNNEL = ("view", "addtocart", "transaction")
EVENT_WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
GAP_BREAKS_MIN = (5, 10, 30, 60, 120, 1440, 10080, 43200)

# Patterns of property values and their tokens; under (?U) \w, \d, \s and \b follow Unicode.
SPACE = r"(?U)\s+"
ENCODED_NUMBER_IN_TEXT = r"(?U)\bn-?\d+\.\d{3}\b"
PLAIN_HASH_IN_TEXT = r"(?U)(?<![\w.])\d+(?![\w.])"
ENCODED_NUMBER = r"(?U)^n-?\d+\.\d{3}$"
NUMBER_VARIANT = r"(?U)^n-?\d+(\.\d+)?$"
PLAIN_HASH = r"(?U)^\d+$"

# Class names of property values, tokens and visitors.
GRAMMARS = (
    "special_categoryid",
    "special_available",
    "mixed_hashed_text_and_numeric",
    "multi_hashed_text_tokens",
    "single_hashed_text_token",
    "encoded_numeric_only",
    "other_or_unexpected",
)
TOKEN_TYPES = ("encoded_numeric_token", "hashed_text_token", "numeric_token_variant", "unexpected_token")
PROFILES = ("buyer", "cart_intent", "recurring_browser", "cold_or_single_view")


def epoch_ms(time: Column) -> Column:
    """Milliseconds since the epoch of a timestamp, zoned or not (session time zone UTC)."""
    return F.unix_millis(time.cast("timestamp"))


def event_time(ms: str = "timestamp") -> Column:
    return F.timestamp_millis(F.col(ms))


def minutes_between(later: str, earlier: str) -> Column:
    """Minutes between two epoch-ms columns, as a double."""
    return (F.col(later) - F.col(earlier)) / F.lit(60000.0)


def event_weight(event: str, weights: Mapping[str, float] = EVENT_WEIGHTS, unknown: float | None = None) -> Column:
    expression = F.lit(unknown).cast("float")
    for name, weight in weights.items():
        expression = F.when(F.col(event) == name, F.lit(weight).cast("float")).otherwise(expression)
    return expression


def is_event(event: str, *names: str) -> Column:
    return F.col(event).isin(*names).cast("int")


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """100 * part / whole, 0 when ``whole`` is 0."""
    value = F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def lenient_long(value: str) -> Column:
    """Whole number of a string, null when it is none."""
    return F.col(value).try_cast("bigint")


def clip(value: Column, upper: float) -> Column:
    return F.least(value, F.lit(upper))


def whole_units(value: Column, per_one: float) -> Column:
    """A value as a whole number of units, ``per_one`` of which make 1; halves up.

    Sums of whole numbers do not depend on the order of rows, so scores built
    from them tie and rank the same on every run.
    """
    return F.floor(value * F.lit(float(per_one)) + F.lit(0.5))


def right_closed_bin(value: str, breaks: Sequence[float] = GAP_BREAKS_MIN) -> Column:
    """Index of the bin ``(a, b]`` a value falls in; the first bin is open below, the last above."""
    expression = F.lit(len(breaks))
    for index in reversed(range(len(breaks))):
        expression = F.when(F.col(value) <= breaks[index], index).otherwise(expression)
    return expression


def bin_label(index: str, breaks: Sequence[float] = GAP_BREAKS_MIN) -> Column:
    edges = ["-inf", *(str(b) for b in breaks), "inf"]
    labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    return F.element_at(F.array(*map(F.lit, labels)), F.col(index) + 1)


def date_parts(time: str) -> dict[str, Column]:
    return {
        "event_month": F.date_format(time, "yyyy-MM"),
        "event_dayofweek": F.weekday(time),
        "event_hour": F.hour(time),
    }


def behaviour_profile(total: Column, carts: Column, purchases: Column) -> Column:
    """The strongest signal wins: buyer, then cart intent, then five or more events."""
    return (
        F.when(purchases > 0, PROFILES[0])
        .when(carts > 0, PROFILES[1])
        .when(total >= 5, PROFILES[2])
        .otherwise(PROFILES[3])
    )


def outcome_signature(flags: Mapping[str, Column]) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f"{name}="), flag.cast("string")) for name, flag in flags.items()))


# ---------------------------------------------------------------- deterministic draws


def draw(seed: int, *parts: Column | str) -> Column:
    """A 60-bit non-negative number from md5 over the seed and the given values."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p) if isinstance(p, str) else p for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted(seed: int, key: str, place: Column, size: Column) -> Column:
    """Where ``place`` of 0 .. size-1 goes in a permutation of these numbers, one permutation per seed and key.

    The numbers are written as left * b + right with a * b >= size and a as near
    the square root as can be; four rounds add a draw over one half to the other,
    which can be undone and so hits every number once. A number that lands at or
    beyond ``size`` is sent on until it lands inside; fewer than a numbers lie there.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.floor((size + a - 1) / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for turn in range(4):
            other = right if turn % 2 == 0 else left
            token = draw(seed, F.col(key).cast("string"), F.lit(str(turn)), other.cast("string"))
            if turn % 2 == 0:
                left = F.pmod(left + token, a)
            else:
                right = F.pmod(right + token, b)
        return left * b + right

    first = once(place)
    again = F.aggregate(F.sequence(F.lit(0).cast("long"), a * b - size), first, lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.when(first < size, first).otherwise(again)


# ---------------------------------------------------------------- property values


def value_tokens(value: str) -> Column:
    parts = F.split(F.coalesce(F.col(value), F.lit("")), SPACE)
    return F.filter(parts, lambda token: token != "")


def encoded_number_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ENCODED_NUMBER_IN_TEXT))


def plain_hash_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLAIN_HASH_IN_TEXT))


def value_grammar(prop: str, tokens: str, numbers: str, hashes: str) -> Column:
    """Seven classes; the special properties come first, then mixed values, then pure ones.

    A value without tokens counts as numeric: zero numbers out of zero tokens.
    """
    n, number, plain = F.col(tokens), F.col(numbers), F.col(hashes)
    return (
        F.when(F.col(prop) == "categoryid", GRAMMARS[0])
        .when(F.col(prop) == "available", GRAMMARS[1])
        .when((number > 0) & (plain > 0), GRAMMARS[2])
        .when((plain == n) & (n > 1), GRAMMARS[3])
        .when((plain == n) & (n == 1), GRAMMARS[4])
        .when(number == n, GRAMMARS[5])
        .otherwise(GRAMMARS[6])
    )


def token_type(token: str) -> Column:
    text = F.lower(F.col(token))
    return (
        F.when(text.rlike(ENCODED_NUMBER), TOKEN_TYPES[0])
        .when(text.rlike(PLAIN_HASH), TOKEN_TYPES[1])
        .when(text.rlike(NUMBER_VARIANT), TOKEN_TYPES[2])
        .otherwise(TOKEN_TYPES[3])
    )


def decode_number(token: str) -> Column:
    """The number behind an ``n``-prefixed token, null for other tokens."""
    return F.regexp_replace(F.col(token), "^n", "").try_cast("double")


# ---------------------------------------------------------------- metric names


def metric_column(name: str) -> Column:
    """``metric@K`` as a column-safe name, ``metric_at_K``."""
    return F.replace(F.col(name), F.lit("@"), F.lit("_at_"))


def metric_k(name: str) -> Column:
    """The K of ``metric@K``, null when the name carries none."""
    return F.nullif(F.regexp_extract(F.col(name), r"@(\d+)$", 1), F.lit("")).cast("int")
