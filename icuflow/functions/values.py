"""Scalar expressions: ranges, units, text, codes, dates, bins and encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from icuflow.rules import diagnoses as dx

# ---------------------------------------------------------------------------- ranges, units


def in_range(value: Column, low=None, low_closed=False, high=None, high_closed=False) -> Column:
    """Value when plausible, else null; each bound open or closed, ``None`` for no bound."""
    tests = []
    if low is not None:
        tests.append(value >= low if low_closed else value > low)
    if high is not None:
        tests.append(value <= high if high_closed else value < high)
    return F.when(reduce(lambda a, b: a & b, tests), value) if tests else value


def fahrenheit_to_celsius(value: Column) -> Column:
    return (value - 32) / 1.8


def flag(test: Column) -> Column:
    """1 where the test holds, 0 where it does not or is unknown."""
    return F.when(test, 1).otherwise(0)


def cap_flag(count: Column) -> Column:
    """Counts to 0/1."""
    return F.least(count, F.lit(1))


# ------------------------------------------------------------------------------ text, codes


def in_code_ranges(code: Column, ranges) -> Column:
    """Code inside one of the closed string ranges; blanks are significant."""
    return reduce(lambda a, b: a | b, (code.between(lo, hi) for lo, hi in ranges))


def code_prefix_number(code: Column) -> Column:
    """Number in the first three characters, null unless they are digits only."""
    prefix = F.substring(code, 1, 3)
    return F.when(prefix.rlike("^[0-9]+$"), prefix.try_cast("int"))


def chapter(number: Column) -> Column:
    """Chapter label of a three-digit code; both bounds of a chapter are exclusive."""
    chain = F
    for low, high, label in dx.CHAPTERS:
        chain = chain.when((number > low) & (number < high), label)
    return chain.otherwise(dx.OTHER_CHAPTER)


def capture(text: Column, pattern: str) -> Column:
    """First group of the first match over the whole text, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def masked_number(text: Column) -> Column:
    """Number in a captured text; null when it is masked with ``*`` or not a number."""
    return F.when(~text.contains("*"), F.trim(text).try_cast("double"))


def parse_time(text: Column, fmt: str) -> Column:
    """Text to timestamp by format, null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


# ------------------------------------------------------------------------------------ dates


def epoch(time: Column) -> Column:
    """Whole seconds since 1970 (session time zone UTC)."""
    return F.unix_seconds(time.cast("timestamp"))


def micros(time: Column) -> Column:
    """Whole microseconds since 1970 (session time zone UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def plus(time: Column, **parts: int) -> Column:
    """Timestamp shifted by a constant number of ``days``, ``hours``, ``minutes`` or ``seconds``."""
    return time + F.make_dt_interval(
        *[F.lit(parts.get(p, 0)) for p in ("days", "hours", "minutes", "seconds")]
    )


def plus_seconds(time: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, time)


def within_days(time: Column, start: Column, first: int, last: int) -> Column:
    """Calendar day of ``time`` between ``first`` and ``last`` days after the day of ``start``."""
    day = F.to_date(time)
    return day.between(F.date_add(F.to_date(start), first), F.date_add(F.to_date(start), last))


def years_by_boundary(later: Column, earlier: Column) -> Column:
    """Age as the number of year boundaries crossed."""
    return F.year(later) - F.year(earlier)


def years_fractional(later: Column, earlier: Column) -> Column:
    return F.date_diff(F.to_date(later), F.to_date(earlier)) / F.lit(dx.DAYS_PER_YEAR)


def whole_hours(later: Column, earlier: Column) -> Column:
    """Hours between two times, truncated."""
    return ((epoch(later) - epoch(earlier)) / 3600).cast("long")


def hours(later: Column, earlier: Column) -> Column:
    return (epoch(later) - epoch(earlier)) / 3600


# ------------------------------------------------------------------------------ bins, encodings


def banded(value: Column, bands, above) -> Column:
    """Label of the first band whose upper bound is not exceeded."""
    chain = F
    for high, label in bands:
        chain = chain.when(value <= high, label)
    return chain.when(value > bands[-1][0], above)


def rate_bin(rate: Column, bins, rest=None) -> Column:
    chain = F
    for least, label in bins:
        chain = chain.when(rate >= least, label)
    return chain.otherwise(rest)


def one_hot(col: Column, categories, prefix: str, drop_first: bool = True) -> list[Column]:
    """0/1 columns per fitted category; an unknown or null value is all zero."""
    kept = sorted(categories)[1:] if drop_first else sorted(categories)
    return [flag(col == c).alias(f"{prefix}{c}") for c in kept]


def first_set_flag(flags: dict[str, Column], rest: str) -> Column:
    """Name of the first flag that is 1 (reverse one-hot)."""
    chain = F
    for name, value in flags.items():
        chain = chain.when(value == 1, name)
    return chain.otherwise(rest)


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, zero for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def hashed_uniform(key: Column, purpose: str) -> Column:
    """Repeatable draw in [0, 1) from an id of any type, in place of an unseeded generator.

    The first 48 bits of the MD5 of ``purpose|id``: draws for different purposes are independent, so a split, a balance order and
    folds of the same ids don't follow from each other. A null id has a null draw.
    """
    digest = F.md5(F.concat(F.lit(f"{purpose}|"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)


# ----------------------------------------------------------------------- class probabilities


def reweight(prob: Column, population: float, training: float) -> Column:
    """Move a probability from the training prior to the population prior."""
    up = prob * (population / training)
    down = (1 - prob) * ((1 - population) / (1 - training))
    return up / (up + down)


def _column(x):
    return x if isinstance(x, Column) else F.lit(x)


def reweight_classes(probs: list[Column], population: list, training: list) -> list[Column]:
    scaled = [p * (_column(q) / _column(r)) for p, q, r in zip(probs, population, training)]
    norm = reduce(lambda a, b: a + b, scaled)
    return [s / norm for s in scaled]


def argmax_class(probs: list[Column]) -> Column:
    """Index of the largest probability, the lowest index on ties."""
    best = F.greatest(*probs)
    chain = F
    for i, p in enumerate(probs[:-1]):
        chain = chain.when(p == best, i)
    return chain.otherwise(len(probs) - 1)


def cautious_class(probs: list[Column], factor: float = 10.0) -> Column:
    """Three classes: class 2 is only called over class 1 when ``factor`` times as likely."""
    top = argmax_class(probs)
    return F.when(top.isin(0, 1), top).when(probs[2] > factor * probs[1], 2).otherwise(1)
