"""Threshold ladders: ordered grade steps compiled to one CASE expression."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from icuflow.rules.scores import ANY, Grade


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS INT)"
    return f"'{value}'" if isinstance(value, str) else f"{value!r}D" if isinstance(value, float) else repr(value)


def condition(tests) -> str:
    """All tests hold, or any of them when the first entry is ``ANY``."""
    word = " AND "
    if tests[0] == ANY:
        word, tests = " OR ", tests[1:]
    return word.join(f"({name} {op} {_literal(bound)})" for name, op, bound in tests)


def _case(steps, rest: str) -> Column:
    return F.expr("CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in steps) + f" ELSE {rest} END")


def _blank(grade: Grade) -> str:
    return f"coalesce({', '.join(grade.blank)}) IS NULL"


def points(grade: Grade) -> Column:
    """Points of one graded part; null when its inputs are blank.

    Built as SQL text from the rule table: one expression per part instead of hundreds of calls.
    """
    steps = [(condition(step[1:]), _literal(step[0])) for step in grade.steps]
    if grade.blank:
        steps.insert(len(steps) if grade.blank_last else 0, (_blank(grade), _literal(None)))
    return _case(steps, _literal(grade.rest))


def deciding_value(grade: Grade) -> Column:
    """The extreme that decided the grade, or the midpoint when nothing did."""
    measure = grade.blank[0].rsplit("_", 1)[0]
    steps = [(_blank(grade), "CAST(NULL AS DOUBLE)")]
    steps += [(condition(step[1:]), step[1][0]) for step in grade.steps]
    return _case(steps, f"({measure}_min + {measure}_max) / 2")


def total(parts) -> Column:
    """Sum of the parts, a missing part counting as zero."""
    return reduce(add, (F.coalesce(F.col(p), F.lit(0)) for p in parts))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
