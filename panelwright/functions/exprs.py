"""Column expressions of the feature jobs. Null in means null out unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d where d > 0, else null."""
    return F.when(c(d) > 0, c(n) / c(d))


def filled(x: Column | str, value=0) -> Column:
    return F.coalesce(c(x), F.lit(value))


def lenient(x: Column | str, kind: str = "double") -> Column:
    """A cast that gives null where it fails; NaN becomes null, too."""
    got = c(x).try_cast(kind)
    return F.when(~F.isnan(got), got) if kind in ("double", "float") else got


def strict(x: Column | str, kind: str = "double") -> Column:
    return c(x).cast(kind)


def score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of measures, a missing one counting 0."""
    return reduce(add, (F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * F.lit(float(w)) for k, w in weights.items()))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds. greatest() and least() skip nulls, so a null is kept apart."""
    out = c(x)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c(x).isNotNull(), out)


def knots(x: Column | str, apex: float) -> tuple[Column, Column]:
    """x up to the apex, and what is beyond it."""
    return clip(x, high=apex), clip(c(x) - apex, low=0.0)


def hinge(x: Column | str, at: float) -> Column:
    return clip(c(x) - at, low=0.0)


def gate(x: Column | str, start: float, width: float) -> Column:
    """0 to 1: how far x is past start, in widths."""
    return clip((c(x) - start) / width, 0.0, 1.0)


def log_amount(x: Column | str) -> Column:
    return F.log1p(clip(x, low=0.0))


def buckets(x: Column | str, edges: Sequence[float], names: Sequence[str], missing: str | None = None) -> Column:
    """names[i] below edges[i] (left-closed), the last name from the last edge on."""
    out = F.when(c(x).isNull(), F.lit(missing))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(c(x) < edge, F.lit(name))
    return out.otherwise(F.lit(names[len(edges)]))


def change_class(now: Column | str, was: Column | str, by: float) -> Column:
    """expanded, collapsed or stable against the value before; null without both."""
    return F.when(c(now) >= c(was) * (1 + by), "expanded").when(c(now) <= c(was) * (1 - by), "collapsed").when(c(now).isNotNull() & c(was).isNotNull(), "stable")


def changed(a: Column | str, b: Column | str) -> Column:
    return (c(a) != c(b)).cast("int")


def renamed(x: Column | str, aliases: Mapping[str, str]) -> Column:
    """x with old codes replaced by new ones."""
    if not aliases:
        return c(x)
    table = F.create_map(*(F.lit(v) for pair in aliases.items() for v in pair))
    return F.coalesce(F.try_element_at(table, c(x)), c(x))


def age_at(birth: Column | str, year: Column | str, month: int = 9, day: int = 1) -> Column:
    """Whole years at a cutoff; a birthday strictly after the cutoff has not come yet."""
    b = c(birth)
    late = (F.month(b) > month) | ((F.month(b) == month) & (F.dayofmonth(b) > day))
    return c(year) - F.year(b) - late.cast("int")


def fractional_age(birth: Column | str, year: Column | str, month: int = 9, day: int = 1) -> Column:
    return F.datediff(F.make_date(c(year), F.lit(month), F.lit(day)), c(birth)) / F.lit(365.2425)


def experience(period: Column | str, first: Column | str, clipped: bool = False) -> Column:
    """Periods since the first; before it null, or 0 if clipped."""
    x = c(period) - c(first)
    return clip(x, low=0) if clipped else F.when(x >= 0, x)


def one_of(label: Column | str, values: Sequence[str]) -> list[Column]:
    """0/1 columns, one a value; exactly one is 1 for every label among the values."""
    return [(c(label) == v).cast("int").alias(f"is_{v}") for v in values]


def flag(condition: Column) -> Column:
    """0/1, unknown counting 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def missing_count(columns: Sequence[str]) -> Column:
    return reduce(add, (F.isnull(x).cast("int") for x in columns))


def any_missing(columns: Sequence[str]) -> Column:
    return missing_count(columns) > 0


def availability(games: Column | str, period: Column | str, change: int = 2021, before: int = 16, after: int = 17) -> Column:
    """Occurrences over those scheduled, at most 1."""
    return clip(c(games) / F.when(c(period) >= change, float(after)).otherwise(float(before)), high=1.0)


def rank_score(rank: Column | str, n: int, best_first: bool = True) -> Column:
    """Rank 1..n as 1..0, or the other way round."""
    x = (c(rank) - 1) / F.lit(float(n - 1))
    return 1 - x if best_first else x


def close(a: Column | str, b: Column | str, within: float = 1e-10) -> Column:
    return F.abs(c(a) - c(b)) <= within


def represented(components: Column, a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Two inputs: a and b where components holds, else their total and the share of a in it."""
    x, y = c(a).cast("double"), c(b).cast("double")
    return F.when(components, x).otherwise(x + y), F.when(components, y).otherwise(F.try_divide(x, x + y))


def exclusive(flags: Sequence[Column]) -> Column:
    """A condition that always holds, and fails the job where not exactly one flag is set."""
    return F.assert_true(reduce(add, (flag(x) for x in flags)) == 1, F.lit("not exactly one flag is set")).isNull()


def implied_share(parts: Column, shares: Column) -> Column:
    """Sum of parts over the sum of the totals that each share implies, at most 1. An aggregate."""
    total = F.sum(F.when(shares > 0, parts / shares))
    return clip(F.when(total > 0, F.sum(F.when(shares > 0, parts)) / total), high=1.0)


# Letters with marks and what they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def ascii_folded(x: Column | str) -> Column:
    """Marks dropped; any other character outside ASCII dropped."""
    return F.regexp_replace(F.translate(c(x), MARKED, FOLDED), r"[^\x00-\x7F]", "")


def compact_key(name: Column | str) -> Column:
    """Letters and digits only, without generation words anywhere in the name."""
    low = F.lower(ascii_folded(name))
    return F.regexp_replace(F.regexp_replace(low, r"\b(jr|sr|ii|iii|iv)\b", ""), "[^a-z0-9]", "")


def spaced_key(name: Column | str) -> Column:
    """Words of letters and digits, apostrophes and dots deleted, without trailing generation words."""
    low = F.regexp_replace(F.lower(ascii_folded(name)), "['.]", "")
    words = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"( (jr|sr|ii|iii|iv|v))+$", "")
