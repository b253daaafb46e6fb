"""Column expressions: null handling, scaling, classes and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x) -> Column:
    """NaN to NULL: Spark takes NaN for a value, and it would win every max."""
    return F.when(~F.isnan(_c(x)), _c(x))


def shown(x, digits: int = 2) -> Column:
    """Rounded for a view; rounded to nine places first, so that a tie doesn't depend on the order of a sum."""
    return F.round(F.round(_c(x), 9), digits)


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def round_even(x, digits: int | Column) -> Column:
    """Rounded to 0 to 15 places as the exact binary value is, halves to the even digit; ``digits`` may differ by row.

    2.675 is a little less than it looks and becomes 2.67; 0.125 is exact and becomes 0.12. ``F.round`` rounds the shortest
    decimal of a double, and halves away from 0. NULL, NaN, infinities and values without such places stay as they are.
    """
    x = _c(x).cast("double")
    scale = F.lit(float(10**digits)) if isinstance(digits, int) else F.get(F.array(*[F.lit(float(10**n)) for n in range(16)]), digits)
    # x * scale is p and a rest that p lacks, exactly: both factors are split into halves of 26 bits.
    first = F.struct(F.abs(x).alias("a"), scale.alias("s"), (F.abs(x) * scale).alias("p"), (F.abs(x) * 134217729.0).alias("ab"), (scale * 134217729.0).alias("sb"))
    high = lambda r: F.struct(*[r[k].alias(k) for k in "asp"], (r["ab"] - (r["ab"] - r["a"])).alias("ah"), (r["sb"] - (r["sb"] - r["s"])).alias("sh"))

    def rest(r: Column) -> Column:
        al, sl = r["a"] - r["ah"], r["s"] - r["sh"]
        exact = ((r["ah"] * r["sh"] - r["p"]) + r["ah"] * sl + al * r["sh"]) + al * sl
        return F.struct(r["s"].alias("s"), r["p"].alias("p"), F.floor(F.least(r["p"], F.lit(1e18))).cast("double").alias("low"), exact.alias("rest"))

    def final(r: Column) -> Column:
        d, odd = r["p"] - r["low"], r["low"] % 2 == 1
        up = (d > 0.5) | ((d == 0.5) & ((r["rest"] > 0) | ((r["rest"] == 0) & odd)))
        # From 2^52 on p is whole and its rest may be a half; from 2^53 on a double has no such places.
        up, down = up | ((d == 0) & (r["rest"] == 0.5) & odd), (d == 0) & (r["rest"] == -0.5) & odd
        out = (r["low"] + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / r["s"]
        return F.when(r["p"] < float(1 << 53), out)

    found = once(once(once(first, high), rest), final)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.coalesce(F.when(x < 0, -found).otherwise(found), x))


def log1p_clipped(x) -> Column:
    """ln(1 + x) with negatives clipped to 0; NULL stays NULL."""
    x = _c(x)
    return F.when(x.isNotNull(), F.ln(F.lit(1.0) + F.greatest(x, F.lit(0.0))))


def clipped(x, low, high) -> Column:
    """x within [low, high]; NULL stays NULL, as least() alone would not keep it."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, _c(low)), _c(high)))


def steady(x) -> Column:
    """To nine places, from 1000 on to five: what is left doesn't depend on the order of a sum."""
    x = _c(x)
    return F.when(F.abs(x) < 1000, F.round(x, 9)).otherwise(F.round(x, 5))


def steady_mean(x) -> Column:
    """An aggregate: the mean of the values there are, the same in whatever order they come.

    Values are summed as decimals, of six places where one is 1000 or above, else of nine; where all are below 1, or one is 1e18 or more
    or no number, as doubles. A mean that ends in a 5 (16 amounts in cents do) is then rounded alike in each run.
    """
    x = _c(x)
    top = F.max(F.abs(x))
    exact = lambda places: F.sum(x.try_cast(f"decimal(28, {places})")).cast("double") / F.count(x)
    return F.when((top >= 1000) & (top < 1e18), exact(6)).when((top >= 1) & (top < 1000), exact(9)).otherwise(F.avg(x))


def steady_sum(x, places: int) -> Column:
    """An aggregate: the sum, the same in whatever order values come, to ``places``; as doubles where a value doesn't fit 28 digits."""
    x = _c(x)
    exact = x.try_cast(f"decimal(28, {places})")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double")).otherwise(F.sum(x))


def correlation(a, b) -> Column:
    """An aggregate: the correlation of two columns over the rows that have both; NULL where one of them doesn't vary, for which ``F.corr`` stops the query."""
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ratio(top, bottom, per: float = 1000.0) -> Column:
    """top / bottom * per; NULL unless the bottom is above 0."""
    return F.when(_c(bottom) > 0, _c(top) / _c(bottom) * per)


def min_max(x, low, high, polarity) -> Column:
    """0 to 100 by polarity; 50 where all values are equal."""
    x, low, high = _c(x), _c(low), _c(high)
    up = (x - low) / (high - low) * 100
    return F.when(x.isNull(), None).when(high == low, 50.0).when(_c(polarity) == "negative", 100 - up).otherwise(up)


def steps(x, bounds: list[tuple[str, float, str]], rest: str | None) -> Column:
    """The label of the first bound that holds: (operator, bound, label)."""
    x, out = _c(x), None
    tests = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">=": lambda b: x >= b, ">": lambda b: x > b, "=": lambda b: x == b}
    for op, b, label in bounds:
        out = F.when(tests[op](b), label) if out is None else out.when(tests[op](b), label)
    return out.otherwise(rest)


def coverage_flag(pct) -> Column:
    return steps(pct, [("<", 0.5, "VERY SPARSE"), ("<", 0.75, "SPARSE")], "")


def rank_range_verdict(r) -> Column:
    return steps(r, [("<=", 5, "Stable"), ("<=", 12, "Moderate")], "Sensitive")


def rho_verdict(r) -> Column:
    return steps(r, [(">=", 0.95, "Highly robust"), (">=", 0.85, "Robust"), (">=", 0.70, "Moderate")], "Sensitive")


def shift_verdict(s) -> Column:
    return steps(s, [("<=", 3, "Stable"), ("<=", 8, "Moderate")], "Data-sensitive")


def fill_flag(pct_filled) -> Column:
    return steps(pct_filled, [("=", 0, "Excellent"), ("<", 0.15, "Good"), ("<", 0.30, "Moderate")], "Caution")


def traffic_light(score) -> Column:
    return F.when(_c(score).isNotNull(), steps(score, [(">=", 65, "Stable"), (">=", 35, "Moderate")], "Fragile"))


def overall_verdict(rho, n_sensitive) -> Column:
    return F.when(_c(n_sensitive) > 5, "Review").otherwise(steps(rho, [(">=", 0.90, "High"), (">=", 0.80, "Moderate")], "Low"))


def tolerance_status(diff, ok: float, warn: float) -> Column:
    """PASS, WARN or FAIL for an absolute difference; NULL fails."""
    return F.when(_c(diff) <= ok, "PASS").when(_c(diff) <= warn, "WARN").otherwise("FAIL")


def side_status(left, right, tol: float = 1e-9) -> Column:
    """Presence in a full outer comparison: left_only, right_only, changed or both."""
    left, right = _c(left), _c(right)
    return (
        F.when(right.isNull() & left.isNotNull(), "left_only")
        .when(left.isNull() & right.isNotNull(), "right_only")
        .when(F.abs(left - right) > tol, "changed")
        .otherwise("both")
    )


def confidence_half(pct_filled) -> Column:
    return 2 + 26.7 * _c(pct_filled)


def tiered_number(x, table: bool = False) -> Column:
    """A number as text, with fewer decimals the larger it is; in tables one more between 1 and 100.

    Below a thousandth: four significant digits without closing zeros, as a power of ten below a ten-thousandth. Digits are those of
    the exact binary value, halves to the even digit.
    """
    x = _c(x)
    a = F.abs(x)
    places = F.when(a >= 10000, 0).when(a >= 100, 1).when(a >= 1, 3 if table else 2).when(a >= 0.001, 4).otherwise(7)

    def text(r: Column) -> Column:
        of = lambda n: F.format_string(f"%.{n}f", r)
        plain = F.when(a >= 10000, F.format_number(r, 0)).when(a >= 100, F.format_number(r, 1)).when(a >= 1, of(3 if table else 2)).when(a >= 0.001, of(4))
        return plain.otherwise(F.regexp_replace(of(7), "\\.?0+$", ""))

    power = F.regexp_replace(F.format_string("%.3e", x), "\\.?0+e", "e")
    return F.when(x.isNull(), None).when(a == 0, "0").when(a < 0.0001, power).otherwise(once(round_even(x, places), text))


def elapsed_days(day, today: Column | None = None) -> Column:
    """Whole days from a date to today."""
    return F.date_diff(F.current_date() if today is None else today, _c(day))
