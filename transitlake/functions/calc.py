"""Column expressions shared by the reports.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Report output labels and thresholds.
POLLUTION_BANDS = ((400, "faible"), (500, "moyen"))
POLLUTION_ELSE = "élevé"
DELAY_BANDS = ((6.5, "retard moyen inf a 6min30"), (7, "retard moyen inf a 7min"))
DELAY_ELSE = "retard moyen sup a 7min"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """x / y with NULL on a zero or NULL divisor (SQLite semantics), as double."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def nan_to_null(c) -> Column:
    """NaN becomes NULL (what the CSV writer of the reference prints as empty)."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def null_to_nan(c) -> Column:
    """The document profile stores a missing number as NaN (pandas → documents)."""
    return F.coalesce(col_(c).cast("double"), F.lit(float("nan")))


def day_of(ts) -> Column:
    """Calendar day of a timestamp as 'yyyy-MM-dd' text; NULL stays NULL."""
    return F.date_format(col_(ts), "yyyy-MM-dd")


def parse_ts(text) -> Column:
    """Lenient parse of date/time text; NULL on bad input (never raises under ANSI)."""
    return F.try_to_timestamp(col_(text)).cast("timestamp_ntz")


def parse_ts_strict(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Strict parse: under ANSI mode a malformed value fails the job (the
    load step of the reference stops on a bad date)."""
    return F.to_timestamp_ntz(col_(text), F.lit(fmt))


def day_of_text(text) -> Column:
    return day_of(parse_ts(text))


def band(value, bands, otherwise: str) -> Column:
    """CASE WHEN v < t1 THEN l1 WHEN v < t2 THEN l2 ... ELSE otherwise END (NULL → ELSE)."""
    v = col_(value)
    expr = None
    for threshold, label in bands:
        expr = F.when(v < threshold, label) if expr is None else expr.when(v < threshold, label)
    return expr.otherwise(otherwise)


def pollution_level(value) -> Column:
    return band(value, POLLUTION_BANDS, POLLUTION_ELSE)


def pollution_level_doc(value) -> Column:
    """Document-profile band: a stored NaN compares below every number there."""
    v = col_(value)
    return F.when(F.isnan(v) | v.isNull(), POLLUTION_BANDS[0][1]).otherwise(pollution_level(v))


def delay_class(avg) -> Column:
    return band(avg, DELAY_BANDS, DELAY_ELSE)


def int_div_trunc(a, b) -> Column:
    """Exact a / b truncating toward zero for decimal(38,0) operands; NULL when b is 0."""
    a, b = col_(a), col_(b)
    return F.when(b != 0, (a - a % b) / b)


def pearson(n, sx, sy, sxx, syy, sxy, truncate_y: bool = False) -> Column:
    """Closed-form Pearson correlation from moment sums.

    (Sxy - Sx*Sy/N) / sqrt((Sxx - Sx^2/N) * (Syy - Sy^2/N)); NULL when a
    variance is zero or N is zero (never an error, unlike ``corr`` under ANSI).
    ``truncate_y`` reproduces SQL engines that evaluate
    ``SUM(int)*SUM(int)/COUNT(*)`` in integer arithmetic: N, Sy and Syy are
    decimal(38,0) sums, the product and the division are exact, and a value
    beyond 38 digits fails the query instead of changing it.
    """
    n, sx, sy, sxx, syy, sxy = (col_(c) for c in (n, sx, sy, sxx, syy, sxy))
    nd = n.cast("double")
    cov = sxy - F.try_divide(sx * sy, nd)
    vx = sxx - F.try_divide(sx * sx, nd)
    if truncate_y:
        exact = sy.cast("decimal(38,0)")
        vy = syy.cast("double") - int_div_trunc(exact * exact, n.cast("decimal(38,0)")).cast("double")
    else:
        syd = sy.cast("double")
        vy = syy.cast("double") - F.try_divide(syd * syd, nd)
    denom = F.sqrt(F.greatest(vx * vy, F.lit(0.0)))
    return F.when(denom > 0, cov / denom)
