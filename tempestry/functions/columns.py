"""Pure Column helpers. Null rules are stated per helper; NaN is turned into null by `denan` at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df with cols, each evaluated once a row however often it is used above.

    A one-row generator stands between: the optimizer merges projections that only take parts out of a struct, and would
    then repeat costly expressions (regular expressions, JSON) at every use; across a generator it doesn't."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def denan(c: Column) -> Column:
    """NaN becomes null; everything else stays."""
    return F.when(~F.isnan(c), c)


def flag(cond: Column) -> Column:
    """1 where cond is true, else 0; a null comparison counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(a: Column, b: Column, positive: bool = True) -> Column:
    """a / b, null where b is null or not positive (or 0, with positive=False)."""
    ok = (b > 0) if positive else (b != 0)
    return F.when(ok, F.try_divide(a.cast("double"), b.cast("double")))


def null_greatest(a: Column, b: Column) -> Column:
    """The larger of both, null if either is null (the builtin skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(c: Column, lo: float, hi: float) -> Column:
    """c held in [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    """The one window specification that all row-based operators of a panel share."""
    return Window.partitionBy(*keys).orderBy(*order)


def roll(fn, c: Column, w: WindowSpec, n: int) -> Column:
    """fn over the last n rows including this one; null only if all n are null."""
    return fn(c).over(w.rowsBetween(-(n - 1), 0))


def roll_std(c: Column, w: WindowSpec, n: int) -> Column:
    """Sample deviation over n rows, null unless all n are there and not null."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) == n, F.stddev_samp(c).over(f))


def ffill(c: Column, w: WindowSpec) -> Column:
    """The last non-null value so far; leading nulls stay."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(c: Column, w: WindowSpec) -> Column:
    """The next non-null value; trailing nulls stay."""
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(c: Column, rn: Column, w: WindowSpec) -> Column:
    """Linear by row position (rn: the row's number); a trailing gap holds the last value, a leading gap stays null."""
    at = F.when(c.isNotNull(), rn)
    px, nx, p, n = ffill(c, w), bfill(c, w), ffill(at, w), bfill(at, w)
    return F.coalesce(c, px + (nx - px) * F.try_divide((rn - p).cast("double"), (n - p).cast("double")), px)


def streak_parts(cond: Column, w: WindowSpec) -> tuple[Column, Column]:
    """(0/1 flag, 1 where the flag changes against the row before) for gaps and islands."""
    f = flag(cond)
    return f, F.coalesce((f != F.lag(f).over(w)).cast("int"), F.lit(1))


def days_since(day: Column, cond: Column, w: WindowSpec, never: int = 999) -> Column:
    """Days since the last row on which cond held; `never` before the first."""
    last = F.last(F.when(cond, day), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.datediff(day, last), F.lit(never))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null for fewer than two rows or a constant side."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bias_corrected_skew(c: Column) -> Column:
    """Sample-corrected skewness; null under three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def average_rank(value: Column, keys: list, name: str) -> Column:
    """Rank of value within keys, ties sharing their mean rank; null for null values."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0).alias(name)


def utc_midnight(day: Column) -> Column:
    """The instant at which the day begins in UTC, whatever the session's zone."""
    return F.timestamp_seconds(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400)


def utc_day(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def fips5(c: Column) -> Column:
    """A county code rid of its spelling: five digits, or null if it can't be one.

    Blanks and a leading FIPS: (any case) go; up to five digits are padded with zeros on the left."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", ""), "^FIPS:?", "")
    return F.when(t.rlike(r"^\d{1,5}$"), F.lpad(t, 5, "0"))


def latest(value: Column, order: Column) -> Column:
    """Aggregate: value of the row with the latest order; among ties the largest value, so the result is fixed."""
    return F.max_by(value, F.struct(order, value))
