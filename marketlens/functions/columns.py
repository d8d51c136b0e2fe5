"""Column expressions. All stay in the JVM; none needs a Python worker."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Amounts of a row: up to 20 digits before the point and 8 after it. Their sums have 10 more digits.
MONEY = "decimal(28,8)"
MICROS_PER_DAY = 86_400_000_000


def money(col: str | Column) -> Column:
    """A money amount as an exact decimal. Text that is no number becomes null, as does NaN; an amount too
    large for the type is an error."""
    col = _col(col)
    exact, number = col.try_cast(MONEY), col.try_cast("double")
    wide = number.isNotNull() & ~F.isnan(number) & exact.isNull()
    message = F.concat(F.lit(f"amount does not fit {MONEY}: "), col.cast("string"))
    return F.when(wide, F.raise_error(message).cast(MONEY)).otherwise(exact)


def amount(df: DataFrame, name: str) -> Column:
    """A money column with all its digits: decimals as they are, anything else as ``money``."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, T.DecimalType) else money(name)


def timestamp(col: str | Column) -> Column:
    """A zone-free timestamp; text that is no date becomes null."""
    return _col(col).try_cast("timestamp_ntz")


def total(col: Column) -> Column:
    """Sum as a double, 0 for no values. Decimals are added exactly and cast last."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("double")


def weighted_total(df: DataFrame, name: str, weight: str) -> Column:
    """Sum of a column times a whole-number weight, as a double with the exact sum behind it.

    A product of decimals has more digits than the type holds and would lose its last ones silently. Here
    the amounts become whole numbers of their smallest unit; what is then too large for 38 digits is an error.
    """
    kind, n = df.schema[name].dataType, F.col(weight).cast("decimal(20,0)")
    if not isinstance(kind, T.DecimalType):
        return F.sum(F.col(name) * F.col(weight)).cast("double")
    whole, places = F.floor(name), kind.scale
    if places == 0:
        return F.sum(F.col(name) * n).cast("double")
    unit = 10**places
    part = (F.col(name) - whole).cast(f"decimal({places + 1},{places})")
    units = (part * F.lit(unit).cast(f"decimal({places + 1},0)")).cast(f"decimal({places},0)")
    low = F.sum(units.cast("decimal(18,0)") * n)
    rest = low % F.lit(unit).cast("decimal(38,0)")
    carried = ((low - rest) / F.lit(unit).cast("decimal(38,0)")).cast(f"decimal({37 - places},0)")
    high = (F.sum(whole * n) + carried).cast(f"decimal(37,{places})")
    fraction = rest.cast(f"decimal({places},0)") * F.lit(f"0.{'0' * (places - 1)}1").cast(f"decimal({places},{places})")
    return (high + fraction.cast(f"decimal({2 * places},{places})")).cast("double")


def mean(col: Column) -> Column:
    """Mean of the non-null values as a double, null for none.

    ``avg`` of a decimal would round to a few more digits than its input.
    """
    return ratio(F.sum(col), F.count(col))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; null instead of an error for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_start(day: dt.date | str) -> Column:
    """Midnight of a day as a zone-free literal, so that range filters reach the scan."""
    return F.lit(f"{_date(day).isoformat()} 00:00:00").cast("timestamp_ntz")


def within_days(ts: Column, start: dt.date | str, end: dt.date | str) -> Column:
    """Calendar day of ``ts`` in [start, end], written as a range on ``ts`` itself."""
    return (ts >= day_start(start)) & (ts < day_start(_date(end) + dt.timedelta(days=1)))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed 24-hour days, floored: one hour back in time is -1.

    Exact for spans below 270 years, where the microseconds fit a double.
    """
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("bigint")


def growth_pct(current: Column, previous: Column) -> Column:
    """Percent change against a positive previous value, else null."""
    current, previous = current.cast("double"), previous.cast("double")
    return F.when(previous > 0, F.try_divide(current - previous, previous) * 100)


def growth_label(pct: Column, cap: int = 999) -> Column:
    """'12.3%', '999%+' from the cap on and for NaN, 'N/A' without a growth figure."""
    return (
        F.when(pct.isNull(), "N/A")
        .when(pct < cap, F.concat(fixed(pct, "0.0"), F.lit("%")))
        .otherwise(f"{cap}%+")
    )


def fixed(col: Column, pattern: str) -> Column:
    """Number as text by a decimal pattern, ties on the binary value half to even."""
    return F.call_function("format_number", col, F.lit(pattern))


def shortened(text: Column, limit: int) -> Column:
    """Text as shown in a table cell: longer ones end in '...'."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day
