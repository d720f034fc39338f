"""Intervals, quarters, bins and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds that stand for open ends of intervals.
OPEN_START, OPEN_END = "0001-01-01", "3000-12-31"


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def expand_quarters(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per quarter that a closed interval touches: an exploded equi-key instead of a range join.

    Adds ``q_start``, ``q_end``, ``quarter``. A null end means the start; rows without a start are dropped.
    """
    last = F.coalesce(F.col(end), F.col(start))
    quarters = F.sequence(quarter_start(F.col(start)), quarter_start(last), F.expr("interval 3 months"))
    out = df.where(F.col(start).isNotNull() & (last >= F.col(start))).select("*", F.explode(quarters).alias("q_start"))
    return out.withColumns({"q_end": quarter_end(F.col("q_start")), "quarter": quarter_label(F.col("q_start"))})


def clamp(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Intersection of two closed intervals."""
    return F.greatest(start, low), F.least(end, high)


def completed(start: Column, end: Column) -> tuple[Column, Column]:
    """Open ends become sentinels, a reversed interval its start alone."""
    s = F.coalesce(start, F.lit(OPEN_START).cast("date"))
    e = F.coalesce(end, F.lit(OPEN_END).cast("date"))
    return s, F.when(e < s, s).otherwise(e)


def wildcard_month(text: Column) -> Column:
    """Month number year*12+month-1 of a date whose parts may be ##; -1 if it is no date (F5). Missing months count as January."""
    year = F.regexp_extract(text, r"^(\d{4})-(\d{2}|##)-(\d{2}|##)$", 1)
    month = F.regexp_extract(text, r"^(\d{4})-(\d{2}|##)-(\d{2}|##)$", 2)
    m = F.when(month == "##", F.lit(1)).otherwise(month.try_cast("int"))
    y = year.try_cast("int")
    return F.when(y.isNull() | m.isNull() | ~m.between(1, 12), F.lit(-1)).otherwise(y * 12 + m - 1)


def bin_index(ts: Column, origin: str, seconds: int) -> Column:
    """Index of the bin of ``seconds`` since ``origin``; floors, so earlier events get negative bins."""
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.floor((F.unix_micros(ts.cast("timestamp")) - start) / F.lit(seconds * 1_000_000)).cast("long")


def dense_grid(cells: DataFrame, entities: DataFrame, bins: int, bin_col: str, entity: str, fill: dict[str, object]) -> DataFrame:
    """Every entity at every bin; cells that are absent get ``fill`` (A12, A13). The bins are exploded per entity."""
    grid = entities.select(entity).distinct().select(entity, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(bin_col))
    grid = grid.withColumn(bin_col, F.col(bin_col).cast("long"))
    joined = grid.join(cells, [bin_col, entity], "left")
    return joined.select(bin_col, entity, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def expand_points(df: DataFrame, start: str, end: str, mode: str, step: str = "interval 1 month", name: str = "point") -> DataFrame:
    """Time points of an interval (U7): all, start, end, both, start-mid-end."""
    s, e = F.col(start), F.col(end)
    middle = F.date_add(s, F.floor(F.datediff(e, s) / 2).cast("int"))
    points = {
        "all": F.sequence(s, e, F.expr(step)),
        "start": F.array(s),
        "end": F.array(e),
        "both": F.array_distinct(F.array(s, e)),
        "start-mid-end": F.array_distinct(F.array(s, middle, e)),
    }[mode]
    return df.select("*", F.explode(points).alias(name))


def weekday_one_hot(ts: Column) -> Column:
    """Seven flags, Monday first."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: (F.weekday(ts) == d).cast("int"))


def day_fraction(ts: Column) -> Column:
    return (F.unix_seconds(ts.cast("timestamp")) % 86400) / F.lit(86400.0)


def check_in_code(ts: Column) -> Column:
    """hour + 24 * weekday + 1."""
    return F.hour(ts) + 24 * F.weekday(ts) + 1


def parsed_time(text: Column, formats: tuple[str, ...]) -> Column:
    """The first format that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def digit_tokens(text: Column, width: int) -> Column:
    """Digits of a date, right-padded with -1."""
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))
    return F.slice(F.concat(digits, F.array_repeat(F.lit(-1), width)), 1, width)
