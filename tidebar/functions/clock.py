"""Time expressions. All tables hold wall-clock UTC as TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidebar.functions.scalars import ColumnOrName, c, cyclic, flag

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_utc(df: DataFrame, *names: str) -> DataFrame:
    """Bring timestamp columns (zoned, plain or ISO text) to UTC wall-clock time."""
    out = df
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampNTZType):
            continue
        if isinstance(kind, T.StringType):
            value = F.to_timestamp(F.col(name))
        elif isinstance(kind, T.TimestampType):
            value = F.col(name)
        else:
            value = F.col(name).cast("timestamp")
        local = value.cast("timestamp_ntz")
        out = out.withColumn(
            name, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
        )
    return out


def micros(ts: ColumnOrName) -> Column:
    """Microseconds since the epoch, exact."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c(ts))


def seconds(ts: ColumnOrName) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), c(ts))


def micros_between(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    return F.timestamp_diff("MICROSECOND", c(earlier), c(later))


def shifted(ts: ColumnOrName, hours: int) -> Column:
    return c(ts) + F.expr(f"INTERVAL '{hours}' HOUR")


def moment(text: str) -> Column:
    """A literal point in time, ``YYYY-MM-DD HH:MM:SS``."""
    return F.lit(text).cast("timestamp_ntz")


def calendar_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Hour, weekday (Monday is 0), day, month, quarter, cyclic forms and session flags."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    hour_sin, hour_cos = cyclic(hour, 24)
    day_sin, day_cos = cyclic(weekday, 7)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": weekday,
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "day_sin": day_sin,
            "day_cos": day_cos,
            "is_weekend": flag(weekday >= 5),
            "us_market_hours": flag(hour.between(14, 21)),
            "asian_market_hours": flag(hour.between(0, 8)),
            "european_market_hours": flag(hour.between(8, 16)),
        }
    )


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' MINUTE")
