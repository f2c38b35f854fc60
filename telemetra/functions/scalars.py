"""Column helpers: time, identifiers, outcome flags, risk labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: canonical 36-character id, and date-time with an explicit offset.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RFC3339_PATTERN = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
)

MINUTE_US = 60_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch (sessions run in UTC, so both timestamp types agree)."""
    return F.unix_micros(col(c).cast("timestamp"))


def minute_index(c) -> Column:
    return F.floor(micros(c) / F.lit(MINUTE_US)).cast("bigint")


def from_micros(c, dtype: T.DataType) -> Column:
    return F.timestamp_micros(col(c)).cast(dtype)


def minute(c, dtype: T.DataType | str = "timestamp") -> Column:
    """Floor to the minute, keeping the timestamp type the caller works in."""
    return F.date_trunc("minute", col(c).cast("timestamp")).cast(dtype)


def is_blank(c) -> Column:
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def is_uuid(c) -> Column:
    return F.coalesce(col(c).rlike(UUID_PATTERN), F.lit(False))


def parse_rfc3339(c) -> Column:
    """Null unless the text is a date-time with an offset."""
    return F.when(col(c).rlike(RFC3339_PATTERN), F.try_to_timestamp(col(c)))


def iso_utc(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def finite(c) -> Column:
    """NaN, infinities and nulls become 0."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def is_server_error(status="status") -> Column:
    return col(status) >= 500


def is_live_error(status="status") -> Column:
    return ~col(status).between(200, 499)


def is_poll_ok(status="status", expected="expected_status") -> Column:
    """Listed success codes decide when there are any, otherwise everything below 500 is fine."""
    listed = F.size(F.coalesce(col(expected), F.array().cast("array<int>"))) > 0
    return F.when(listed, F.array_contains(col(expected), col(status))).otherwise(col(status) < 500)


def outcome_flags(df: DataFrame, expected: str | None = None) -> DataFrame:
    out = df.withColumn("is_server_error", is_server_error()).withColumn("is_live_error", is_live_error())
    ok = is_poll_ok(expected=expected) if expected else F.col("status") < 500
    return out.withColumn("is_poll_ok", ok)


def rate(flag: Column) -> Column:
    """Share of rows where ``flag`` holds, as a double."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def risk_label(risk="risk_score") -> Column:
    r = col(risk)
    return F.when(r < 0.4, "normal").when(r < 0.7, "degraded").otherwise("high_failure_risk")


def risk_band(risk="risk_score") -> Column:
    r = col(risk)
    return F.when(r >= 0.8, "critical").when(r >= 0.5, "warning").otherwise("stable")


def clip01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def relative_age(then, now) -> tuple[Column, Column]:
    """(signed amount, unit): minutes under an hour, hours under a day, days beyond; halves round up."""
    diff = F.floor(micros(then) / 1000) - F.floor(micros(now) / 1000)
    span = F.abs(diff)
    hour, day = 3_600_000, 86_400_000
    unit = F.when(span < hour, "minute").when(span < day, "hour").otherwise("day")
    size = F.when(span < hour, 60_000.0).when(span < day, float(hour)).otherwise(float(day))
    return F.floor(diff / size + 0.5).cast("bigint"), unit


def contains_ci(c, needle: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(needle.strip().lower()))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    """Bounds for request parameters (window hours, page sizes)."""
    return default if value is None else max(low, min(int(value), high))
