"""ISO-8601 text -> instant and wall clock, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Forms accepted (groups in order: extended date 1-3, basic date 4-6, week date
# 7-9, hour 10, minute 12, second 13, fraction 14, offset sign 15, hours 16,
# minutes 18, seconds 19).
_DATE = (
    r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})"
    r"|(?!\d{4}-W\d{3}|\d{4}W\d{2}-\d)(\d{4})-?W(\d{2})(?:-?(\d))?)"
)
_CLOCK = r"(\d{2})(?:(:?)(\d{2})(?:\11(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(?:([+-])(\d{2})(?:(:?)(\d{2})(?:\17(\d{2})(?:[.,]\d+)?)?)?)?"
_PATTERN = rf"^{_DATE}(?:[\s\S]{_CLOCK}{_OFFSET})?\z"
# The usual form, which Spark's own cast reads as it should.
_USUAL = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)\z"
)
_GROUPS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 18, 19)
_FIELDS = "|".join(f"${g}" for g in _GROUPS)


def _from_parts(p: Column) -> Column:
    """STRUCT<micros, hour, minute> from the 17 matched groups; micros NULL if no such time."""

    def part(i: int) -> Column:
        return F.get(p, F.lit(i))

    def number(i: int) -> Column:
        # A failing cast is slow, so empty text never reaches it.
        return F.coalesce(F.nullif(part(i), F.lit("")).try_cast("int"), F.lit(0))

    clock = F.concat(
        F.lpad(part(9), 2, "0"), F.lit(":"),
        F.lpad(part(10), 2, "0"), F.lit(":"),
        F.lpad(part(11), 2, "0"), F.lit("."),
        F.rpad(F.substring(part(12), 1, 6), 6, "0"), F.lit("Z"),
    )
    calendar = F.concat_ws("-", *(F.concat(part(i), part(i + 3)) for i in range(3)))
    # Monday of ISO week 1 is the Monday on or before 4 January; week 53 exists only
    # in years whose last Thursday falls in it.
    week_one = F.date_trunc(
        "week", F.concat(part(6), F.lit("-01-04")).try_cast("timestamp_ntz")
    ).cast("date")
    week, weekday = number(7), F.when(part(8) == "", F.lit(1)).otherwise(number(8))
    week_ok = (
        week.between(1, 53)
        & weekday.between(1, 7)
        & (F.year(F.date_add(week_one, (week - 1) * 7 + 3)) == number(6))
    )
    week_day = F.date_add(week_one, (week - 1) * 7 + weekday - 1).cast("string")
    date = F.when(part(6) == "", calendar).when(week_ok, week_day)
    shift = (number(14) * 3600 + number(15) * 60 + number(16)).cast("bigint")
    micros = F.unix_micros(F.concat(date, F.lit(" "), clock).try_cast("timestamp")) - (
        F.when(part(13) == "-", -shift).otherwise(shift) * 1_000_000
    )
    return F.struct(
        F.when((F.size(p) == len(_GROUPS)) & (shift < 86400), micros).alias("micros"),
        number(9).alias("hour"),
        number(10).alias("minute"),
    )


def with_instant(df: DataFrame, text: str) -> DataFrame:
    """Add `micros`, `hour`, `minute` read from a text column; all NULL if not ISO-8601.

    `micros` counts from the epoch, naive text taken as UTC; `hour` and `minute` are
    the wall clock as written, whatever the offset. The unusual forms are read inside
    a lambda: it is evaluated for such rows only and keeps the code Spark generates
    for all others short.
    """
    kept = df.columns
    stamp = F.col(text)
    utc = F.replace(stamp, F.lit("Z"), F.lit("+00:00"))
    groups = F.split(F.regexp_replace(utc, _PATTERN, _FIELDS), r"\|")
    readable = ~stamp.startswith("0000") & utc.rlike(_PATTERN)
    usual = F.struct(
        F.unix_micros(stamp.try_cast("timestamp")).alias("micros"),
        F.substring(stamp, 12, 2).try_cast("int").alias("hour"),
        F.substring(stamp, 15, 2).try_cast("int").alias("minute"),
    )
    at = F.when(stamp.rlike(_USUAL), usual).when(
        readable, F.get(F.transform(F.array(groups), _from_parts), F.lit(0))
    )
    found = F.col("_at")["micros"]
    return df.withColumn("_at", at).select(
        *kept,
        found.alias("micros"),
        *(F.when(found.isNotNull(), F.col("_at")[n]).alias(n) for n in ("hour", "minute")),
    )
