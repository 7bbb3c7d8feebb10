"""Problem 2: texts in many formats, precisions and zones to one unambiguous instant.

An ordered cascade of anchored patterns rewrites each text to one canonical list of parts; the first pattern
that matches decides. The parts are checked strictly (an impossible date or time is no instant), the zone comes
from the text or from a lookup by feed, and wall times that a clock change repeats or skips follow a stated
policy. Everything is built from column expressions, so it runs inside the JVM without a shuffle: the lookups
are tables of a few rows per feed or zone, which Catalyst broadcasts by their size.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.exprs import strip
from panelspark.plans.local import local_table

# --- fixed values: names of months in English, German, French, Portuguese ---------------------------------------
MONTHS = [
    "jan january januar janvier janeiro",
    "feb february februar février fevereiro",
    "mar march märz mars março",
    "apr april avril abril",
    "may mai maio",
    "jun june juni juin junho",
    "jul july juli juillet julho",
    "aug august août agosto",
    "sep sept september septembre setembro",
    "oct october oktober octobre outubro",
    "nov november novembre novembro",
    "dec december dezember décembre dezembro",
]
# ----------------------------------------------------------------------------------------------------------------

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
AMPM = r"(?: ?([ap]m)(?![a-z]))?"
ZONE = r"(?: ?(z|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z0-9_+-]+)+))?(?:\[([^\]]+)\])?"
CLOCK = TIME + AMPM + "(?: uhr)?" + ZONE

#: name, pattern over the stripped lower-cased text, canonical parts
#: kind|first|second|third|month name|hour|minute|second|fraction|am or pm|zone|zone in brackets
#: Digits and T/Z only first, then year-first dates, dates in the feed's order, dates with a month's name.
CASCADE = [
    ("epoch_s", r"(-?\d{9,10})(?:\.(\d{1,9}))?", "epoch_s|$1|||||||$2|||"),
    ("epoch_ms", r"(-?\d{13})", "epoch_ms|$1||||||||||"),
    ("epoch_us", r"(-?\d{16})", "epoch_us|$1||||||||||"),
    ("epoch_ns", r"(-?\d{19})", "epoch_ns|$1||||||||||"),
    ("serial", r"(\d{5}(?:\.\d+)?)", "serial|$1||||||||||"),
    ("compact", r"(\d{4})(\d{2})(\d{2})(?:t? ?(\d{2})(\d{2})(?:(\d{2})(?:\.(\d{1,9}))?)?(z|[+-]\d{2}:?\d{2})?)?", "ymd|$1|$2|$3||$4|$5|$6|$7||$8|"),
    ("year_first", r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?:t| +)" + CLOCK + ")?", "ymd|$1|$3|$4||$5|$6|$7|$8|$9|$10|$11"),
    ("day_order", r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?:(?:t|,? +)" + CLOCK + ")?", "order|$1|$3|$4||$5|$6|$7|$8|$9|$10|$11"),
    ("day_month_name", r"(?:\p{L}{2,10}\.?,? )?(\d{1,2})\.? (?:de )?(\p{L}+)\.?,? (?:de )?(\d{4})(?:,? (?:às |à |um |at )?" + CLOCK + ")?", "name|$3||$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("month_name_day", r"(?:\p{L}{2,10}\.?,? )?(\p{L}+)\.? (\d{1,2}),? (\d{4})(?:,? (?:at )?" + CLOCK + ")?", "name|$3||$2|$1|$4|$5|$6|$7|$8|$9|$10"),
]


@functools.cache
def _zone_rows() -> list[tuple]:
    return [(z.lower(), z) for z in sorted(zoneinfo.available_timezones()) if "/" in z or z in ("UTC", "GMT")]


def zone_table(spark: SparkSession) -> DataFrame:
    """Every public zone name, by its lower-case form. Some 600 rows, bounded by the tz database; a local relation of known size."""
    return local_table(spark, _zone_rows(), "zone_key string, zone_name string")


@functools.cache
def _abbreviation_rows() -> list[tuple]:
    rows = set()
    for z in zoneinfo.available_timezones():
        if "/" not in z:
            continue
        zone, seen = zoneinfo.ZoneInfo(z), {}
        for k in range(48 * 4):  # every quarter of 1990 to 2037, newest last
            at = dt.datetime(1990 + k // 4, 1 + 3 * (k % 4), 15, tzinfo=dt.UTC).astimezone(zone)
            if at.tzname().isalpha():
                seen[at.tzname().lower()] = int(at.utcoffset().total_seconds())
        rows |= {(z, a, s) for a, s in seen.items()}
    return sorted(rows)


def abbreviation_table(spark: SparkSession) -> DataFrame:
    """Offsets of the alphabetic abbreviations of each zone since 1990, derived from the tz database's own rules."""
    return local_table(spark, _abbreviation_rows(), "abbr_zone string, abbr string, abbr_offset int")


def _cascade(text: Column) -> Column:
    """The canonical parts by the first pattern that matches, or null."""
    out = F.lit(None).cast("string")
    for _, pattern, parts in reversed(CASCADE):
        full = F.lit(r"\A(?:" + pattern + r")\z")
        out = F.when(F.regexp(text, full), F.regexp_replace(text, full, F.lit(parts))).otherwise(out)
    return out


def _format_name(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(CASCADE):
        out = F.when(F.regexp(text, F.lit(r"\A(?:" + pattern + r")\z")), F.lit(name)).otherwise(out)
    return out


def _offset_seconds(z: Column) -> Column:
    """Seconds of ``+hh:mm``, ``+hhmm``, ``+hh`` and the same after utc or gmt; null outside 18 hours or 59 minutes."""
    h = F.regexp_extract(z, r"([+-])(\d{2})(?::?(\d{2}))?$", 2).try_cast("int")
    m = F.coalesce(F.regexp_extract(z, r"([+-])(\d{2})(?::?(\d{2}))?$", 3).try_cast("int"), F.lit(0))
    s = h * 3600 + m * 60
    return F.when((m < 60) & (s <= 18 * 3600), F.when(z.contains("-"), -s).otherwise(s))


def _wall_to_utc(wall: Column, zone: Column, policy: str) -> Column:
    """UTC microseconds of a wall time given as microseconds since 1970, both as bigint.

    The zone rules come from the JVM. With t the instant under the offset in force before a change and u the one
    under the offset after it: a skipped wall time has neither t nor u showing it, a repeated one has both.
    """
    as_ts = F.timestamp_micros(wall)
    before = F.unix_micros(F.to_utc_timestamp(as_ts, zone))
    if policy == "before":
        return before
    day = F.lit(86_400_000_000)
    later = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(before + day), zone)) - (before + day)
    after = wall - later
    shows = lambda t: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), zone)) == wall
    skipped, repeated = ~shows(before), shows(after) & (after != before)
    if policy == "after":
        return F.when(skipped | repeated, after).otherwise(before)
    if policy == "null":
        return F.when(~(skipped | repeated), before)
    raise ValueError(f"unknown policy for clock changes: {policy!r}")


def normalise_timestamps(
    df: DataFrame,
    feeds: DataFrame,
    text: str = "date",
    feed: str = "feed_id",
    keep: tuple[str, ...] = ("row_id",),
    policy: str = "before",
    zone: str = "zone_id",
    day_order: str = "day_order",
) -> DataFrame:
    """One row per input row: the kept columns, ``format``, ``epoch_us``, ``epoch_ms`` and ``failure``.

    ``feeds`` gives zone and order of day and month by ``feed``. ``policy`` says how a wall time that a clock
    change repeats or skips is read: ``before`` (the offset in force before the change), ``after`` or ``null``.
    ``epoch_ms`` is null where the text denotes no instant, and ``failure`` then says why: ``missing`` (null or
    blank), ``format`` (no pattern), ``date`` or ``time`` (no existing day, or no time of day), ``zone`` (unknown
    zone or offset, or no zone in the text and none known for the feed). Fractions are floored. Repeated rows
    stay, an empty table gives no rows, columns outside ``keep`` are dropped, whatever their names. A feed that
    isn't in ``feeds``, or a null one, has no zone and order; of several rows for a feed the least one counts.
    """
    spark = df.sparkSession
    out = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = df.select(*out, F.col(feed).alias("_feed"), F.lower(F.regexp_replace(strip(F.col(text)), r"[\s ]+", " ")).alias("_t"))
    known = feeds.groupBy(F.col(feed).alias("_f")).agg(F.min(F.struct(F.col(zone).alias("z"), F.lower(F.col(day_order)).alias("o"))).alias("_s"))
    rows = rows.join(known, rows["_feed"] == known["_f"], "left").select(
        *[f"_k{i}" for i in range(len(keep))], "_t", F.col("_s.z").alias("_fz"), F.col("_s.o").alias("_fo")
    )
    rows = rows.withColumn("_p", F.split(_cascade(F.col("_t")), r"\|", -1))
    p = lambda i: F.col("_p")[i]
    num = lambda i: p(i).try_cast("bigint")
    kind, order = p(0), F.coalesce(F.col("_fo"), F.lit("ymd"))
    two_digit = lambda y: F.when(F.length(y) == 2, y.try_cast("int") + 2000).otherwise(y.try_cast("int"))
    month_of = F.create_map(*[F.lit(x) for k, names in enumerate(MONTHS) for n in names.split() for x in (n, k + 1)])
    ordered = kind == "order"
    # a four-digit year at the end can't stand first, so under ymd it leaves no order to read day and month by
    year_last = ordered & (F.length(p(3)) == 4)
    year = F.when(ordered, F.when(order == "ymd", F.when(~year_last, two_digit(p(1)))).otherwise(two_digit(p(3)))).otherwise(p(1).try_cast("int"))
    month = F.when(ordered, F.when(order == "mdy", p(1)).otherwise(p(2)).try_cast("int")).when(kind == "name", F.try_element_at(month_of, p(4))).otherwise(p(2).try_cast("int"))
    day = F.when(ordered, F.when(order == "dmy", p(1)).when(order == "mdy", p(2)).otherwise(p(3)).try_cast("int")).otherwise(p(3).try_cast("int"))
    rows = rows.select(
        "*",
        F.when(kind.isin("ymd", "order", "name") & (year >= 1), F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))).alias("_day"),
        F.coalesce(F.nullif(p(10), F.lit("")), F.nullif(F.lower(p(11)), F.lit(""))).alias("_z"),
    )
    # time of day in microseconds
    hour, minute, second = (F.when(p(i) == "", 0).otherwise(p(i).try_cast("int")) for i in (5, 6, 7))
    ampm = p(9)
    hour = F.when(ampm == "", hour).when(hour.between(1, 12), hour % 12 + F.when(ampm == "pm", 12).otherwise(0))
    micros = F.rpad(F.substring(p(8), 1, 6), 6, "0").try_cast("bigint")
    micros = F.when(p(8) == "", 0).otherwise(micros)
    ends_day = (hour == 24) & (minute == 0) & (second == 0) & (micros == 0) & (ampm == "")
    in_day = F.when((hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)) | ends_day, (hour.cast("bigint") * 3600 + minute * 60 + second) * 1_000_000 + micros)
    # spreadsheet days: 1 is 1899-12-31, whole seconds, wall time of the feed
    serial = F.round(p(1).try_cast("decimal(28,18)") * 86_400).cast("bigint") - 25_569 * 86_400
    wall = F.when(kind == "serial", serial * 1_000_000).otherwise(F.unix_micros("_day") + in_day)
    frac = F.when(p(8) == "", 0).otherwise(F.rpad(F.substring(p(8), 1, 6), 6, "0").try_cast("bigint"))
    sign = F.when(p(1).startswith("-"), -1).otherwise(1)
    count = (
        F.when(kind == "epoch_s", num(1) * 1_000_000 + sign * frac)
        .when(kind == "epoch_ms", num(1) * 1_000)
        .when(kind == "epoch_us", num(1))
        .when(kind == "epoch_ns", F.floor(num(1) / 1000).cast("bigint"))
    )
    rows = rows.select("*", wall.alias("_wall"), count.alias("_count"), in_day.alias("_in_day"))
    # zone of the text: an offset, a name, UTC, or an abbreviation of the feed's zone
    z = F.col("_z")
    fixed = F.when(z.isin("z", "utc", "gmt"), 0).when(F.regexp(z, F.lit(r"^(?:utc|gmt)?[+-]\d")), _offset_seconds(z))
    rows = rows.join(zone_table(spark), z == F.col("zone_key"), "left")
    rows = rows.join(abbreviation_table(spark), (F.col("_fz") == F.col("abbr_zone")) & (z == F.col("abbr")), "left")
    feed_zone = F.when(F.lower(F.col("_fz")).isin("utc", "gmt", "z"), F.lit("UTC")).otherwise(F.col("_fz"))
    utc = F.coalesce(
        F.col("_wall") - F.coalesce(fixed, F.when(F.col("zone_key").isNull(), F.col("abbr_offset"))).cast("bigint") * 1_000_000,
        F.when(fixed.isNull() & F.col("zone_name").isNotNull(), _wall_to_utc(F.col("_wall"), F.col("zone_name"), policy)),
        F.when(z.isNull() & feed_zone.isNotNull(), _wall_to_utc(F.col("_wall"), feed_zone, policy)),
    )
    us = F.coalesce(F.col("_count"), utc)
    failure = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), "missing")
        .when(F.col("_p").isNull(), "format")
        .when(us.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_day").isNull() & (F.col("_p")[0] != "serial"), "date")
        .when(F.col("_in_day").isNull() & (F.col("_p")[0] != "serial"), "time")
        .otherwise("zone")
    )
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        _format_name(F.col("_t")).alias("format"),
        us.alias("epoch_us"),
        F.floor(us / 1000).cast("bigint").alias("epoch_ms"),
        failure.alias("failure"),
    )
