"""Mixed printed forms and zones of times and days, brought to one instant or day each.

Every printed form is a pattern with a reading, and a value has a likelihood under each reading that names a real day.
Values of year-first, named, compact, spreadsheet and epoch forms fit one reading only, so its posterior is one.
Year-last numeric values may fit two, day first and month first. Which one is meant is estimated by
expectation-maximisation over the mixture of readings: a value that is a real day under one reading only is evidence for
it, values that fit both share their weight by the current posterior. The mixture has two levels. A zone's is estimated
from the values of all its sources, the custom of its country counting as ``CUSTOM_COUNTS`` values; a source's is drawn
to its zone's by ``ZONE_COUNTS`` values, so that a branch that writes as its country does is read as it even where its
own values settle nothing, and one with evidence of its own against it isn't.
The statistics of a source are three counts, aggregated on the map side before the shuffle and iterated inside one
expression, so no source, however large, is gathered anywhere. Posteriors between ``SETTLED`` and ``1 - SETTLED`` leave
the value explicitly ``AMBIGUOUS``.

Local times are turned to UTC with the zone of the issuing branch; local times that occur twice or never come out as
``AMBIGUOUS`` or ``NONEXISTENT``.

The rows meet their source's zone in one shuffle of three narrow columns. A source may hold a third of all rows: rows
are spread over ``SALTS`` parts of each source, and the (unique, small) sources are repeated as often.

Defined results: NULL and ``''`` are absent and give no row; a source without an account row, or with a zone name that
isn't known, is read in ``DEFAULT_ZONE``; an unreadable or impossible value is ``INVALID``; a repeated row gives one row;
very long texts match no pattern and are ``INVALID``; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Shanghai"
INVALID, AMBIGUOUS, NONEXISTENT = "INVALID", "AMBIGUOUS", "NONEXISTENT"
SALTS = 8
SETTLED = 0.9
ITERATIONS = 12
#: The weight of the country's custom for a zone, and of the zone for a source, as so many settled values.
CUSTOM_COUNTS = 2.0
ZONE_COUNTS = 10.0
#: Zones of branches whose country writes the month first when the year is last.
MONTH_FIRST_ZONES = r"^(America/(New_York|Chicago|Denver|Los_Angeles|Phoenix|Anchorage|Detroit|Boise|Indiana/.*|Kentucky/.*|North_Dakota/.*)|US/.*|Pacific/Honolulu)$"
#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "JST": 540, "HKT": 480, "北京时间": 480,
}
#: English month names by their first three letters.
MONTHS = {m: k for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}

_PLAIN_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_PLAIN_DAY = r"^\d{4}-\d{2}-\d{2}$"
_CLOCK = r"(?:(上午|下午|AM|PM)\s*)?(\d{1,2})[:时](\d{1,2})(?:[:分](\d{1,2})秒?(?:[.,](\d{1,9}))?)?分?\s*(AM|PM|上午|下午)?"
_ZONE = r"\s*\(?(Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}|北京时间)?\)?"
_YEAR_FIRST = r"(\d{4})(?:[-/.]|年)(\d{1,2})(?:[-/.]|月)(\d{1,2})日?"
_COMPACT_DAY = r"(\d{4})(\d{2})(\d{2})"
_YEAR_LAST = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
_DAY_NAME = r"(\d{1,2})[- ]([A-Z]{3})[A-Z]*[- ](\d{4})"
_NAME_DAY = r"([A-Z]{3})[A-Z]*\.? (\d{1,2}),? (\d{4})"
_REST = rf"(?:[T ]\s*{_CLOCK}{_ZONE})?$"
_COMPACT_STAMP = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"
_SERIAL = r"^(\d{5})(\.\d{1,12})?$"
_EPOCH = r"^(\d{10})(\d{3})?$"


def day_patterns() -> dict[str, str]:
    """The whole pattern of each form that names a day, in the order in which they are tried."""
    forms = {"first": _YEAR_FIRST + _REST, "stamp": _COMPACT_STAMP[1:], "compact": _COMPACT_DAY + _REST, "last": _YEAR_LAST + _REST, "day_name": _DAY_NAME + _REST, "name_day": _NAME_DAY + _REST}
    return {name: f"^{pattern}" for name, pattern in forms.items()}


def _int(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def _read(text: Column) -> Column:
    """What the text says, as an array of strings: form, year, the two other numbers as printed, half of the day, hour,
    minute, second, zone. One pattern match and one rewrite per value; NULL if no form fits."""
    clock = "$4$9|$5|$6|$7|$10"
    forms = [
        (rf"^{_YEAR_FIRST}{_REST}", f"ymd|$1|$2|$3|{clock}"),
        (_COMPACT_STAMP, "ymd|$1|$2|$3||$4|$5|$6|"),
        (rf"^{_COMPACT_DAY}{_REST}", f"ymd|$1|$2|$3|{clock}"),
        (rf"^{_YEAR_LAST}{_REST}", f"last|$3|$1|$2|{clock}"),
        (rf"^{_DAY_NAME}{_REST}", f"ymd|$3|$2|$1|{clock}"),
        (rf"^{_NAME_DAY}{_REST}", f"ymd|$3|$1|$2|{clock}"),
    ]
    out = F.lit(None).cast("string")
    for pattern, shape in reversed(forms):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, shape)).otherwise(out)
    return F.split(out, r"\|")


def with_reading(df: DataFrame, value: str) -> DataFrame:
    """``df`` with a struct ``read`` of what ``value`` says.

    Each step is a projection of its own: the optimizer keeps costly expressions that are used more than once apart.
    """
    month_of = F.create_map(*(x for m, k in MONTHS.items() for x in (F.lit(m), F.lit(k))))
    n = lambda k: _int(F.col("_part")[k])
    half = F.col("_part")[4]
    read = F.struct(
        F.col("_part")[0].alias("form"), n(1).alias("y"), F.coalesce(F.try_element_at(month_of, F.col("_part")[2]), n(2)).alias("a"), n(3).alias("b"),
        F.when(half.isin("AM", "上午"), "AM").when(half.isin("PM", "下午"), "PM").otherwise(half).alias("half"),
        n(5).alias("h"), n(6).alias("mi"), n(7).alias("s"), F.col("_part")[8].alias("zone"),
    )
    return df.withColumn("_text", F.upper(F.trim(value))).withColumn("_part", _read(F.col("_text"))).withColumn("read", read).drop("_part")


def _real_day(y: Column, m: Column, d: Column) -> Column:
    """The date, or NULL if the three numbers name none."""
    return F.when(y > 0, F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date"))


def _day_of(read: Column, month_first: Column) -> Column:
    as_md, as_dm = _real_day(read["y"], read["a"], read["b"]), _real_day(read["y"], read["b"], read["a"])
    return F.when(read["form"] == "ymd", as_md).when(month_first, as_md).otherwise(as_dm)


def _seconds_of(read: Column) -> Column:
    """Seconds since midnight, NULL if the clock is impossible; 12 AM is midnight, 12 PM noon."""
    h, half = read["h"], read["half"]
    hour = F.when(half == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "PM", 12).otherwise(0)).when((half == "PM") & (h >= 13) | (half == "AM") & (h == 0), h)
    second = F.coalesce(read["s"], F.lit(0))
    return F.when((hour < 24) & (read["mi"] < 60) & (second < 60), hour * 3600 + read["mi"] * 60 + second)


def _offset_minutes(zone: Column) -> Column:
    """The offset a zone text settles; NULL if it names none that is known."""
    table = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))))
    pattern = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    size = _int(F.regexp_extract(zone, pattern, 2)) * 60 + F.coalesce(_int(F.regexp_extract(zone, pattern, 3)), F.lit(0))
    numeric = F.when(F.regexp_extract(zone, pattern, 1) == "-", -size).otherwise(size)
    return F.when(zone.rlike(pattern), F.when(F.abs(numeric) <= 14 * 60, numeric)).otherwise(F.try_element_at(table, zone))


def _utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DDTHH:MM:SSZ``, in whatever time zone the session is."""
    stamp = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.regexp_replace(stamp.cast("string"), " ", "T"), F.lit("Z"))


def _epoch_seconds(day: Column, seconds: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + seconds


def month_first_share(day_only: Column, month_only: Column, either: Column, prior: Column, counts: float) -> Column:
    """The share of year-last values that put the month first, by expectation-maximisation.

    E: a value that fits both readings is month-first with the current share; M: the share is the month-first weight
    over all, the prior share counting as ``counts`` values.
    """
    settled = month_only + prior * counts
    total = day_only + month_only + either + counts
    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), prior, lambda share, _: (settled + either * share) / total)


@cache
def known_zones() -> list[str]:
    """The regions of the zone database that both this process and the executors' runtime have."""
    regions = r"(Africa|America|Antarctica|Arctic|Asia|Atlantic|Australia|Europe|Indian|Pacific|Etc)/[A-Za-z0-9_/+-]+"
    return ["UTC", "GMT", DEFAULT_ZONE, *sorted(z for z in available_timezones() if re.fullmatch(regions, z))]


def source_profiles(rows: DataFrame, accounts: DataFrame, source: str, zone: str, columns: tuple[str, ...], customs: bool = True) -> DataFrame:
    """``(source, zone, month_first)`` of every account source, ``month_first`` being the posterior of its mixture.

    Without ``customs`` no country has one, and the values alone decide."""
    known = F.col(zone).isin(known_zones())
    dims = accounts.groupBy(source).agg(F.min(F.when(known, F.col(zone))).alias("zone"))
    dims = dims.select(source, F.coalesce("zone", F.lit(DEFAULT_ZONE)).alias("zone"))
    written = rows.select(source, F.explode(F.array(*columns)).alias("t")).where(F.col("t").rlike(rf"^\s*{_YEAR_LAST}"))
    split = written.select(source, F.split(F.regexp_extract(F.trim("t"), r"^([\d/.-]+)", 1), "[-/.]").alias("n"))
    numbers = split.select(source, *(F.col("n")[k].try_cast("int").alias(c) for k, c in enumerate("aby")))
    last = numbers.select(source, _real_day(F.col("y"), F.col("a"), F.col("b")).isNotNull().alias("md"), _real_day(F.col("y"), F.col("b"), F.col("a")).isNotNull().alias("dm"))
    md, dm = F.col("md"), F.col("dm")
    count = lambda c: F.sum(c.cast("double"))
    stats = last.groupBy(source).agg(count(dm & ~md).alias("day_only"), count(md & ~dm).alias("month_only"), count(md & dm).alias("either"))
    names = ("day_only", "month_only", "either")
    counted = dims.join(stats, source, "left").select(source, "zone", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    custom = F.when(F.col("zone").rlike(MONTH_FIRST_ZONES), 0.999).otherwise(0.001) if customs else F.lit(0.5)
    summed = counted.groupBy("zone").agg(*(F.sum(c).alias(f"zone_{c}") for c in names))
    # one row a zone of the zone database, which known_zones() bounds
    zones = summed.select("zone", month_first_share(*(F.col(f"zone_{c}") for c in names), custom, CUSTOM_COUNTS).alias("zone_share"))
    shares = counted.join(F.broadcast(zones), "zone")
    return shares.select(source, "zone", month_first_share(*(F.col(c) for c in names), F.col("zone_share"), ZONE_COUNTS).alias("month_first"))


def with_norm(df: DataFrame, is_time: Column, zone: Column, month_first: Column) -> DataFrame:
    """``df`` (with a column ``value``) and its ``norm``: the instant in UTC where ``is_time``, else the day; or ``INVALID``,
    ``AMBIGUOUS`` or ``NONEXISTENT``."""
    read, t = F.col("read"), F.col("_text")
    unsettled = (read["form"] == "last") & (month_first > 1 - SETTLED) & (month_first < SETTLED) & (read["a"] != read["b"])
    whole = F.regexp_extract(t, _SERIAL, 1).try_cast("int")
    fraction = F.concat(F.lit("0"), F.regexp_extract(t, _SERIAL, 2)).try_cast("decimal(20,12)")
    serial = (whole - 25569).cast("long") * 86400 + F.round(fraction * 86400).cast("long")
    df = (
        with_reading(df, "value")
        .withColumn("_day", F.when(t.rlike(r"^\d{5}(\.0*)?$") & ~is_time, F.date_add(F.lit("1899-12-30").cast("date"), whole)).otherwise(_day_of(read, month_first >= 0.5)))
        .withColumn("_clock", F.when(is_time, _seconds_of(read)))
        .withColumn("_local", F.when(is_time & t.rlike(_SERIAL), serial).when(is_time, _epoch_seconds(F.col("_day"), F.col("_clock"))))
        .withColumn("_zoned", F.coalesce(read["zone"], F.lit("")) != "")
        .withColumn("_utc", F.when(t.rlike(_EPOCH), F.regexp_extract(t, _EPOCH, 1).try_cast("long")).when(F.col("_zoned"), F.col("_local") - _offset_minutes(read["zone"]) * 60))
    )
    local, settled = F.col("_local"), t.rlike(_EPOCH) | F.col("_zoned")
    offset = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone)) - s
    # the offsets in force a day before and a day after are the only ones the local time can have
    df = (
        df.withColumn("_before", F.when(~settled, offset(local - 86400)))
        .withColumn("_after", F.when(~settled, offset(local + 86400)))
        .withColumn("_early", (F.col("_before") == F.col("_after")) | (offset(local - F.col("_before")) == F.col("_before")))
        .withColumn("_late", (F.col("_before") == F.col("_after")) | (offset(local - F.col("_after")) == F.col("_after")))
        .withColumn("_utc", F.coalesce("_utc", F.when(F.col("_early"), local - F.col("_before")).when(F.col("_late"), local - F.col("_after"))))
    )
    twice = F.col("_early") & F.col("_late") & (F.col("_before") != F.col("_after"))
    time_norm = (
        F.when(~t.rlike(_EPOCH) & local.isNull(), INVALID)
        .when(F.coalesce(unsettled, F.lit(False)), AMBIGUOUS)
        .when(settled, F.coalesce(_utc_text(F.col("_utc")), F.lit(INVALID)))
        .when(twice, AMBIGUOUS)
        .otherwise(F.coalesce(_utc_text(F.col("_utc")), F.lit(NONEXISTENT)))
    )
    day_norm = F.when(F.col("_day").isNull(), INVALID).when(F.coalesce(unsettled, F.lit(False)), AMBIGUOUS).otherwise(F.col("_day").cast("string"))
    return df.withColumn("norm", F.when(is_time, time_norm).otherwise(day_norm))


def normalise_times(rows: DataFrame, accounts: DataFrame, key: str, time: str, day: str, source: str, zone: str) -> DataFrame:
    """``(key, field_name, value, norm)`` for each time and day that isn't written plainly and read in ``DEFAULT_ZONE``."""
    profiles = source_profiles(rows, accounts, source, zone, (time, day))
    t, d = F.col(time), F.col(day)
    # what needs no source at all is told apart first, so that plain days never reach the shuffle
    wants_time = (F.coalesce(t, F.lit("")) != "") & ~t.rlike(_PLAIN_DAY)
    wants_day = (F.coalesce(d, F.lit("")) != "") & ~(d.rlike(_PLAIN_DAY) & d.try_cast("date").isNotNull())
    values = F.array(F.struct(F.lit(time).alias("field_name"), F.when(wants_time, t).alias("value")), F.struct(F.lit(day).alias("field_name"), F.when(wants_day, d).alias("value")))
    wanted = rows.select(key, source, F.explode(values).alias("v")).where(F.col("v.value").isNotNull()).select(key, source, "v.field_name", "v.value")
    salted = wanted.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    spread = profiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(spread, [source, "salt"], "left").withColumn("zone", F.coalesce("zone", F.lit(DEFAULT_ZONE))).withColumn("month_first", F.coalesce("month_first", F.lit(0.001)))
    v = F.col("value")
    regular = (F.col("field_name") == time) & (F.col("zone") == DEFAULT_ZONE) & v.rlike(_PLAIN_TIME) & v.try_cast("timestamp_ntz").isNotNull()
    told = with_norm(joined.where(~regular), F.col("field_name") == time, F.col("zone"), F.col("month_first"))
    return told.select(key, "field_name", "value", "norm").dropDuplicates()


def normalise_days(rows: DataFrame, accounts: DataFrame, key: str, time: str, day: str, source: str, zone: str) -> DataFrame:
    """``(key, source, value, day)`` for each day that isn't written plainly; NULL where it names no real and settled day."""
    profiles = source_profiles(rows, accounts, source, zone, (time, day)).select(source, "month_first")
    d = F.col(day)
    wanted = rows.where((F.coalesce(d, F.lit("")) != "") & ~d.rlike(_PLAIN_DAY)).select(key, source, d.alias("value")).dropDuplicates()
    salted = wanted.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    spread = profiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(spread, [source, "salt"], "left").withColumn("month_first", F.coalesce("month_first", F.lit(0.001)))
    # the days of with_norm alone: its instants make plans that use the ledger twice slow to optimise
    read, t, month_first = F.col("read"), F.col("_text"), F.col("month_first")
    unsettled = (read["form"] == "last") & (month_first > 1 - SETTLED) & (month_first < SETTLED) & (read["a"] != read["b"])
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(t, _SERIAL, 1).try_cast("int"))
    told = with_reading(joined, "value").withColumn("day", F.when(t.rlike(r"^\d{5}(\.0*)?$"), serial).when(~F.coalesce(unsettled, F.lit(False)), _day_of(read, month_first >= 0.5)))
    # no filter on the day here: it would be pushed down and compute the reading again
    return told.select(key, source, "value", "day")
