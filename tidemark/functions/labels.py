"""Times and operator-facing texts as column expressions. What cannot be told is null, never a made-up value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Indonesian names of the days from Sunday on, and of the months.
DAYS = ("Minggu", "Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu")
MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")
#: Hours from which a forecast is no warning any more.
WARN_HOURS = 6.0


def names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parse_utc(text: Column) -> Column:
    """An ISO time, with ``T`` or a blank and ``Z`` or an offset such as ``+07:00``; without either it is UTC; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), " ", "T"), r"(T\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    zone = F.nullif(F.regexp_extract(plain, r"(Z|[+-]\d{2}:\d{2})$", 1), F.lit(""))
    return F.try_to_timestamp(F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"), F.when(zone.isNull(), F.concat(plain, F.lit("Z"))).otherwise(plain)))


def utc_text(epoch_s: Column) -> Column:
    """``2024-01-31T08:36:26Z`` of seconds since 1970, cut to whole seconds."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch_s)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hours_until(text: Column, now_s: Column) -> Column:
    """Hours from ``now_s`` (seconds since 1970) to a time given as text."""
    return (F.unix_micros(parse_utc(text)) / F.lit(1e6) - now_s) / F.lit(3600.0)


def whole(x: Column) -> Column:
    """Rounded with halves up, as text."""
    return F.floor(x + 0.5).cast("bigint").cast("string")


def due_label(hours: Column) -> Column:
    """When a forecast comes true, in words."""
    minutes = F.greatest(F.lit(1), F.floor(hours * 60 + 0.5)).cast("bigint").cast("string")
    return F.when(hours <= 0, "sedang berlangsung").when(hours < 1, F.concat(minutes, F.lit(" menit lagi"))).when(hours.isNotNull(), F.concat(whole(hours), F.lit(" jam lagi")))


def until_label(seconds: Column) -> Column:
    """How far ahead a time lies, in words: rounded to minutes, hours from one hour on, days from 24 on."""
    hours = F.floor(seconds / 3600 + 0.5)
    minutes = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("bigint").cast("string")
    said = lambda n, unit: F.concat(F.lit("dalam "), n, F.lit(f" {unit}"))
    return (
        F.when(seconds <= 0, "sedang berlangsung")
        .when(seconds < 3600, said(minutes, "menit"))
        .when(hours < 24, said(hours.cast("bigint").cast("string"), "jam"))
        .when(seconds.isNotNull(), said(whole(hours / 24), "hari"))
    )


def date_label(day: Column) -> Column:
    """Weekday, day, month and year."""
    return F.concat(F.element_at(names(DAYS), F.dayofweek(day)), F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(names(MONTHS), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def clock_label(time: Column) -> Column:
    """Hours, minutes and seconds of two digits each."""
    return F.date_format(time, "HH:mm:ss")


def decimal(x: Column, places: int = 1) -> Column:
    """A number with a decimal comma; halves of its shortest decimal form away from zero."""
    return F.replace(F.format_string(f"%.{places}f", F.round(x.cast("decimal(38,18)"), places).cast("double")), F.lit("."), F.lit(","))


def coverage_label(share: Column) -> Column:
    """A share as a percentage with one place; null in words."""
    return F.when(share.isNull(), "tidak terukur").otherwise(F.concat(decimal(share * 100), F.lit("%")))


def reading(value: Column, unit: str, places: int = 1) -> Column:
    """A measured value with its unit; null in words."""
    return F.when(value.isNull() | F.isnan(value), "tidak terukur").otherwise(F.concat(decimal(value, places), F.lit(f" {unit}")))


def forecast_line(status: Column, text: Column, hours: Column) -> Column:
    """(line, warn) of a rain forecast: ``status`` is off, failed or ok; null hours mean no rain in sight. Rain within WARN_HOURS warns."""
    line = F.when(status == "off", "tidak dipasang").when(status == "failed", "gagal diambil").when(hours.isNull(), "tidak ada hujan").otherwise(F.concat_ws(" ", text, due_label(hours)))
    return F.struct(line.alias("line"), F.coalesce((status == "ok") & (hours <= WARN_HOURS), F.lit(False)).alias("warn"))


def alert_reason(area: Column, growth: Column, area_from: float, growth_from: float) -> Column:
    """Why an alert fired: the area, the growth or both; empty if neither."""
    said = lambda x, form, limit, unit: F.when(x >= limit, F.format_string(f"{form} >= {limit}", x.cast("double")))
    return F.concat_ws("; ", said(area, "area %.2f", area_from, ""), said(growth, "growth %.3f/min", growth_from, "/min"))


def notifications(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def looked_up(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The value of a closed set of keys, else ``default``."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def looked_up_or_fail(key: Column, table: dict[str, int], what: str = "class") -> Column:
    """The value of a closed set of keys; another key, null included, fails the query that reads it."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(key, F.lit("null")))).cast("int"))


def reconnect_delay(attempt: Column, most: float = 30.0) -> Column:
    """Seconds before the n-th new attempt: 1, 2, 4, ... up to ``most``."""
    return F.least(F.lit(most), F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(32))))


def live_source(source: Column) -> Column:
    """Whether a source is a camera number or a stream address, not a file."""
    return source.rlike("^[0-9]+$") | F.contains(source, F.lit("://"))


def camera_number(source: Column) -> Column:
    """The one digit that names a camera, else null."""
    return F.when(F.trim(source).rlike("^[0-9]$"), F.trim(source).cast("int"))


def jpeg(data: Column, most: int = 5 << 20) -> Column:
    """Whether bytes begin as a JPEG file does, hold more than that and at most ``most``."""
    return (F.hex(F.substring(data, 1, 3)) == "FFD8FF") & F.octet_length(data).between(4, most)


def csv_record(fields: Sequence[Column]) -> Column:
    """Fields in fixed order, comma-joined; null is an empty field."""
    return F.concat_ws(",", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def stale(age_s: Column, minutes: float = 20.0) -> Column:
    """Whether the last reading is older than ``minutes``; one that never came is stale."""
    return age_s.isNull() | (age_s / 60.0 > minutes)
