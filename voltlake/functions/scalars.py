"""Identifier, date, path, marker and unit functions."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR = "|"


def record_id(*parts: Column) -> Column:
    """Parts joined by a bar; a bar inside a part fails the query, as the id could not be parsed again."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    clash = F.exists(F.array(*text), lambda x: F.contains(x, F.lit(BAR)))
    return F.when(clash, F.raise_error(F.lit("a part holds the delimiter |")).cast("string")).otherwise(F.concat_ws(BAR, *text))


def record_parts(rid: Column, names: list[str]) -> Column:
    """A struct of the id's parts; null unless there are exactly as many as names."""
    parts = F.split(rid, r"\|")
    return F.when(F.size(parts) == len(names), F.struct(*[parts[k].alias(n) for k, n in enumerate(names)]))


def or_none(c: Column, default: str = "none") -> Column:
    """The trimmed value, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def iso_date(c: Column) -> Column:
    """The date of exactly YYYY-MM-DD, else null."""
    return F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))


def completed_years(birth: Column, on: Column) -> Column:
    """Full years from birth to on; null if either is null or they are reversed."""
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.when(on >= birth, (F.year(on) - F.year(birth) - before.cast("int")).cast("long"))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def add_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


def entity_name(subject: Column, session: Column, task: Column, run: Column, suffix: str) -> Column:
    """sub-…_ses-…_task-…_run-…_suffix; null entities are left out."""
    named = [add_prefix(c, f"{n}-") for c, n in ((subject, "sub"), (session, "ses"), (task, "task"), (run, "run"))]
    return F.concat_ws("_", *named, F.lit(suffix))


def entity_token(name: Column, entity: str) -> Column:
    """The value behind entity- in a file name, or null."""
    return F.nullif(F.regexp_extract(name, rf"(?:^|_){entity}-([^_.]+)", 1), F.lit(""))


def strip_suffixes(c: Column) -> Column:
    return F.regexp_replace(c, r"(\.[^.]+)+$", "")


def root_before_subject(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/sub-", 1)


def marker_code(description: Column) -> Column:
    """The number in a description that starts with S, else null."""
    return F.when(F.startswith(F.trim(description), F.lit("S")), F.try_to_number(F.nullif(F.regexp_replace(description, "[^0-9]", ""), F.lit("")), F.lit("999999999")).cast("int"))


def behaviour_code(code: Column) -> Column:
    """(code, stimulus) of 'r_31 174183' or '31 174183'."""
    parts = F.split(F.regexp_replace(F.trim(code), "^r_", ""), r"\s+")
    return F.struct(parts[0].try_cast("int").alias("code"), F.try_element_at(parts, F.lit(2)).alias("stimulus"))


def stimulus_id(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)\.bmp$", "")


def seconds_text(seconds: Column) -> Column:
    return F.format_string("%.6f", seconds)


def ticks_to_seconds(ticks: Column) -> Column:
    """Ticks of 0.1 ms."""
    return ticks / 10000.0


def to_sample(seconds: Column, rate: float, first: int = 0) -> Column:
    return (F.rint(seconds * rate) + first).cast("long")


def to_metres(value: Column, unit: str) -> Column:
    return value / 1000.0 if unit == "mm" else value


def shaft_and_contact(channel: Column) -> Column:
    """(shaft, contact) of letters followed by digits, else null."""
    fits = F.rlike(channel, F.lit(r"^[A-Za-z]+[0-9]+$"))
    return F.when(fits, F.struct(F.regexp_extract(channel, "^([A-Za-z]+)", 1).alias("shaft"), F.regexp_extract(channel, "([0-9]+)$", 1).cast("int").alias("contact")))


def natural_key(name: Column) -> Column:
    """A key under which digit runs order by value: each is padded to 12 places."""
    padded = F.regexp_replace(F.lower(name), r"([0-9]+)", "000000000000$1")
    return F.regexp_replace(padded, r"0+([0-9]{12})(?![0-9])", "$1")


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def erb_width(hz: Column) -> Column:
    return 24.7 * (4.37 * hz / 1000.0 + 1.0)


def hz_to_erb_rate(hz: Column) -> Column:
    return 21.4 * F.log10(4.37 * hz / 1000.0 + 1.0)


def hz_to_bark(hz: Column) -> Column:
    return 13.0 * F.atan(0.00076 * hz) + 3.5 * F.atan(F.pow(hz / 7500.0, 2.0))


def db_to_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def power_to_db(power: Column, floor: float = 1e-30) -> Column:
    return 10.0 * F.log10(F.greatest(power, F.lit(floor)))


def magnitude(z: Column) -> Column:
    """Of a struct (re, im)."""
    return F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])


def rate_ratio(new: float, old: float, limit: int = 1000) -> tuple[int, int]:
    f = Fraction(new / old).limit_denominator(limit)
    return f.numerator, f.denominator


def harmonics(base: float, top: float) -> list[float]:
    return [base * k for k in range(1, int(math.floor(top / base)) + 1)]


def lag_samples(start: float, stop: float, rate: float, drop_zero: bool = False) -> list[int]:
    """Whole-sample lags from start to stop seconds, each once."""
    lags = range(int(round(start * rate)), int(round(stop * rate)) + 1)
    return [k for k in lags if k or not drop_zero]
