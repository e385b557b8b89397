"""Numbers, dates and colours in the notations of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of powers of one thousand
SHORT = ("", "K", "M", "G", "T", "P", "E", "Z", "Y")
MEDIUM = ("", "Kilo", "Mega", "Giga", "Tera", "Peta", "Exa", "Zetta", "Yotta")
LONG = ("", "Thousand", "Million", "Billion", "Trillion", "Quadrillion", "Quintillion", "Sextillion", "Septillion")
NAMES = {"short": SHORT, "medium": MEDIUM, "long": LONG}


def pretty_time(seconds: Column) -> Column:
    """A duration in days, hrs, min and sec, without leading units that are zero."""
    s = F.floor(seconds).cast("bigint")
    day, hour, minute, second = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.format_string("%d sec", second)
    text = F.when(s >= 60, F.format_string("%d min, %d sec", minute, second)).otherwise(text)
    text = F.when(s >= 3600, F.format_string("%d hrs, %d min, %d sec", hour, minute, second)).otherwise(text)
    return F.when(s >= 86400, F.format_string("%d days, %d hrs, %d min, %d sec", day, hour, minute, second)).otherwise(text)


def pretty_number(number: Column, mode: str = "short", precision: int = 2) -> Column:
    """A number with the name of its power of one thousand, rounded at each division by it."""
    if mode not in NAMES:
        raise ValueError("mode must be short, medium or long")
    values, names = [number.cast("double")], NAMES[mode]
    for _ in names[1:]:
        values.append(F.when(F.abs(values[-1]) >= 1000, F.round(values[-1] / 1000, precision)))
    text = None
    for value, name in zip(values, names):
        this = F.concat(value.cast("string"), F.lit(f" {name}"))
        text = this if text is None else F.when(value.isNotNull(), this).otherwise(text)
    return text


def money(c: Column) -> Column:
    """``$12.43M`` as a number; suffixes K, M, B and T; ``n/a`` and other text give null."""
    digits = F.regexp_extract(F.trim(c), r"^\$?([0-9]+(?:\.[0-9]+)?)[KMBT]?$", 1)
    suffix = F.right(F.trim(c), F.lit(1))
    factor = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9).when(suffix == "T", 1e12).otherwise(1.0)
    return F.when(digits != "", digits).cast("double") * factor


def day_shift(now: Column, before: Column, year: int = 31_536_000, day: int = 86_400) -> Column:
    """By how many days a date comes earlier than one year after another one; toward zero."""
    return ((F.unix_timestamp(now) - F.unix_timestamp(before) - F.lit(year)) / F.lit(-day)).cast("int")


def weekdays(start: Column) -> Column:
    """The dates from Monday to Friday in the month after a date."""
    days = F.sequence(F.to_date(start), F.date_sub(F.add_months(F.to_date(start), 1), 1))
    return F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7))


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """``#rrggbb`` of three numbers from 0 to 255."""
    return F.format_string("#%02x%02x%02x", red.cast("int"), green.cast("int"), blue.cast("int"))


def support_colour(support: Column) -> Column:
    """Six hex digits from red (0) over blue (0.5) to green (1); black for null or 0, null outside 0..1."""
    def two(c: Column) -> Column:
        return F.lpad(F.hex(c.cast("int")), 2, "0")

    zero = F.lit("00")
    red = F.when(support <= 0.5, two(175 - 175 * support)).otherwise(zero)
    green = F.when(support >= 0.5, two(175 * support)).otherwise(zero)
    blue = two(175 * (1 - F.abs(0.5 - support)))
    coloured = F.when((support >= 0) & (support <= 1), F.concat(red, green, blue))
    return F.when(support.isNull() | (support == 0), F.lit("000000")).otherwise(coloured)


# fixed values: twenty colours of greatest contrast, in order
CONTRAST = (
    "#f2f3f4", "#222222", "#f3c300", "#875692", "#f38400", "#a1caf1", "#be0032", "#c2b280", "#848482", "#008856",
    "#e68fac", "#0067a5", "#f99379", "#604e97", "#f6a600", "#b3446c", "#dcd300", "#882d17", "#8db600", "#654522",
)


def contrast_colour(n: Column) -> Column:
    """The n-th colour (from 0) of the palette, which begins again after its last one."""
    return F.element_at(F.array(*[F.lit(c) for c in CONTRAST]), F.pmod(n, F.lit(len(CONTRAST))).cast("int") + 1)


def jittered_colour(red: Column, green: Column, blue: Column, key: Column, spread: int = 20, seed: int = 1) -> Column:
    """A colour moved by up to ``spread`` in each part, within 0..255, by a seeded hash of a key."""
    part = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(255), c + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(2 * spread + 1)) - spread))
    return hex_colour(part(red, 1), part(green, 2), part(blue, 3))


def epoch(c: Column, pattern: str = "MM/dd/yyyy") -> Column:
    """A date in seconds since 1970; ``n/a``, empty and other texts give null."""
    return F.unix_timestamp(F.try_to_timestamp(F.when(F.trim(c).rlike("[0-9]"), F.trim(c)), F.lit(pattern)))


def outside_band(now: Column, before: Column, early: int, late: int, year: int = 31_536_000, day: int = 80_640) -> Column:
    """True where a date (in seconds) comes more than ``early`` days before, or ``late`` days after, one year after another one."""
    moved = now - before - F.lit(year)
    return F.coalesce((moved + F.lit(day * early) < 0) | (moved - F.lit(day * late) > 0), F.lit(False))


def reversed_map(c: Column) -> Column:
    """Values as keys; of several keys of a value the last one in order."""
    groups = F.map_from_entries(F.transform(F.array_distinct(F.map_values(c)), lambda v: F.struct(v, F.array_max(F.map_keys(F.map_filter(c, lambda k, x: x == v))))))
    return F.when(F.size(c) > 0, groups)


def get_or(c: Column, key: Column, default: Column) -> Column:
    """A map's value for a key, else a default."""
    return F.coalesce(F.try_element_at(c, key), default)
