"""Names, labels and display forms as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, formatted

# fixed values: codes and labels of the data model
POLLUTANT_CODES = {"PM25": "PM2.5"}
SOURCE_BADGES = {"municipal-official": "Resmi belediye", "municipal-sensor": "Sensör ağı", "modeled": "Model"}
DEFAULT_BADGE = "Resmî"
MONTHS = ("Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara")
SOURCE_WEIGHTS = {"municipal-official": 0.96, "municipal-sensor": 0.92, "modeled": 0.82}
BACKGROUND = {2000: "rural-background", 2002: "suburban-background"}
AREAS = {2000: "rural", 2002: "suburban"}
SITES = {1001: "traffic", 1002: "industrial"}


def mapped(c: Column | str, names: dict, default: Column | str) -> Column:
    """The name of a code; the default where it has none or is null."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(default) if isinstance(default, str) else default)


def pollutant_name(c: Column | str) -> Column:
    return mapped(c, POLLUTANT_CODES, col(c))


def source_badge(source: Column | str) -> Column:
    return mapped(F.coalesce(col(source), F.lit("")), SOURCE_BADGES, DEFAULT_BADGE)


def station_type(source_code: Column | str, area_code: Column | str) -> Column:
    area = lambda names, other: mapped(F.coalesce(col(area_code), F.lit(-1)), names, other)
    source = F.coalesce(col(source_code), F.lit(-1))
    return F.when(source == 1003, area(BACKGROUND, "urban-background")).otherwise(mapped(source, SITES, area(AREAS, "urban")))


def district(title: Column | str) -> Column:
    """A station title without the city before and the network's mark behind it, up to a bracket."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(col(title), "Bursa - |Bursa-", "")), "-MTHM", ""))
    return F.when(F.contains(bare, F.lit("(")), F.trim(F.split_part(bare, F.lit("("), F.lit(1)))).when(bare == "Bursa", "Nilüfer").when(bare == "", "Bursa").otherwise(bare)


def sensor_name(name: Column | str, tenant: Column | str) -> Column:
    """What comes before ` - `; else the tenant and the name."""
    head = F.trim(F.split_part(col(name), F.lit(" - "), F.lit(1)))
    owner = F.coalesce(col(tenant), F.lit(""))
    return F.when((head != "") & (head != col(name)), head).when(owner != "", F.trim(F.concat(owner, F.lit(" / "), col(name)))).otherwise(col(name))


def utc_text(c: Column | str) -> Column:
    return F.when(F.endswith(col(c), F.lit("Z")), col(c)).otherwise(F.concat(col(c), F.lit("Z")))


def official_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "dd.MM.yyyy HH:00")


def years_back(day: Column | str, n: int) -> Column:
    """The same day n years before; 29 February becomes the 28th."""
    return F.add_months(col(day), -12 * n)


def event_window(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """A week before an event to two weeks after it."""
    return F.date_sub(col(start), 7), F.date_add(col(end), 14)


def percent(c: Column | str, digits: int = 0) -> Column:
    return F.when(col(c).isNull() | F.isnan(col(c)), formatted(c)).otherwise(F.concat(F.lit("%"), formatted(col(c) * 100, digits)))


def signed(c: Column | str, digits: int = 1) -> Column:
    return F.when(col(c) > 0, F.concat(F.lit("+"), formatted(c, digits))).otherwise(formatted(c, digits))


def day_label(day: Column | str) -> Column:
    d = col(day)
    return F.concat_ws(" ", F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))


def string_hash(c: Column | str) -> Column:
    """The 31-fold polynomial of the characters' codes in 32 bits, without its sign."""
    span = 1 << 32
    wrapped = lambda x: F.pmod(x + (1 << 31), F.lit(span)) - (1 << 31)
    codes = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrapped(h * 31 + x)))


def noise(seed: Column | str) -> Column:
    x = F.sin(col(seed) * 12.9898) * 43758.5453123
    return x - F.floor(x)


def spread(value: Column | str, threshold: float, source: Column | str) -> tuple[Column, Column]:
    """(intensity, radius) of a measurement's mark on a map."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(value) / max(1.55 * threshold, threshold + 28)))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in SOURCE_WEIGHTS.items() for x in item]), F.coalesce(col(source), F.lit(""))), F.lit(1.0))
    return 0.18 + 0.82 * share, (56 + 118 * share) * weight


def surface_method(wanted: Column | str, available: Column | str) -> Column:
    """The wanted method where it is available, else the first that is, else idw."""
    return F.when(F.array_contains(col(available), col(wanted)), col(wanted)).otherwise(F.coalesce(F.get(col(available), F.lit(0)), F.lit("idw")))
