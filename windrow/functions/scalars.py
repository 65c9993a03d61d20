"""Scalar expressions: text, units, time buckets, labels and the normal distribution, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels, codes and limits of the data model
SEASONS = ("Kış", "İlkbahar", "Yaz", "Sonbahar")
COMPASS = ("K", "KD", "D", "GD", "G", "GB", "B", "KB")
THRESHOLDS = {"PM10": 50.0, "PM2.5": 25.0, "NO2": 100.0, "SO2": 125.0, "O3": 120.0, "CO": 10.0}
LATIN = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĞğİŞş", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyGgISs")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str) -> Column:
    """To 6 digits, nudged by a thousandth of one so that a tie doesn't hang on the order in which a sum was made."""
    return F.round(col(c) + 1e-9, 6)


def slug(c: Column | str) -> Column:
    """Identifier of a name: accents off, other non-ASCII dropped, lower case, runs of the rest as single hyphens."""
    plain = F.regexp_replace(F.translate(col(c), *LATIN), r"[^\x00-\x7F]", "")
    dashed = F.regexp_replace(F.translate(F.lower(plain), "/ ", "--"), "[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-|-$", "")


def lenient_double(c: Column | str) -> Column:
    """A number with a decimal comma or point; null if it is none."""
    return F.replace(col(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def converted(value: Column | str, unit: Column | str, pollutant: Column | str) -> Column:
    """CO in mg/m3, everything else in ug/m3."""
    v, u = col(value), F.replace(F.replace(F.lower(col(unit)), F.lit("µ"), F.lit("u")), F.lit("μ"), F.lit("u"))
    co = col(pollutant) == "CO"
    out = F.when(co & F.contains(u, F.lit("u")), v / 1000).when(~co & F.contains(u, F.lit("mg")), v * 1000).otherwise(v)
    return F.round(out, 6)


def canonical_unit(pollutant: Column | str) -> Column:
    return F.when(col(pollutant) == "CO", "mg/m3").otherwise("ug/m3")


def parsed_timestamp(c: Column | str) -> Column:
    """The first of the known forms that fits; an ISO offset is applied."""
    forms = ("dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    tried = [F.try_to_timestamp(col(c), F.lit(f)) for f in forms]
    return F.coalesce(*tried, col(c).try_cast("timestamp"))


def excel_time(serial: Column | str) -> Column:
    """Days since 1899-12-30, with fractions, as a timestamp."""
    return F.timestamp_seconds(F.round((col(serial) - 25569) * 86400))


def wkt_point(c: Column | str) -> tuple[Column, Column]:
    """(lat, lng) of POINT(lng lat)."""
    form = r"POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    return tuple(F.nullif(F.regexp_extract(col(c), form, i), F.lit("")).try_cast("double") for i in (2, 1))


def season_index(day: Column | str) -> Column:
    return F.floor(F.pmod(F.month(col(day)), F.lit(12)) / 3).cast("int")


def season_year(day: Column | str) -> Column:
    return F.year(F.add_months(col(day), 1))


def bucket(day: Column | str, resolution: str) -> tuple[Column, Column]:
    """(key, label) of the day, month, season or year that holds a day."""
    d = col(day)
    if resolution == "season":
        name = F.element_at(F.array(*map(F.lit, SEASONS)), season_index(d) + 1)
        return F.concat_ws("-", season_year(d).cast("string"), season_index(d).cast("string")), F.concat_ws(" ", name, season_year(d).cast("string"))
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[resolution]
    key = F.date_format(d, form)
    return key, key


def compass(angle: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(col(angle) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def inclusive_days(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.datediff(col(end), col(start)) + 1, F.lit(0))


def overlap_days(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    return F.greatest(F.datediff(F.least(col(e1), col(e2)), F.greatest(col(s1), col(s2))) + 1, F.lit(0))


def normal_cdf(z: Column | str) -> Column:
    """By the five-term polynomial for erf (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 0.5 * (1 + F.signum(col(z)) * (1 - poly * F.exp(-x * x)))


def two_sided_p(z: Column | str) -> Column:
    return 2 * (1 - normal_cdf(F.abs(col(z))))


def continuity_z(s: Column | str, variance: Column | str) -> Column:
    s, root = col(s), F.sqrt(col(variance))
    return F.when(s > 0, (s - 1) / root).when(s < 0, (s + 1) / root).otherwise(0.0)


def risk_label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 0.75, "Cok yuksek").when(s >= 0.55, "Yuksek").when(s >= 0.35, "Orta").otherwise("Dusuk")


def hotspot_class(z: Column | str) -> Column:
    """Hot and cold spots at 99, 95 and 90 percent."""
    z, out = col(z), None
    for name, sign in (("hotspot", 1), ("coldspot", -1)):
        for limit, level in ((2.58, 99), (1.96, 95), (1.65, 90)):
            hit, label = (z >= limit if sign > 0 else z <= -limit), f"{name}-{level}"
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("not-significant")


def banded(c: Column | str, limits: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the first limit reached, from the highest; the last label below all."""
    out = F.when(col(c) >= limits[0], labels[0])
    for limit, label in zip(limits[1:], labels[1:], strict=False):
        out = out.when(col(c) >= limit, label)
    return out.otherwise(labels[-1])


def formatted(c: Column | str, digits: int = 1) -> Column:
    """1.234,5; `Veri yok` where there is no number."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), "Veri yok").otherwise(F.translate(F.format_number(c, digits), ",.", ".,"))
