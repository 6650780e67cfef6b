"""Scalar functions of the lifecycle records, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Service steps proper, and all step types that count as one.
SERVICE_TYPES = ("RepairServiceStep", "ReplaceServiceStep", "CleaningServiceStep", "RemanufacturingServiceStep", "RefurbishmentServiceStep", "RecyclingStep")
SECONDARY_TYPES = ("SecondaryValueStep", *SERVICE_TYPES)
#: What a step's type name contains, in the order it is looked for, and the bucket it goes to.
BUCKETS = (("repair", "Repair"), ("replace", "Replace"), ("clean", "Cleaning"), ("remanufactur", "Remanufacturing"), ("refurb", "Refurbishment"))
#: Units whose factor is for one of them.
EXACT_UNITS = ("kWh", "kg", "km")


def rounded(x: Column, digits: int) -> Column:
    """To the nearest multiple of 10 ** -digits (6 digits at most), of two as near to the even one, by the exact binary value.

    The product with 10 ** digits is known exactly as a double and its error: halves of
    27 bits (Veltkamp's splitting) times a number of at most 20 bits are exact.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    low = F.floor(product).cast("double")
    over = (product - low - F.lit(0.5)) + error  # its sign is exact
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    # Beyond 2 ** 52 units a double has no such digits left.
    return F.when(F.abs(product) < F.lit(4503599627370496.0), (low + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


def with_rounded(rows: DataFrame, **columns: tuple[Column, int]) -> DataFrame:
    """Adds columns rounded to so many digits. They are computed in a step of their own, so that rounding, which names its argument often, stays small."""
    return rows.withColumns({name: x for name, (x, _) in columns.items()}).withColumns({name: rounded(F.col(name), digits) for name, (_, digits) in columns.items()})


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def is_urn_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike("^urn:uuid:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), F.lit(False))


def digits_of_length(x: Column, n: int) -> Column:
    return F.coalesce(x.rlike(f"^[0-9]{{{n}}}$"), F.lit(False))


def gs1_check_digit(body: Column) -> Column:
    """The check digit of a GS1 number without it: weights 3 and 1 from the right."""
    digits = F.split(F.reverse(body), "")
    weighted = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10) % 10


def is_gs1(x: Column, n: int) -> Column:
    """A GS1 number of n digits whose last one checks."""
    return digits_of_length(x, n) & (gs1_check_digit(F.substring(x, 1, n - 1)) == F.substring(x, n, 1).cast("int"))


def gs1_number(body: Column) -> Column:
    return F.concat(body, gs1_check_digit(body).cast("string"))


def classify_step(kind: Column) -> Column:
    """Category by name: a name with "manufactur" is production, so remanufacturing is too."""
    low = F.lower(kind)
    return F.when(low.contains("transport"), "transport").when(low.contains("production") | low.contains("manufactur") | low.contains("assembly"), "production").otherwise("secondary")


def map_category(kind: Column) -> Column:
    """Category by type, as the process map has it: remanufacturing is secondary here."""
    return F.when(kind == "TransportStep", "transport").when(kind == "ProductionStep", "production").when(is_secondary(kind), "secondary").otherwise(classify_step(kind))


def is_secondary(kind: Column) -> Column:
    return kind.isin(*SECONDARY_TYPES)


def service_bucket(kind: Column) -> Column:
    out, low = F, F.lower(kind)
    for part, bucket in BUCKETS:
        out = out.when(low.contains(part), bucket)
    return out


def short_type(kind: Column) -> Column:
    return F.replace(F.replace(kind, F.lit("ServiceStep"), F.lit("")), F.lit("Step"), F.lit(""))


def to_utc(x: Column) -> Column:
    """A time from an ISO string, a date or a timestamp; null if it is none. The session's zone is UTC."""
    return x.try_cast("timestamp")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between, rounded down also below zero."""
    return F.floor(fractional_days(later, earlier)).cast("double")


def fractional_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400000000.0)


def age_days(declared: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), whole_days(as_of, declared))


def number(x: Column, default: float = 0.0) -> Column:
    value = x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value)


def weight_kg(value: Column, unit: Column) -> Column:
    u = F.upper(F.coalesce(unit, F.lit("GRM")))
    return number(value) * F.when(u.isin("KGM", "KG"), 1.0).when(u == "MG", 1e-6).otherwise(1e-3)


def purity(p: Column) -> Column:
    """A share between 0 and 1: above 1.5 it was a percentage."""
    share = F.when(p > 1.5, p / 100.0).otherwise(p)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def cost(*fields: Column) -> Column:
    return F.coalesce(*fields, F.lit(0.0))


def shown_cost(x: Column) -> Column:
    """What a history shows: no cost instead of zero."""
    return F.nullif(x, F.lit(0.0))


def symptoms_from_text(x: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(x, separator), lambda s: F.trim(s)), lambda s: s != "")


def trimmed_symptoms(x: Column) -> Column:
    return F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != "")


def target_ids(repaired: Column, replaced: Column, cleaned: Column, repaired_many: Column, cleaned_many: Column, pairs: Column) -> Column:
    """All part ids a step is about, each once."""
    none = F.array().cast("array<string>")
    old = F.transform(F.coalesce(pairs, F.array().cast("array<struct<old_id:string>>")), lambda p: p["old_id"])
    many = F.concat(F.array(repaired, replaced, cleaned), F.coalesce(repaired_many, none), F.coalesce(cleaned_many, none), old)
    return F.array_distinct(F.filter(many, lambda i: i.isNotNull()))


def place_key(place_id: Column, name: Column) -> Column:
    return F.coalesce(place_id, name)


def emissions_kg(quantity: Column, factor: Column) -> Column:
    return quantity * factor


def units_compatible(activity: Column, factor: Column) -> Column:
    """Energy, mass and distance need a factor for that unit; others take any."""
    return F.when(activity.isin(*EXACT_UNITS), factor == F.concat(F.lit("kgCO2e/"), activity)).otherwise(F.lit(True))


def humanised_days(days: Column) -> Column:
    """Days below two months, months below a year, else years."""
    return (
        F.when(days.isNull(), None)
        .when(days < 60, F.format_string("%d days", F.floor(days + 0.5)))
        .when(days < 365, F.format_string("%d months", F.floor(days / 30.0 + 0.5)))
        .otherwise(F.format_string("%s years", (F.floor(days / 365.0 * 10.0 + 0.5) / 10.0).cast("string")))
    )


def euros(x: Column) -> Column:
    """An amount with two places and the sign of its currency, a dash without one."""
    return F.when(x.isNull(), F.lit("–")).otherwise(F.concat(F.format_string("%.2f", x), F.lit(" €")))


def purity_percent(value: Column) -> Column:
    """A purity from a number or text as a percentage with two places; shares up to 1 are of one."""
    p = F.when(F.typeof(value) == "string", F.regexp_replace(value.cast("string"), "%", "")).otherwise(value.cast("string")).try_cast("double")
    return rounded(F.when(p <= 1.0, p * 100.0).otherwise(p), 2)


def coordinates(latitude: Column, longitude: Column, geo_latitude: Column, geo_longitude: Column) -> Column:
    """Latitude and longitude of a place, or else those of its geo field; null unless both are known."""
    lat, lon = F.coalesce(latitude, geo_latitude), F.coalesce(longitude, geo_longitude)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("latitude"), lon.alias("longitude")))


def spaced_times(start: Column, end: Column, n: Column) -> Column:
    """n points of time at even distances from start to end, both included; start alone for one."""
    step = (F.unix_micros(end) - F.unix_micros(start)) / F.greatest(n - 1, F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.timestamp_micros((F.unix_micros(start) + k * step).cast("bigint"))))


def percent(p: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(p * 100.0 + 0.5)))


def clean_text(x: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def country(x: Column) -> Column:
    return F.upper(F.trim(x))


def is_rare_name(x: Column) -> Column:
    return x.rlike("(?i)ndfeb|magnet|rare")
