"""Rules that rows must meet before they are stored: accepted rows, and rejected ones with the reasons.

A rule is a name and a condition; a row is rejected for every rule whose condition
is not true. Conditions on single rows are columns; those on other tables (a link
resolves, an id is new) are joined in as columns first: ``checked_*`` gives the rows of
an entity with these columns, and all of its rules, for ``judged`` or ``insert_checked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import country, digits_of_length, is_urn_uuid

Rules = dict[str, Column]
#: Rows with what was looked up for them, and the rules that use it.
Checked = tuple[DataFrame, Rules]
#: Columns that a check adds begin so.
FLAG = "link_ok_"


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows with ``reasons``, the names of the rules they break."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.withColumn("reasons", F.array_compact(broken))


def accepted(rows: DataFrame, rules: Rules) -> DataFrame:
    return judged(rows, rules).where(F.size("reasons") == 0).drop("reasons")


def rejected(rows: DataFrame, rules: Rules) -> DataFrame:
    return judged(rows, rules).where(F.size("reasons") > 0)


def resolves(rows: DataFrame, column: str, target: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds ``flag``: the link is in the target table."""
    keys = target.select(F.col(key).alias("resolved_key")).distinct()
    return rows.join(keys, F.col(column) == F.col("resolved_key"), "left").withColumn(flag, F.col("resolved_key").isNotNull()).drop("resolved_key")


def all_resolve(rows: DataFrame, column: str, target: DataFrame, key: str, row_id: str, flag: str) -> DataFrame:
    """Adds ``flag``: every link of a list is in the target table, and none is there twice; no list is an empty one.

    Rows that share an id are judged together.
    """
    links = rows.select(F.col(row_id).alias("of"), F.explode(column).alias("link"))
    known = resolves(links, "link", target, key, "known").groupBy("of").agg(F.min("known").alias("all_known"))
    once = F.coalesce(F.size(column) == F.size(F.array_distinct(column)), F.lit(True))
    found = rows.join(known, F.col(row_id).eqNullSafe(F.col("of")), "left")
    return found.withColumn(flag, once & F.coalesce("all_known", F.lit(True))).drop("of", "all_known")


def unique(rows: DataFrame, keys: list[str], existing: DataFrame | None, flag: str) -> DataFrame:
    """Adds ``flag``: no other new row and no stored row has these keys."""
    once = rows.withColumn(flag, F.count("*").over(Window.partitionBy(*keys)) == 1)
    if existing is None:
        return once
    stored = existing.select(*(F.col(k).alias(f"stored_{k}") for k in keys)).distinct()
    match = [F.col(k) == F.col(f"stored_{k}") for k in keys]
    return once.join(stored, match, "left").withColumn(flag, F.col(flag) & F.col(f"stored_{keys[0]}").isNull()).drop(*stored.columns)


def insert(rows: DataFrame, existing: DataFrame, key: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """What an insert appends, and what it turns away: broken rules or an id that is taken."""
    checked = unique(rows, [key], existing, "id_is_new")
    all_rules = rules | {"duplicate_id": F.col("id_is_new")}
    return accepted(checked, all_rules).drop("id_is_new"), rejected(checked, all_rules).drop("id_is_new")


def insert_checked(checked: Checked, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """As ``insert``, for an entity's own checks."""
    rows, rules = checked
    flags = [c for c in rows.columns if c.startswith(FLAG)]
    new, refused = insert(rows, existing, key, rules)
    return new.drop(*flags), refused.drop(*flags)


def judge(checked: Checked) -> DataFrame:
    """An entity's rows with the names of the rules they break."""
    rows, rules = checked
    return judged(rows, rules).drop(*(c for c in rows.columns if c.startswith(FLAG)))


def filled(column: str) -> Column:
    return F.trim(column) != ""


def at_least_zero(column: str) -> Column:
    return (F.col(column) >= 0) & ~F.isnan(column)


def optional(column: str, ok: Column) -> Column:
    return F.col(column).isNull() | ok


def organisation_rules(eori: str = "eori", lucid: str | None = None) -> Rules:
    """Names and address of any organisation; registration numbers where there are any."""
    rules = {"name": filled("name"), "url": F.col("url").rlike("^https?://"), "eori": optional(eori, F.col(eori).rlike("^DE[0-9]{10}$"))}
    return rules | ({"lucid": optional(lucid, F.col(lucid).rlike("^DE[0-9]{20}$"))} if lucid else {})


def transport_rules(number: str = "transport_number") -> Rules:
    return {"transport_number": F.col(number).rlike("^DE-BAG-[0-9]{4}-[0-9]{6}$")}


def checked_transport(rows: DataFrame, number: str = "transport_number") -> Checked:
    """Companies that transport goods: organisations with a permit number."""
    return rows, organisation_rules() | transport_rules(number)


def place_rules() -> Rules:
    code = country(F.col("country"))
    return {"gln": digits_of_length(F.col("place_id"), 13), "latitude": F.col("latitude").between(-90, 90), "longitude": F.col("longitude").between(-180, 180), "country": F.length(code).between(2, 3), "name": filled("name")}


def material_rules() -> Rules:
    return {"id": is_urn_uuid(F.col("material_instance_id")), "weight": at_least_zero("weight_g"), "recycled": F.col("pct_recycled").between(0, 100), "purity": at_least_zero("purity"), "batch": filled("batch_number")}


def part_rules() -> Rules:
    sizes = {c: F.col(c) > 0 for c in ("height_cm", "width_cm", "depth_cm", "weight_g")}
    return {"id": is_urn_uuid(F.col("part_static_id")), "mtbf": at_least_zero("mtbf_hrs"), **sizes}


def passport_rules() -> Rules:
    counters = {c: optional(c, at_least_zero(c)) for c in ("cleaning_count", "chalk_count", "brewing_count", "grinding_count", "operating_hrs")}
    return {"sgtin": digits_of_length(F.col("instance_id"), 34), "timeline": F.col("guarantee_end") >= F.col("declared_at"), **counters}


def line_rules() -> Rules:
    return {"gtin": digits_of_length(F.col("static_id"), 14), "ean": optional("ean", digits_of_length(F.col("ean"), 13)), "mtbf": at_least_zero("expected_mtbf_hrs")}


def emission_rules() -> Rules:
    return {"factor": at_least_zero("factor"), "quantity": at_least_zero("quantity"), "emissions": at_least_zero("kg")}


def step_rules() -> Rules:
    return {"place": F.col("place_id").isNotNull(), "distance": optional("distance_km", at_least_zero("distance_km")), "cost": optional("cost", at_least_zero("cost"))}


def links(rows: DataFrame, **targets: tuple[str, DataFrame, str]) -> Checked:
    """Rules that single links resolve; each names its column, the table it leads to and that table's key.

    A target holds only rows of the type that the link asks for.
    """
    for name, (column, target, key) in targets.items():
        rows = resolves(rows, column, target, key, FLAG + name)
    return rows, {name: F.col(FLAG + name) for name in targets}


def of_type(organisations: DataFrame, kind: str) -> DataFrame:
    return organisations.where(F.col("type") == kind)


def checked_places(rows: DataFrame, organisations: DataFrame) -> Checked:
    found, rules = links(rows, managed_by=("managed_by", organisations, "org_id"))
    address = {"city": filled("city"), "postal_code": filled("postal_code")}
    return found, place_rules() | address | rules


def checked_passports(rows: DataFrame, lines: DataFrame, places: DataFrame) -> Checked:
    """Products need their line; where they are may be missing, but not unknown."""
    found, rules = links(rows, line=("static_id", lines, "static_id"), location=("location_id", places, "place_id"))
    return found, passport_rules() | rules | {"location": optional("location_id", rules["location"])}


def checked_lines(rows: DataFrame, organisations: DataFrame, part_statics: DataFrame, places: DataFrame) -> Checked:
    """Product lines need a manufacturer and an operator, and may have an importer; spare parts and places to return to are known, each once."""
    found, rules = links(
        rows, manufacturer=("manufacturer_id", of_type(organisations, "Manufacturer"), "org_id"),
        operator=("operator_id", organisations, "org_id"), importer=("importer_id", of_type(organisations, "Importer"), "org_id"))
    rules["importer"] = optional("importer_id", rules["importer"])
    lists = {"spares": ("spare_ids", part_statics, "part_static_id"), "returning_places": ("returning_place_ids", places, "place_id")}
    for name, (column, target, key) in lists.items():
        found = all_resolve(found, column, target, key, "static_id", FLAG + name)
        rules[name] = F.col(FLAG + name)
    return found, line_rules() | rules


def checked_steps(rows: DataFrame, places: DataFrame, emissions: DataFrame | None = None, key: str = "step_key") -> Checked:
    """Steps have a known place; their destination may be missing, but not unknown. With ``emissions``, records that have a step's ``key``, all of them are in order."""
    found, rules = links(rows, place=("place_id", places, "place_id"), destination=("dest_id", places, "place_id"))
    rules = step_rules() | rules | {"destination": optional("dest_id", rules["destination"])}
    if emissions is None:
        return found, rules
    bad = rejected(emissions, emission_rules()).select(F.col(key).alias("bad_step")).distinct()
    found = found.join(bad, F.col(key) == F.col("bad_step"), "left").withColumn(f"{FLAG}emissions", F.col("bad_step").isNull()).drop("bad_step")
    return found, rules | {"emissions": F.col(f"{FLAG}emissions")}


def _with_steps(checked: Checked, row_id: str, steps: DataFrame, places: DataFrame) -> Checked:
    """Adds the rule that all of a row's steps, which have its id in ``owner_id``, are in order."""
    rows, rules = checked
    bad = judge(checked_steps(steps, places)).where(F.size("reasons") > 0).select(F.col("owner_id").alias("bad_owner")).distinct()
    found = rows.join(bad, F.col(row_id) == F.col("bad_owner"), "left").withColumn(f"{FLAG}steps", F.col("bad_owner").isNull())
    return found.drop("bad_owner"), rules | {"steps": F.col(f"{FLAG}steps")}


def checked_parts(rows: DataFrame, part_statics: DataFrame, steps: DataFrame, places: DataFrame) -> Checked:
    found, rules = links(rows, static=("part_static_id", part_statics, "part_static_id"))
    return _with_steps((found, {"id": is_urn_uuid(F.col("part_id"))} | rules), "part_id", steps, places)


def checked_part_statics(rows: DataFrame, organisations: DataFrame) -> Checked:
    found, rules = links(rows, manufacturer=("manufacturer_id", of_type(organisations, "Manufacturer"), "org_id"))
    return found, part_rules() | rules


def checked_materials(rows: DataFrame, material_statics: DataFrame, steps: DataFrame, places: DataFrame) -> Checked:
    found, rules = links(rows, static=("material_static_id", material_statics, "material_static_id"))
    return _with_steps((found, material_rules() | rules), "material_instance_id", steps, places)


def checked_material_statics(rows: DataFrame, existing: DataFrame | None, organisations: DataFrame) -> Checked:
    """A manufacturer's material has a name that no other of its materials has."""
    found, rules = links(rows, manufacturer=("manufacturer_id", of_type(organisations, "Manufacturer"), "org_id"))
    found = unique(found, ["material_name", "manufacturer_id"], existing, f"{FLAG}name")
    return found, {"id": is_urn_uuid(F.col("material_static_id")), **rules, "name": F.col(f"{FLAG}name")}
