"""Linked-data (JSON-LD) export: one JSON text per organisation, place, material, part, step and passport.

Nodes are structs, so that Spark writes the JSON and leaves out null fields. The keys
below are fixed values of the vocabulary. Part trees, which no struct type can hold,
are put together from the leaves up as JSON texts, one level of the forest at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SECONDARY_TYPES
from ..stages import dealt, storing_long_texts, written

#: Fixed values of the format: the context, the action that stands for each type of step, and the keys of the fields below.
CONTEXT = {
    "schema": "https://schema.org/", "dpp": "https://example.org/dpp#",
    "name": "schema:name", "url": "schema:url", "identifier": "schema:identifier", "additionalType": "schema:additionalType",
    "address": "schema:address", "geo": "schema:geo", "latitude": "schema:latitude", "longitude": "schema:longitude",
    "managedBy": "dpp:managedBy", "isVariantOf": "schema:isVariantOf", "hasPart": "schema:hasPart",
    "height": "schema:height", "width": "schema:width", "depth": "schema:depth", "weight": "schema:weight",
    "additionalProperty": "schema:additionalProperty", "startTime": "schema:startTime", "endTime": "schema:endTime", "priceSpecification": "schema:priceSpecification",
    "ghgEmissionRecords": "dpp:ghgEmissionRecords", "scope": "dpp:scope", "scope3Category": "dpp:scope3Category", "activity": "dpp:activity",
    "emissionFactor": "dpp:emissionFactor", "emissionsKgCO2e": "dpp:emissionsKgCO2e", "calculationMethod": "dpp:calculationMethod",
    "provenance": "dpp:provenance", "excludedFromAggregation": "dpp:excludedFromAggregation",
    "destination": "dpp:destination", "modeOfTransport": "dpp:modeOfTransport", "distanceKM": "dpp:distanceKM", "reasonForTransport": "dpp:reasonForTransport",
}
ACTIONS = {
    "ProductionStep": "schema:ManufactureAction", "TransportStep": "schema:TransferAction", "RepairServiceStep": "schema:RepairAction", "CleaningServiceStep": "schema:CleanAction",
    "ReplaceServiceStep": "schema:UpdateAction", "RefurbishmentServiceStep": "schema:UpdateAction", "RemanufacturingServiceStep": "schema:UpdateAction",
}
#: A line's documents, and a product's counters with their columns and units.
DOCUMENTS = ("dataSheet", "installationOperatingGuide", "ceConformityDeclaration", "ecodesignConformityDeclaration", "repairAndServiceManual", "DisassemblyInstructions", "recyclingEOLInstructions")
COUNTERS = (("cleaningCount", "cleaning_count", None), ("chalkCount", "chalk_count", None), ("brewingCount", "brewing_count", None), ("coffeeGrindingCount", "grinding_count", None), ("operatingHRS", "operating_hrs", "HRS"))
#: A product's text takes the room of about so many usual rows when it is dealt out.
TEXT_ROWS = 10

#: Texts that are made at the same time have together about so many bytes; whoever stores one holds it some ten times over.
BYTES_AT_ONCE = 1_000_000_000

#: A text is made of pieces of about so many bytes, so that no task collects all of its objects.
PIECE_BYTES = 16_000_000

Has = set[str]


def node(kind: Column | str, fields: dict[str, Column | None]) -> Column:
    """A struct with its type first; fields that are None are left out."""
    named = [(F.lit(kind) if isinstance(kind, str) else kind).alias("@type")]
    return F.struct(*named, *(value.alias(key) for key, value in fields.items() if value is not None))


def of(row: Column, has: Has, column: str) -> Column | None:
    return row[column] if column in has else None


def given(value: Column | None, make) -> Column | None:
    """``make`` of a value, null where the value is; None if there is no such column."""
    return None if value is None else F.when(value.isNotNull(), make(value))


def when_known(column: Column, value: Column) -> Column:
    return F.when(column.isNotNull(), value)


def property_value(name: str, value: Column | None, url: bool = False) -> Column | None:
    return given(value, lambda v: node("schema:PropertyValue", {"propertyID": F.lit(name), "value": v, "url": v if url else None}))


def quantity(name: str | None, value: Column | None, unit: str | None) -> Column | None:
    return given(value, lambda v: node("schema:QuantitativeValue", {"name": F.lit(name) if name else None, "value": v, "unitCode": F.lit(unit) if unit else None}))


def document(value: Column | None) -> Column | None:
    return given(value, lambda d: node("schema:CreativeWork", {k: d[k] for k in ("name", "url", "description")}))


def iso(value: Column | None) -> Column | None:
    return None if value is None else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def text(value: Column | None) -> Column | None:
    return None if value is None else value.cast("string")


#: How an object with the context begins.
OPENING = '{"@context":{' + ",".join(f'"{k}":"{v}"' for k, v in CONTEXT.items()) + "},"


def fields_of(json: Column) -> Column:
    """An object's text without its opening brace."""
    return F.substr(json, F.lit(2))


def with_context(json: Column) -> Column:
    """The context before the fields of an object."""
    return F.concat(F.lit(OPENING), fields_of(json))


def organisation(o: Column, has: Has) -> Column:
    return when_known(o["org_id"], node("schema:Organisation", {
        "@id": o["org_id"], "schema:name": o["name"], "schema:alternateName": of(o, has, "trade_name"), "schema:url": of(o, has, "url"), "schema:identifier": property_value("GLN", o["org_id"]),
        "dpp:eoriNumber": property_value("EORI", of(o, has, "eori")), "dpp:lucidNumber": property_value("LUCID", of(o, has, "lucid")),
        "dpp:subtype": o["type"], "schema:additionalType": F.concat(F.lit("dpp:"), o["type"])}))


#: What an organisation that is part of another row has.
OWNER = {"org_id", "name", "trade_name", "url", "eori", "lucid", "type"}


def embedded(row: Column, has: Has, column: str) -> Column | None:
    """An organisation that a row holds as a struct."""
    return organisation(row[column], OWNER) if column in has else None


def place(p: Column, has: Has) -> Column:
    """With address, coordinates and, if the row has one, its ``owner``."""
    address = {"addressCountry": of(p, has, "country"), "addressLocality": of(p, has, "city"), "postalCode": of(p, has, "postal_code")}
    return when_known(p["place_id"], node("schema:Place", {
        "@id": text(p["place_id"]), "schema:name": p["name"], "schema:identifier": property_value("GLN", text(p["place_id"])), "schema:address": node("schema:PostalAddress", address),
        "schema:geo": node("schema:GeoCoordinates", {"schema:latitude": p["latitude"], "schema:longitude": p["longitude"]}), "dpp:managedBy": embedded(p, has, "owner")}))


def material_static(m: Column, has: Has) -> Column:
    return node("schema:ProductModel", {
        "@id": m["material_static_id"], "schema:name": m["material_name"], "schema:description": of(m, has, "description"), "schema:manufacturer": embedded(m, has, "manufacturer"),
        "dpp:casNumber": property_value("CAS", of(m, has, "cas_number")), "dpp:isoDesignation": property_value("ISO Designation", of(m, has, "iso_designation")), "dpp:eclassClassification": property_value("ECLASS", of(m, has, "eclass")),
        "dpp:hazardous": m["hazardous"], "dpp:rareEarth": m["rare"], "dpp:warnings": F.coalesce(m["warnings"], F.array().cast("array<string>")),
        "dpp:reachCertification": document(of(m, has, "reach_certification"))})


def material_instance(m: Column, has: Has) -> Column:
    """With its static material if the row has that; purity is not exported."""
    recycled = F.array(node("schema:PropertyValue", {"name": F.lit("percentRecycled"), "value": m["pct_recycled"]}))
    return node("schema:Product", {
        "@id": text(m["material_instance_id"]), "isVariantOf": material_static(m, has) if "material_name" in has else None, "dpp:batchNumber": of(m, has, "batch_number"),
        "schema:weight": quantity("weight", m["weight_g"], "GRM"), "additionalProperty": recycled})


def emission(e: Column, has: Has) -> Column:
    activity = {"dpp:activityType": of(e, has, "activity_type"), "dpp:quantity": e["quantity"], "dpp:unit": of(e, has, "activity_unit")}
    factor = {"dpp:description": of(e, has, "factor_description"), "dpp:value": e["factor"], "dpp:unit": of(e, has, "factor_unit"), "dpp:technology": of(e, has, "technology")}
    return node("dpp:GHGEmissionRecord", {
        "dpp:scope": e["scope"], "dpp:scope3Category": e["category"], "dpp:activity": node("dpp:ActivityData", activity), "dpp:emissionFactor": node("dpp:EmissionFactor", factor),
        "dpp:emissionsKgCO2e": e["kg"], "dpp:calculationMethod": e["method"], "dpp:provenance": of(e, has, "provenance"), "dpp:excludedFromAggregation": e["excluded"]})


def action(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), F.concat(F.lit("dpp:"), F.coalesce(kind, F.lit("ProcessStep"))))


def step(s: Column, has: Has) -> Column:
    """A step of any type with the fields of its type; the target of a cleaning, and what a production says, are not exported."""
    kind, some = s["type"], lambda c: None if c is None else F.when(F.size(c) > 0, c)
    is_service = kind.isin(*SECONDARY_TYPES)
    only = lambda ok, value: None if value is None else F.when(ok, value)
    moved, many = kind == "TransportStep", kind.isin("RefurbishmentServiceStep", "RemanufacturingServiceStep")
    filled = lambda column: given(of(s, has, column), lambda v: F.nullif(v, F.lit("")))
    return node(action(kind), {
        "dpp:stepType": kind, "startTime": iso(of(s, has, "begin_at")), "endTime": iso(of(s, has, "end_at")), "location": of(s, has, "location"),
        "dpp:destination": only(moved, of(s, has, "destination")), "dpp:modeOfTransport": only(moved, filled("mode")), "dpp:distanceKM": only(moved, quantity("distanceKM", of(s, has, "distance_km"), "KM")), "dpp:reasonForTransport": only(moved, filled("reason_for_transport")),
        "priceSpecification": only(is_service, given(of(s, has, "cost"), lambda v: node("schema:PriceSpecification", {"schema:price": v, "schema:priceCurrency": F.lit("EUR")}))),
        "dpp:diagnose": only(is_service, filled("diagnose")), "dpp:observedSymptoms": only(is_service, some(of(s, has, "symptoms"))),
        "dpp:repairedPartId": only(kind == "RepairServiceStep", filled("repaired_id")), "dpp:replacedPartId": only(kind == "ReplaceServiceStep", filled("replaced_id")),
        "dpp:repairedPartIds": only(many, some(of(s, has, "repaired_ids"))), "dpp:cleanedPartIds": only(many, some(of(s, has, "cleaned_ids"))),
        "dpp:reason": only(kind == "RecyclingStep", filled("reason")), "dpp:ghgEmissionRecords": some(of(s, has, "records"))})


def sizes(row: Column, has: Has) -> dict[str, Column | None]:
    return {f"schema:{n}": quantity(n, of(row, has, c), u) for n, c, u in (("height", "height_cm", "CM"), ("width", "width_cm", "CM"), ("depth", "depth_cm", "CM"), ("weight", "weight_g", "GRM"))}


def part_static(p: Column, has: Has) -> Column:
    return node("schema:ProductModel", {
        "@id": text(p["part_static_id"]), "schema:name": p["name"], "schema:description": of(p, has, "description"), "schema:manufacturer": embedded(p, has, "manufacturer"),
        **sizes(p, has), "dpp:avvDispose": property_value("AVV", of(p, has, "avv_dispose")), "dpp:mtbf": quantity("MTBF", of(p, has, "mtbf_hrs"), "HRS")})


def part_instance(p: Column, has: Has) -> Column:
    """Without the parts, materials and steps in it, which ``part_trees`` adds."""
    return node("schema:Product", {
        "@id": text(p["part_id"]), "isVariantOf": part_static(p, has) if "part_static_id" in has else None, "schema:serialNumber": of(p, has, "serial_number"), "dpp:batchNumber": of(p, has, "batch_number"),
        "dpp:isModular": p["is_modular"], "dpp:hasFailstate": p["has_failstate"]})


def line(d: Column, has: Has) -> Column:
    """A product line: what it is, its organisations, documents, spare parts and places."""
    filled = lambda column: None if column not in has else F.when(F.size(d[column]) > 0, d[column])
    return node("schema:ProductModel", {
        "@id": text(d["static_id"]), "schema:name": d["product_name"], "schema:description": of(d, has, "description"), "dpp:EAN": of(d, has, "ean"),
        "dpp:GS1DigitalLink": property_value("GS1DigitalLink", of(d, has, "digital_link"), url=True), "schema:category": of(d, has, "product_class"), **sizes(d, has),
        "schema:datePublished": iso(of(d, has, "published_at")), "dpp:guaranteeDescription": given(of(d, has, "guarantee"), lambda v: node("schema:CreativeWork", {"name": v})), "dpp:taricCode": of(d, has, "taric_code"),
        "schema:manufacturer": embedded(d, has, "manufacturer"), "dpp:responsibleOperator": embedded(d, has, "operator"), "dpp:importer": embedded(d, has, "importer"),
        "dpp:expectedMtbfHRS": quantity("expectedMtbfHRS", of(d, has, "expected_mtbf_hrs"), "HRS"), **{f"dpp:{name}": document(of(d, has, name)) for name in DOCUMENTS},
        "dpp:has_spare_parts": filled("spare_parts"), "dpp:returningPlaces": filled("returning_places"), "dpp:toolsForMaintenance": filled("tools"),
        "dpp:qualificationForRepair": property_value("QualificationForRepair", of(d, has, "qualification")), "dpp:weeeRegistrationNumber": property_value("WEEE", of(d, has, "weee_number")),
        "dpp:backupLink": property_value("BackupLink", of(d, has, "backup_link"), url=True), "dpp:imageFileIds": filled("images")})


def passport(p: Column, has: Has) -> Column:
    """A product with its identifier, its line if the row has ``line``, its dates, place and counters."""
    counters = [given(of(p, has, c), lambda v, n=n, u=u: node("schema:PropertyValue", {"name": F.lit(n), "value": v, "unitCode": F.lit(u).cast("string")})) for n, c, u in COUNTERS]
    known = F.filter(F.array(*(c for c in counters if c is not None)), lambda c: c.isNotNull())
    return node("schema:Product", {
        "@id": text(p["instance_id"]), "dpp:SGTIN": property_value("SGTIN", text(p["instance_id"])), "isVariantOf": of(p, has, "line"),
        "dpp:minimalValidityOfData": iso(of(p, has, "valid_until")), "dpp:dateOfDeclaration": iso(of(p, has, "declared_at")), "dpp:endOfGuarantee": iso(of(p, has, "guarantee_end")),
        "schema:location": of(p, has, "location"), "schema:additionalProperty": F.when(F.size(known) > 0, known),
        "dpp:discontinued": F.coalesce(p["discontinued"], F.lit(False)), "dpp:backupLink": property_value("BackupLink", of(p, has, "backup_link"), url=True)})


def exported(rows: DataFrame, key: str, make, context: bool = True) -> DataFrame:
    """Key and JSON text of every row; ``make`` builds the node from the row as a struct and the names of its columns."""
    json = F.to_json(make(F.struct("*"), set(rows.columns)))
    return rows.select(key, (with_context(json) if context else json).alias("json"))


def contents(uses: DataFrame, steps: DataFrame) -> DataFrame:
    """What parts hold beside parts, as JSON: tree_id, part_id, materials and tracking (steps of the part itself), each a list or null."""
    of_uses = uses.select("tree_id", "part_id", F.col("place").alias("at"), F.to_json(material_instance(F.struct("*"), set(uses.columns))).alias("material"), F.lit(None).cast("string").alias("tracked"))
    own = steps.where(F.col("owner_kind") == "part")
    of_steps = own.select("tree_id", "part_id", F.col("step_key").alias("at"), F.lit(None).cast("string").alias("material"), F.to_json(step(F.struct("*"), set(own.columns))).alias("tracked"))
    joined = lambda rows, column: rows.groupBy("tree_id", "part_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column]), ",").alias(column))
    right = joined(of_steps, "tracked").withColumnsRenamed({"tree_id": "st", "part_id": "sp"})
    both = joined(of_uses, "material").join(right, (F.col("tree_id") == F.col("st")) & (F.col("part_id") == F.col("sp")), "full")
    return both.select(F.coalesce("tree_id", "st").alias("tree_id"), F.coalesce("part_id", "sp").alias("part_id"), F.col("material").alias("materials"), F.col("tracked").alias("tracking"))


def part_trees(nodes: DataFrame, held: DataFrame | None = None, roots_only: bool = False, detached: DataFrame | None = None) -> DataFrame:
    """Every part, or every root, with all below it, nested: tree_id, part_id, parent_id, json. One pass for each level, from the deepest up; each is written.

    ``held``: ``contents`` of the parts. A part id that is in a tree twice has the same contents in both places.
    ``detached``: what was taken out of parts, as tree_id and part_id of the part that has it in its history, pos, and json
    (such as these trees of the parts that were taken out).
    """
    own = F.to_json(part_instance(F.struct("*"), set(nodes.columns)))
    flat = nodes.select("tree_id", "part_id", "parent_id", "lvl", own.alias("own"))
    if held is None:
        flat = flat.withColumns({"materials": F.lit(None).cast("string"), "tracking": F.lit(None).cast("string")})
    else:
        right = held.withColumnsRenamed({"tree_id": "ht", "part_id": "hp"})
        flat = flat.join(right, (F.col("tree_id") == F.col("ht")) & (F.col("part_id") == F.col("hp")), "left").drop("ht", "hp")
    if detached is None:
        flat = flat.withColumn("gone", F.lit(None).cast("string"))
    else:
        gone = detached.groupBy(F.col("tree_id").alias("gt"), F.col("part_id").alias("gp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "json"))), lambda d: d["json"]), ",").alias("gone"))
        flat = flat.join(gone, (F.col("tree_id") == F.col("gt")) & (F.col("part_id") == F.col("gp")), "left").drop("gt", "gp")
    flat = written(flat, "parts")
    deepest = flat.agg(F.max("lvl")).first()[0] or 0
    listed = lambda key, column: F.coalesce(F.concat(F.lit(f',"dpp:{key}":['), F.col(column), F.lit("]")), F.lit(""))
    done, out = None, None
    for level in range(deepest, -1, -1):
        here = flat.where(F.col("lvl") == level)
        if done is None:
            joined = here.withColumn("inner", F.lit(None).cast("string"))
        else:
            inner = done.groupBy(F.col("tree_id").alias("bt"), F.col("parent_id").alias("bp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_id", "json"))), lambda c: c["json"]), ",").alias("inner"))
            joined = here.join(inner, (F.col("tree_id") == F.col("bt")) & (F.col("part_id") == F.col("bp")), "left").drop("bt", "bp")
        json = F.concat(F.expr("left(own, length(own) - 1)"), listed("compositeParts", "inner"), listed("historyOfDetachedParts", "gone"), listed("compositeMaterials", "materials"), listed("partProcessTracking", "tracking"), F.lit("}"))
        done = written(joined.select("tree_id", "part_id", "parent_id", json.alias("json")), "nested")
        if not roots_only:
            out = done if out is None else out.unionByName(done)
    return done if roots_only else out


def bundle(lines: DataFrame, instances: DataFrame) -> DataFrame:
    """One JSON array per line: the line, then its products in order of their ids.

    A line's text is as long as its products make it, and is in one row. Only the fields of the objects are
    dealt out and collected, by ranges of their ids; the context, of which most of the text consists, comes in
    between as the pieces of a line are joined. The longer the texts, the fewer tasks make them, one after
    another, so that those in memory together do not grow until one alone has ``BYTES_AT_ONCE``.
    """
    own = lambda make, rows: fields_of(F.to_json(make(F.struct("*"), set(rows.columns)))).alias("json")
    first = lines.select("static_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), own(line, lines))
    rest = instances.select("static_id", F.lit(1).alias("kind"), F.col("instance_id").alias("id"), own(passport, instances))
    objects = first.unionByName(rest)
    sized = objects.groupBy("static_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("json") + len(OPENING)).alias("bytes"), F.min("id").alias("least"), F.max("id").alias("most"))
    n_texts, n, longest, least, most = sized.agg(F.count("*"), F.sum("n"), F.max("bytes"), F.min("least"), F.max("most")).first()
    n_pieces, at_once = 1 + (longest or 0) // PIECE_BYTES, max(1, BYTES_AT_ONCE // (longest or 1))
    share = (F.col("id").cast("double") - float(least or 0)) / max(1.0, float(most or 0) - float(least or 0))
    piece = F.least(F.coalesce(F.floor(share * n_pieces), F.lit(0)), F.lit(n_pieces - 1))  # the line, which has no id, is first
    cut = dealt(objects.withColumn("piece", piece), TEXT_ROWS * (n or 0), "static_id", "piece")
    pieces = cut.groupBy("static_id", "piece").agg(F.sort_array(F.collect_list(F.struct("kind", "id", "json")))["json"].alias("items"))
    few = at_once < n_texts
    if few:
        pieces = pieces.repartition(4 * n_texts, "static_id")
    held = pieces.groupBy("static_id").agg(*(F.first(F.when(F.col("piece") == k, F.col("items")), ignorenulls=True).alias(f"piece_{k}") for k in range(n_pieces)))
    if few:
        held = held.coalesce(at_once)
        storing_long_texts(lines.sparkSession, "json")
    items = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in held.columns[1:]))
    head, last = F.concat(F.lit("[" + OPENING), items[0]), F.concat(F.element_at(items, -1), F.lit("]"))
    joined = F.concat_ws("," + OPENING, head, F.slice(items, 2, F.greatest(F.size(items) - 2, F.lit(0))), last)
    return held.select("static_id", F.when(F.size(items) == 1, F.concat(head, F.lit("]"))).otherwise(joined).alias("json"))


def write_files(exports: DataFrame, path: str) -> None:
    """One JSON text a line."""
    exports.select("json").write.text(path)
