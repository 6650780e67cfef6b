"""The library's operators over the relational tables, through the adapters: one query each."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.scalars import gs1_check_digit, humanised_days, percent, rounded, weight_kg
from ..operators import jsonld, links as followed, materials, mutations, passports, processes, rules, services, trees, views
from ..sources import adapters as A
from ..streaming import service_steps as streams


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flatten(A.parts(spark, sf_dir))


def product_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's own tree. Products are of parts of all levels, so a part is in the trees of several."""
    return trees.product_trees(nodes(spark, sf_dir), A.passports(spark, sf_dir).select("root_part_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lines with the places that take them back and their spare parts."""
    s = F.col("static_id")
    base = A.passports(spark, sf_dir).groupBy("static_id").agg(F.min("product_name").alias("product_name"))
    return base.withColumn("returning_place_ids", F.array((s % 25).cast("int"), (s % 7).cast("int"), (s + 10).cast("int"))).withColumn("spare_ids", F.array(s, s * 3, s + 1000000))


def on(source: Callable, operator: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(source(spark, sf_dir))


def on_two(a: Callable, b: Callable, operator: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(a(spark, sf_dir), b(spark, sf_dir))


def service_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.rollup_to_ancestors(A.service_steps(spark, sf_dir), nodes(spark, sf_dir))


def modular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_modular(A.tree_services(spark, sf_dir), A.service_instances(spark, sf_dir), product_nodes(spark, sf_dir))


def diagnosis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = services.with_line_totals(services.diagnosis_summary(A.tree_services(spark, sf_dir)), A.service_instances(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("diagnosis_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("static_id", "symptom", "most_likely", "n_instances", "total_instances", shown.alias("diagnosis_counts"))


def secondary_totals(steps: DataFrame, instances: DataFrame) -> DataFrame:
    return services.with_line_totals(services.secondary_totals(steps, instances), instances)


def organisations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = passports.with_organisations(A.passports(spark, sf_dir), A.organisations(spark, sf_dir))
    return joined.select("instance_id", F.col("manufacturer.name").alias("manufacturer"), F.col("manufacturer.eori").alias("manufacturer_eori"), F.col("importer.name").alias("importer"), F.col("importer.url").alias("importer_url"))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations that break a rule, were every one to have an EORI whose number is not a multiple of seven."""
    rows = A.organisations(spark, sf_dir).withColumn("eori", F.when(F.pmod(F.regexp_extract("org_id", "[0-9]+", 0).cast("int"), F.lit(7)) == 0, F.lit("DE1")).otherwise(F.col("eori")))
    found = rules.rejected(rows, rules.organisation_rules() | {"manufacturer": F.col("type") == "Manufacturer"})
    return found.select("org_id", F.array_join("reasons", ",").alias("reasons"))


def reasons_of(checked: rules.Checked, *keys: str) -> DataFrame:
    """The rows of an entity that break a rule, by their keys: how many, and the rules."""
    broken = rules.judge(checked).where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ","))
    return broken.groupBy(*keys, "reasons").agg(F.count("*").alias("n"))


def bad_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products as they might be registered: some with a short number, an unknown line or place, a guarantee that ends before it begins, a negative counter."""
    key = F.col("o_orderkey")
    rows = A.read(spark, sf_dir, "orders").select(
        F.lpad(key.cast("string"), 34, "0").alias("number"), key, (F.col("o_custkey") % 53).alias("static_id"), F.when(key % 4 != 0, key % 27).alias("location_id"),
        F.col("o_orderdate").alias("declared_at"), F.timestamp_add("DAY", (key % 40 - 1).cast("int"), F.col("o_orderdate")).alias("guarantee_end"),
        *((key % n - 1).cast("double").alias(c) for c, n in (("cleaning_count", 13), ("chalk_count", 17))), *(F.lit(None).cast("double").alias(c) for c in ("brewing_count", "grinding_count", "operating_hrs")),
    )
    rows = rows.withColumn("instance_id", F.when(key % 19 == 0, F.substring("number", 2, 33)).otherwise(F.col("number")))
    return reasons_of(rules.checked_passports(rows, lines(spark, sf_dir), A.places(spark, sf_dir)), "o_orderkey")


def bad_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps, as if some had gone to unknown places, had none, or had cost less than nothing."""
    distance = F.col("distance_km")
    rows = A.process_steps(spark, sf_dir).select(
        "tree_id", F.when(F.col("part_id") != 7, F.col("place_id")).alias("place_id"), F.when(distance > 450, F.col("dest_id") + 100).otherwise(F.col("dest_id")).alias("dest_id"),
        distance, (F.col("part_id") - 1).cast("double").alias("cost"))
    return reasons_of(rules.checked_steps(rows, A.places(spark, sf_dir)), "tree_id")


def records_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All emission records with the step they are of, as if some factors and quantities had been below zero."""
    step = F.concat_ws("/", "tree_id", "step_key.part", "step_key.line")
    return A.emissions(spark, sf_dir).select("tree_id", step.alias("step_key"), (F.col("factor") - 0.02).alias("factor"), (F.col("quantity") - 4).alias("quantity"), "kg")


def bad_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons_of((records_of_steps(spark, sf_dir), rules.emission_rules()), "tree_id")


def bad_steps_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps with all of their emission records."""
    rows = A.process_steps(spark, sf_dir).withColumns({"step_key": F.concat_ws("/", "tree_id", "level_visit.key", "level_visit.line"), "cost": F.lit(None).cast("double")})
    return reasons_of(rules.checked_steps(rows, A.places(spark, sf_dir), records_of_steps(spark, sf_dir)), "tree_id")


def bad_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers as if they transported goods themselves, some with a permit number of too few digits or none."""
    makers = rules.of_type(A.organisations(spark, sf_dir), "Manufacturer")
    key = F.regexp_extract("org_id", "[0-9]+", 0).cast("int")
    number = F.concat(F.lit("DE-BAG-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((key % 1000).cast("string"), F.when(key % 5 == 0, 5).otherwise(6), F.lit("0")))
    return reasons_of(rules.checked_transport(makers.withColumn("transport_number", F.when(key % 7 != 6, number))), "org_id")


def static_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flatten(trees.with_statics(A.part_instances(spark, sf_dir), A.part_statics(spark, sf_dir)))


def static_mtbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = A.passports(spark, sf_dir)
    return services.part_mtbf(products, trees.product_trees(static_nodes(spark, sf_dir), products.select("root_part_id")))


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All product lines, some of them with a short number or links to what is not there, is there twice, or is of another type."""
    s = F.col("static_id")
    rows = lines(spark, sf_dir).select(
        F.lpad(s.cast("string"), 14, "0").alias("number"), s.alias("line"), F.concat(F.lit("M"), s).alias("manufacturer_id"), F.concat(F.when(s % 2 == 0, "I").otherwise("M"), s).alias("operator_id"),
        F.when(s % 3 == 0, F.concat(F.when(s % 5 == 0, "M").otherwise("I"), s)).alias("importer_id"), "spare_ids", "returning_place_ids", F.lit(None).cast("string").alias("ean"), (s - 2).cast("double").alias("expected_mtbf_hrs"))
    rows = rows.withColumn("static_id", F.when(F.col("line") % 7 == 0, F.substring("number", 2, 13)).otherwise(F.col("number")))
    statics = A.parts(spark, sf_dir).select(F.col("part_id").alias("part_static_id"))
    return reasons_of(rules.checked_lines(rows, A.organisations(spark, sf_dir), statics, A.places(spark, sf_dir)), "line")


def bad_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' materials, as if each came from one of forty-one manufacturers, of which one is not known."""
    rows = A.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("material_name"), F.concat(F.lit("M"), F.when(F.col("p_partkey") % 41 == 0, -1).otherwise(F.col("p_partkey") % 41)).alias("manufacturer_id"))
    known = A.organisations(spark, sf_dir)
    return reasons_of(rules.checked_material_statics(rows.withColumn("material_static_id", F.concat(F.lit("urn:uuid:00000000-0000-0000-0000-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))), None, known), "p_partkey")


def step_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each product between the places where they were done and went to."""
    found = passports.with_step_places(A.process_steps(spark, sf_dir), A.places(spark, sf_dir))
    names = found.select("tree_id", "owner_kind", "type", F.col("place.name").alias("place"), F.col("place.latitude").alias("latitude"), F.col("destination.name").alias("destination"))
    return names.groupBy(*names.columns).agg(F.count("*").alias("n"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose order and line number are not theirs alone, and whose part number is not known."""
    items = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = A.read(spark, sf_dir, "part")
    checked = rules.resolves(rules.unique(items, ["l_orderkey", "l_linenumber"], None, "is_unique"), "l_partkey", parts, "p_partkey", "part_known")
    found = rules.rejected(checked, {"unique": F.col("is_unique"), "part": F.col("part_known")})
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(F.array_join("reasons", ",")).alias("reasons"))


def failing_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth part."""
    return nodes(spark, sf_dir).where("part_id % 10 = 3").select("tree_id", "part_id")


def toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, _ = mutations.toggle_failstate(nodes(spark, sf_dir), failing_commands(spark, sf_dir))
    return changed.select("tree_id", "part_id", "has_failstate")


def replacements(all_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every seventh part, once or twice, to be swapped for a new part with one child, and some of the new ones again later: commands and new parts."""
    asked = all_nodes.where("part_id % 7 = 3").select("tree_id", F.col("part_id").alias("old_id"), F.explode(F.when(F.col("part_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    commands = asked.select("tree_id", "old_id", (-(F.col("old_id") * 2 + F.col("again")) - 1).alias("new_id"), (((F.col("old_id") * 7919) % 100003 * 2 + F.col("again")) * 2).alias("seq"))
    again = asked.where("again = 0 AND old_id % 21 = 3").select("tree_id", (-F.col("old_id") * 2 - 1).alias("old_id"), (-F.col("old_id") * 2 - 1 - 10000000000).alias("new_id"), ((F.col("old_id") * 7919) % 100003 * 4 + 60001).alias("seq"))
    commands = commands.unionByName(again)
    roots = commands.select("new_id", F.col("new_id").alias("part_id"), F.lit(None).cast("bigint").alias("parent_id"), F.array("new_id").alias("path"))
    children = commands.select("new_id", (F.col("new_id") - 1000000).alias("part_id"), F.col("new_id").alias("parent_id"), F.array(F.col("new_id"), F.col("new_id") - 1000000).alias("path"))
    return commands, roots.unionByName(children)


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees after the replacements, what was taken out of them, and the commands that failed."""
    all_nodes = nodes(spark, sf_dir).select("tree_id", "part_id", "parent_id", "lvl", "path")
    commands, new_nodes = replacements(all_nodes)
    kept, detached, failed = mutations.replace_parts(all_nodes, commands, new_nodes)
    shown = lambda df, kind, gone_with: df.select(F.lit(kind).alias("kind"), "tree_id", "part_id", "parent_id", "lvl", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"), gone_with.alias("note"))
    refused = failed.select(F.lit("failed").alias("kind"), "tree_id", F.col("old_id").alias("part_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(None).cast("int").alias("lvl"), F.lit(None).cast("string").alias("path"), F.col("reason").alias("note"))
    return shown(kept, "kept", F.lit(None).cast("string")).unionByName(shown(detached, "detached", F.col("detached_with").cast("string"))).unionByName(refused)


def grafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees after every thirtieth part has got a copy of the part after it, wherever that is, and some of a part above them; and the commands that failed."""
    known = nodes(spark, sf_dir).select("tree_id", "part_id", "parent_id", "lvl", "path")
    other = F.when(F.col("part_id") % 60 == 7, F.col("path")[0]).otherwise(F.col("part_id") + 1)
    asked = known.where("part_id % 30 = 7").select("tree_id", F.col("part_id").alias("parent_id"), other.alias("child_id"))
    asked = asked.join(known.select(F.col("part_id").alias("of"), F.col("tree_id").alias("from_tree")), F.col("child_id") == F.col("of"), "left").drop("of")
    changed, failed = mutations.graft(known, asked.withColumn("from_tree", F.coalesce("from_tree", F.lit(0).cast("bigint"))))
    path = F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path")
    refused = failed.select("tree_id", F.col("child_id").alias("part_id"), "parent_id", F.lit(None).cast("int").alias("lvl"), F.lit(None).cast("string").alias("path"), "reason")
    return changed.select("tree_id", "part_id", "parent_id", "lvl", path, F.lit(None).cast("string").alias("reason")).unionByName(refused)


def recycled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = A.service_instances(spark, sf_dir).withColumn("discontinued", F.lit(False))
    new = A.service_steps(spark, sf_dir).where("type = 'RecyclingStep' AND cost > 50")
    owned = owned.select("static_id", "instance_id", "discontinued")
    return mutations.recycle(owned, A.service_steps(spark, sf_dir).limit(0), new)[0].select("static_id", "instance_id", "discontinued")


def unrecycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recycling steps whose products are not there, were every third product unknown."""
    owned = A.service_instances(spark, sf_dir).where("instance_id % 3 <> 0").withColumn("discontinued", F.lit(False))
    steps = A.service_steps(spark, sf_dir)
    return mutations.recycle(owned, steps.limit(0), steps.where("type = 'RecyclingStep' AND cost > 50"))[2].select("event_id", "instance_id", "reason")


def more_spares(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = lines(spark, sf_dir).select("static_id", F.explode(F.array(F.col("static_id") * 3, F.col("static_id") + 7)).alias("link"))
    changed, _ = mutations.add_links(lines(spark, sf_dir), "spare_ids", commands, distinct=True)
    return changed.select("static_id", F.array_join(F.transform("spare_ids", lambda p: p.cast("string")), ",").alias("spare_ids"))


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lpad(F.col("o_orderkey").cast("string"), 12, "4")
    return A.read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), gs1_check_digit(body).cast("int").alias("check_digit"))


def scalar_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in other units, humanised days and clamped percentages, of every customer."""
    unit = F.element_at(F.array(*map(F.lit, ("GRM", "KGM", "MG", "other"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return A.read(spark, sf_dir, "customer").select("c_custkey", rounded(weight_kg(F.col("c_acctbal"), unit), 6).alias("kg"), humanised_days(F.col("c_custkey").cast("double")).alias("age"), percent(F.col("c_acctbal") / 5000.0).alias("percent"))


def sums_of_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of each product of which some are far below a microgram and some above a billion tonnes, and a sum in which they cancel."""
    kg = F.col("quantity") * F.element_at(F.array(F.lit(4e-9), F.lit(1e11), F.lit(0.1)), (F.col("visit.line") % 3 + 1).cast("int"))
    rows = A.emissions(spark, sf_dir).select("tree_id", kg.alias("kg"))
    both = rows.unionByName(rows.where("kg > 1e10").select("tree_id", (-F.col("kg")).alias("kg")).withColumn("undone", F.lit(True)), allowMissingColumns=True)
    first = F.when(F.col("undone").isNull(), F.col("kg"))
    return both.groupBy("tree_id").agg(exact_sum(first).alias("kg"), exact_sum(F.col("kg")).alias("small_kg"))


def place_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = A.places(spark, sf_dir).join(A.owners(spark, sf_dir), F.col("managed_by") == F.col("of"), "left")
    return jsonld.exported(owned, "place_id", jsonld.place)


def organisation_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.exported(A.organisations(spark, sf_dir), "org_id", jsonld.organisation)


def material_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.exported(A.material_static(spark, sf_dir), "material_static_id", jsonld.material_static)


def part_static_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.exported(A.parts(spark, sf_dir).withColumn("part_static_id", F.col("part_id").cast("string")), "part_id", jsonld.part_static)


def step_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.service_steps(spark, sf_dir).withColumn("repaired_id", F.col("target_ids")[0].cast("string"))
    return jsonld.exported(rows.withColumn("replaced_id", F.col("repaired_id")), "event_id", jsonld.step, context=False)


def line_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.exported(lines(spark, sf_dir).select("static_id", "product_name"), "static_id", jsonld.line)


def with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their line's node."""
    nodes_ = lines(spark, sf_dir).select(F.col("static_id").alias("of"), jsonld.line(F.struct("static_id", "product_name"), {"static_id", "product_name"}).alias("line"))
    return A.passports(spark, sf_dir).join(nodes_, F.col("static_id") == F.col("of")).drop("of")


def passport_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.exported(with_lines(spark, sf_dir), "instance_id", jsonld.passport)


def bundle_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.bundle(lines(spark, sf_dir).select("static_id", "product_name"), A.passports(spark, sf_dir))


def part_tree_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.part_trees(nodes(spark, sf_dir), roots_only=True).select("tree_id", "json")


def linked_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Products, lines, organisations, places and spare parts, and the links between them; some lead nowhere."""
    body = lambda *fields: F.to_json(F.struct(*fields)).alias("body")
    entity = lambda rows, kind, key, *fields: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), body(F.col(key).cast("string").alias("id"), *fields))
    products, listed, places = A.passports(spark, sf_dir), lines(spark, sf_dir), A.places(spark, sf_dir)
    orgs = A.organisations(spark, sf_dir).select("org_id", "name").unionByName(A.owners(spark, sf_dir).select("owner.org_id", "owner.name"))
    entities = entity(products, "product", "instance_id", "product_name")
    for rows in (entity(listed, "line", "static_id", "product_name"), entity(orgs, "organisation", "org_id", "name"), entity(places, "place", "place_id", "name"), entity(A.parts(spark, sf_dir), "part", "part_id", "name")):
        entities = entities.unionByName(rows)
    none = F.lit(None).cast("int").alias("pos")
    to = lambda rows, kind, key, field, to_kind, to_id, pos=none: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(field).alias("field"), pos, F.lit(to_kind).alias("to_kind"), to_id.cast("string").alias("to_id"))
    every = lambda column: listed.select("static_id", F.posexplode(column).alias("pos", "target"))
    links = to(products, "product", "instance_id", "line", "line", F.col("static_id"))
    for rows in (
        to(products, "product", "instance_id", "manufacturer", "organisation", F.col("manufacturer_id")), to(products, "product", "instance_id", "importer", "organisation", F.col("importer_id")),
        to(every("returning_place_ids"), "line", "static_id", "returningPlaces", "place", F.col("target"), F.col("pos")), to(every("spare_ids"), "line", "static_id", "spareParts", "part", F.col("target"), F.col("pos")),
        to(places, "place", "place_id", "managedBy", "organisation", F.concat(F.lit("R"), F.col("managed_by"))),
    ):
        links = links.unionByName(rows)
    return entities, links


def deep_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with its line, its organisations, and all that the line links to."""
    return followed.embedded(*linked_entities(spark, sf_dir)).where("kind = 'product'").select("id", "json")


def reached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each product, line and place leads to, and by how many links."""
    entities, links = linked_entities(spark, sf_dir)
    return followed.reached(links, entities)


def user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passports.user_summary(A.passports(spark, sf_dir), product_nodes(spark, sf_dir), A.material_use(spark, sf_dir), A.process_steps(spark, sf_dir), A.emissions(spark, sf_dir))


def end_of_life_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passports.end_of_life_summary(A.passports(spark, sf_dir), product_nodes(spark, sf_dir), A.material_use(spark, sf_dir), A.service_steps(spark, sf_dir))


def service_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passports.service_summary(A.passports(spark, sf_dir), product_nodes(spark, sf_dir), A.service_steps(spark, sf_dir))


def line_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product lines with their measures, images and documents, some of which have no name and some of which are missing."""
    s = F.col("static_id")
    address = lambda kind: F.concat(F.lit(f"https://docs.example/{kind}/"), s.cast("string"))
    document = lambda kind, n: F.when(s % n != 0, F.struct(F.when(s % 2 == 0, F.lit(kind)).otherwise("").alias("name"), address(kind).alias("url")))
    kinds = {kind: document(kind, n + 3) for n, kind in enumerate((*views.USER_DOCUMENTS, *views.COMPLIANCE))}
    sizes = {c: (s + k).cast("double") for k, c in enumerate(views.EXTRAS[:4])}
    image = F.struct(s.cast("string").alias("file_id"), F.concat(F.lit("front-"), s.cast("string"), F.lit(".png")).alias("filename"))
    return lines(spark, sf_dir).withColumns(kinds | sizes | {"taric_code": s.cast("string"), "images": F.when(s % 3 == 0, F.array(image)).otherwise(F.array().cast("array<struct<file_id:string,filename:string>>"))})


def with_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with an operator, which for some lines is not known."""
    return A.passports(spark, sf_dir).withColumn("operator_id", F.concat(F.lit("M"), F.col("static_id") * 2))


def shown_list(name: str, form: Callable) -> Column:
    return F.array_join(F.transform(name, form), ";").alias(name)


def whole(x, times: int) -> Column:
    return F.floor(x * float(times) + 0.5).cast("bigint").cast("string")


def parts_shown(c) -> Column:
    return F.concat_ws(":", c["part_id"].cast("string"), c["name"], c["is_modular"].cast("string"), c["has_failstate"].cast("string"))


#: Lists of the views as text.
SHOWN = {
    "first_level": parts_shown,
    "materials": lambda m: F.concat_ws(":", m["material_name"], whole(m["grams"], 1000), whole(m["percent"], 100), whole(m["recycled_percent"], 100), whole(m["virgin_percent"], 100)),
    "linked": lambda x: F.concat_ws(":", x["part_name"], x["part_id"].cast("string"), x["linked_id"].cast("string"), x["linked_name"]),
}


def user_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that owners see of a product, its lists as text."""
    found = views.user_view(
        with_operators(spark, sf_dir), line_details(spark, sf_dir), A.organisations(spark, sf_dir), A.places(spark, sf_dir), product_nodes(spark, sf_dir),
        A.material_use(spark, sf_dir), A.process_steps(spark, sf_dir), A.emissions(spark, sf_dir))
    figures = lambda label: lambda e: F.concat_ws(":", e[label], whole(e["kg"], 1000))
    forms = SHOWN | {"scopes": figures("scope"), "categories": figures("category"), "returning_places": lambda p: p["name"], "documents": lambda d: d["name"], "images": lambda i: i["url"]}
    return found.select(
        "instance_id", "product_name", *(F.col(f"{r}.name").alias(r) for r in views.ROLES), F.col("counters.brewing_count").alias("brewing_count"), "recycled_percent", "rare_percent", *views.processes.CATEGORIES,
        "n_steps", "parts_km", "materials_km", "total_km", "ghg_kg", "n_parts", "n_fail", F.col("compliance.ce_conformity.name").alias("ce_conformity"), F.col("extras.weight_g").alias("weight_g"),
        *(shown_list(name, form) for name, form in forms.items()))


def end_of_life_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that dismantlers see of a product, its lists as text."""
    found = views.end_of_life_view(with_operators(spark, sf_dir), line_details(spark, sf_dir), A.organisations(spark, sf_dir), product_nodes(spark, sf_dir), A.material_use(spark, sf_dir), A.service_steps(spark, sf_dir))
    held = lambda m: F.concat_ws(":", m["material_name"], whole(m["grams"], 1000), F.array_join(m["warnings"], "+"), F.array_join(F.transform(m["parts"], lambda p: F.concat_ws("=", p["path"], whole(p["grams"], 1000))), "+"))
    forms = SHOWN | {"rare": held, "hazardous": held}
    return found.select(
        "instance_id", F.col("operator.name").alias("operator"), "grams", "recycled_percent", "rare_percent", "cost_eur", *(b.lower() for b in services.BUCKET_NAMES), "n_parts", "n_fail",
        F.col("manuals.disassembly.url").alias("disassembly"), F.col("manuals.recycling.name").alias("recycling"), *(shown_list(name, form) for name, form in forms.items()))


def utility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passports.utility_summary(A.service_steps(spark, sf_dir), A.service_instances(spark, sf_dir), A.parts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "material_mass_by_name": on(A.material_use, materials.mass_by_name),
    "material_recycled_share": on(A.material_use, materials.recycled_by_name),
    "material_overall_shares": on(A.material_use, materials.overall_shares),
    "material_purity_mean": on(A.material_use, materials.purity_by_name),
    "rare_earth_metrics": on(A.material_use, materials.rare_earth_metrics),
    "material_shares_by_static": on(A.material_use, materials.shares_by_static),
    "material_summary_by_name": on(A.material_use, materials.summary_by_name),
    "hazardous_locations": on(A.material_use, materials.hazardous_locations),
    "end_of_life_buckets": on(A.material_use, materials.end_of_life_buckets),
    "pie_cumulative_share": on(A.material_use, lambda uses: materials.pie(materials.mass_by_name(uses))),
    "tree_flatten": on(nodes, lambda n: n.select("tree_id", "part_id", "parent_id", "lvl", "name", "is_modular", "has_failstate", "mtbf_hrs")),
    "tree_static_names": on(static_nodes, lambda n: n.select("tree_id", "part_id", "name", "mtbf_hrs", F.array_join("names", trees.ARROW).alias("trail"))),
    "tree_breadcrumbs": on(nodes, trees.breadcrumbs),
    "tree_descendant_counts": on(product_nodes, trees.subtree_counts),
    "tree_direct_children": on(product_nodes, trees.direct_children),
    "tree_first_level": on(nodes, trees.first_level),
    "tree_fail_counts": on(product_nodes, trees.tree_summary),
    "failing_parts": on(nodes, trees.failing_parts),
    "tree_expanded": on(nodes, trees.expanded),
    "tree_layout": on(product_nodes, trees.layout),
    "linked_sub_passports": on_two(A.passports, product_nodes, trees.linked_passports),
    "step_category_counts": on(A.process_steps, processes.category_counts),
    "transport_km": on(A.process_steps, processes.transport_km),
    "transport_km_transports_only": on(A.process_steps, partial(processes.transport_km, transports_only=True)),
    "ghg_by_scope": on(A.emissions, processes.ghg_by_scope),
    "ghg_by_category": on(A.emissions, processes.ghg_by_category),
    "ghg_total": on(A.emissions, processes.ghg_total),
    "ghg_sums_of_all_sizes": sums_of_all_sizes,
    "ghg_footprint_dedup": on(A.emissions, processes.footprint),
    "ghg_footprint_by_category": on(A.emissions, processes.footprint_by_category),
    "map_nodes": on_two(A.process_steps, A.places, processes.map_nodes),
    "map_edges": on_two(A.process_steps, A.places, processes.map_edges),
    "map_totals": on(A.process_steps, processes.map_totals),
    "service_bucket_totals": on(A.service_steps, services.bucket_totals),
    "service_rollup_ancestors": service_rollup,
    "mtbf_remaining": on_two(A.passports, product_nodes, services.product_mtbf),
    "mtbf_exceeded_counts": on_two(A.passports, product_nodes, services.mtbf_counts),
    "symptom_top2_diagnoses": on(A.service_steps, services.symptom_top_diagnoses),
    "symptom_top2_fractional_days": on(A.service_steps, partial(services.symptom_top_diagnoses, whole=False)),
    "symptom_instance_counts": on(A.service_steps, services.symptom_instances),
    "diagnosis_summary_argmax": diagnosis_summary,
    "operation_totals": on_two(A.service_steps, A.service_instances, services.operation_totals),
    "top10_parts_overall": on_two(A.service_steps, A.parts, services.top_parts),
    "top10_parts_by_operation": on_two(A.service_steps, A.parts, partial(services.top_parts, by_type=True)),
    "secondary_steps_aggregate": on_two(A.tree_services, A.service_instances, secondary_totals),
    "secondary_entries": on_two(A.tree_services, A.service_instances, services.secondary_entries),
    "secondary_entries_true_counters": on_two(A.tree_services, A.service_instances, partial(services.secondary_entries, compatible=False)),
    "part_mtbf_static": static_mtbf,
    "part_mtbf": on_two(A.passports, product_nodes, services.part_mtbf),
    "part_picker": on(product_nodes, trees.picker_options),
    "service_modular_counts": modular,
    "service_modular_by_line": lambda spark, sf_dir: services.service_modular_by_line(modular(spark, sf_dir)),
    "service_history": on(A.service_steps, lambda s: services.history(s).withColumn("symptoms", F.array_join("symptoms", ","))),
    "service_history_cost": on(A.service_steps, services.history_cost),
    "passport_organisations": organisations_of,
    "returning_places": on_two(lines, A.places, passports.returning_places),
    "spare_parts": on_two(lines, A.parts, passports.spare_parts),
    "passport_search": on(A.passports, partial(passports.search, term="urgent")),
    "passport_ages": on(A.passports, lambda p: passports.ages(p, F.lit("2000-01-01").cast("timestamp_ntz"))),
    "gs1_check_digit": check_digits,
    "scalar_shapes": scalar_shapes,
    "validation_rejects": rejects,
    "validation_uniqueness": duplicates,
    "validation_passports": bad_passports,
    "validation_steps": bad_steps,
    "validation_emissions": bad_emissions,
    "validation_steps_with_records": bad_steps_with_records,
    "validation_transport": bad_transport,
    "validation_lines": bad_lines,
    "validation_material_statics": bad_materials,
    "step_places": step_places,
    "mutation_toggle_fail": toggled,
    "mutation_replace_part": replaced,
    "mutation_graft": grafted,
    "mutation_recycle": recycled_lines,
    "mutation_recycle_failed": unrecycled,
    "mutation_add_spare": more_spares,
    "jsonld_place": place_exports,
    "jsonld_organisation": organisation_exports,
    "jsonld_material": material_exports,
    "jsonld_passport": passport_exports,
    "jsonld_part_static": part_static_exports,
    "jsonld_service_step": step_exports,
    "jsonld_line": line_exports,
    "jsonld_bundle": bundle_exports,
    "jsonld_part_tree": part_tree_exports,
    "jsonld_deep": deep_products,
    "links_reached": reached_entities,
    "user_summary": user_summary,
    "end_of_life_summary": end_of_life_summary,
    "service_summary": service_summary,
    "utility_summary": utility_summary,
    "user_view": user_view,
    "end_of_life_view": end_of_life_view,
    "service_windows": on(A.service_steps, streams.windowed),
}
