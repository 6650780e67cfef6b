"""The survey's values by hand, on nested records."""

import json

import pytest
from pyspark.sql import functions as F

from bomwright.functions import scalars
from bomwright.functions.scalars import rounded
from bomwright.operators import jsonld, materials, processes, services, trees, views
from bomwright.sources import documents
from tests.golden import MATERIALS, part, z10


def nodes_of(spark, path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return documents.part_nodes(documents.read_records(spark, str(path)))


def uses_of(spark, nodes):
    known = [(m, m, m == "ndfeb", m == "fr4", ["H302"] if m == "fr4" else []) for m in MATERIALS]
    return documents.material_uses(nodes).join(spark.createDataFrame(known, "material_static_id string, material_name string, rare boolean, hazardous boolean, warnings array<string>"), "material_static_id")


@pytest.fixture(scope="module")
def machine(spark, tmp_path_factory):
    return nodes_of(spark, tmp_path_factory.mktemp("golden") / "z10.json", z10())


def test_materials_of_repeated_instances_count_in_every_part(spark, machine):
    uses = uses_of(spark, machine)
    assert machine.count() == 20
    shares = {r.material_static_id: r.grams for r in materials.shares_by_static(uses).collect()}
    assert sum(shares.values()) == 11204.0 and shares["stl_general"] == 7000.0
    named = {r.material_name: r for r in materials.summary_by_name(uses).collect()}
    assert sum(r.grams for r in named.values()) == 11204.0 and (named["fr4"].grams, named["fr4"].percent) == (360.0, 3.21)
    assert {(r.part_id, r.grams, r.warnings) for r in materials.hazardous_locations(uses).collect()} == {("main_pcb", 180.0, "H302"), ("ui_pcb", 180.0, "H302")}
    once = materials.once_per_material(materials.once_per_part(uses))
    assert once.agg({"weight_g": "sum"}).first()[0] == 3677.0
    rare = materials.rare_earth_metrics(uses).first()
    assert (rare.grams, rare.percent) == (80.0, 2.18)


def test_repeated_parts_count_once(spark, tmp_path):
    twice = part("machine", part("grinder", part("main_pcb")), part("main_pcb", compositeMaterials=[{"id": "other", "materialStaticLink": "ndfeb", "weightGRM": 7}]))
    uses = uses_of(spark, nodes_of(spark, tmp_path / "r.json", twice))
    assert {(r.material_static_id, r.grams) for r in materials.shares_by_static(uses).collect()} == {("fr4", 180.0), ("solder", 22.0), ("copper", 520.0)}
    assert materials.rare_earth_metrics(uses).count() == 0


def test_services_on_detached_parts_count_for_the_root(spark, machine):
    steps, detached = documents.service_steps(documents.steps(machine)), documents.detached_parts(machine)
    assert [(r.root_part_id, r.part_id, r.name) for r in detached.collect()] == [("machine", "burrs", "burrs")]
    found = {r.part_id: (r.cost_eur, r.repair, r.replace, r.cleaning) for r in services.product_rollup(steps, machine, detached).collect()}
    some = {"machine": (163.0, 1, 1, 1), "water_system": (79.0, 1, 0, 0), "solenoid": (79.0, 1, 0, 0), "brew_group": (25.0, 0, 0, 1)}
    assert len(found) == 20 and found == dict.fromkeys(found, (0.0, 0, 0, 0)) | some
    assert {(r.target, r.name) for r in services.target_names(steps, machine, detached).collect()} == {("solenoid", "solenoid"), ("burrs", "burrs"), ("brew_group", "brew group")}


def test_a_step_counts_once_for_the_root(spark, tmp_path):
    step = {"type": "RemanufacturingServiceStep", "costEur": 5, "repairedPartIds": ["a", ""], "cleanedPartIds": ["a", "b"], "replacedAndNewParts": [["old", {"id": "b"}], ["older", {"id": "c"}], "no pair"]}
    ignored = [{"type": "RecyclingStep", "costEur": 9, "repairedPartId": "a"}, {"type": "RepairServiceStep", "costEur": 7, "repairedPartId": "elsewhere"}]
    one = part("root", part("a"), part("b"), historyOfDetachedParts=[{"id": "old"}, {"id": "older", "name": "Older"}, {"id": "old"}], partProcessTracking=[step, *ignored])
    other = part("other", part("elsewhere"), historyOfDetachedParts=[{"id": "a"}])
    nodes = nodes_of(spark, tmp_path / "r.json", one, other)
    steps, detached = documents.service_steps(documents.steps(nodes)), documents.detached_parts(nodes)
    assert sorted(r.target_ids for r in steps.collect())[-2:] == [["a", "b", "old", "older"], ["elsewhere"]]
    found = {(r.instance_id, r.part_id): (r.cost_eur, r.n_steps) for r in services.product_rollup(steps, nodes, detached).collect()}
    assert found == {("root", "root"): (5.0, 1), ("root", "a"): (5.0, 1), ("root", "b"): (5.0, 1), ("other", "other"): (0.0, 0), ("other", "elsewhere"): (0.0, 0)}
    names = {r.target: r.name for r in services.target_names(steps, nodes, detached).where("instance_id = 'root'").collect()}
    assert names == {"a": "a", "b": "b", "old": "old", "older": "Older", "elsewhere": "elsewhere"}


def view_tables(spark):
    """A machine and two of its parts as products, of a line with two documents of which one has no name; nothing is known of a third product."""
    counters = ", ".join(f"{c} double" for c in views.COUNTERS)
    rows = [(i, line, f"Product {i}", i, None, False, *[None] * 5, "M", None, "gone") for i, line in (("machine", "l"), ("grinder", "l"), ("electronics", "l"), ("nowhere", None))]
    instances = spark.createDataFrame(rows, f"instance_id string, static_id string, product_name string, root_part_id string, declared_at timestamp, discontinued boolean, {counters}, manufacturer_id string, importer_id string, operator_id string")
    document = "struct<name:string,url:string>"
    kinds = {k: F.lit(None).cast(document) for k in (*views.USER_DOCUMENTS, *views.COMPLIANCE)} | {"data_sheet": F.struct(F.lit("Sheet").alias("name"), F.lit("u1").alias("url")), "recycling": F.struct(F.lit(" ").alias("name"), F.lit("u2").alias("url"))}
    lines = spark.createDataFrame([("l", ["p2", "gone", "p1"], [("f", "front.png")])], "static_id string, returning_place_ids array<string>, images array<struct<file_id:string,filename:string>>")
    lines = lines.withColumns(kinds | {c: F.lit(None).cast("double") for c in views.EXTRAS})
    organisations = spark.createDataFrame([("M", "Maker", "u", "Manufacturer", None)], "org_id string, name string, url string, type string, eori string")
    places = spark.createDataFrame([("p1", "One", 1.0, 2.0), ("p2", "Two", None, None)], "place_id string, name string, latitude double, longitude double")
    return instances, lines, organisations, places


def test_views_of_a_product(spark, machine):
    instances, lines, organisations, places = view_tables(spark)
    steps, uses = documents.steps(machine), uses_of(spark, machine)
    own = trees.product_trees(machine, instances.select("root_part_id"))
    found = {r.instance_id: r for r in views.user_view(instances, lines, organisations, places, own, uses, steps, documents.emissions(steps)).collect()}
    one, none = found["machine"], found["nowhere"]
    assert (one.n_parts, len(one.first_level), one.first_level[0].name, one.first_level[8].name) == (20, 9, "housing", "milk system")
    assert [(x.part_name, x.linked_id, x.linked_name) for x in one.linked] == [("electronics", "electronics", "Product electronics"), ("grinder", "grinder", "Product grinder")]
    assert sum(m.grams for m in one.materials) == 11204.0 and one.materials[0].material_name == "stl_general" and abs(sum(m.percent for m in one.materials) - 100.0) < 1e-9
    assert (one.rare_percent, one.recycled_percent, one.production, one.n_steps, one.counters.cleaning_count) == (0.71, 0.0, 1, 4, 0.0)
    assert [(d.name, d.url) for d in one.documents] == [("Sheet", "u1"), ("u2", "u2")] and one.compliance.ce_conformity is None
    assert [p.name for p in one.returning_places] == ["Two", "One"] and [i.url for i in one.images] == ["/images/l/images/f"]
    assert (one.manufacturer.name, one.importer, one.operator) == ("Maker", None, None)
    assert found["grinder"].n_parts == 4 and found["grinder"].linked == [] and found["grinder"].materials == []
    assert (none.n_parts, none.first_level, none.linked, none.scopes, none.ghg_kg, none.documents, none.returning_places) == (0, [], [], [], 0.0, [], [])


def test_end_of_life_view_of_a_product(spark, machine):
    instances, lines, organisations, _ = view_tables(spark)
    services_done = documents.service_steps(documents.steps(machine))
    found = {r.instance_id: r for r in views.end_of_life_view(instances, lines, organisations, machine, uses_of(spark, machine), services_done).collect()}
    one = found["machine"]
    assert (one.cost_eur, one.repair, one.replace, one.cleaning, one.grams) == (163.0, 1, 1, 1, 11204.0)
    assert [(h.material_name, h.grams, h.warnings, [(p.name, p.path) for p in h.parts]) for h in one.hazardous] == [("fr4", 360.0, ["H302"], [("main pcb", "machine → electronics → main pcb"), ("ui pcb", "machine → electronics → ui pcb")])]
    assert [(h.material_name, h.grams, [p.part_id for p in h.parts]) for h in one.rare] == [("ndfeb", 80.0, ["motor"])]
    assert one.manuals.recycling.url == "u2" and found["nowhere"].hazardous == [] and found["nowhere"].cost_eur == 0.0


def test_exports_hold_parts_materials_and_steps(spark, machine):
    flat = machine.withColumn("path", F.col("ord_path"))
    held = jsonld.contents(uses_of(spark, machine), documents.steps(machine))
    root = json.loads(jsonld.part_trees(flat, held, roots_only=True).first().json)
    assert root["@type"] == "schema:Product" and root["@id"] == "machine"

    def walk(node):
        yield node
        for child in node.get("dpp:compositeParts", []):
            yield from walk(child)

    every = list(walk(root))
    assert len(every) == 20 and len({p["@id"] for p in every}) == 20
    materials_of = [m for p in every for m in p.get("dpp:compositeMaterials", [])]
    assert sum(m["schema:weight"]["value"] for m in materials_of) == 11204.0
    assert all(m["isVariantOf"]["@type"] == "schema:ProductModel" and m["additionalProperty"][0]["name"] == "percentRecycled" for m in materials_of)
    kinds = [s["@type"] for s in root["dpp:partProcessTracking"]]
    assert kinds == ["schema:ManufactureAction", "schema:RepairAction", "schema:UpdateAction", "schema:CleanAction"]
    assert [s["priceSpecification"]["schema:price"] for s in root["dpp:partProcessTracking"][1:]] == [79.0, 59.0, 25.0]


def test_footprint_counts_first_visits_and_each_record_once(spark, tmp_path):
    record = lambda kg, scope="Scope 3", **more: {"scope": scope, "activity": {"quantity": 1}, "emission_factor": {"value": 1}, "emissions_kg_co2e": kg, "calculation_method": "m", **more}
    step = lambda *records: {"type": "ProductionStep", "processedAt": "p", "ghgEmissionRecords": list(records)}
    twice = part("shared", partProcessTracking=[step(record(1.0), record(1.0), record(2.5, "Scope 2", scope3_category="odd"), record(8.0, excluded_from_aggregation=True)), step(record(1.0))])
    nodes = nodes_of(spark, tmp_path / "g.json", part("root", part("a", twice), twice, partProcessTracking=[step(record(0.125, "Scope 1"))]))
    rows = documents.emissions(documents.steps(nodes))
    assert {(r.scope, r.kg) for r in processes.footprint(rows).collect()} == {("Scope 1", 0.125), ("Scope 2", 2.5), ("Scope 3", 2.0)}
    assert {(r.scope, r.category, r.kg) for r in processes.footprint_by_category(rows).collect()} == {("Scope 1", "direct", 0.125), ("Scope 2", "direct", 2.5), ("Scope 3", "Uncategorized", 2.0)}
    assert {(r.scope, r.kg) for r in processes.ghg_by_scope(rows).collect()} == {("Scope 1", 0.125), ("Scope 2", 5.0), ("Scope 3", 22.0)}
    places = spark.createDataFrame([("p", "P", 1.0, 2.0)], "place_id string, name string, latitude double, longitude double")
    assert [(r.place_id, r.production) for r in processes.map_nodes(documents.steps(nodes), places).collect()] == [("p", 3)]


def test_rounding_is_exact(spark):
    import random

    r = random.Random(1)
    values = [0.125, 2.5, 0.5, 1.5, 2.675, 1.005, -0.125, -2.5, 1e17, None, *(r.uniform(-1000, 1000) for _ in range(500)), *(k / 8 for k in range(-80, 80)), *(k / 1000 + 0.0005 for k in range(-80, 80))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for n in (0, 2, 3, 6):
        assert all(y == (None if x is None else round(x, n)) for x, y in df.select("x", rounded(F.col("x"), n)).collect())


def test_shown_forms(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-02 00:00:00' AS b, cast(null as double) AS none, 0.97D AS share, 97.125D AS p, '98.5%' AS said, 1234.5D AS eur, 3.0D AS lat, 4.0D AS lon")
    c = F.col
    found = row.select(
        scalars.spaced_times(c("a"), c("b"), F.lit(3)).alias("times"), scalars.purity_percent(c("share")).alias("share"), scalars.purity_percent(c("p")).alias("p"), scalars.purity_percent(c("said")).alias("said"),
        scalars.euros(c("eur")).alias("eur"), scalars.euros(c("none")).alias("dash"), scalars.coordinates(c("none"), c("none"), c("lat"), c("lon")).alias("at"), scalars.coordinates(c("lat"), c("none"), c("none"), c("none")).alias("nowhere"),
        scalars.is_gs1(F.lit("4006381333931"), 13).alias("ean"), scalars.gs1_number(F.lit("400638133393")).alias("number"), scalars.units_compatible(F.lit("kg"), F.lit("kgCO2e/km")).alias("units"), scalars.emissions_kg(F.lit(2.0), F.lit(0.5)).alias("kg"),
        scalars.symptoms_from_text(F.lit(" a, ,b ")).alias("symptoms"), scalars.is_rare_name(F.lit("NdFeB")).alias("rare")).first()
    assert [t.hour for t in found.times] == [0, 12, 0] and (found.share, found.p, found.said) == (97.0, 97.12, 98.5)
    assert (found.eur, found.dash) == ("1234.50 €", "–") and (found["at"].latitude, found.nowhere) == (3.0, None)
    assert (found.ean, found.number, found.units, found.kg, found.symptoms, found.rare) == (True, "4006381333931", False, 1.0, ["a", "b"], True)
