"""Nested records, rules, changes and exports on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bomwright import stages
from bomwright.operators import jsonld, materials, mutations, passports, processes, rules, services, trees, views
from bomwright.sources import documents, tables
from bomwright.streaming import service_steps as streams

RECORD = {
    "id": "root", "name": "Machine", "isModular": True,
    "compositeMaterials": [{"id": "m1", "materialStaticLink": "steel", "weightGRM": 10.0, "percentRecycled": 50, "purityLevel": 97,
                            "materialProcessTracking": [{"type": "TransportStep", "processedAt": "p1", "destination": "p2", "distanceKM": 5.0}]}],
    "partProcessTracking": [{"type": "RemanufacturingServiceStep", "costEUR": 3, "observedSymptoms": [" leak ", ""], "beginDate": "2024-01-02T00:00:00Z",
                             "ghgEmissionRecords": [{"scope": "Scope 3", "scope3_category": "travel", "activity": {"quantity": 1.0}, "emission_factor": {"value": 2.0}, "emissions_kg_co2e": 2.0, "calculation_method": "x"}] * 2
                             + [{"scope": "Scope 1", "emissions_kg_co2e": 9.0, "excluded_from_aggregation": True}]}],
    "compositeParts": [
        {"id": "a", "name": "A", "hasFailstate": True, "compositeParts": [{"id": "b", "name": "B", "compositeMaterials": [{"id": "m1", "materialStaticLink": "steel", "weight_g": {"value": 4.0}}]}]},
        {"id": "c"},
    ],
}


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "r.json"
    path.write_text(json.dumps(RECORD) + "\nnot json\n")
    return documents.part_nodes(documents.read_records(spark, str(path)))


def test_nested_records(nodes):
    rows = [(r.part_id, r.parent_id, r.lvl, r.name) for r in nodes.orderBy("ord_path").collect()]
    assert rows == [("root", None, 0, "Machine"), ("a", "root", 1, "A"), ("b", "a", 2, "B"), ("c", "root", 1, None)]
    uses = {(r.part_id, r.weight_g, r.purity) for r in documents.material_uses(nodes).collect()}
    assert uses == {("root", 10.0, 97.0), ("b", 4.0, None)}


def test_steps_and_emissions_of_records(nodes):
    steps = documents.steps(nodes)
    assert {(r.owner_kind, r.type, r.cost) for r in steps.collect()} == {("part", "RemanufacturingServiceStep", 3.0), ("material", "TransportStep", None)}
    assert processes.category_counts(steps).first().asDict() == {"tree_id": "root", "transport": 1, "production": 1, "secondary": 0, "total": 2}  # by name
    assert processes.map_totals(steps).first().asDict() == {"tree_id": "root", "transport": 1, "production": 0, "secondary": 1, "total": 2}  # by type
    emissions = documents.emissions(steps)
    assert {(r.scope, r.kg) for r in processes.ghg_by_scope(emissions).collect()} == {("Scope 1", 9.0), ("Scope 3", 4.0)}
    assert {(r.scope, r.kg) for r in processes.footprint(emissions).collect()} == {("Scope 1", 0.0), ("Scope 2", 0.0), ("Scope 3", 2.0)}


def test_material_counted_once_or_not(nodes, spark):
    known = spark.createDataFrame([("steel", "Steel", True, False, [])], "material_static_id string, material_name string, rare boolean, hazardous boolean, warnings array<string>")
    uses = documents.material_uses(nodes).join(known, "material_static_id")
    assert materials.mass_by_name(uses).first().grams == 14.0
    assert materials.rare_earth_metrics(uses).first().grams == 10.0
    assert abs(materials.purity_by_name(uses).first().mean_purity - 0.97) < 1e-9


def test_random_trees_count_like_brute_force(spark):
    r = random.Random(1)
    parent = {0: None} | {k: r.randrange(k) for k in range(1, 60)}
    parts = spark.createDataFrame([(k, p, f"n{k}", k % 2 == 0, k % 3 == 0, None) for k, p in parent.items()], "part_id bigint, parent_id bigint, name string, is_modular boolean, has_failstate boolean, mtbf_hrs double")
    size = dict.fromkeys(parent, 0)
    for k in parent:
        up = k
        while up is not None:
            size[up] += 1
            up = parent[up]
    flat = trees.flatten(parts)
    assert {row.part_id: row.n_parts for row in trees.subtree_counts(flat).collect()} == size
    nested = {row.part_id: json.loads(row.json) for row in jsonld.part_trees(flat).collect()}

    def count(node):
        return 1 + sum(map(count, node.get("dpp:compositeParts", [])))

    assert {k: count(v) for k, v in nested.items()} == size
    twice, failed = mutations.toggle_failstate(flat, spark.createDataFrame([(0, 5), (0, 5), (0, 7), (0, 99)], "tree_id bigint, part_id bigint"))
    state = {row.part_id: row.has_failstate for row in twice.collect()}
    assert [k for k in parent if state[k] != (k % 3 == 0)] == [7] and failed.first().part_id == 99


def test_replace_part_moves_the_subtree_out(spark):
    rows = [(1, 1, None, [1]), (1, 2, 1, [1, 2]), (1, 3, 2, [1, 2, 3]), (1, 4, 1, [1, 4])]
    flat = spark.createDataFrame(rows, "tree_id bigint, part_id bigint, parent_id bigint, path array<bigint>")
    commands = spark.createDataFrame([(1, 2, 9), (1, 3, 9), (1, 1, 9), (1, 77, 9)], "tree_id bigint, old_id bigint, new_id bigint")
    new = spark.createDataFrame([(9, 9, None, [9])], "new_id bigint, part_id bigint, parent_id bigint, path array<bigint>")
    kept, detached, failed = mutations.replace_parts(flat, commands.where("old_id <> 1"), new)
    assert {(r.part_id, r.parent_id, tuple(r.path)) for r in kept.collect()} == {(1, None, (1,)), (4, 1, (1, 4)), (9, 1, (1, 9))}
    assert {r.part_id for r in detached.collect()} == {2, 3}
    # 3 went with 2, so that its own command finds no part any more
    assert sorted((r.old_id, r.reason) for r in failed.collect()) == [(3, "no such part"), (77, "no such part")]
    assert {r.reason for r in mutations.replace_parts(flat, commands, new)[2].collect()} == {"no such part", "root cannot be replaced"}


def test_steps_of_unknown_targets_fail(spark):
    steps = spark.createDataFrame([(1, 1, "RepairServiceStep", [5])], "event_id bigint, tree_id bigint, type string, target_ids array<bigint>")
    new = spark.createDataFrame([(2, 1, "RepairServiceStep", [2]), (3, 1, "RepairServiceStep", [2, 8]), (4, 1, "CleaningServiceStep", [8])], steps.schema)
    parts = spark.createDataFrame([(1, 2)], "tree_id bigint, part_id bigint")
    all_steps, failed = mutations.append_steps(steps, new, parts)
    assert {r.event_id for r in all_steps.collect()} == {1, 2, 4} and [r.event_id for r in failed.collect()] == [3]


def test_links_and_children(spark):
    lines = spark.createDataFrame([(1, ["a"]), (2, [])], "static_id bigint, spare_ids array<string>")
    commands = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "static_id bigint, link string")
    changed, failed = mutations.add_links(lines, "spare_ids", commands, distinct=True)
    assert {r.static_id: r.spare_ids for r in changed.collect()} == {1: ["a", "b"], 2: ["c"]} and failed.first().link == "a"
    assert {r.static_id: r.spare_ids for r in mutations.add_links(lines, "spare_ids", commands, distinct=False)[0].collect()} == {1: ["a", "a", "b"], 2: ["c"]}
    parts = spark.createDataFrame([(1, None), (2, 1), (3, None)], "part_id bigint, parent_id bigint")
    grown, refused = mutations.attach_children(parts, spark.createDataFrame([(1, 3), (1, 2), (1, 9)], "parent_id bigint, child_id bigint"))
    assert grown.where("part_id = 3 AND parent_id = 1").count() == 1
    assert {(r.child_id, r.reason) for r in refused.collect()} == {(2, "already a child"), (9, "no such part")}


def test_rules(spark):
    rows = spark.createDataFrame([("4006381333931", "x", 10.0, 20.0, " de "), ("12", " ", 95.0, None, "d"), ("4006381333931", "y", 0.0, 0.0, "DEU")], "place_id string, name string, latitude double, longitude double, country string")
    found = [r.reasons for r in rules.judged(rows, rules.place_rules()).collect()]
    assert found == [[], ["gln", "latitude", "longitude", "country", "name"], []]
    stored = rows.where("name = 'x'")
    new, refused = rules.insert(rows, stored, "place_id", rules.place_rules())
    assert new.count() == 0 and refused.count() == 3
    linked = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, ["z"]), (4, [])], "id bigint, links array<string>")
    targets = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r.id: r.ok for r in rules.all_resolve(linked, "links", targets, "key", "id", "ok").collect()} == {1: True, 2: False, 3: False, 4: True}


def test_rule_sets_catch_bad_rows(spark):
    orgs = spark.createDataFrame([("A", "https://a", "DE0123456789"), ("B", "ftp://b", "X")], "name string, url string, eori string")
    assert [r.reasons for r in rules.judged(orgs, rules.organisation_rules()).collect()] == [[], ["url", "eori"]]
    uses = spark.createDataFrame([("urn:uuid:12345678-1234-1234-1234-123456789abc", 1.0, 50.0, 0.9, "b"), ("x", -1.0, 101.0, float("nan"), " ")], "material_instance_id string, weight_g double, pct_recycled double, purity double, batch_number string")
    assert [r.reasons for r in rules.judged(uses, rules.material_rules()).collect()] == [[], ["id", "weight", "recycled", "purity", "batch"]]


URN = "urn:uuid:00000000-0000-0000-0000-00000000000"
LINK_TABLES = {
    "orgs": ([("M", "Manufacturer"), ("I", "Importer"), ("T", "Transport")], "org_id string, type string"),
    "places": ([("p", "Berlin")], "place_id string, name string"),
    "statics": ([("s1",), ("s2",)], "part_static_id string"),
    "stuff": ([("steel",)], "material_static_id string"),
    "steps": ([(URN + "1", "p", None), (URN + "1", "p", "p"), (URN + "2", "p", "q"), (URN + "2", None, None), (URN + "3", "q", None)], "owner_id string, place_id string, dest_id string"),
}


@pytest.fixture(scope="module")
def linked(spark):
    tables = {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in LINK_TABLES.items()}
    return tables | {"steps": tables["steps"].withColumns({"distance_km": F.lit(1.0), "cost": F.lit(None).cast("double")})}


def broken(checked, key):
    return {r[key]: r.reasons for r in rules.judge(checked).collect()}


def test_parts_and_materials_need_known_statics_and_places_of_steps(spark, linked):
    parts = spark.createDataFrame([(URN + "1", "s1"), (URN + "2", "s2"), (URN + "3", "gone"), (URN + "4", None), ("x", "s1")], "part_id string, part_static_id string")
    checked = rules.checked_parts(parts, linked["statics"], linked["steps"], linked["places"])
    assert broken(checked, "part_id") == {URN + "1": [], URN + "2": ["steps"], URN + "3": ["static", "steps"], URN + "4": ["static"], "x": ["id"]}
    new, refused = rules.insert_checked(checked, parts.limit(0), "part_id")
    assert new.columns == parts.columns and [r.part_id for r in new.collect()] == [URN + "1"] and refused.count() == 4
    uses = spark.createDataFrame([(URN + "1", "steel"), (URN + "2", "tin")], "material_instance_id string, material_static_id string").withColumns({"weight_g": F.lit(1.0), "pct_recycled": F.lit(0.0), "purity": F.lit(1.0), "batch_number": F.lit("b")})
    assert broken(rules.checked_materials(uses, linked["stuff"], linked["steps"], linked["places"]), "material_instance_id") == {URN + "1": [], URN + "2": ["static", "steps"]}


def test_lines_link_to_organisations_of_the_right_type(spark, linked):
    n = "0000000000000"
    rows = [(n + "1", "M", "T", "I", ["s1", "s2"], ["p"]), (n + "2", "I", "gone", "M", ["s1", "s1"], ["q"]), (n + "3", "M", "M", None, None, []), (n + "4", None, None, None, [None], ["p", "p"])]
    lines = spark.createDataFrame(rows, "static_id string, manufacturer_id string, operator_id string, importer_id string, spare_ids array<string>, returning_place_ids array<string>")
    lines = lines.withColumns({"ean": F.lit(None).cast("string"), "expected_mtbf_hrs": F.lit(0.0)})
    found = broken(rules.checked_lines(lines, linked["orgs"], linked["statics"], linked["places"]), "static_id")
    assert found == {n + "1": [], n + "2": ["manufacturer", "operator", "importer", "spares", "returning_places"], n + "3": [], n + "4": ["manufacturer", "operator", "spares", "returning_places"]}


def test_products_and_places_need_what_they_link_to(spark, linked):
    rows = spark.createDataFrame([("0" * 34, "1", None), ("1" * 34, "9", "p"), ("2" * 34, "1", "q")], "instance_id string, static_id string, location_id string")
    rows = rows.withColumns({"declared_at": F.lit("2024-01-01").cast("timestamp"), "guarantee_end": F.lit("2024-01-01").cast("timestamp"), **{c: F.lit(None).cast("double") for c in ("cleaning_count", "chalk_count", "brewing_count", "grinding_count", "operating_hrs")}})
    found = broken(rules.checked_passports(rows, spark.createDataFrame([("1",)], "static_id string"), linked["places"]), "instance_id")
    assert found == {"0" * 34: [], "1" * 34: ["line"], "2" * 34: ["location"]}
    places = spark.createDataFrame([("4006381333931", "T", "B", "1"), ("4006381333932", "X", " ", None)], "place_id string, managed_by string, city string, postal_code string")
    places = places.withColumns({"name": F.lit("n"), "latitude": F.lit(0.0), "longitude": F.lit(0.0), "country": F.lit("de")})
    assert broken(rules.checked_places(places, linked["orgs"]), "place_id") == {"4006381333931": [], "4006381333932": ["city", "postal_code", "managed_by"]}


def test_a_manufacturers_materials_differ_by_name(spark, linked):
    rows = spark.createDataFrame([(URN + "1", "Steel", "M"), (URN + "2", "Tin", "M"), (URN + "3", "Tin", "M"), (URN + "4", "Zinc", "I")], "material_static_id string, material_name string, manufacturer_id string")
    stored = spark.createDataFrame([("Steel", "M"), ("Zinc", "M")], "material_name string, manufacturer_id string")
    assert broken(rules.checked_material_statics(rows, stored, linked["orgs"]), "material_static_id") == {URN + "1": ["name"], URN + "2": ["name"], URN + "3": ["name"], URN + "4": ["manufacturer"]}


def test_steps_show_their_places(spark, linked):
    places = linked["places"].withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    steps = linked["steps"].withColumnRenamed("owner_id", "part_id")
    found = [(r.place and r.place.name, r.destination and r.destination.name) for r in passports.steps_of_part(steps, places, URN + "2").collect()]
    assert sorted(found, key=str) == [("Berlin", None), (None, None)]


def test_lookup_raises_and_lists_are_empty(spark):
    table = spark.createDataFrame([(1, "x")], "instance_id bigint, product_name string").withColumn("discontinued", F.lit(False))
    assert passports.lookup(table, "instance_id", 1).count() == 1
    with pytest.raises(passports.NotFound):
        passports.lookup(table, "instance_id", 2)
    assert passports.search(table, "  ").count() == 1 and passports.search(table, "X").count() == 1 and passports.search(table, "q").count() == 0


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    blobs = tables.image_files(spark, str(tmp_path))
    image = blobs.first()
    lines = spark.createDataFrame([(1, [(image.file_id, "a.png")]), (2, [])], "static_id bigint, images array<struct<file_id:string,filename:string>>")
    assert passports.images(lines, "https://x/").first().url == f"https://x/1/images/{image.file_id}"
    assert bytes(passports.image_content(lines, blobs, 1, image.file_id).first().content) == b"abc"
    with pytest.raises(passports.NotFound):
        passports.image_content(lines, blobs, 2, image.file_id)


def test_tables_round_trip(spark, tmp_path):
    rows = spark.range(3)
    tables.append(rows, str(tmp_path), "t")
    tables.append(rows, str(tmp_path), "t")
    assert tables.read_table(spark, str(tmp_path), "t").count() == 6
    tables.clear(spark, str(tmp_path), "t")
    assert tables.read_table(spark, str(tmp_path), "t").count() == 0


def test_service_windows_as_a_stream(spark, sf_dir, tmp_path):
    from bomwright.sources import adapters

    steps = adapters.service_steps(spark, sf_dir)
    steps.write.parquet(str(tmp_path / "in"))
    stream = streams.windowed(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, streams.windowed(steps).collect()))


def test_mtbf_and_rollup(spark):
    parts = spark.createDataFrame([(1, None, "r", False, False, 100.0), (2, 1, "a", False, False, None), (3, 1, "b", False, False, 5.0)], "part_id bigint, parent_id bigint, name string, is_modular boolean, has_failstate boolean, mtbf_hrs double")
    flat = trees.flatten(parts)
    product = spark.createDataFrame([(7, 1, 10.0)], "instance_id bigint, root_part_id bigint, operating_hrs double")
    assert {(r.part_id, r.remaining_hrs, r.exceeded) for r in services.part_mtbf(product, flat).collect()} == {(1, 90.0, False), (2, None, False), (3, 0.0, True)}
    steps = spark.createDataFrame([(1, 7, "RefurbishmentServiceStep", 4.0, [2, 3])], "event_id bigint, instance_id bigint, type string, cost double, target_ids array<bigint>")
    assert {(r.part_id, r.cost_eur, r.refurbishment) for r in services.rollup_to_ancestors(steps, flat).collect()} == {(1, 4.0, 1), (2, 4.0, 1), (3, 4.0, 1)}


def test_exported_trees_hold_the_parts_taken_out_of_them(spark):
    """In the order of the history, beneath the part that has them in it, with all that was below them."""
    schema = "part_id bigint, parent_id bigint, name string, is_modular boolean, has_failstate boolean, mtbf_hrs double"
    row = lambda k, p: (k, p, f"n{k}", False, False, None)
    flat = trees.flatten(spark.createDataFrame([row(1, None), row(2, 1), row(3, 2)], schema))
    out = trees.flatten(spark.createDataFrame([row(20, None), row(21, 20), row(10, None)], schema))
    gone = jsonld.part_trees(out, roots_only=True).selectExpr("1L AS tree_id", "2L AS part_id", "IF(part_id = 20, 0, 1) AS pos", "json")
    root = json.loads(jsonld.part_trees(flat, roots_only=True, detached=gone).first().json)
    inner = root["dpp:compositeParts"][0]
    assert "dpp:historyOfDetachedParts" not in root and [d["@id"] for d in inner["dpp:historyOfDetachedParts"]] == ["20", "10"]
    assert inner["dpp:historyOfDetachedParts"][0]["dpp:compositeParts"][0]["@id"] == "21" and inner["dpp:compositeParts"][0]["@id"] == "3"
    assert jsonld.part_trees(flat, roots_only=True, detached=gone.limit(0)).first().json == jsonld.part_trees(flat, roots_only=True).first().json


def test_products_without_an_organisation_are_dealt_out(spark, monkeypatch):
    """Joined by shuffles, products without an importer would all meet in one task."""
    monkeypatch.setattr(passports, "minimal_organisations", lambda o: o.select("org_id", F.struct("org_id", "name").alias("organisation")))
    products = spark.range(2000).select(F.col("id").alias("instance_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("I"), F.col("id") % 300)).alias("importer_id"))
    organisations = spark.createDataFrame([("I0", "a"), ("I100", "b"), ("I7", "unasked"), (None, "none")], "org_id string, name string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = passports.with_organisations(products, organisations, ("importer",)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    tasks = [r.task for r in found]
    assert len(found) == 2000 and max(map(tasks.count, set(tasks))) < 500
    assert {(r.instance_id % 300, r.importer and r.importer.name) for r in found if r.importer_id} == {(0, "a"), (100, "b"), (200, None)}
    assert all(r.importer is None for r in found if r.importer_id is None)


def test_bundles_carry_the_context_once(spark, monkeypatch):
    """Lines without products, products without a line; rows that are dealt out and collected are without the context."""
    monkeypatch.setattr(stages, "ROWS_A_TASK", 10)
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "static_id int, product_name string")
    made = spark.createDataFrame([(1, i, False) for i in (10, 9, -1)] + [(3, 7, True), (4, 5, None), (4, 6, None)], "static_id int, instance_id bigint, discontinued boolean")
    found = jsonld.bundle(lines, made)
    texts = {r.static_id: json.loads(r.json) for r in found.collect()}
    assert {k: [item["@id"] for item in v] for k, v in texts.items()} == {1: ["1", "-1", "9", "10"], 2: ["2"], 3: ["7"], 4: ["5", "6"]}
    assert all(item["@context"] == jsonld.CONTEXT for v in texts.values() for item in v)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [static_id" in plan and "@context" not in plan[plan.index("RepartitionByExpression") :]


def test_long_texts_are_made_few_at_a_time_of_pieces(spark, monkeypatch):
    """Tasks join the pieces of a few lines, one after another; what they are stored with keeps one text at a time and no copies of it."""
    monkeypatch.setattr(jsonld, "BYTES_AT_ONCE", 30_000)
    monkeypatch.setattr(jsonld, "PIECE_BYTES", 2_000)
    keys = [*stages.LONG_ROWS, *(f"{k}#json" for k in stages.LONG_TEXTS)]
    lines = spark.createDataFrame([(k, "a") for k in range(5)], "static_id int, product_name string")
    made = spark.createDataFrame([(1, i, False) for i in (10, 9, -1, 2**62, -(2**62), 11)] + [(7, 12, None)], "static_id int, instance_id bigint, discontinued boolean")
    try:
        found = jsonld.bundle(lines, made)
        assert [spark.conf.get(k) for k in keys] == ["1", "false", "false"]
        texts = {r.static_id: json.loads(r.json) for r in found.collect()}
        assert found.rdd.getNumPartitions() <= 3
    finally:
        for k in keys:
            spark.conf.unset(k)
    ids = {k: [str(k)] for k in range(5)} | {1: ["1", str(-(2**62)), "-1", "9", "10", "11", str(2**62)], 7: ["12"]}
    assert {k: [item["@id"] for item in v] for k, v in texts.items()} == ids
    assert "piece_3" in found._jdf.queryExecution().analyzed().toString()


def test_views_stay_where_they_are_for_what_products_share(spark, monkeypatch):
    """Wide rows meet few trees and few lines without a shuffle, whatever Spark guesses of their size; many are joined by shuffles."""
    products = spark.createDataFrame([(i, i % 3, i % 2) for i in range(10)], "instance_id bigint, of_tree bigint, static_id int")
    of_trees = spark.createDataFrame([(0, 4, [1]), (1, 5, [2, 3])], "of bigint, n_parts int, first_level array<int>")
    of_lines = spark.createDataFrame([(1, ["a"])], "of int, documents array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((stages.FEW_ROWS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(stages, "FEW_ROWS", most)
            found = views.with_shared(products, of_trees, of_lines)
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert [line.split("Join")[0].split()[-1] + "Join" for line in plan.splitlines() if "Join" in line] == [kind] * 2
            rows = {r.instance_id: (r.n_parts, r.first_level, r.documents) for r in found.collect()}
            assert rows == {i: (*((4, [1]), (5, [2, 3]), (None, []))[i % 3], ["a"] if i % 2 else []) for i in range(10)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_steps_are_counted_and_measured_in_one_pass(spark):
    steps = spark.createDataFrame(
        [(1, "part", "TransportStep", 1.0005), (1, "material", "ProductionStep", 2.0), (1, "part", "RepairServiceStep", None), (2, "part", "X", None)], "tree_id bigint, owner_kind string, type string, distance_km double")
    apart = processes.category_counts(steps).join(processes.transport_km(steps), "tree_id")
    assert sorted(processes.counts_and_km(steps).collect()) == sorted(apart.collect())
