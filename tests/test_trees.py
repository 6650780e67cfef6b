"""Trees in which a sub-part is a product of its own, deep trees, cycles, and places in an order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bomwright.operators import mutations, ranks, services, trees, views
from bomwright.sources import adapters

SCHEMA = "part_id bigint, parent_id bigint, name string, is_modular boolean, has_failstate boolean, mtbf_hrs double"


def parts_of(spark, links, fail=()):
    return spark.createDataFrame([(p, up, f"n{p}", p % 2 == 0, p in fail, float(p)) for p, up in links], SCHEMA)


@pytest.fixture(scope="module")
def machine(spark):
    """A machine (1) of a grinder (2), which has a rotor (3) and a motor (4); grinder and rotor are products too."""
    nodes = trees.flatten(parts_of(spark, [(1, None), (2, 1), (3, 2), (4, 2), (5, 1)], fail=(3,)))
    products = spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, 3)], "instance_id bigint, root_part_id bigint")
    return products, trees.product_trees(nodes, products.select("root_part_id"))


def test_a_part_of_two_trees_counts_once_in_each(machine):
    _, nodes = machine
    counts = {(r.tree_id, r.part_id): (r.n_parts, r.n_fail, r.n_modular) for r in trees.subtree_counts(nodes).collect()}
    assert counts == {(1, 1): (5, 1, 2), (1, 2): (3, 1, 2), (1, 3): (1, 1, 0), (1, 4): (1, 0, 1), (1, 5): (1, 0, 0), (2, 2): (3, 1, 2), (2, 3): (1, 1, 0), (2, 4): (1, 0, 1), (3, 3): (1, 1, 0)}
    found = sorted((r.tree_id, r.parent_id, r.part_id, r.pos) for r in trees.direct_children(nodes).collect())
    assert found == [(1, 1, 2, 1), (1, 1, 5, 2), (1, 2, 3, 1), (1, 2, 4, 2), (2, 2, 3, 1), (2, 2, 4, 2)]
    assert {(r.tree_id, r.breadcrumb) for r in trees.failing_parts(nodes).collect()} == {(1, "n1 → n2 → n3"), (2, "n2 → n3"), (3, "n3")}
    assert {(r.tree_id, r.part_id): r.y for r in trees.layout(nodes).collect()} == {(1, 1): 2.0, (1, 2): 1.5, (1, 3): 1.0, (1, 4): 2.0, (1, 5): 3.0, (2, 2): 1.5, (2, 3): 1.0, (2, 4): 2.0, (3, 3): 1.0}


def test_links_and_locations_are_of_the_products_own_tree(spark, machine):
    products, nodes = machine
    links = sorted((r.instance_id, r.part_id, r.part_name, r.linked_id) for r in trees.linked_passports(products, nodes).collect())
    assert links == [(10, 2, "n2", 20), (10, 3, "n3", 30), (20, 3, "n3", 30), (21, 3, "n3", 30)]
    blocks = {r.of: ([c.part_id for c in r.first_level or []], r.n_parts, r.n_fail) for r in views.part_blocks(nodes).collect()}
    assert blocks == {1: ([2, 5], 5, 1), 2: ([3, 4], 3, 1), 3: ([], 1, 1)}
    uses = spark.createDataFrame([(t, 3, "NdFeB", 2.0, True, False, ["H1"]) for t in (10, 20, 30)], "tree_id bigint, part_id bigint, material_name string, weight_g double, rare boolean, hazardous boolean, warnings array<string>")
    names = trees.breadcrumbs(nodes).withColumnRenamed("breadcrumb", "path").join(nodes.select("tree_id", "part_id", "name"), ["tree_id", "part_id"])
    rare, _ = views.holding_blocks(uses, products, names)
    assert {r.of: [p.path for m in r.rare for p in m.parts] for r in rare.collect()} == {10: ["n1 → n2 → n3"], 20: ["n2 → n3"], 30: ["n3"]}


def test_reliability_by_tree(machine):
    products, nodes = machine
    used = products.withColumn("operating_hrs", F.lit(2.5))
    assert {(r.instance_id, r.n_parts, r.n_exceeded) for r in services.mtbf_counts(used, nodes).collect()} == {(10, 5, 2), (20, 3, 1), (21, 3, 1), (30, 1, 0)}
    assert sorted((r.instance_id, r.mtbf_hrs) for r in services.product_mtbf(used, nodes).collect()) == [(10, 1.0), (20, 2.0), (21, 2.0), (30, 3.0)]
    assert services.part_mtbf(used, nodes).count() == 12


def test_several_parents_and_cycles(spark):
    """Part 4 is in two places; 6 is below 4 and above it, 8 and 9 are each other's."""
    nodes = trees.flatten(parts_of(spark, [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (6, 4), (4, 6), (8, 9), (9, 8), (7, None)]))
    assert sorted(tuple(r.path) for r in nodes.collect()) == [(1,), (1, 2), (1, 2, 4), (1, 2, 4, 6), (1, 3), (1, 3, 4), (1, 3, 4, 6), (7,)]
    assert {(r.tree_id, r.part_id): r.n_parts for r in trees.subtree_counts(nodes).collect()} == {(1, 1): 7, (1, 2): 3, (1, 3): 3, (1, 4): 2, (1, 6): 1, (7, 7): 1}


def test_trees_of_thousands_of_levels(spark):
    """A chain of 5,000 levels with a twig at each, in about thirteen rounds and without settings for recursion."""
    depth = 5000
    n = F.col("id")
    chain = spark.range(depth).select(n.alias("part_id"), F.when(n > 0, n - 1).alias("parent_id"))
    twigs = spark.range(depth).select((n + 100_000).alias("part_id"), n.alias("parent_id"))
    parts = chain.unionByName(twigs).select("*", F.lit("x").alias("name"), F.lit(True).alias("is_modular"), (F.col("part_id") % 2 == 0).alias("has_failstate"), F.lit(None).cast("double").alias("mtbf_hrs"))
    nodes = trees.flatten(parts, paths=False)
    assert nodes.agg(F.max("lvl"), F.count("*"), F.count_distinct("tree_id")).first() == (depth, 2 * depth, 1)
    counts = {r.part_id: (r.n_parts, r.n_modular) for r in trees.subtree_counts(nodes).where("part_id < 100000").collect()}
    assert counts == {k: (2 * (depth - k), 2 * (depth - k)) for k in range(depth)}


@pytest.mark.parametrize("within", [[], ["g"]])
def test_places_in_an_order(spark, within):
    r = random.Random(5)
    rows = [(k, r.choice([None, 1, 1, 1, 2]), r.randrange(40)) for k in range(500)]
    found = ranks.ranked(spark.createDataFrame(rows, "k int, g int, v int").repartition(5), ["v", "k"], within).collect()
    expected = {}
    for g in {row[1] for row in rows} if within else [0]:
        some = sorted((row[2], row[0]) for row in rows if not within or row[1] == g)
        expected |= {k: n + 1 for n, (_, k) in enumerate(some)}
    assert {x.k: x.pos for x in found} == expected


def test_names_in_reading_order(spark):
    names = ["Zug", "zebra", "Ärger", "arm", "Apfel", "äpfel", "apfel", "Öl", "oben", "ß", "Straße", "Strasse", None]
    df = spark.createDataFrame([(1, k, 1 if n else None, n) for k, n in enumerate(names)], "tree_id int, part_id int, parent_id int, name string")
    shown = [r.label for r in trees.picker_options(df).orderBy("pos").collect()]
    assert shown == ["12", "apfel", "Apfel", "äpfel", "Ärger", "arm", "oben", "Öl", "ß", "Strasse", "Straße", "zebra", "Zug"]
    swedish = df.where("name IS NOT NULL").orderBy(ranks.reading_order(F.col("name"), "sv")).select("name").collect()
    assert [r.name for r in swedish][-3:] == ["äpfel", "Ärger", "Öl"]


def test_grafts_copy_subtrees_and_refuse_loops(spark):
    nodes = trees.flatten(parts_of(spark, [(1, None), (2, 1), (3, 2), (4, 1), (9, None), (8, 9), (7, 8)])).drop("names")
    asked = [(1, 4, 1, 2), (1, 3, 9, 8), (1, 3, 1, 1), (1, 2, 1, 2), (1, 1, 1, 4), (1, 99, 1, 2), (9, 9, 1, 77), (1, 3, 9, 8)]
    changed, failed = mutations.graft(nodes, spark.createDataFrame(asked, "tree_id bigint, parent_id bigint, from_tree bigint, child_id bigint"))
    found = sorted((tuple(r.path), r.parent_id, r.lvl, r.name) for r in changed.where("tree_id = 1").collect())
    assert [f[0] for f in found] == [(1,), (1, 2), (1, 2, 3), (1, 2, 3, 8), (1, 2, 3, 8, 7), (1, 4), (1, 4, 2), (1, 4, 2, 3)]
    assert all(f[0][-2:-1] == ((f[1],) if f[1] else ()) and f[2] == len(f[0]) - 1 and f[3] == f"n{f[0][-1]}" for f in found)
    assert changed.where("tree_id = 9").count() == 3
    assert sorted((r.parent_id, r.child_id, r.reason) for r in failed.collect()) == [(1, 4, "already a child"), (2, 2, "would be below itself"), (3, 1, "would be below itself"), (9, 77, "no such part"), (99, 2, "no such part")]


def test_refused_grafts_copy_nothing(spark, monkeypatch):
    """Sixty parts that all ask for the root above them: each refused copy would be of the whole tree."""
    nodes = trees.flatten(parts_of(spark, [(1, None), *((k, 1) for k in range(2, 62))])).drop("names")
    sizes = []
    monkeypatch.setattr(mutations, "written", lambda rows, name: sizes.append(rows.count()) or rows)
    changed, failed = mutations.graft(nodes, nodes.where("part_id > 1").select("tree_id", F.col("part_id").alias("parent_id"), F.col("tree_id").alias("from_tree"), F.lit(1).cast("bigint").alias("child_id")))
    assert changed.count() == 61 and {r.reason for r in failed.collect()} == {"would be below itself"} and failed.count() == 60
    assert max(sizes) <= 61


def test_parts_are_shown_by_their_static_part(spark):
    """The static name first, then the part's own, then its id; empty names are none, unknown static parts give nothing, and of two of one id the least counts."""
    parts = spark.createDataFrame(
        [(1, "own", 5.0, "A"), (2, "own", None, "B"), (3, "", None, "C"), (4, None, 7.0, None), (5, "own", 8.0, "unknown"), (6, None, None, "D")], "part_id int, name string, mtbf_hrs double, part_static_id string")
    statics = spark.createDataFrame([("A", "a", 1.0), ("B", "", 2.0), ("C", None, None), ("D", "z", 4.0), ("D", "d", 3.0), (None, "none", 9.0)], "part_static_id string, name string, mtbf_hrs double")
    found = {r.part_id: (r.name, r.mtbf_hrs) for r in trees.with_statics(parts, statics).collect()}
    assert found == {1: ("a", 1.0), 2: ("own", 2.0), 3: ("3", None), 4: ("4", 7.0), 5: ("own", 8.0), 6: ("d", 3.0)}
    assert trees.with_statics(parts, statics).columns == parts.columns
    assert trees.with_statics(parts.limit(0), statics).count() == 0 and trees.with_statics(parts, statics.limit(0)).where("part_id = 1").first().name == "own"


def joins(rows):
    return re.findall(r"(\w+Join)\b", rows._jdf.queryExecution().sparkPlan().toString())


def test_trees_are_not_broadcast(spark, sf_dir):
    """A forest that is small in its files is a thousand times as large with its paths spread."""
    parts = adapters.parts(spark, sf_dir)
    flat = trees.flatten(parts)
    assert set(joins(flat)) == {"SortMergeJoin"}
    cut = trees.product_trees(flat, parts.select("part_id"))
    at = [line for line in cut._jdf.queryExecution().sparkPlan().toString().splitlines() if "above" in line and "Join" in line]
    assert at and all("SortMergeJoin" in line for line in at)
    assert set(joins(trees.layout(flat))) - {"SortMergeJoin"} <= {"BroadcastHashJoin"}  # sizes of ranges are few
    assert any("has_child" in line and "SortMergeJoin" in line for line in trees.layout(flat)._jdf.queryExecution().sparkPlan().toString().splitlines())


def test_links_are_found_once_for_a_tree(machine):
    found = trees.linked_passports(*machine)
    assert sorted((r.instance_id, r.part_id, r.linked_id) for r in found.collect()) == [(10, 2, 20), (10, 3, 30), (20, 3, 30), (21, 3, 30)]
    last = next(line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line)
    assert "of_tree" in last and "linked_part" not in last


def test_large_trees_meet_products_in_blocks(spark):
    """Of a tree of 5,000 parts no row that is joined holds more than some of them, and none is lost."""
    forest = trees.flatten(parts_of(spark, [(1, None), *((p, 1) for p in range(2, 5001))]), paths=False)
    instances = spark.createDataFrame([(i, 1, 2500.0) for i in range(3)], "instance_id bigint, root_part_id bigint, operating_hrs double")
    found = services.part_mtbf(instances, forest)
    assert found.groupBy("instance_id").agg(F.count("*"), F.count_distinct("part_id"), F.count_if("exceeded")).orderBy("instance_id").collect() == [(i, 5000, 5000, 2500) for i in range(3)]
    assert "of_block" in found._jdf.queryExecution().analyzed().toString()


def test_parts_of_like_mtbf_follow_each_other(spark):
    """Rows of a product differ from the one before in little but the part; parts without a MTBF are there too."""
    forest = trees.flatten(parts_of(spark, [(1, None), *((p, 1) for p in range(2, 3001))]), paths=False)
    forest = forest.withColumn("mtbf_hrs", F.when(F.col("part_id") % 4 != 0, (F.col("part_id") % 4 * 1000).cast("double")))
    instances = spark.createDataFrame([(i, 1, 1500.0) for i in range(3)], "instance_id bigint, root_part_id bigint, operating_hrs double")
    rows = [(r.instance_id, r.mtbf_hrs) for r in services.part_mtbf(instances, forest).collect()]
    assert {(i, m): rows.count((i, m)) for i, m in set(rows)} == {(i, m): 750 for i in range(3) for m in (None, 1000.0, 2000.0, 3000.0)}
    assert sum(a != b for a, b in zip(rows, rows[1:], strict=False)) < 3 * (4 + 3)
