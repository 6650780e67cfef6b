"""Replacing parts one after another, remanufacturing, and links, on small tables."""

import random

import pytest

from bomwright.operators import mutations, rules

TREE = [(1, None, [1]), (2, 1, [1, 2]), (3, 2, [1, 2, 3]), (4, 3, [1, 2, 3, 4]), (5, 1, [1, 5])]
NEW = [(-1, -1, None, [-1]), (-1, -11, -1, [-1, -11]), (-2, -2, None, [-2]), (-3, -3, None, [-3])]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(t, *r) for t in (7, 8) for r in TREE], "tree_id int, part_id int, parent_id int, path array<int>")


@pytest.fixture(scope="module")
def new_nodes(spark):
    return spark.createDataFrame(NEW, "new_id int, part_id int, parent_id int, path array<int>")


def paths(df):
    return sorted("/".join(map(str, r.path)) for r in df.where("tree_id = 7").collect())


def replace(spark, nodes, new_nodes, commands):
    return mutations.replace_parts(nodes, spark.createDataFrame(commands, "tree_id int, old_id int, new_id int, seq int"), new_nodes)


def test_the_second_replacement_of_a_part_fails(spark, nodes, new_nodes):
    kept, detached, failed = replace(spark, nodes, new_nodes, [(7, 3, -1, 1), (7, 3, -2, 2), (7, 4, -3, 3), (7, 1, -3, 4), (7, 99, -3, 5)])
    assert paths(kept) == ["1", "1/2", "1/2/-1", "1/2/-1/-11", "1/5"] and paths(detached) == ["1/2/3", "1/2/3/4"]
    assert sorted((r.old_id, r.reason) for r in failed.collect()) == [(1, "root cannot be replaced"), (3, "no such part"), (4, "no such part"), (99, "no such part")]
    assert kept.where("tree_id = 8").count() == 5
    assert {r.parent_id for r in kept.where("part_id = -1").collect()} == {2}


def test_an_outer_part_goes_with_what_was_put_into_it(spark, nodes, new_nodes):
    kept, detached, failed = replace(spark, nodes, new_nodes, [(7, 3, -1, 1), (7, 2, -2, 2)])
    assert paths(kept) == ["1", "1/-2", "1/5"] and failed.count() == 0
    assert sorted(("/".join(map(str, r.path)), r.detached_with) for r in detached.collect()) == [("1/2", 2), ("1/2/-1", 2), ("1/2/-1/-11", 2), ("1/2/3", 3), ("1/2/3/4", 3)]


def test_a_part_that_was_put_in_can_be_replaced(spark, nodes, new_nodes):
    kept, detached, failed = replace(spark, nodes, new_nodes, [(7, 2, -1, 1), (7, -1, -2, 2)])
    assert paths(kept) == ["1", "1/-2", "1/5"] and failed.count() == 0
    assert sorted(("/".join(map(str, r.path)), r.detached_with) for r in detached.collect()) == [("1/-1", -1), ("1/-1/-11", -1), ("1/2", 2), ("1/2/3", 2), ("1/2/3/4", 2)]
    # a part inside of a new one, one that is not there yet, and one that was to come with a command that failed
    kept, _, failed = replace(spark, nodes, new_nodes, [(7, 2, -1, 1), (7, -11, -2, 2), (7, -3, -2, 3), (7, 5, -3, 4), (7, 1, -4, 5), (7, -4, -2, 6)])
    assert paths(kept) == ["1", "1/-1", "1/-1/-2", "1/-3"]
    assert sorted((r.old_id, r.reason) for r in failed.collect()) == [(-4, "no such part"), (-3, "no such part"), (1, "root cannot be replaced")]


@pytest.mark.parametrize("seed", range(8))
def test_logs_as_if_done_one_by_one(spark, seed):
    """Random logs, in which commands name old and new parts, parts that went and parts that never came."""
    r = random.Random(seed)
    tree = {1: None}
    for p in range(2, 9):
        tree[p] = r.choice(list(tree))
    path_of = lambda links, p: [] if p is None else [*path_of(links, links[p]), p]
    new = {-k: ({-k: None} | ({-k - 100: -k} if k % 2 else {})) for k in range(1, 13)}
    log = [(7, r.choice([*range(1, 9), *(-j for j in range(1, 13)), *(-j - 100 for j in range(1, 13, 2))]), -k, n) for n, k in enumerate(r.sample(range(1, 13), 12))]
    now, gone, failed = dict(tree), {}, []
    for _, old, put, _ in log:
        if old not in now or now[old] is None:
            failed.append((old, "root cannot be replaced" if old in now else "no such part"))
            continue
        below = [p for p in now if old in path_of(now, p)]
        parent = now[old]
        for p in below:
            gone[p] = old
        now = {p: up for p, up in now.items() if p not in below} | new[put] | {put: parent}
    rows = [(7, p, up, path_of(tree, p)) for p, up in tree.items()]
    fresh = [(root, p, up, path_of(links, p)) for root, links in new.items() for p, up in links.items()]
    schema = "{} int, part_id int, parent_id int, path array<int>"
    kept, detached, refused = replace(spark, spark.createDataFrame(rows, schema.format("tree_id")), spark.createDataFrame(fresh, schema.format("new_id")), log)
    assert sorted((x.part_id, x.parent_id or 0, x.path) for x in kept.collect()) == sorted((p, up or 0, path_of(now, p)) for p, up in now.items())
    assert {x.part_id: x.detached_with for x in detached.collect()} == gone
    assert sorted((x.old_id, x.reason) for x in refused.collect()) == sorted(failed)


def test_several_steps_of_rework_for_one_product(spark, nodes, new_nodes):
    """The second step's part is put in by the first; the third one fails and leaves nothing; the fourth does not see it."""
    schema = "event_id int, tree_id int, type string, repaired_ids array<int>, cleaned_ids array<int>, pairs array<struct<old_id:int,new_id:int>>"
    log = [(1, 7, "R", [5], None, [(2, -1)]), (2, 7, "R", [-1, 1], None, [(-11, -2)]), (3, 7, "R", [], [], [(5, -3), (99, -3)]), (4, 7, "R", None, [5], []), (5, 7, "R", [-3], None, [])]
    steps = spark.createDataFrame([], "event_id int, tree_id int, type string")
    kept, changed, _, failed = mutations.rework(nodes, steps, spark.createDataFrame(log, schema), new_nodes)
    assert paths(kept) == ["1", "1/-1", "1/-1/-2", "1/5"]
    assert sorted(r.event_id for r in changed.collect()) == [1, 2, 4] and sorted(r.event_id for r in failed.collect()) == [3, 5]


def test_steps_of_replacements_that_did_not_fail(spark, nodes, new_nodes):
    steps = spark.createDataFrame([(0, 7, "old")], "event_id int, tree_id int, type string")
    commands = spark.createDataFrame([(1, 7, "a", 3, -1, 1), (2, 7, "b", 3, -2, 2), (3, 7, "c", 5, -3, 3), (4, 8, "d", 1, -3, 1)], "event_id int, tree_id int, type string, old_id int, new_id int, seq int")
    _, changed, _, failed = mutations.replace_with_steps(nodes, steps, commands, new_nodes)
    assert sorted(r.event_id for r in changed.collect()) == [0, 1, 3] and failed.count() == 2


def test_rework_is_all_or_nothing(spark, nodes, new_nodes):
    steps = spark.createDataFrame([], "event_id int, tree_id int, type string")
    schema = "event_id int, tree_id int, type string, repaired_ids array<int>, cleaned_ids array<int>, pairs array<struct<old_id:int,new_id:int>>"
    good = (1, 7, "RemanufacturingServiceStep", [5], [4], [(3, -1), (5, -2)])
    for bad in ((2, 8, "RefurbishmentServiceStep", [99], None, [(3, -1)]), (2, 8, "RefurbishmentServiceStep", None, None, [(3, -1), (4, -2)]), (2, 8, "RefurbishmentServiceStep", [], [], [(5, -1), (1, -2)])):
        kept, changed, detached, failed = mutations.rework(nodes, steps, spark.createDataFrame([good, bad], schema), new_nodes)
        assert paths(kept) == ["1", "1/-2", "1/2", "1/2/-1", "1/2/-1/-11"] and paths(detached) == ["1/2/3", "1/2/3/4", "1/5"]
        assert [r.event_id for r in changed.collect()] == [1] and [r.event_id for r in failed.collect()] == [2]
        assert kept.where("tree_id = 8").count() == 5


def test_links_keep_the_order_of_commands(spark):
    lines = spark.createDataFrame([(1, [5]), (2, None)], "static_id int, returning_place_ids array<int>")
    places = spark.createDataFrame([(5, "five")], "place_id int, name string")
    commands = spark.createDataFrame([(1, 9, "nine", 1), (1, 3, "three", 2), (1, 5, "again", 3), (2, 9, "other", 4)], "static_id int, place_id int, name string, seq int")
    changed, known = mutations.add_returning_places(lines, places, commands)
    assert {r.static_id: r.returning_place_ids for r in changed.collect()} == {1: [5, 9, 3, 5], 2: [9]}
    assert sorted(map(tuple, known.collect())) == [(3, "three"), (5, "five"), (9, "nine")]


def test_recycling_of_unknown_products_fails(spark):
    owned = spark.createDataFrame([(1, False), (2, True), (3, False)], "instance_id int, discontinued boolean")
    new = spark.createDataFrame([(10, 1), (11, 9), (12, 1), (13, None)], "event_id int, instance_id int")
    changed, steps, failed = mutations.recycle(owned, new.limit(0), new)
    assert {(r.instance_id, r.discontinued) for r in changed.collect()} == {(1, True), (2, True), (3, False)}
    assert sorted(r.event_id for r in steps.collect()) == [10, 12] and sorted((r.event_id, r.reason) for r in failed.collect()) == [(11, "no such product"), (13, "no such product")]


def test_steps_answer_for_their_emission_records(spark):
    """A step with one bad record of several breaks the rule once; steps without records do not, nor do records of no step."""
    rows = spark.createDataFrame([("a", 1, None, None, None), ("b", 1, None, None, None), ("c", 1, None, None, None)], "step_key string, place_id int, dest_id int, distance_km double, cost double")
    places = spark.createDataFrame([(1,)], "place_id int")
    records = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", -1.0, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0), ("b", 0.0, 0.0, 0.0), ("x", None, 1.0, 1.0), (None, -1.0, 1.0, 1.0)], "step_key string, factor double, quantity double, kg double")
    judged = rules.judge(rules.checked_steps(rows, places, records))
    assert {r.step_key: r.reasons for r in judged.collect()} == {"a": ["emissions"], "b": [], "c": []}
