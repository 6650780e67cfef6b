"""Links that are followed to the end: lists, targets that are missing or shared, and cycles."""

import json

from bomwright import stages
from bomwright.operators import links

ENTITIES = "kind string, id string, body string"
LINKS = "kind string, id string, field string, pos int, to_kind string, to_id string"


def tables(spark):
    entities = [("product", "p", '{"n":1}'), ("line", "l", "{}"), ("place", "a", '{"n":"a"}'), ("place", "b", '{"n":"b"}'), ("org", "o", '{"n":"\\"o\\""}'), ("org", "a", '{"n":"not the place"}'), ("step", "x", "{}"), ("step", "y", "{}"), ("step", "z", "{}")]
    rows = [
        ("product", "p", "line", None, "line", "l"), ("product", "p", "maker", None, "org", "o"), ("product", "p", "seller", None, "org", None),
        ("line", "l", "places", 1, "place", "a"), ("line", "l", "places", 0, "place", "b"), ("line", "l", "places", 2, "place", "none"), ("line", "l", "places", 10, "place", "a"),
        ("place", "a", "by", None, "org", "o"), ("step", "x", "next", None, "step", "y"), ("step", "y", "next", None, "step", "x"), ("step", "y", "at", None, "place", "b"), ("step", "z", "next", None, "step", "x"),
    ]
    return spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(rows, LINKS)


def test_everything_is_embedded(spark):
    found = {(r.kind, r.id): json.loads(r.json) for r in links.embedded(*tables(spark)).collect()}
    org, b = {"n": '"o"'}, {"n": "b"}
    a = {"n": "a", "by": org}
    line = {"places": [b, a, None, a]}
    assert found[("line", "l")] == line and found[("place", "a")] == a
    assert found[("product", "p")] == {"n": 1, "line": line, "maker": org, "seller": None}
    assert found[("step", "x")] == {"next": {"@id": "y"}} and found[("step", "y")] == {"next": {"@id": "x"}, "at": b} and found[("step", "z")] == {"next": {"@id": "x"}}
    assert len(found) == 9


def test_what_is_reached(spark):
    entities, rows = tables(spark)
    found = {}
    for r in links.reached(rows, entities).collect():
        found.setdefault((r.start_kind, r.start_id), set()).add((r.kind, r.id, r.depth))
    assert found[("product", "p")] == {("line", "l", 1), ("org", "o", 1), ("place", "a", 2), ("place", "b", 2), ("place", "none", 2)}
    assert found[("step", "z")] == {("step", "x", 1), ("step", "y", 2), ("place", "b", 3)}
    assert found[("step", "x")] == {("step", "y", 1), ("place", "b", 2)} and ("org", "o") not in found
    assert links.embedded(entities.limit(0), rows.limit(0)).count() == links.reached(rows.limit(0), entities).count() == 0


def fan(spark, n):
    """The same few entities, and n products that nothing links to."""
    entities, rows = tables(spark)
    products = spark.range(n).selectExpr("'product' AS kind", "'n' || id AS id")
    line, org = (products.selectExpr("kind", "id", f"'{field}' AS field", "CAST(NULL AS int) AS pos", f"'{kind}' AS to_kind", f"'{to}' AS to_id") for field, kind, to in (("line", "line", "l"), ("step", "step", "x")))
    return entities.unionByName(products.selectExpr("*", "'{}' AS body")), rows.unionByName(line).unionByName(org)


def rows_written(monkeypatch):
    """How many rows are written from here on."""
    counts, original = [], links.written

    def counted(rows, name):
        out = original(rows, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(links, "written", counted)
    return counts


def test_reached_does_not_write_what_nothing_links_to(spark, monkeypatch):
    counts = rows_written(monkeypatch)
    assert links.reached(*fan(spark, 0)[::-1]).count() == 17 and counts
    few = sum(counts)
    counts.clear()
    monkeypatch.setattr(stages, "ROWS_A_TASK", 20)
    entities, rows = fan(spark, 100)
    found = links.reached(rows, entities).where("start_id LIKE 'n%'").groupBy("start_id").agg({"depth": "sum", "id": "count"})
    assert {tuple(r)[1:] for r in found.collect()} == {(13, 7)} and found.count() == 100
    assert sum(counts) == few


def test_embedded_does_not_write_what_nothing_links_to(spark, monkeypatch):
    counts = rows_written(monkeypatch)
    few = {(r.kind, r.id): r.json for r in links.embedded(*fan(spark, 0)).collect()}
    n = sum(counts)
    counts.clear()
    monkeypatch.setattr(stages, "ROWS_A_TASK", 20)
    found = {(r.kind, r.id): r.json for r in links.embedded(*fan(spark, 100)).collect()}
    assert json.loads(found[("product", "n7")]) == {"line": json.loads(few[("line", "l")]), "step": {"@id": "x"}}
    assert len(found) == 109 and {k: v for k, v in found.items() if not k[1].startswith("n")} == few
    assert sum(counts) == n


def test_targets_of_very_many_links_are_shown_alike(spark, monkeypatch):
    usual = sorted(map(tuple, links.embedded(*fan(spark, 10)).collect()))
    monkeypatch.setattr(links, "HOT_LINKS", 1)
    assert sorted(map(tuple, links.embedded(*fan(spark, 10)).collect())) == usual
