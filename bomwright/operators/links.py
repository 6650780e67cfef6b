"""Links between entities, followed as far as they lead.

``entities``: kind, id and body, the JSON object of an entity's own fields.
``links``: kind, id, field, pos (the place in a list of links, null for a single one),
to_kind and to_id. Links are typed: they lead to an entity of their to_kind only.

Links are followed in rounds, one join each, that are written to the shared folder; this is
done only for entities that others link to. All others, which may be by far the most, are
finished in one step from these, dealt out by their own id, and are not written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import dealt, written

KEY = ["kind", "id"]
#: A target of more links than this, and than a thousandth of all, is looked up where the links lie that lead to it. There are a thousand at most.
HOT_LINKS = 10_000


def _of_targets(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` of kinds that links lead to; kinds are few."""
    kinds = links.select(F.col("to_kind").alias("kind")).distinct()
    return rows.join(F.broadcast(kinds), "kind", "left_semi")


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """All that each of ``starts`` (kind, id) leads to: start_kind, start_id, kind, id, and depth, the fewest links. An entity is followed once for each start, so cycles end."""
    steps = links.where("to_id IS NOT NULL").select("kind", "id", "to_kind", "to_id")
    start = ["start_kind", "start_id"]
    begun = starts.select(F.col("kind").alias("start_kind"), F.col("id").alias("start_id"))
    targets = steps.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
    inner = written(_of_targets(steps, steps).join(targets, KEY, "left_semi").distinct(), "steps")
    passed = inner.select(*KEY).distinct()
    front = written(passed.select(F.col("kind").alias("start_kind"), F.col("id").alias("start_id"), "kind", "id", F.lit(0).alias("depth")), "front")
    seen = front
    while not front.isEmpty():
        found = front.join(inner, KEY).select(*start, F.col("to_kind").alias("kind"), F.col("to_id").alias("id"), (F.col("depth") + 1).alias("depth")).distinct()
        front = written(found.join(seen.select(*start, *KEY), [*start, *KEY], "left_anti"), "front")
        seen = seen.unionByName(front)
    own = dealt(steps.join(passed, KEY, "left_anti").withColumnsRenamed({"kind": "start_kind", "id": "start_id"}), steps.count(), *start).join(begun, start, "left_semi")
    beyond = seen.withColumnsRenamed({"start_kind": "to_kind", "start_id": "to_id"})
    ends = own.join(beyond, ["to_kind", "to_id"], "left").select(*start, *(F.coalesce(c, f"to_{c}").alias(c) for c in KEY), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"))
    return ends.groupBy(*start, *KEY).agg(F.min("depth").alias("depth")).unionByName(seen.where("depth > 0").join(begun, start, "left_semi"))


def _fields(parts: DataFrame) -> DataFrame:
    """The text of each entity's links (kind, id, fields) with their targets (shown) in it, lists in their order, fields by name."""
    items = F.sort_array(F.collect_list(F.struct("field", "pos", F.coalesce("shown", F.lit("null")).alias("shown"))))
    grouped = parts.groupBy(*KEY).agg(items.alias("items"))

    def field(name):
        values = F.filter("items", lambda i: i["field"].eqNullSafe(name))
        quoted = F.to_json(F.array(name))
        text = F.when(values[0]["pos"].isNull(), values[0]["shown"]).otherwise(F.concat(F.lit("["), F.array_join(values["shown"], ","), F.lit("]")))
        return F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), text)

    return grouped.select(*KEY, F.array_join(F.transform(F.array_distinct(F.col("items")["field"]), field), ",").alias("fields"))


def _whole(entities: DataFrame, fields: DataFrame, how: str) -> DataFrame:
    """One JSON object of each entity's body and its fields."""
    open_body = F.col("body").substr(F.lit(1), F.length("body") - 1)
    json = F.when(F.col("fields").isNull(), F.col("body")).otherwise(F.concat(open_body, F.when(F.col("body") == "{}", "").otherwise(","), F.col("fields"), F.lit("}")))
    return entities.join(fields, KEY, how).select(*KEY, json.alias("json"))


def _linked_to(entities: DataFrame, links: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities that others link to: themselves, their links, all (kind, id, json) that could be finished, and the links of those that could not.

    From the bottom up: in each round those entities are made whose targets all are, so
    there are as many rounds as the longest chain of links.
    """
    inner = written(_of_targets(entities, targets).join(targets, KEY, "left_semi").dropDuplicates(KEY), "entities")
    known = inner.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"), F.lit(True).alias("is_known"))
    asked = written(_of_targets(links, targets).join(inner.select(*KEY), KEY, "left_semi").join(known, ["to_kind", "to_id"], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False))), "asked")
    made = written(inner.join(asked.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.col("body").alias("json")), "made")
    left = asked
    while True:
        wanted = left.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        shown = made.join(wanted, KEY, "left_semi").select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"), F.col("json").alias("shown"))
        parts = left.join(shown, ["to_kind", "to_id"], "left")
        waits = F.count_if(F.col("is_known") & F.col("shown").isNull()).over(Window.partitionBy(*KEY))
        new = written(_whole(inner, _fields(parts.withColumn("waits", waits).where("waits = 0")), "inner"), "made")
        if new.isEmpty():
            return inner, asked, made, parts
        made = made.unionByName(new)
        left = left.join(new.select(*KEY), KEY, "left_anti")


def embedded(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Every entity (kind, id, json) with all that it links to inside it, and all that these link to.

    A target that is not known is null. Entities that lead back to themselves, and those
    that lead to such, hold their unfinished targets by @id. Of entities of one kind and id
    one is taken.
    """
    entities, links = entities.select("kind", "id", "body"), links.select("kind", "id", "field", "pos", "to_kind", "to_id")
    n = links.count()
    asked_for = links.where("to_id IS NOT NULL").groupBy("to_kind", "to_id").agg(F.count("*").alias("n_links"))
    targets = written(asked_for.withColumns({"kind": F.col("to_kind"), "id": F.col("to_id")}), "targets")
    inner, asked, made, parts = _linked_to(entities, links, targets)
    by_id = F.to_json(F.struct(F.col("to_id").alias("@id")))
    unfinished = _whole(inner, _fields(parts.withColumn("shown", F.when(F.col("is_known"), F.coalesce("shown", by_id)))), "inner")
    shown = made.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"), F.col("json").alias("shown"))
    shown = shown.unionByName(parts.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")).distinct().withColumn("shown", by_id))

    to = ["to_kind", "to_id"]
    hot = F.broadcast(targets.where(F.col("n_links") > max(HOT_LINKS, n // 1000)).select(*to, F.lit(True).alias("is_hot")))
    hot_shown = written(shown.join(hot, to, "left_semi"), "hot").withColumnRenamed("shown", "hot_shown")
    own = links.join(asked.select(*KEY).distinct(), KEY, "left_anti").join(hot, to, "left")
    far = own.where("is_hot IS NULL AND to_id IS NOT NULL").join(shown, to, "left")
    near = own.where("is_hot IS NOT NULL OR to_id IS NULL").withColumn("shown", F.lit(None).cast("string"))
    looked_up = dealt(far.unionByName(near), n, *KEY).join(hot_shown, to, "left").withColumn("shown", F.coalesce("shown", "hot_shown"))
    others = dealt(entities, n, *KEY).join(inner.select(*KEY), KEY, "left_anti").dropDuplicates(KEY)
    return made.unionByName(unfinished).unionByName(_whole(others, _fields(looked_up), "left"))
