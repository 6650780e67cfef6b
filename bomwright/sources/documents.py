"""Nested product records, as JSON lines, to the canonical tables.

A part holds parts, so no struct type can describe it: records are read as VARIANT
and one recursive query walks them level by level. ``ord_path`` holds a part's place
among its siblings at every level, so that sorting by it is a walk from the root.
Old names of a field are tried in turn, here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import allow_deep_trees

#: Names that one field has had.
COST_NAMES = ("costEur", "costEUR", "cost", "priceEUR", "priceEur")
WEIGHT_NAMES = ("weightGRM", "weight_g", "weightGrm", "weightgrm")
#: Where a service step says which parts it is about.
TARGET_NAMES = ("repairedPartId", "replacedPartId", "cleanedPartId")
TARGET_LIST_NAMES = ("repairedPartIds", "cleanedPartIds")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One column, ``record`` (VARIANT); lines that are not JSON are null and left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("record")).where(F.col("record").isNotNull())


def field(variant: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(variant), f"$.{path}", kind)


def first_field(variant: str, names: tuple[str, ...], kind: str) -> Column:
    """The first name that has a value; a quantity may be an object with a value."""
    return F.coalesce(*(x for n in names for x in (field(variant, n, kind), field(variant, f"{n}.value", kind))))


def part_nodes(records: DataFrame) -> DataFrame:
    """Every part of every record: tree_id, ord_path, lvl, part_id, parent_id, names along the path, and the part itself (``part``)."""
    allow_deep_trees(records.sparkSession)
    return records.sparkSession.sql(
        """
        WITH RECURSIVE node AS (
          SELECT try_variant_get(record, '$.id', 'string') AS tree_id, try_variant_get(record, '$.id', 'string') AS part_id, CAST(NULL AS STRING) AS parent_id,
                 0 AS lvl, CAST(array() AS ARRAY<INT>) AS ord_path, array(try_variant_get(record, '$.id', 'string')) AS path,
                 array(coalesce(try_variant_get(record, '$.name', 'string'), try_variant_get(record, '$.id', 'string'))) AS names, record AS part
          FROM {records}
          UNION ALL
          SELECT n.tree_id, try_variant_get(c.value, '$.id', 'string'), n.part_id, n.lvl + 1, concat(n.ord_path, array(c.pos)),
                 concat(n.path, array(try_variant_get(c.value, '$.id', 'string'))),
                 concat(n.names, array(coalesce(try_variant_get(c.value, '$.name', 'string'), try_variant_get(c.value, '$.id', 'string')))), c.value
          FROM node n, LATERAL variant_explode(try_variant_get(n.part, '$.compositeParts', 'variant')) c
        )
        SELECT tree_id, part_id, parent_id, lvl, ord_path, path, names, try_variant_get(part, '$.name', 'string') AS name,
               try_variant_get(part, '$.partStaticLink', 'string') AS part_static_id,
               coalesce(try_variant_get(part, '$.isModular', 'boolean'), false) AS is_modular,
               coalesce(try_variant_get(part, '$.hasFailstate', 'boolean'), false) AS has_failstate,
               try_variant_get(part, '$.mtbfHRS', 'double') AS mtbf_hrs, part
        FROM node
        """,
        records=records,
    )


def _exploded(nodes: DataFrame, variant: str, path: str, keep: list[str], name: str) -> DataFrame:
    nodes.select(F.col(variant)).schema  # a missing column shows here, not inside the query
    columns = ", ".join(f"n.{c}" for c in keep)
    return nodes.sparkSession.sql(f"SELECT {columns}, c.pos AS {name}_pos, c.value AS {name} FROM {{nodes}} n, LATERAL variant_explode(try_variant_get(n.{variant}, '$.{path}', 'variant')) c", nodes=nodes)


def material_uses(nodes: DataFrame) -> DataFrame:
    rows = _exploded(nodes, "part", "compositeMaterials", ["tree_id", "ord_path", "part_id"], "material")
    return rows.select(
        "tree_id", "part_id", field("material", "id").alias("material_instance_id"), field("material", "materialStaticLink").alias("material_static_id"),
        first_field("material", WEIGHT_NAMES, "double").alias("weight_g"), first_field("material", ("percentRecycled",), "double").alias("pct_recycled"),
        first_field("material", ("purityLevel",), "double").alias("purity"), F.col("ord_path").alias("visit"), F.struct("ord_path", F.col("material_pos").alias("pos")).alias("place"), "material")


def steps(nodes: DataFrame) -> DataFrame:
    """Steps of parts and of their materials; step_key names a step wherever it occurs."""
    of_parts = _exploded(nodes, "part", "partProcessTracking", ["tree_id", "ord_path", "lvl", "part_id"], "step").withColumn("owner_kind", F.lit("part")).withColumn("material_pos", F.lit(None).cast("int"))
    uses = _exploded(nodes, "part", "compositeMaterials", ["tree_id", "ord_path", "lvl", "part_id"], "material")
    of_materials = _exploded(uses, "material", "materialProcessTracking", ["tree_id", "ord_path", "lvl", "part_id", "material_pos"], "step").withColumn("owner_kind", F.lit("material"))
    s = "step"
    return of_parts.unionByName(of_materials).select(
        "tree_id", "part_id", "lvl", "owner_kind", F.col("ord_path").alias("visit"), F.struct("lvl", "ord_path").alias("level_visit"), F.struct("tree_id", "ord_path", "material_pos", "step_pos").alias("step_key"),
        F.coalesce(field(s, "type"), field(s, "type_")).alias("type"), field(s, "processedAt").alias("place_id"), field(s, "destination").alias("dest_id"),
        field(s, "distanceKM", "double").alias("distance_km"), first_field(s, COST_NAMES, "double").alias("cost"), F.coalesce(field(s, "diagnose"), field(s, "diagnosis"), F.lit("")).alias("diagnose"),
        F.coalesce(field(s, "observedSymptoms", "array<string>"), F.array().cast("array<string>")).alias("symptoms"), field(s, "beginDate").try_cast("timestamp").alias("begin_at"), target_ids(s).alias("target_ids"), "step")


def target_ids(step: str) -> Column:
    """The different parts that a service step is about; of a pair of replaced and new part, the replaced one."""
    one = F.array(*(field(step, n) for n in TARGET_NAMES))
    many = [F.coalesce(field(step, n, "array<string>"), F.array().cast("array<string>")) for n in TARGET_LIST_NAMES]
    pairs = F.transform(field(step, "replacedAndNewParts", "array<variant>"), lambda pair: F.try_variant_get(pair, "$[0]", "string"))
    found = F.concat(one, *many, F.coalesce(pairs, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda i: i != ""))


def service_steps(step_rows: DataFrame) -> DataFrame:
    """Steps on products' root parts, as services take them; a product goes by its root part."""
    return step_rows.where("lvl = 0 AND owner_kind = 'part'").withColumns({"event_id": F.col("step_key"), "instance_id": F.col("tree_id")})


def detached_parts(nodes: DataFrame) -> DataFrame:
    """Parts taken out of a product, from its root part's history: instance_id, root_part_id, part_id, name, part_static_id."""
    rows = _exploded(nodes.where("lvl = 0"), "part", "historyOfDetachedParts", ["tree_id", "part_id"], "detached")
    return rows.select(
        F.col("tree_id").alias("instance_id"), F.col("part_id").alias("root_part_id"), field("detached", "id").alias("part_id"), field("detached", "name").alias("name"),
        field("detached", "partStaticLink").alias("part_static_id")).where("part_id <> ''")


def emissions(step_rows: DataFrame) -> DataFrame:
    rows = _exploded(step_rows, "step", "ghgEmissionRecords", ["tree_id", "part_id", "visit", "step_key"], "record")
    r = "record"
    return rows.select(
        "tree_id", "part_id", "visit", "step_key", field(r, "scope").alias("scope"), field(r, "scope3_category").alias("category"), field(r, "activity.quantity", "double").alias("quantity"), field(r, "emission_factor.value", "double").alias("factor"),
        field(r, "emissions_kg_co2e", "double").alias("kg"), field(r, "calculation_method").alias("method"), F.coalesce(field(r, "excluded_from_aggregation", "boolean"), F.lit(False)).alias("excluded"))
