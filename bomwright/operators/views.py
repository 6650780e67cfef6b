"""What the views of owners and of dismantlers show of a product, as one row with its blocks.

Lists are those that a page shows: a product's first parts, its materials by name, the
places and documents of its line. Lists over a whole tree, such as failing parts or
services, stay rows of their own (``trees.failing_parts``, ``services``). A product for
which a block has nothing has an empty list there, and zero for a figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.exact import exact_sum
from ..functions.scalars import ratio, rounded
from ..stages import few_or_shuffled
from . import materials, passports, processes, services, trees

ROLES = ("manufacturer", "importer", "operator")
#: Documents of a line, each a name and an address, in the order that the owners' view lists them.
USER_DOCUMENTS = ("data_sheet", "operating_guide", "repair_manual", "disassembly", "recycling")
COMPLIANCE = ("ce_conformity", "ecodesign_conformity")
EXTRAS = ("height_cm", "width_cm", "depth_cm", "weight_g", "taric_code")
COUNTERS = ("cleaning_count", "chalk_count", "brewing_count", "grinding_count", "operating_hrs")


def gathered(rows: DataFrame, key: str, name: str, *items: Column | str) -> DataFrame:
    """The rows of each key, which is ``of`` then, as a list of structs sorted by their fields in turn."""
    return rows.groupBy(F.col(key).alias("of")).agg(F.sort_array(F.collect_list(F.struct(*items))).alias(name))


def attached(rows: DataFrame, key: str, more: DataFrame) -> DataFrame:
    """Rows with what ``more`` has for their key; lists are empty where it has nothing."""
    lists = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in more.schema if isinstance(f.dataType, ArrayType)}
    return rows.join(more, F.col(key) == F.col("of"), "left").drop("of").withColumns(lists)


def line_blocks(lines: DataFrame, places: DataFrame, base_url: str) -> DataFrame:
    """Of each product line, by ``of``: documents, compliance, extras, images, and the places that take its products back."""
    back = gathered(passports.returning_places(lines, places), "static_id", "returning_places", "pos", "place_id", "name", "latitude", "longitude")
    pictures = gathered(passports.images(lines, base_url), "static_id", "images", "pos", "file_id", "filename", "url")
    single = {c: passports.minimal_document(F.col(c)) for c in ("disassembly", "recycling", "repair_manual")}
    blocks = lines.select(
        "static_id", passports.document_list(*map(F.col, USER_DOCUMENTS)).alias("documents"), F.struct(*(c.alias(n) for n, c in single.items())).alias("manuals"),
        F.struct(*(passports.minimal_document(F.col(c)).alias(c) for c in COMPLIANCE)).alias("compliance"), F.struct(*EXTRAS).alias("extras"))
    return attached(attached(blocks, "static_id", back), "static_id", pictures).withColumnRenamed("static_id", "of")


def part_blocks(nodes: DataFrame) -> DataFrame:
    """Of each tree, by ``of``: the parts right below its root, in their order, and how many parts it has and how many fail."""
    place = "ord_path" if "ord_path" in nodes.columns else "path"
    children = gathered(nodes.where("lvl = 1"), "tree_id", "first_level", place, "part_id", "name", "is_modular", "has_failstate")
    shown = F.transform("first_level", lambda c: F.struct(c["part_id"].alias("part_id"), c["name"].alias("name"), c["is_modular"].alias("is_modular"), c["has_failstate"].alias("has_failstate")))
    counts = trees.tree_summary(nodes).select("tree_id", "n_parts", "n_fail")
    return attached(counts, "tree_id", children.withColumn("first_level", shown)).withColumnRenamed("tree_id", "of")


def material_block(uses: DataFrame) -> DataFrame:
    """Of each product, by ``of``: its materials, the heaviest first, their mass, and what of it is recycled and rare, in percent."""
    g, wp = F.col("g"), F.col("wp")
    recycled = ratio(wp, g)
    item = F.struct((-F.col("g")).alias("order"), "material_name", g.alias("grams"), recycled.alias("recycled_percent"), (100.0 - recycled).alias("virgin_percent"))
    rare = F.when(F.col("rare"), F.col("g")).otherwise(0.0)
    sums = materials.totals_by_name(uses).groupBy(F.col("tree_id").alias("of")).agg(
        F.sort_array(F.collect_list(item)).alias("items"), exact_sum(F.col("g")).alias("grams"), exact_sum(F.col("wp")).alias("recycled"), exact_sum(rare).alias("rare"))
    with_share = F.transform("items", lambda m: m.dropFields("order").withField("percent", ratio(m["grams"], F.col("grams")) * 100.0))
    return sums.select("of", with_share.alias("materials"), "grams", ratio(F.col("recycled"), F.col("grams")).alias("recycled_percent"), (ratio(F.col("rare"), F.col("grams")) * 100.0).alias("rare_percent"))


def emission_blocks(emissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each product, by ``of``: emissions by scope with their total, and by category."""
    scopes = processes.ghg_by_scope(emissions).groupBy(F.col("tree_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("scope", "kg"))).alias("scopes"), exact_sum(F.col("kg")).alias("ghg_kg"))
    return scopes.withColumn("ghg_kg", rounded(F.col("ghg_kg"), 3)), gathered(processes.ghg_by_category(emissions), "tree_id", "categories", "category", "kg")


def linked_block(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each product, by ``of``: the products that parts of it are, by the part's name, with theirs."""
    named = instances.select(F.col("instance_id").alias("named_id"), F.col("product_name").alias("linked_name"))
    links = trees.linked_passports(instances, nodes).join(named, F.col("linked_id") == F.col("named_id"), "left")
    return gathered(links, "instance_id", "linked", F.coalesce("part_name", F.lit("")).alias("part_name"), "part_id", "linked_id", "linked_name")


def holding_blocks(uses: DataFrame, instances: DataFrame, names: DataFrame) -> list[DataFrame]:
    """Of each product, by ``of``: its rare and its hazardous materials by name, with warnings and the parts that hold them.

    ``names``: tree_id, part_id, name and path as the parts of a tree are to be shown; of
    several places in a tree the least. A part that is not in the product's tree goes by its id.
    """
    trees_of = trees.with_trees(instances).select(F.col("instance_id").alias("product"), "of_tree")
    in_tree = names.groupBy(F.col("tree_id").alias("shown_tree"), F.col("part_id").alias("named")).agg(F.min("name").alias("name"), F.min("path").alias("path"))
    out = []
    for kind in ("rare", "hazardous"):
        held = uses.where(F.col(kind)).withColumn("material_name", F.coalesce("material_name", F.lit("Unknown")))
        parts = held.groupBy("tree_id", "material_name", "part_id").agg(exact_sum(F.col("weight_g")).alias("g"), F.flatten(F.collect_set("warnings")).alias("w"))
        parts = parts.join(trees_of, F.col("tree_id") == F.col("product"), "left").join(in_tree, (F.col("of_tree") == F.col("shown_tree")) & (F.col("part_id") == F.col("named")), "left")
        item = F.struct("part_id", F.coalesce("name", F.col("part_id").cast("string")).alias("name"), F.coalesce("path", F.col("part_id").cast("string")).alias("path"), F.col("g").alias("grams"))
        by_name = parts.groupBy("tree_id", "material_name").agg(
            exact_sum(F.col("g")).alias("grams"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("warnings"), F.sort_array(F.collect_list(item)).alias("parts"))
        out.append(gathered(by_name, "tree_id", kind, "material_name", "grams", "warnings", "parts"))
    return out


def with_shared(products: DataFrame, of_trees: DataFrame, of_lines: DataFrame) -> DataFrame:
    """Products with all their other blocks, and the blocks that the products of one tree or of one line share.

    Trees and lines are few for how many products they have, so wide rows are not dealt
    out by them: all products of a line would meet in one task.
    """
    found = attached(products, "of_tree", few_or_shuffled(of_trees, "trees")).drop("of_tree")
    return attached(found, "static_id", few_or_shuffled(of_lines, "lines"))


def _products(instances: DataFrame, organisations: DataFrame) -> DataFrame:
    counters = F.struct(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in COUNTERS)).alias("counters")
    rows = trees.with_trees(instances).select("instance_id", "static_id", "product_name", "root_part_id", "of_tree", "declared_at", "discontinued", counters, *(f"{r}_id" for r in ROLES))
    return passports.with_organisations(rows, organisations, ROLES)


def user_view(instances: DataFrame, lines: DataFrame, organisations: DataFrame, places: DataFrame, nodes: DataFrame, uses: DataFrame, steps: DataFrame, emissions: DataFrame, base_url: str = "/images/") -> DataFrame:
    """All that owners see of each product; percentages of materials as they are, the product's to two places."""
    made = material_block(uses)
    made = made.withColumns({"recycled_percent": rounded(F.col("recycled_percent"), 2), "rare_percent": rounded(F.col("rare_percent"), 2)}).drop("grams")
    figures_of_steps = processes.counts_and_km(steps).withColumnsRenamed({"tree_id": "of", "total": "n_steps"})
    out = _products(instances, organisations)
    for block in (made, figures_of_steps, *emission_blocks(emissions), linked_block(instances, nodes)):
        out = attached(out, "instance_id", block)
    out = with_shared(out, part_blocks(nodes), line_blocks(lines, places, base_url).drop("manuals"))
    figures = ["recycled_percent", "rare_percent", *processes.CATEGORIES, "n_steps", "parts_km", "materials_km", "total_km", "ghg_kg", "n_parts", "n_fail"]
    return out.na.fill(0, figures)


def end_of_life_view(instances: DataFrame, lines: DataFrame, organisations: DataFrame, nodes: DataFrame, uses: DataFrame, service_steps: DataFrame) -> DataFrame:
    """All that dismantlers see of each product; figures are not rounded."""
    names = trees.breadcrumbs(nodes).withColumnRenamed("breadcrumb", "path").join(nodes.select("tree_id", "part_id", "name"), ["tree_id", "part_id"])
    done = services.bucket_totals(service_steps).withColumnRenamed("instance_id", "of")
    out = _products(instances, organisations)
    for block in (material_block(uses), *holding_blocks(uses, instances, names), done, linked_block(instances, nodes)):
        out = attached(out, "instance_id", block)
    manuals = F.struct(*(passports.minimal_document(F.col(c)).alias(c) for c in ("disassembly", "recycling")))
    out = with_shared(out, part_blocks(nodes), lines.select(F.col("static_id").alias("of"), manuals.alias("manuals")))
    return out.na.fill(0, ["grams", "recycled_percent", "rare_percent", "cost_eur", *(b.lower() for b in services.BUCKET_NAMES), "n_parts", "n_fail"])
