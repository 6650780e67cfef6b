"""Passports: looking them up, their organisations, places and spare parts, search, and the summaries of the four views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.scalars import age_days, clean_text, rounded
from . import materials, processes, services, trees
from .ranks import ranked


class NotFound(LookupError):
    """No row has the key that was asked for."""


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; raises NotFound if there is none."""
    found = table.where(F.col(key) == value)
    if found.isEmpty():
        raise NotFound(f"{key} {value}")
    return found


def lookup_many(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ``wanted``."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("wanted_key"))
    return table.join(ids, F.col(key) == F.col("wanted_key"), "left_semi")


def of_line(instances: DataFrame, static_id) -> DataFrame:
    return instances.where(F.col("static_id") == static_id)


def first_of(instances: DataFrame, key: str) -> DataFrame:
    """Of several passports with one value of ``key`` the least."""
    return instances.groupBy(key).agg(F.min("instance_id").alias("instance_id"))


def minimal_organisations(organisations: DataFrame) -> DataFrame:
    """Id and what views show; an organisation's EORI only where it has one."""
    return organisations.select("org_id", F.struct("org_id", "name", "url", "type", "eori").alias("organisation"))


def with_organisations(instances: DataFrame, organisations: DataFrame, roles: tuple[str, ...] = ("manufacturer", "importer")) -> DataFrame:
    """Every passport with the organisations of its roles; null where there is none.

    Only organisations that are asked for are joined. Passports without one are dealt out by
    their id, or all of them would meet in one task; those of one organisation do meet
    where Spark joins by shuffles.
    """
    out = instances
    for role in roles:
        asked = instances.select(F.col(f"{role}_id").alias("asked")).distinct()
        shown = minimal_organisations(organisations).join(asked, F.col("org_id") == F.col("asked"), "left_semi").select(F.col("org_id").alias("of"), F.col("organisation").alias(role))
        there = F.col(f"{role}_id")
        rows = out.withColumn("dealt_by", F.coalesce(there, F.concat(F.lit("none "), F.col("instance_id").cast("string"))))
        out = rows.join(shown, (F.col("dealt_by") == F.col("of")) & there.isNotNull(), "left").drop("of", "dealt_by")
    return out


def minimal_document(document) -> Column:
    """Name, or address if the name is empty, and address."""
    return F.when(document.isNotNull(), F.struct(F.coalesce(clean_text(document["name"]), document["url"]).alias("name"), document["url"].alias("url")))


def document_list(*documents) -> Column:
    return F.filter(F.array(*map(minimal_document, documents)), lambda d: d.isNotNull())


def returning_places(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Places of each line in its order; places that are not known are left out."""
    listed = lines.select("static_id", F.posexplode("returning_place_ids").alias("pos", "of"))
    return listed.join(places, F.col("of") == F.col("place_id")).select("static_id", "pos", "place_id", "name", "latitude", "longitude")


def with_step_places(steps: DataFrame, places: DataFrame) -> DataFrame:
    """Steps of parts or materials with the places where they were done and went to as ``place`` and ``destination``; null where unknown."""
    out = steps
    for link, name in (("place_id", "place"), ("dest_id", "destination")):
        shown = places.select(F.col("place_id").alias("of"), F.struct("place_id", "name", "latitude", "longitude").alias(name))
        out = out.join(shown, F.col(link) == F.col("of"), "left").drop("of")
    return out


def steps_of_part(steps: DataFrame, places: DataFrame, part_id) -> DataFrame:
    """What a look-up of one part shows: its steps and those of its materials, places resolved."""
    return with_step_places(steps.where(F.col("part_id") == part_id), places)


def spare_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    listed = lines.select("static_id", F.posexplode("spare_ids").alias("pos", "spare_id"))
    names = parts.select(F.col("part_id").alias("of"), "name")
    return listed.join(names, F.col("spare_id") == F.col("of"), "left").select("static_id", "pos", "spare_id", F.coalesce("name", F.col("spare_id").cast("string")).alias("name"))


def search(instances: DataFrame, term: str) -> DataFrame:
    """Passports whose product name or id holds the term, by case-folded text; all for an empty one; ``pos`` orders them, active ones first, then by name and id."""
    t = term.strip().lower()
    hit = F.lower("product_name").contains(t) | F.lower(F.col("instance_id").cast("string")).contains(t)
    found = instances.where(F.coalesce(hit, F.lit(False))).select("instance_id", "product_name", "discontinued")
    order = {"o0": F.coalesce("discontinued", F.lit(False)).cast("int"), "o1": F.coalesce("product_name", F.lit("")), "o2": F.col("instance_id")}
    return ranked(found.withColumns(order), list(order)).drop(*order).withColumn("pos", F.col("pos").cast("bigint"))


def ages(instances: DataFrame, as_of) -> DataFrame:
    return instances.select("instance_id", age_days(F.col("declared_at"), as_of).alias("age_days"))


def images(lines: DataFrame, base_url: str) -> DataFrame:
    """Image references with their addresses."""
    listed = lines.select("static_id", F.posexplode("images").alias("pos", "image"))
    return listed.select("static_id", "pos", "image.file_id", "image.filename", F.concat(F.lit(base_url), F.col("static_id").cast("string"), F.lit("/images/"), F.col("image.file_id")).alias("url"))


def image_content(lines: DataFrame, blobs: DataFrame, static_id, file_id: str) -> DataFrame:
    """The bytes of an image, only if this line refers to it."""
    linked = lines.where(F.col("static_id") == static_id).select(F.explode("images.file_id").alias("linked")).where(F.col("linked") == file_id)
    found = blobs.join(linked, F.col("file_id") == F.col("linked"), "left_semi")
    if found.isEmpty():
        raise NotFound(f"image {file_id} of {static_id}")
    return found


def user_summary(instances: DataFrame, nodes: DataFrame, uses: DataFrame, steps: DataFrame, emissions: DataFrame) -> DataFrame:
    """What owners see: parts, materials, steps, distances and emissions of each product.

    Materials, steps and emissions are keyed by the product, parts by its tree.
    """
    parts = trees.tree_summary(nodes).select(F.col("tree_id").alias("root"), "n_parts", "n_fail", "n_modular")
    shares = materials.overall_shares(uses).select(F.col("tree_id").alias("u"), rounded(F.col("grams"), 3).alias("grams"), rounded(F.col("recycled_percent"), 2).alias("recycled_percent"), rounded(F.col("rare_percent"), 2).alias("rare_percent"))
    counts = processes.category_counts(steps).withColumnRenamed("tree_id", "c").withColumnRenamed("total", "steps")
    km = processes.transport_km(steps).select(F.col("tree_id").alias("k"), "total_km")
    ghg = processes.ghg_total(emissions).select(F.col("tree_id").alias("g"), F.col("kg").alias("ghg_kg"))
    out = trees.with_trees(instances).select("instance_id", "static_id", "root_part_id", "of_tree")
    for right, key in ((shares, "u"), (counts, "c"), (km, "k"), (ghg, "g")):
        out = out.join(right, F.col("instance_id") == F.col(key), "left").drop(key)
    figures = ["n_parts", "n_fail", "n_modular", "grams", "recycled_percent", "rare_percent", *processes.CATEGORIES, "steps", "total_km", "ghg_kg"]
    return out.join(parts, F.col("of_tree") == F.col("root"), "left").drop("root", "of_tree").na.fill(0, figures)


def end_of_life_summary(instances: DataFrame, nodes: DataFrame, uses: DataFrame, service_steps: DataFrame) -> DataFrame:
    """What dismantlers see: materials unrounded, rare and hazardous mass, services."""
    shares = materials.overall_shares(uses).withColumnRenamed("tree_id", "u").withColumnRenamed("grams", "mass_g")
    kinds = materials.end_of_life_buckets(uses).groupBy(F.col("tree_id").alias("b")).agg(*(exact_sum(F.when(F.col("bucket") == k, F.col("grams"))).alias(f"{k}_g") for k in ("rare", "hazardous")))
    done = services.bucket_totals(service_steps).withColumnRenamed("instance_id", "s")
    parts = trees.tree_summary(nodes).select(F.col("tree_id").alias("root"), "n_parts")
    out = trees.with_trees(instances).select("instance_id", "static_id", "root_part_id", "discontinued", "of_tree")
    for right, key in ((shares, "u"), (kinds, "b"), (done, "s")):
        out = out.join(right, F.col("instance_id") == F.col(key), "left").drop(key)
    figures = ["mass_g", "recycled_percent", "rare_percent", "rare_g", "hazardous_g", "cost_eur", *(b.lower() for b in services.BUCKET_NAMES), "n_parts"]
    return out.join(parts, F.col("of_tree") == F.col("root"), "left").drop("root", "of_tree").na.fill(0, figures)


def service_summary(instances: DataFrame, nodes: DataFrame, service_steps: DataFrame) -> DataFrame:
    """What service staff see: reliability, failing parts among root and first level, services done."""
    near = nodes.where("lvl <= 1").groupBy("tree_id").agg(F.count_if("has_failstate").alias("n_top_fail"))
    reliable = services.product_mtbf(instances, nodes).withColumnRenamed("instance_id", "m")
    done = services.bucket_totals(service_steps).withColumnRenamed("instance_id", "s")
    out = trees.with_trees(instances).select("instance_id", "static_id", "root_part_id", "of_tree", "operating_hrs")
    out = out.join(reliable, F.col("instance_id") == F.col("m"), "left").drop("m").join(done, F.col("instance_id") == F.col("s"), "left").drop("s")
    return out.join(near, F.col("of_tree") == F.col("tree_id"), "left").drop("tree_id", "of_tree").na.fill(0, ["n_top_fail", "cost_eur", *(b.lower() for b in services.BUCKET_NAMES)])


def utility_summary(service_steps: DataFrame, instances: DataFrame, names: DataFrame) -> DataFrame:
    """Per product line its products, operations, and the part and symptom met most often."""
    lines = instances.groupBy("static_id").agg(F.count("*").alias("n_instances"))
    operations = services.operation_totals(service_steps, instances).where("type = 'SecondaryValueStep'").select(F.col("static_id").alias("o"), F.col("n").alias("operations"), "avg_per_instance")
    part = services.top_parts(service_steps, names, 1).select(F.col("static_id").alias("p"), F.col("name").alias("top_part"))
    symptom = services.symptom_instances(service_steps).where("pos = 1").select(F.col("static_id").alias("y"), F.col("symptom").alias("top_symptom"))
    for right, key in ((operations, "o"), (part, "p"), (symptom, "y")):
        lines = lines.join(right, F.col("static_id") == F.col(key), "left").drop(key)
    return lines


def nth(rows: DataFrame, keys: list[str], order: list, name: str = "pos") -> DataFrame:
    """Stable positions within keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
