"""What products are made of: mass, recycled, rare-earth, hazardous and purity shares.

All take ``uses``, one row per material in a part of a product, and give rows per
product (tree_id). Some count a part or material once per product and some do not,
as the figures they stand for differ in that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum, with_exact_sum
from ..functions.scalars import purity, ratio, with_rounded


def _product():
    return Window.partitionBy("tree_id")


def _named(uses: DataFrame) -> DataFrame:
    return uses.withColumn("material_name", F.coalesce("material_name", F.lit("Unknown")))


def mass_by_name(uses: DataFrame) -> DataFrame:
    grams = _named(uses).groupBy("tree_id", "material_name").agg(exact_sum(F.col("weight_g")).alias("grams"))
    totalled = with_exact_sum(grams, "total", F.col("grams"), _product())
    return totalled.select("tree_id", "material_name", "grams", (ratio(F.col("grams"), F.col("total")) * 100.0).alias("percent"))


def recycled_by_name(uses: DataFrame) -> DataFrame:
    """Mass-weighted recycled and virgin percentages of each material."""
    w, p = F.col("weight_g"), F.col("pct_recycled")
    sums = _named(uses).groupBy("tree_id", "material_name").agg(exact_sum(w).alias("grams"), exact_sum(w * p).alias("wp"))
    recycled = ratio(F.col("wp"), F.col("grams"))
    return sums.select("tree_id", "material_name", "grams", recycled.alias("recycled_percent"), (100.0 - recycled).alias("virgin_percent"))


def totals_by_name(uses: DataFrame) -> DataFrame:
    """Exact mass (g), and mass times recycled percentage (wp), of each name; a name is rare if any static material of that name is."""
    w, p = F.col("weight_g"), F.col("pct_recycled")
    return _named(uses).groupBy("tree_id", "material_name").agg(exact_sum(w).alias("g"), exact_sum(w * p).alias("wp"), F.bool_or("rare").alias("rare"))


def overall_shares(uses: DataFrame) -> DataFrame:
    """Recycled and rare-earth percentages of the product."""
    sums = totals_by_name(uses).groupBy("tree_id").agg(exact_sum(F.col("g")).alias("grams"), exact_sum(F.col("wp")).alias("wp"), exact_sum(F.when(F.col("rare"), F.col("g")).otherwise(0.0)).alias("rare_g"))
    return sums.select("tree_id", "grams", ratio(F.col("wp"), F.col("grams")).alias("recycled_percent"), (ratio(F.col("rare_g"), F.col("grams")) * 100.0).alias("rare_percent"))


def purity_by_name(uses: DataFrame) -> DataFrame:
    """Mass-weighted mean purity, a share; null without mass."""
    w = F.col("weight_g")
    heavy = _named(uses).where("weight_g > 0 AND purity IS NOT NULL").withColumn("share", purity(F.col("purity")))
    return heavy.groupBy("tree_id", "material_name").agg((exact_sum(w * F.col("share")) / exact_sum(w)).alias("mean_purity"))


def once_per_part(uses: DataFrame) -> DataFrame:
    """All uses of the first visit of each part of a product; a material instance in several parts counts in each.

    ``visit`` says where the part is and orders like ``place``; rows of one place are one use.
    """
    first = Window.partitionBy("tree_id", "part_id").orderBy("place")
    seen = uses.withColumns({"first_visit": F.first("visit").over(first), "before": F.lag("place").over(first)})
    return seen.where((F.col("visit") == F.col("first_visit")) & ~F.col("place").eqNullSafe(F.col("before"))).drop("first_visit", "before")


def once_per_material(uses: DataFrame) -> DataFrame:
    """The first use of each material instance of a product."""
    first = Window.partitionBy("tree_id", "material_instance_id").orderBy("place")
    return uses.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def rare_earth_metrics(uses: DataFrame) -> DataFrame:
    """Rare materials, parts and material instances counted once."""
    names = _named(once_per_material(once_per_part(uses))).groupBy("tree_id", "material_name").agg(exact_sum(F.col("weight_g")).alias("g"), F.bool_or("rare").alias("rare"))
    found = with_exact_sum(names, "total", F.col("g"), _product()).where("rare")
    return with_rounded(found, grams=(F.col("g"), 4), percent=(ratio(F.col("g"), F.col("total")) * 100.0, 2)).select("tree_id", "material_name", "grams", "percent")


def shares_by_static(uses: DataFrame) -> DataFrame:
    """Mass, recycled percentage and share of each static material, parts counted once, all to two places."""
    w, p = F.col("weight_g"), F.col("pct_recycled")
    sums = _named(once_per_part(uses)).groupBy("tree_id", "material_static_id", "material_name").agg(
        exact_sum(w).alias("g"), exact_sum(w * p).alias("wp"), F.bool_or("rare").alias("rare"), F.bool_or("hazardous").alias("hazardous"))
    grams, total = F.col("g"), F.col("total")
    totalled = with_exact_sum(sums, "total", grams, _product()).withColumn("total", F.when(total > 0, total).otherwise(1.0))
    shares = with_rounded(totalled, percent=(grams / F.col("total") * 100.0, 2), recycled_percent=(ratio(F.col("wp"), grams), 2), grams=(grams, 2))
    return shares.select("tree_id", "material_static_id", "material_name", "rare", "hazardous", "grams", "recycled_percent", "percent")


def summary_by_name(uses: DataFrame) -> DataFrame:
    """Summary by name, added up from masses and recycled percentages already rounded to two places."""
    w, p = F.col("grams"), F.col("recycled_percent")
    names = shares_by_static(uses).groupBy("tree_id", "material_name").agg(exact_sum(w).alias("g"), exact_sum(w * p).alias("wp"), F.bool_or("rare").alias("rare"), F.bool_or("hazardous").alias("hazardous"))
    grams = F.col("g")
    totalled = with_exact_sum(names, "total", grams, _product())
    shared = with_rounded(totalled, percent=(ratio(grams, F.col("total")) * 100.0, 2), recycled_percent=(ratio(F.col("wp"), grams), 2), grams=(grams, 4))
    shared = shared.select("tree_id", "material_name", "rare", "hazardous", "grams", "percent", "recycled_percent")
    pure = purity_by_name(uses).select(F.col("tree_id").alias("t"), F.col("material_name").alias("m"), "mean_purity")
    return shared.join(pure, (F.col("tree_id") == F.col("t")) & (F.col("material_name") == F.col("m")), "left").drop("t", "m")


def hazardous_locations(uses: DataFrame) -> DataFrame:
    """Hazardous materials by part, parts counted once, with their warnings and share of the product's rounded mass."""
    totals = shares_by_static(uses).groupBy(F.col("tree_id").alias("t")).agg(exact_sum(F.col("grams")).alias("total"))
    found = _named(once_per_part(uses)).where("hazardous")
    by_part = found.groupBy("tree_id", "material_name", "part_id").agg(exact_sum(F.col("weight_g")).alias("grams"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))), ",").alias("warnings"))
    return by_part.join(totals, F.col("tree_id") == F.col("t")).select("tree_id", "material_name", "part_id", "grams", "warnings", (F.col("grams") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0) * 100.0).alias("percent"))


def end_of_life_buckets(uses: DataFrame) -> DataFrame:
    """Rare and hazardous materials of each product with the parts that hold them; nothing counted once."""
    bucket = F.explode(F.filter(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("hazardous"), "hazardous")), lambda b: b.isNotNull()))
    rows = _named(uses).select("tree_id", "material_name", "part_id", "weight_g", bucket.alias("bucket"))
    return rows.groupBy("tree_id", "bucket", "material_name").agg(exact_sum(F.col("weight_g")).alias("grams"), F.array_join(F.transform(F.array_sort(F.collect_set("part_id")), lambda p: p.cast("string")), ",").alias("parts"))


def pie(shares: DataFrame) -> DataFrame:
    """Start and end of each material's slice, 0 to 1, the heaviest first."""
    order = _product().orderBy(F.desc("grams"), "material_name")
    summed = with_exact_sum(shares, "upto", F.col("grams"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totalled = with_exact_sum(summed, "total", F.col("grams"), _product())
    to, total = F.col("upto"), F.col("total")
    return totalled.select("tree_id", "material_name", ((to - F.col("grams")) / total).alias("from_share"), (to / total).alias("to_share"))
