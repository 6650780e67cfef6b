"""Service steps: roll-ups over part trees, reliability, and what symptoms point to across sibling products.

``steps`` has one row per service step on a product's root part, or, for the statistics of
lines (``diagnosis_summary``, ``secondary_totals``, ``secondary_entries``,
``service_modular``), on any part of it (``whole_tree``); ``seen`` is the order in which
steps would be read and settles ties as "first seen".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.scalars import BUCKETS, SERVICE_TYPES, fractional_days, is_secondary, ratio, rounded, service_bucket, shown_cost, short_type, trimmed_symptoms, whole_days
from ..stages import shuffled
from .trees import positions, with_trees

#: About how many parts of a tree products meet at once.
BLOCK = 1000

BUCKET_NAMES = tuple(name for _, name in BUCKETS)


def _counts(bucket) -> list:
    return [F.count_if(bucket == b).alias(b.lower()) for b in BUCKET_NAMES]


def whole_tree(steps: DataFrame) -> DataFrame:
    """Services among the steps of all parts of products; a part that is there several times counts each time."""
    return steps.where((F.col("owner_kind") == "part") & is_secondary(F.col("type"))).drop("owner_kind")


def with_line_totals(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Adds total_instances, all products of the line, those without a root part included."""
    lines = instances.groupBy(F.col("static_id").alias("of_line")).agg(F.count("*").alias("total_instances"))
    return rows.join(lines, F.col("static_id") == F.col("of_line")).drop("of_line")


def bucket_totals(steps: DataFrame) -> DataFrame:
    """Cost and number of services of each kind; recycling and services of no kind are in neither."""
    bucket = service_bucket(F.col("type"))
    return steps.where(is_secondary(F.col("type")) & bucket.isNotNull()).groupBy("instance_id").agg(exact_sum(F.col("cost")).alias("cost_eur"), *_counts(bucket))


def rollup_to_ancestors(steps: DataFrame, nodes: DataFrame, detached: DataFrame | None = None) -> DataFrame:
    """Every part with the services on it or below: a step counts once for a part, however many of its targets lie below.

    ``detached``: instance_id, root_part_id and part_id of parts taken out of a product;
    a step on one counts for the product's root. Steps with a tree_id look for their
    targets in that tree only.
    """
    trees = ["tree_id"] if "tree_id" in steps.columns else []
    keys = ["event_id", "instance_id", "type", "cost"]
    hit = steps.where(is_secondary(F.col("type"))).select(*keys, *trees, F.explode("target_ids").alias("target"))
    above = nodes.select(F.col("part_id").alias("at"), "path", *(F.col(t).alias("in_tree") for t in trees))
    within = F.col("target") == F.col("at")
    found = hit.join(above, within & (F.col("tree_id") == F.col("in_tree")) if trees else within).select(*keys, "path")
    if detached is not None:
        gone = detached.select(F.col("instance_id").alias("of"), F.col("part_id").alias("gone_id"), F.array("root_part_id").alias("path")).distinct()
        found = found.unionByName(hit.join(gone, (F.col("instance_id") == F.col("of")) & (F.col("target") == F.col("gone_id"))).select(*keys, "path"))
    # The union of a step's paths, made where its targets meet, before it is spread over parts.
    once = found.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("path"))).alias("parts")).select(*keys, F.explode("parts").alias("part_id"))
    return once.groupBy("instance_id", "part_id").agg(exact_sum(F.col("cost")).alias("cost_eur"), *_counts(service_bucket(F.col("type"))), F.count("*").alias("n_steps"))


def product_rollup(steps: DataFrame, nodes: DataFrame, detached: DataFrame) -> DataFrame:
    """The roll-up of products that are their root parts' trees: a row for every part, zeros where no service was; services of no kind do not count."""
    figures = rollup_to_ancestors(steps.where(service_bucket(F.col("type")).isNotNull()), nodes, detached).withColumnsRenamed({"instance_id": "of", "part_id": "at"})
    parts = nodes.select("tree_id", "part_id").distinct()
    joined = parts.join(figures, (F.col("tree_id") == F.col("of")) & (F.col("part_id") == F.col("at")), "left").drop("of", "at")
    return joined.withColumnRenamed("tree_id", "instance_id").na.fill(0, ["cost_eur", *(b.lower() for b in BUCKET_NAMES), "n_steps"])


def target_names(steps: DataFrame, nodes: DataFrame, detached: DataFrame) -> DataFrame:
    """Each step's targets with their names: as in the product, else as when they were taken out of it, else their ids."""
    hit = steps.where(is_secondary(F.col("type"))).select("event_id", "instance_id", F.explode("target_ids").alias("target"))
    here = nodes.groupBy(F.col("tree_id").alias("ht"), F.col("part_id").alias("hp")).agg(F.min("name").alias("here"))
    gone = detached.groupBy(F.col("instance_id").alias("gt"), F.col("part_id").alias("gp")).agg(F.min("name").alias("gone"))
    for right, tree, part in ((here, "ht", "hp"), (gone, "gt", "gp")):
        hit = hit.join(right, (F.col("instance_id") == F.col(tree)) & (F.col("target") == F.col(part)), "left").drop(tree, part)
    return hit.select("event_id", "instance_id", "target", F.coalesce(F.nullif("here", F.lit("")), F.nullif("gone", F.lit("")), "target").alias("name"))


def _reliability(mtbf, hours) -> list:
    return [F.when(mtbf.isNotNull(), F.greatest(F.lit(0.0), mtbf - hours)).alias("remaining_hrs"), F.coalesce(hours >= mtbf, F.lit(False)).alias("exceeded")]


def part_mtbf(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every part of every product's tree by the product's hours; null remaining and not exceeded without a known MTBF.

    A tree is cut into blocks of some ``BLOCK`` parts, and products meet it block by block,
    so that tasks are alike however few and large the trees are. Parts of like MTBF are in
    one block, one after another, so that rows that follow each other differ in little but
    the part: there are as many as products times parts, and they are stored in less.
    """
    held = nodes.select("tree_id", "part_id", "mtbf_hrs")
    sizes = held.groupBy(F.col("tree_id").alias("sized")).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    # A known MTBF or none, then which: a bucket is joined by its values, which are not null.
    placed = positions(held, ["part_id"], [F.col("mtbf_hrs").isNotNull(), F.coalesce("mtbf_hrs", F.lit(0.0))])
    blocks = placed.groupBy("tree_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("mtbf_hrs", "part_id"))).alias("held"))
    asked = with_trees(instances).select("instance_id", "of_tree", "operating_hrs").join(sizes, F.col("of_tree") == F.col("sized"))
    asked = asked.select("instance_id", "of_tree", "operating_hrs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("of_block"))
    joined = asked.join(shuffled(blocks), (F.col("of_tree") == F.col("tree_id")) & (F.col("of_block") == F.col("block")))
    joined = joined.select("instance_id", "operating_hrs", F.explode("held").alias("part")).select("instance_id", "operating_hrs", "part.part_id", "part.mtbf_hrs")
    return joined.select("instance_id", "part_id", "mtbf_hrs", *_reliability(F.col("mtbf_hrs"), F.col("operating_hrs")))


def product_mtbf(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    roots = nodes.where("lvl = 0").select(F.col("tree_id").alias("root_tree"), "mtbf_hrs")
    joined = with_trees(instances).join(roots, F.col("of_tree") == F.col("root_tree"), "left")
    return joined.select("instance_id", "mtbf_hrs", *_reliability(F.col("mtbf_hrs"), F.col("operating_hrs")))


def mtbf_counts(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per product how many parts it has and how many are past their MTBF; parts of one MTBF meet products as one row."""
    kinds = nodes.groupBy("tree_id", "mtbf_hrs").agg(F.count("*").alias("n"))
    joined = with_trees(instances).select("instance_id", "of_tree", "operating_hrs").join(kinds, F.col("of_tree") == F.col("tree_id"))
    past = F.coalesce(F.col("operating_hrs") >= F.col("mtbf_hrs"), F.lit(False))
    return joined.groupBy("instance_id").agg(
        F.sum("n").alias("n_parts"), F.sum(F.when(past, F.col("n")).otherwise(0)).alias("n_exceeded"),
        F.min(F.greatest(F.lit(0.0), F.col("mtbf_hrs") - F.col("operating_hrs"))).alias("least_remaining_hrs"))


def symptom_rows(steps: DataFrame, trimmed: bool = True) -> DataFrame:
    """One row per symptom of a step: trimmed and not empty, or as it is if not empty."""
    clean = trimmed_symptoms(F.col("symptoms")) if trimmed else F.filter("symptoms", lambda s: s != "")
    rows = steps.where(is_secondary(F.col("type"))).withColumn("diagnose", F.coalesce("diagnose", F.lit("")))
    return rows.select("static_id", "instance_id", "diagnose", "seen", F.posexplode(clean).alias("pos", "symptom")).withColumn("seen", F.col("seen") + F.col("pos")).drop("pos")


def diagnosis_figures(steps: DataFrame, whole: bool) -> DataFrame:
    """Mean cost and mean days since declaration of each diagnosis; days before it do not count."""
    days = whole_days(F.col("begin_at"), F.col("declared_at")) if whole else fractional_days(F.col("begin_at"), F.col("declared_at"))
    known = steps.where(is_secondary(F.col("type")) & (F.coalesce("diagnose", F.lit("")) != "")).withColumn("days", F.when(days >= 0, days))
    sums = known.groupBy("static_id", "diagnose").agg(exact_sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.count("*").alias("n"), exact_sum(F.col("days")).alias("days"), F.count("days").alias("n_days"))
    return sums.select(F.col("static_id").alias("of"), F.col("diagnose").alias("is"), (F.col("cost") / F.col("n")).alias("avg_cost"), F.when(F.col("n_days") > 0, F.col("days") / F.col("n_days")).alias("avg_days"))


def symptom_top_diagnoses(steps: DataFrame, k: int = 2, whole: bool = True) -> DataFrame:
    """The k likeliest diagnoses of each symptom of a product line, ties by first seen."""
    counts = symptom_rows(steps).groupBy("static_id", "symptom", "diagnose").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    symptom = Window.partitionBy("static_id", "symptom")
    ranked = counts.withColumn("total", F.sum("n").over(symptom)).withColumn("rank", F.row_number().over(symptom.orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k)
    figures = diagnosis_figures(steps, whole)
    joined = ranked.join(figures, (F.col("static_id") == F.col("of")) & (F.col("diagnose") == F.col("is")), "left")
    return joined.select("static_id", "symptom", "rank", "diagnose", "n", (F.col("n") / F.col("total")).alias("probability"), "avg_cost", "avg_days")


def symptom_instances(steps: DataFrame) -> DataFrame:
    """How many products of a line show each symptom, the most first."""
    counts = symptom_rows(steps).groupBy("static_id", "symptom").agg(F.count_distinct("instance_id").alias("n_instances"), F.min("seen").alias("first"))
    order = Window.partitionBy("static_id").orderBy(F.desc("n_instances"), "first")
    return counts.select("static_id", "symptom", "n_instances", F.row_number().over(order).alias("pos"))


def diagnosis_summary(steps: DataFrame) -> DataFrame:
    """All diagnoses of each raw symptom with counts, and the likeliest, ties by first seen."""
    rows = symptom_rows(steps, trimmed=False)
    counts = rows.groupBy("static_id", "symptom", "diagnose").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    products = rows.groupBy("static_id", "symptom").agg(F.count_distinct("instance_id").alias("n_instances"))
    summed = counts.groupBy("static_id", "symptom").agg(
        F.max_by("diagnose", F.struct("n", -F.col("first"))).alias("most_likely"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("diagnose", "n")))).alias("diagnosis_counts"))
    return summed.join(products, ["static_id", "symptom"])


def operation_totals(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """Operations by type and in all, and per product of the line; a plain secondary step counts in both."""
    kinds = F.explode(F.array(F.lit("SecondaryValueStep"), F.col("type")))
    totals = steps.where(is_secondary(F.col("type"))).select("static_id", kinds.alias("type")).groupBy("static_id", "type").agg(F.count("*").alias("n"))
    lines = instances.groupBy(F.col("static_id").alias("of")).agg(F.greatest(F.lit(1), F.count("*")).alias("n_instances"))
    return totals.join(lines, F.col("static_id") == F.col("of")).select("static_id", "type", "n", (F.col("n") / F.col("n_instances")).alias("avg_per_instance"))


def top_parts(steps: DataFrame, names: DataFrame, k: int = 10, by_type: bool = False) -> DataFrame:
    """The k part names that services are about most often; an unknown part goes by its id."""
    keys = ["static_id", *(["type"] if by_type else [])]
    hit = steps.where(is_secondary(F.col("type"))).select(*keys, "seen", F.posexplode(F.array_distinct("target_ids")).alias("pos", "part_id"))
    # Counted by id before names are looked up.
    counts = hit.groupBy(*keys, "part_id").agg(F.count("*").alias("n"), F.min(F.col("seen") + F.col("pos")).alias("first"))
    named = counts.join(names.select(F.col("part_id").alias("of"), "name"), F.col("part_id") == F.col("of"), "left").withColumn("name", F.coalesce("name", F.col("part_id").cast("string")))
    sums = named.groupBy(*keys, "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "name", "n", "rank")


def secondary_totals(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """Per product line the six tracked types, zero where there is none, also for lines without any step."""
    lines = instances.select(F.col("static_id").alias("line")).distinct()
    found = steps.groupBy("static_id").agg(*(F.count_if(F.col("type") == t).alias(t) for t in SERVICE_TYPES))
    counts = lines.join(found, F.col("line") == F.col("static_id"), "left").drop("static_id").withColumnRenamed("line", "static_id").na.fill(0, list(SERVICE_TYPES))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).alias("n")) for t in SERVICE_TYPES)))
    return counts.select("static_id", rows.alias("r")).select("static_id", "r.type", "r.n")


def secondary_entries(steps: DataFrame, instances: DataFrame, compatible: bool = True) -> DataFrame:
    """Tracked steps with their product's counters. ``compatible``: counters are zero, as clients of the original saw them."""
    counters = ("cleaning_count", "chalk_count", "brewing_count", "grinding_count")
    shown = [F.lit(0.0).alias(c) if compatible else F.coalesce(c, F.lit(0.0)).alias(c) for c in counters]
    own = instances.select(F.col("instance_id").alias("of"), *counters)
    return steps.where(F.col("type").isin(*SERVICE_TYPES)).join(own, F.col("instance_id") == F.col("of"), "left").select("static_id", "instance_id", "event_id", "type", "cost", "diagnose", *shown)


def service_modular(steps: DataFrame, instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Repairs, replacements and modular parts of each product."""
    done = steps.groupBy(F.col("instance_id").alias("of")).agg(F.count_if(F.col("type") == "RepairServiceStep").alias("repairs"), F.count_if(F.col("type") == "ReplaceServiceStep").alias("replaces"))
    parts = nodes.groupBy("tree_id").agg(F.count_if("is_modular").alias("modulars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = with_trees(instances).select("static_id", "instance_id", "of_tree").join(done, F.col("instance_id") == F.col("of"), "left").join(parts, F.col("of_tree") == F.col("tree_id"), "left")
    return joined.select("static_id", "instance_id", zero("repairs"), zero("replaces"), zero("modulars"))


def service_modular_by_line(counts: DataFrame) -> DataFrame:
    """Sums over a product line and means to two places."""
    kinds = ("repairs", "replaces", "modulars")
    sums = counts.groupBy("static_id").agg(F.count("*").alias("n_instances"), *(F.sum(k).alias(k) for k in kinds))
    return sums.select("static_id", "n_instances", *kinds, *(rounded(F.col(k) / F.col("n_instances"), 2).alias(f"avg_{k}") for k in kinds))


def history(steps: DataFrame) -> DataFrame:
    """Steps as a product's history shows them: short type, no cost instead of zero, trimmed symptoms."""
    return steps.where(is_secondary(F.col("type"))).select("instance_id", "event_id", short_type(F.col("type")).alias("type"), shown_cost(F.col("cost")).alias("cost"), "diagnose", trimmed_symptoms(F.col("symptoms")).alias("symptoms"), "begin_at")


def history_cost(steps: DataFrame) -> DataFrame:
    return steps.where(is_secondary(F.col("type"))).groupBy("instance_id").agg(exact_sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"))


def failing_share(summary: DataFrame) -> DataFrame:
    return summary.select("tree_id", "n_parts", "n_fail", (ratio(F.col("n_fail"), F.col("n_parts")) * 100.0).alias("fail_percent"))
