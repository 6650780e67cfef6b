"""Part trees: flattening, ancestors, counts over subtrees, and breadcrumbs.

A forest is a table of part_id and parent_id. It is flattened by pointer doubling: every
part knows an ancestor, and in each round takes that one's ancestor for its own, so the
number of rounds is the logarithm of the depth. Rounds are written to the shared folder.

A part may be in several trees, and a sub-part may be a product with a tree of its own,
so a part of a tree goes by (tree_id, part_id), never by part_id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import shuffled, written
from .ranks import ranked, reading_order

ARROW = " → "
FIELDS = ("name", "is_modular", "has_failstate", "mtbf_hrs")


def with_statics(parts: DataFrame, statics: DataFrame) -> DataFrame:
    """Parts as they are shown: by the name of their static part, else their own, else their id, and with its MTBF, else their own.

    ``statics``: part_static_id, name and mtbf_hrs. An empty name is none; parts without a
    static part, or with an unknown one, keep what they have. Of static parts that share an
    id the least is taken. Works on parts as they are stored, so that paths of trees made
    of the result have these names, and on flattened ones.
    """
    known = statics.where("part_static_id IS NOT NULL").groupBy(F.col("part_static_id").alias("of_static")).agg(F.min(F.struct("name", "mtbf_hrs")).alias("static"))
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    joined = parts.join(known, F.col("part_static_id") == F.col("of_static"), "left")
    shown = {"name": F.coalesce(named("static.name"), named("name"), F.col("part_id").cast("string")), "mtbf_hrs": F.coalesce("static.mtbf_hrs", "mtbf_hrs")}
    return joined.withColumns(shown).drop("of_static", "static")


def flatten(parts: DataFrame, paths: bool = True) -> DataFrame:
    """Every part with its root (tree_id) and level, and with ``paths`` the ids (path) and names (names) from the root to it.

    A part with several parents is in several places. Of a part that is its own ancestor
    no branch comes back to it; parts that no root leads to are left out. ``paths=False``
    is for trees of thousands of levels, whose paths would be longer than all else; there
    each part has one parent.
    """
    label = F.coalesce("name", F.col("part_id").cast("string"))
    is_root = F.col("parent_id").isNull()
    start = parts.select("part_id", "parent_id", F.coalesce("parent_id", "part_id").alias("top"), F.when(is_root, 0).otherwise(1).alias("lvl"), is_root.alias("done"))
    if paths:
        start = start.withColumns({"path": F.array("part_id")}).join(shuffled(parts.select(F.col("part_id").alias("of"), label.alias("label")).dropDuplicates(["of"])), F.col("part_id") == F.col("of"))
        start = start.withColumn("names", F.array("label")).drop("of", "label")
    arrays = ["path", "names"] if paths else []
    now, most = written(start, "walks"), parts.count()
    for _ in range(max(1, most).bit_length()):
        if now.where("NOT done").isEmpty():
            break
        up = now.select(F.col("part_id").alias("at"), F.col("top").alias("next_top"), F.col("lvl").alias("more"), F.col("done").alias("next_done"), *(F.col(c).alias(f"up_{c}") for c in arrays))
        met = now.where("NOT done").join(shuffled(up), F.col("top") == F.col("at"))
        if paths:
            met = met.where(~F.arrays_overlap("path", "up_path"))
        joined = met.select("part_id", "parent_id", F.col("next_top").alias("top"), (F.col("lvl") + F.col("more")).alias("lvl"), F.col("next_done").alias("done"), *(F.concat(f"up_{c}", c).alias(c) for c in arrays))
        now = written(now.where("done").unionByName(joined), "walks")
    rest = parts.select(F.col("part_id").alias("of"), *FIELDS).dropDuplicates(["of"])
    return now.where("done").join(shuffled(rest), F.col("part_id") == F.col("of")).select(F.col("top").alias("tree_id"), "part_id", "parent_id", "lvl", *arrays, *FIELDS)


def product_trees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The tree of each product: the part that is its root (the one column of ``roots``), with all below it, a tree_id of its own.

    A sub-part that is a product too is in the trees of both, so its parts come twice. Of
    a root that is in several places the highest one is taken, then the least; what is
    below it is alike everywhere, unless it has a tree of its own, which is that place.
    """
    own = roots.select(F.col(roots.columns[0]).alias("product")).distinct()
    places = nodes.join(own, F.col("part_id") == F.col("product")).groupBy("product").agg(F.min(F.struct("lvl", "tree_id", "path")).alias("at"))
    places = places.select("product", F.col("at.lvl").alias("up"), F.col("at.tree_id").alias("in_tree"), F.col("at.path").alias("over"))
    above = nodes.select("*", F.explode("path").alias("above"))
    below = shuffled(above).join(places, (F.col("above") == F.col("product")) & (F.col("tree_id") == F.col("in_tree")) & (F.slice("path", 1, F.size("over")) == F.col("over")))
    cut = lambda c: F.slice(c, F.col("up") + 1, F.size(c)).alias(c)
    changed = {"tree_id": F.col("product").alias("tree_id"), "parent_id": F.when(F.col("lvl") > F.col("up"), F.col("parent_id")).alias("parent_id"), "lvl": (F.col("lvl") - F.col("up")).alias("lvl")}
    changed |= {c: cut(c) for c in ("path", "names", "ord_path")}
    return below.select(*(changed.get(c, F.col(c)) for c in nodes.columns))


def with_trees(instances: DataFrame) -> DataFrame:
    """Products with the tree they have (of_tree): their own tree_id, or that of their root part."""
    return instances.withColumn("of_tree", F.col("tree_id" if "tree_id" in instances.columns else "root_part_id"))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "part_id", "lvl", F.array_join("names", ARROW).alias("breadcrumb"))


def _key(nodes: DataFrame) -> str:
    """What names a place in a tree: where the part is among its siblings, if known, else its ids from the root."""
    return "ord_path" if "ord_path" in nodes.columns else "path"


def subtree_sums(nodes: DataFrame, **values: Column) -> DataFrame:
    """tree_id, part_id and the sum of each value over a part's subtree, itself included; a part that is in several places of its tree has one row for each.

    By pointer doubling: what has been summed up to 2 ** k levels down is added to the
    ancestor 2 ** k levels up, in as many rounds as the depth has binary digits, so
    no part is repeated for each of its ancestors.
    """
    by_path = "path" in nodes.columns
    key = F.col(_key(nodes)) if by_path else F.col("part_id")
    up = F.when(F.col("lvl") > 0, F.expr(f"slice({_key(nodes)}, 1, size({_key(nodes)}) - 1)") if by_path else F.col("parent_id"))
    now = written(nodes.select("tree_id", "part_id", key.alias("place"), up.alias("up"), *(x.cast("bigint").alias(c) for c, x in values.items())), "sums")
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy(F.col("tree_id").alias("bt"), F.col("up").alias("bp")).agg(*(F.sum(c).alias(f"more_{c}") for c in values))
        higher = now.select(F.col("tree_id").alias("ht"), F.col("place").alias("hp"), F.col("up").alias("next_up"))
        added = now.join(shuffled(below), (F.col("tree_id") == F.col("bt")) & (F.col("place") == F.col("bp")), "left").join(shuffled(higher), (F.col("tree_id") == F.col("ht")) & (F.col("up") == F.col("hp")), "left")
        now = written(added.select("tree_id", "part_id", "place", F.col("next_up").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in values)), "sums")
    return now.select("tree_id", "part_id", *values)


def first_visits(rows: DataFrame, visit: str) -> DataFrame:
    """Rows of the first visit of each part of a product; ``visit`` says where the part is and orders like the walk.

    A path of places among siblings is a walk from the root, a level before it one level by level.
    """
    first = F.min(visit).over(Window.partitionBy("tree_id", "part_id"))
    return rows.withColumn("first_visit", first).where(F.col(visit) == F.col("first_visit")).drop("first_visit")


def find_part(nodes: DataFrame, part_id) -> DataFrame:
    """In each product the place of a part and its parent: of several the last one in a walk from the root, as a stack finds it."""
    found = nodes.where(F.col("part_id") == part_id)
    order = Window.partitionBy("tree_id").orderBy(F.desc("ord_path" if "ord_path" in nodes.columns else "path"))
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def picker_options(nodes: DataFrame) -> DataFrame:
    """What a part picker offers: every part of a product once, by label in the order of a reader (see ``ranks.reading_order``)."""
    once = nodes.groupBy("tree_id", "part_id").agg(F.min(F.coalesce("name", F.col("part_id").cast("string"))).alias("label"))
    return ranked(once, [reading_order(F.col("label")), "part_id"], ["tree_id"])


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """For every part of a tree: parts, failing parts and modular parts in its subtree, itself included. Of a part in several places of its tree the subtrees are alike."""
    counts = subtree_sums(nodes, n_parts=F.lit(1), n_fail=F.coalesce("has_failstate", F.lit(False)), n_modular=F.coalesce("is_modular", F.lit(False)))
    return counts.groupBy("tree_id", "part_id").agg(*(F.max(c).alias(c) for c in ("n_parts", "n_fail", "n_modular")))


def direct_children(nodes: DataFrame) -> DataFrame:
    """Children of each part of a tree by name, a missing name first; of a part in several places once."""
    order = Window.partitionBy("tree_id", "parent_id").orderBy(reading_order(F.coalesce("name", F.lit(""))), "part_id")
    once = nodes.where(F.col("parent_id").isNotNull()).select("tree_id", "parent_id", "part_id", "name", "is_modular", "has_failstate").distinct()
    return once.withColumn("pos", F.row_number().over(order))


def first_level(nodes: DataFrame) -> DataFrame:
    return nodes.where("lvl = 1").select("tree_id", "part_id", "name", "is_modular", "has_failstate")


def failing_parts(nodes: DataFrame) -> DataFrame:
    """Failing parts with their breadcrumbs; paths in array order are the order of a walk from the root."""
    return nodes.where("has_failstate").select("tree_id", "part_id", "name", F.array_join("names", ARROW).alias("breadcrumb"), F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Per tree: all parts, failing parts in all of it, and failing among root and first level."""
    return nodes.groupBy("tree_id").agg(
        F.count("*").alias("n_parts"), F.count_if("has_failstate").alias("n_fail"), F.count_if(F.col("has_failstate") & (F.col("lvl") <= 1)).alias("n_top_fail"),
        F.count_if("is_modular").alias("n_modular"), F.max("lvl").alias("depth"), F.greatest(F.lit(0), F.count("*") - F.count_if("has_failstate")).alias("n_healthy"),
    )


def positions(rows: DataFrame, order: list, bucket: list) -> DataFrame:
    """Adds ``pos``, the place of each row of a tree in ``order``, from 1.

    ``bucket`` orders alike but more coarsely. Rows are ranked within their bucket, and
    buckets, of which there are few, within the tree, so no task sorts a whole tree.
    """
    names = [f"bucket_{k}" for k in range(len(bucket))]
    cut = rows.withColumns(dict(zip(names, bucket, strict=True)))
    before = Window.partitionBy("of_tree").orderBy(*(f"of_{n}" for n in names)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col("tree_id").alias("of_tree"), *(F.col(n).alias(f"of_{n}") for n in names)).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = cut.withColumn("pos", F.row_number().over(Window.partitionBy("tree_id", *names).orderBy(*order)))
    joined = ranked.join(sizes, [F.col("tree_id") == F.col("of_tree"), *(F.col(n) == F.col(f"of_{n}") for n in names)])
    return joined.withColumn("pos", (F.col("pos") + F.col("before")).cast("int")).drop("of_tree", "before", *names, *(f"of_{n}" for n in names))


#: A tree's parts are ranked by the first so many parts of their paths, then within these.
PREFIX = 3


def expanded(nodes: DataFrame, cap: int = 2000) -> DataFrame:
    """The first parts of each tree that a view opens, level by level, up to its cap (a feature of that view)."""
    ranked = positions(nodes.select("tree_id", "part_id", "lvl", "path"), ["lvl", "path"], [F.col("lvl"), F.slice("path", 1, PREFIX)])
    return ranked.where(F.col("pos") <= cap).select("tree_id", "part_id", "lvl", "pos")


def layout(nodes: DataFrame) -> DataFrame:
    """Rows of a drawn tree: leaves one below the other in walking order, a parent midway between its first and last leaf."""
    place = _key(nodes)
    parents = nodes.where("lvl > 0").select(F.col("tree_id").alias("pt"), F.expr(f"slice({place}, 1, size({place}) - 1)").alias("has_child")).distinct()
    leaves = nodes.join(shuffled(parents), (F.col("tree_id") == F.col("pt")) & (F.col(place) == F.col("has_child")), "left_anti")
    rows = positions(leaves.select("tree_id", place), [place], [F.slice(place, 1, PREFIX)]).withColumnRenamed("pos", "row")
    above = rows.select("tree_id", "row", F.explode(F.transform(F.sequence(F.lit(1), F.size(place)), lambda n: F.slice(place, 1, n))).alias("at"))
    ends = above.groupBy(F.col("tree_id").alias("lt"), "at").agg(((F.min("row") + F.max("row")) / 2.0).alias("y"))
    return nodes.select("tree_id", "part_id", F.col(place).alias("here")).join(shuffled(ends), (F.col("tree_id") == F.col("lt")) & (F.col("here") == F.col("at"))).select("tree_id", "part_id", "y")


def linked_passports(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parts below a product's root that are the root of another product; of several, the least. A part in several places is one link."""
    below = nodes.where("lvl > 0").select("tree_id", "part_id", F.col("name").alias("part_name")).distinct()
    roots = instances.groupBy(F.col("root_part_id").alias("linked_part")).agg(F.min("instance_id").alias("linked_id"))
    # Links are found once for a tree, not for each of its products, which would meet all of its parts.
    links = below.join(roots, F.col("part_id") == F.col("linked_part"))
    found = with_trees(instances).select("instance_id", "of_tree").join(links, F.col("of_tree") == F.col("tree_id"))
    return found.where("linked_id <> instance_id").select("instance_id", "part_id", "part_name", "linked_id")
