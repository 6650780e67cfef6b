"""Changes to products, as functions from tables and a table of commands to tables.

Each takes commands for many products at once, and gives the changed table and, where
a command can fail, the commands that did with a reason. Nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import shuffled, written
from .command_log import outcome


def _known(commands: DataFrame, parts: DataFrame, target: str) -> DataFrame:
    keys = parts.select(F.col("tree_id").alias("kt"), F.col("part_id").alias("kp")).distinct()
    return commands.join(keys, (F.col("tree_id") == F.col("kt")) & (F.col(target) == F.col("kp")), "left").withColumn("known", F.col("kp").isNotNull()).drop("kt", "kp")


def toggle_failstate(parts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commands``: tree_id and part_id. A part named an odd number of times changes its state; unknown parts fail."""
    times = commands.groupBy(F.col("tree_id").alias("ct"), F.col("part_id").alias("cp")).agg((F.count("*") % 2 == 1).alias("turn"))
    joined = parts.join(times, (F.col("tree_id") == F.col("ct")) & (F.col("part_id") == F.col("cp")), "left")
    changed = joined.withColumn("has_failstate", F.when(F.col("turn"), ~F.col("has_failstate")).otherwise(F.col("has_failstate"))).drop("ct", "cp", "turn")
    failed = _known(commands, parts, "part_id").where("NOT known").select("tree_id", "part_id", F.lit("no such part").alias("reason"))
    return changed, failed


def append_steps(steps: DataFrame, new: DataFrame, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds service steps to products. With ``parts`` a step fails if one of its targets is not in the product (cleaning steps are not checked)."""
    if parts is None:
        return steps.unionByName(new, allowMissingColumns=True), new.limit(0).withColumn("reason", F.lit(""))
    targets = new.where(F.col("type") != "CleaningServiceStep").select("event_id", "tree_id", F.explode("target_ids").alias("target"))
    lost = _known(targets, parts, "target").where("NOT known").select(F.col("event_id").alias("lost_id")).distinct()
    good = new.join(lost, F.col("event_id") == F.col("lost_id"), "left_anti")
    failed = new.join(lost, F.col("event_id") == F.col("lost_id"), "left_semi").withColumn("reason", F.lit("a target is not in the product"))
    return steps.unionByName(good, allowMissingColumns=True), failed


def recycle(instances: DataFrame, steps: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adds recycling steps and ends their products: (instances, steps, failed). Steps of products that are not there fail."""
    there = instances.select(F.col("instance_id").alias("there")).distinct()
    good = new.join(there, F.col("instance_id") == F.col("there"), "left_semi")
    failed = new.join(there, F.col("instance_id") == F.col("there"), "left_anti").withColumn("reason", F.lit("no such product"))
    ended = new.select(F.col("instance_id").alias("ended")).distinct()
    joined = instances.join(ended, F.col("instance_id") == F.col("ended"), "left")
    return joined.withColumn("discontinued", F.col("discontinued") | F.col("ended").isNotNull()).drop("ended"), steps.unionByName(good, allowMissingColumns=True), failed


def _timed(commands: DataFrame, *seq: str) -> DataFrame:
    """Commands with t, their time: by ``seq``, then by the parts they name. Commands that are alike in all of it are one."""
    return commands.withColumn("t", F.struct(*seq, "old_id", "new_id")).dropDuplicates(["tree_id", "t"])


def _split(states: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = states.where("gone_at IS NULL").select(*columns)
    return kept, states.where("gone_at IS NOT NULL").select(*columns, F.col("gone_with").alias("detached_with"))


def _columns(nodes: DataFrame, new_nodes: DataFrame) -> list[str]:
    return [*nodes.columns, *(c for c in new_nodes.columns if c not in (*nodes.columns, "new_id"))]


def replace_parts(nodes: DataFrame, commands: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Swaps subtrees, a product's commands one after another: (nodes, detached, failed).

    ``nodes``: tree_id, part_id, parent_id, path (ids from the root) and more.
    ``commands``: tree_id, old_id, new_id and seq, the order within a product (without it
    old_id is). ``new_nodes``: new_id (the new subtree's root), part_id, parent_id, path
    (from that root) and the same other columns.

    What goes is the old part with all below it at that time; it is kept in
    ``detached`` with detached_with, the part it went with. A command may name a part
    that an earlier one put in. Root parts and unknown parts fail, and so does a part that
    an earlier command has taken out, or that was to be put in by one that failed.
    """
    states, told = outcome(nodes, _timed(commands, *(["seq"] if "seq" in commands.columns else [])), new_nodes)
    kept, detached = _split(states, _columns(nodes, new_nodes))
    return kept, detached, told.where("NOT done").select("tree_id", "old_id", "reason")


def replace_with_steps(nodes: DataFrame, steps: DataFrame, commands: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``replace_parts``, and the step of each command that did not fail is added: (nodes, steps, detached, failed).

    ``commands`` also have the columns of ``steps`` that a step fills.
    """
    states, told = outcome(nodes, _timed(commands, *(["seq"] if "seq" in commands.columns else [])), new_nodes)
    kept, detached = _split(states, _columns(nodes, new_nodes))
    good = told.where("done").select(*(c for c in commands.columns if c in steps.columns))
    return kept, steps.unionByName(good, allowMissingColumns=True), detached, told.where("NOT done").select("tree_id", "old_id", "reason")


def rework(nodes: DataFrame, steps: DataFrame, new: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remanufacturing and refurbishment steps: (nodes, steps, detached, failed).

    ``new``: event_id, tree_id, repaired_ids, cleaned_ids, pairs (old_id and new_id, in
    order) and the columns of ``steps``. A product's steps are done one after another, by
    seq if there is one, else by event_id. Repaired and cleaned parts must be in the product
    when the step's turn comes, then pairs are swapped in order. A step one of whose parts
    is missing changes nothing and is not added; later steps do not see it.

    In each round the first step that fails in a product is left out, as those before it
    are known to work; products are worked on together, so there are as many rounds as one
    product has steps that fail, and one more.
    """
    turn = F.col("seq") if "seq" in new.columns else F.col("event_id")
    looked_for = F.array_distinct(F.concat(F.coalesce("repaired_ids", F.array()), F.coalesce("cleaned_ids", F.array())))
    swapped = new.select("event_id", "tree_id", turn.alias("turn"), F.posexplode("pairs").alias("nth", "pair")).select("event_id", "tree_id", "turn", F.lit(1).alias("phase"), "nth", "pair.old_id", "pair.new_id")
    asked = new.select("event_id", "tree_id", turn.alias("turn"), F.lit(0).alias("phase"), F.posexplode(looked_for).alias("nth", "old_id")).withColumn("new_id", F.lit(None).cast(swapped.schema["new_id"].dataType))
    log = written(_timed(asked.unionByName(swapped), "turn", "event_id", "phase", "nth"), "rework")
    failed = None
    while True:
        left = log if failed is None else log.join(failed.select(F.col("event_id").alias("lost")), F.col("event_id") == F.col("lost"), "left_anti")
        states, told = outcome(nodes, left, new_nodes)
        first = told.where("NOT done").groupBy("tree_id").agg(F.min(F.struct("t", "event_id", "reason")).alias("f")).select("f.event_id", "tree_id", "f.reason")
        first = written(first, "failed")
        if first.isEmpty():
            break
        failed = first if failed is None else failed.unionByName(first)
    kept, detached = _split(states, _columns(nodes, new_nodes))
    failed = first if failed is None else failed
    good = new.join(failed.select(F.col("event_id").alias("lost")), F.col("event_id") == F.col("lost"), "left_anti")
    return kept, steps.unionByName(good.select(*(c for c in good.columns if c in steps.columns)), allowMissingColumns=True), detached, failed


def add_links(lines: DataFrame, column: str, commands: DataFrame, distinct: bool) -> tuple[DataFrame, DataFrame]:
    """Appends ids to a list of each line, in the order of ``seq`` if commands have one, else of the ids.

    Spare parts: ``distinct``, an id already there fails; returning places: twice is fine.
    """
    seq = F.col("seq") if "seq" in commands.columns else F.col("link")
    asked = commands.select(F.col("static_id").alias("of"), "link", seq.alias("seq")).withColumn("nth", F.row_number().over(Window.partitionBy("of", "link").orderBy("seq")))
    present = lines.select(F.col("static_id").alias("at"), F.explode(column).alias("has")).distinct()
    judged = asked.join(present, (F.col("of") == F.col("at")) & (F.col("link") == F.col("has")), "left")
    clash = (F.col("has").isNotNull() | (F.col("nth") > 1)) if distinct else F.lit(False)
    new = judged.where(~clash).groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "link"))), lambda x: x["link"]).alias("new_links"))
    failed = judged.where(clash).select(F.col("of").alias("static_id"), "link", F.lit("already there").alias("reason"))
    joined = lines.join(new, F.col("static_id") == F.col("of"), "left")
    return joined.withColumn(column, F.when(F.col("of").isNull(), F.col(column)).otherwise(F.concat(F.coalesce(column, F.array()), "new_links"))).drop("of", "new_links"), failed


def add_returning_places(lines: DataFrame, places: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends places to the lines' lists, and those that are not known yet to the places: (lines, places).

    ``commands``: static_id, the columns of a place, and seq.
    """
    changed, _ = add_links(lines, "returning_place_ids", commands.select("static_id", F.col("place_id").alias("link"), "seq"), distinct=False)
    new = commands.join(places.select(F.col("place_id").alias("known")), F.col("place_id") == F.col("known"), "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("place_id").orderBy("seq", "static_id"))).where("nth = 1")
    return changed, places.unionByName(new.select(*(c for c in places.columns if c in commands.columns)), allowMissingColumns=True)


def add_materials(uses: DataFrame, new: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds uses of materials to parts; those of unknown parts fail."""
    judged = _known(new, parts, "part_id")
    return uses.unionByName(judged.where("known").drop("known"), allowMissingColumns=True), judged.where("NOT known").drop("known").withColumn("reason", F.lit("no such part"))


def graft(nodes: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts copies of subtrees into trees: (nodes, failed).

    ``commands``: tree_id and parent_id, where to; from_tree and child_id, what. A child
    comes with all below it, under every place of the parent. Commands look at the trees
    as they are before any of them, so their order plays no part, and alike ones are one.
    Parents and children must be known; a child must not be there already, and no part may
    come to be below itself: that fails if the parent, or a part above it, is in what is
    to be copied.
    """
    asked = commands.select("tree_id", "parent_id", "from_tree", "child_id").distinct()
    keys = ["tree_id", "parent_id", "from_tree", "child_id"]
    parents = nodes.select(F.col("tree_id").alias("pt"), F.col("part_id").alias("pp"), F.col("path").alias("parent_path"))
    under = asked.join(parents, (F.col("tree_id") == F.col("pt")) & (F.col("parent_id") == F.col("pp")), "left").drop("pt", "pp")
    first = nodes.groupBy(F.col("tree_id").alias("ft"), F.col("part_id").alias("fp")).agg(F.min("path").alias("child_path"))
    found = under.join(first, (F.col("from_tree") == F.col("ft")) & (F.col("child_id") == F.col("fp")), "left").drop("ft", "fp")
    links = nodes.where("parent_id IS NOT NULL").select(F.col("tree_id").alias("lt"), F.col("parent_id").alias("lp"), F.col("part_id").alias("lc")).distinct()
    found = written(found.join(links, (F.col("tree_id") == F.col("lt")) & (F.col("parent_id") == F.col("lp")) & (F.col("child_id") == F.col("lc")), "left").withColumn("linked", F.col("lc").isNotNull()).drop("lt", "lp", "lc"), "graft")
    places = found.where("parent_path IS NOT NULL AND child_path IS NOT NULL AND NOT linked").select(*(F.col(k).alias(f"c_{k}") for k in keys), "parent_path", "child_path")
    # Loops are found before anything is copied: a part at or above the parent whose path goes through the child's place. A refused child may be the root of all.
    over = places.select(*(f"c_{k}" for k in keys), "child_path", F.explode("parent_path").alias("at_or_above"))
    inside = nodes.select(F.col("tree_id").alias("it"), F.col("part_id").alias("ip"), F.col("path").alias("inner_path"))
    met = over.join(shuffled(inside), (F.col("c_from_tree") == F.col("it")) & (F.col("at_or_above") == F.col("ip")) & (F.slice("inner_path", 1, F.size("child_path")) == F.col("child_path")))
    loops = written(met.select(*(f"c_{k}" for k in keys)).distinct(), "graft")
    good = places.join(loops.withColumnsRenamed({f"c_{k}": f"x_{k}" for k in keys}), [F.col(f"c_{k}") == F.col(f"x_{k}") for k in keys], "left_anti")
    # What is copied: the rows whose path goes through the child's place.
    above = nodes.withColumn("over", F.explode("path"))
    through = (F.col("over") == F.col("c_child_id")) & (F.col("tree_id") == F.col("c_from_tree")) & (F.slice("path", 1, F.size("child_path")) == F.col("child_path"))
    copied = shuffled(above).join(good, through).drop("over")
    same = [F.col(f"c_{k}") == F.col(k) for k in keys]
    path = F.concat("parent_path", F.slice("path", F.size("child_path"), F.size("path")))
    changed = {"tree_id": F.col("c_tree_id"), "parent_id": F.when(F.size("path") == F.size("child_path"), F.col("c_parent_id")).otherwise(F.col("parent_id")), "path": path, "lvl": F.size(path) - 1}
    new = copied.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in nodes.columns))
    told = found.join(loops, same, "left").withColumn("loops", F.col("c_child_id").isNotNull())
    reason = F.when(F.col("parent_path").isNull() | F.col("child_path").isNull(), "no such part").when(F.col("linked"), "already a child").when(F.col("loops"), "would be below itself")
    return nodes.unionByName(new), told.select(*keys, reason.alias("reason")).where("reason IS NOT NULL").distinct()


def attach_children(parts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commands``: parent_id and child_id. Children must exist, and not be there already; parts is part_id and parent_id."""
    known = parts.select(F.col("part_id").alias("kp")).distinct()
    links = parts.where(F.col("parent_id").isNotNull()).select(F.col("part_id").alias("lc"), F.col("parent_id").alias("lp")).distinct()
    judged = commands.join(known, F.col("child_id") == F.col("kp"), "left").join(links, (F.col("child_id") == F.col("lc")) & (F.col("parent_id") == F.col("lp")), "left")
    reason = F.when(F.col("kp").isNull(), "no such part").when(F.col("lc").isNotNull(), "already a child")
    new = judged.where(reason.isNull()).select(F.col("child_id").alias("part_id"), "parent_id")
    copies = new.join(parts.drop("parent_id").dropDuplicates(["part_id"]), "part_id")
    return parts.unionByName(copies, allowMissingColumns=True), judged.where(reason.isNotNull()).select("parent_id", "child_id", reason.alias("reason"))
