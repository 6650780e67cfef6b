"""What a log of replacements comes to, when a later one may name a part that an earlier one put in.

Each command has a time, and takes out a part with all below it and puts a new subtree
where the part was. All places that parts may ever have are worked out first: those of
the trees as they were, and those in the new subtree of each command for each place its
target may have, round by round while commands find targets among the places of the
round before. A place is named by the parts on its path and the times they were put in.

A command then does nothing if its target's place was put in by a command that does
nothing, or if an earlier command has taken out the target or a part above it. Whether
that one was itself in vain need not be known: if so, a still earlier one took out its
target or a part above it, which is above this target too. So commands are judged in
one pass, however many they are; rounds are as many as replacements of replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import written


def _key(part: Column, born: Column) -> Column:
    """A part's name on a path: its id, and when it was put in."""
    return F.concat(part.cast("string"), F.lit("@"), F.coalesce(F.to_json(born), F.lit("")))


def places(nodes: DataFrame, commands: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All places of parts, and all pairs of a command and a place of its target.

    ``nodes`` and ``new_nodes`` as in ``mutations.replace_parts``; ``commands``: tree_id,
    old_id, new_id and t, a struct that orders the commands of a tree. Places: the columns of nodes with spot (the names on the
    path), born (the time, null for what was there) and since (the pairs that put it in,
    outermost first). Pairs: tree_id, t, old_id, new_id, spot, born, since, is_root.
    """
    order = commands.schema["t"].dataType
    log = commands.select(F.col("tree_id").alias("ct"), "t", "old_id", "new_id")
    pair_type = "array<string>"
    here = nodes.withColumns({"born": F.lit(None).cast(order), "since": F.array().cast(pair_type)}).withColumn("spot", F.transform("path", lambda p: F.concat(p.cast("string"), F.lit("@"))))
    here, all_places, all_pairs = written(here, "places"), None, None
    while True:
        all_places = here if all_places is None else all_places.unionByName(here, allowMissingColumns=True)
        hit = log.join(here.select("tree_id", "part_id", "parent_id", "path", "spot", "born", "since"), (F.col("ct") == F.col("tree_id")) & (F.col("old_id") == F.col("part_id")))
        hit = hit.where(F.col("born").isNull() | (F.col("born") < F.col("t")))
        pairs = written(hit.select("tree_id", "t", "old_id", "new_id", "spot", "born", "since", F.col("parent_id").isNull().alias("is_root"), F.col("parent_id").alias("old_parent"), F.col("path").alias("old_path")), "pairs")
        all_pairs = pairs if all_pairs is None else all_pairs.unionByName(pairs)
        fits = pairs.where("NOT is_root AND new_id IS NOT NULL")
        if fits.isEmpty():
            return all_places, all_pairs
        put = fits.select(F.col("tree_id").alias("of_tree"), F.col("t").alias("put_at"), F.col("new_id").alias("put"), "old_parent", "old_path", F.col("spot").alias("old_spot"), F.col("since").alias("old_since"))
        fresh = put.join(new_nodes.withColumnRenamed("new_id", "of_new"), F.col("put") == F.col("of_new"))
        above = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
        made = {
            "tree_id": F.col("of_tree"), "parent_id": F.when(F.size("path") == 1, F.col("old_parent")).otherwise(F.col("parent_id")),
            "spot": F.concat(above("old_spot"), F.transform("path", lambda p: _key(p, F.col("put_at")))), "path": F.concat(above("old_path"), F.col("path")),
            "born": F.col("put_at"), "since": F.concat("old_since", F.array(pair_name(F.col("put_at"), F.col("old_spot")))),
        }
        fresh = fresh.withColumns(made)
        if "lvl" in nodes.columns:
            fresh = fresh.withColumn("lvl", F.size("path") - 1)
        here = written(fresh.drop("of_tree", "put_at", "put", "of_new", "old_parent", "old_path", "old_spot", "old_since"), "places")


def pair_name(t: Column, spot: Column) -> Column:
    return F.concat(F.to_json(t), F.lit(" "), F.array_join(spot, "/"))


def judged(pairs: DataFrame) -> DataFrame:
    """``pairs`` with works: whether the command finds its target at that place when its time comes."""
    kills = pairs.where("NOT is_root AND new_id IS NOT NULL").groupBy(F.col("tree_id").alias("kt"), F.element_at("spot", -1).alias("killed"), F.col("spot").alias("kill_spot")).agg(F.min("t").alias("first_kill"))
    named = pairs.withColumn("pair", pair_name(F.col("t"), F.col("spot")))
    above = named.select("tree_id", "pair", "t", F.explode(F.transform(F.sequence(F.lit(1), F.size("spot")), lambda n: F.slice("spot", 1, n))).alias("over"))
    gone = above.join(kills, (F.col("tree_id") == F.col("kt")) & (F.col("over") == F.col("kill_spot"))).where("first_kill < t").select(F.col("tree_id").alias("gt"), F.col("pair").alias("lost")).distinct()
    gone = written(gone, "lost")
    links = named.select("tree_id", "pair", F.explode(F.concat("since", F.array("pair"))).alias("link"))
    vain = links.join(gone, (F.col("tree_id") == F.col("gt")) & (F.col("link") == F.col("lost")), "left_semi").select(F.col("tree_id").alias("vt"), F.col("pair").alias("vain")).distinct()
    return named.join(vain, (F.col("tree_id") == F.col("vt")) & (F.col("pair") == F.col("vain")), "left").withColumn("works", F.col("vain").isNull()).drop("vt", "vain")


def outcome(nodes: DataFrame, commands: DataFrame, new_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places that came to be, with gone_at and gone_with (when and with which part they went; null for what stays), and the commands with done and reason."""
    where, pairs = places(nodes, commands, new_nodes)
    known = written(judged(pairs), "judged")
    done = known.where("works AND NOT is_root")
    took = done.where("new_id IS NOT NULL").select(F.col("tree_id").alias("dt"), F.col("spot").alias("taken"), F.col("t").alias("at"), "old_id")
    rows = where.withColumn("row", F.concat_ws("/", "spot"))
    above = rows.select("tree_id", "row", F.explode(F.transform(F.sequence(F.lit(1), F.size("spot")), lambda n: F.slice("spot", 1, n))).alias("over"))
    ends = above.join(took, (F.col("tree_id") == F.col("dt")) & (F.col("over") == F.col("taken"))).groupBy(F.col("tree_id").alias("et"), F.col("row").alias("ended")).agg(F.min("at").alias("gone_at"), F.min_by("old_id", "at").alias("gone_with"))
    works = done.select(F.col("tree_id").alias("wt"), F.col("pair").alias("working")).distinct()
    born = rows.withColumn("put_by", F.element_at(F.when(F.size("since") > 0, F.col("since")), -1)).join(works, (F.col("tree_id") == F.col("wt")) & (F.col("put_by") == F.col("working")), "left")
    real = born.where("put_by IS NULL OR working IS NOT NULL").join(ends, (F.col("tree_id") == F.col("et")) & (F.col("row") == F.col("ended")), "left")
    states = real.drop("row", "put_by", "wt", "working", "et", "ended", "spot", "since", "born")
    best = known.groupBy(F.col("tree_id").alias("bt"), F.col("t").alias("bn")).agg(F.bool_or(F.col("works") & ~F.col("is_root")).alias("found"), F.bool_or(F.col("works") & F.col("is_root")).alias("at_root"))
    told = commands.join(best, (F.col("tree_id") == F.col("bt")) & (F.col("t") == F.col("bn")), "left").drop("bt", "bn")
    reason = F.when(F.coalesce("at_root", F.lit(False)), "root cannot be replaced").otherwise("no such part")
    # A part that is only looked for may be the root.
    good = F.coalesce("found", F.lit(False)) | (F.col("new_id").isNull() & F.coalesce("at_root", F.lit(False)))
    return states, told.withColumn("done", good).withColumn("reason", F.when(~F.col("done"), reason)).drop("found", "at_root")
