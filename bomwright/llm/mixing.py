"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words. A source with target ``t`` and size ``s`` is
wanted ``t / s`` times. The whole part of that is given to every document of the source
(certain copies). The words that are then missing are drawn as an order sample with
unequal inclusion probabilities: a document's probability ``p`` is in proportion to its
weight, at most 1, with the factor for which the expected words are the missing ones. It
is found by taking documents out, heaviest weight first, as long as they would reach 1;
those are certain to get one more copy. The others are ranked by

    (u / (1 - u)) / (p / (1 - p))

with ``u`` a fixed uniform number of the document, and the first ones are taken until
the missing words are reached. The sample has a fixed size (in words, up to half of
the document at the cut). Reruns agree: ``u`` is a hash of id and text, so that null and
repeated ids draw numbers of their own, and rows with one id and text are alike.

A document's weight, unless ``weight`` gives one, is about the square root of its size
(the power of two at or below it): longer documents are likelier, and a source's
weights are few.

No window runs over a source: ranks are cut into narrow bands whose sums are
added up first, so that only the band in which the cut falls is ordered in full.
The bands go to all tasks if they are few, so that documents stay where they are.

Sources, and the weights of each, are few: a window over one row for each runs in one
task.

Defined results: null text has size 0; a null source is a source of its own that
sorts last; null ids are ids like others; equal rows are ranked in any order, with
equal results; an empty table gives no rows; a source of size 0 takes nothing; other
columns, of any name, come along with ``carry`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, table, word_count

#: Bands a source's ranks are cut into for every so many documents.
ROWS_PER_BAND = 2_000
#: So many bands, a few dozen bytes each, are sent to all tasks; more are joined by a shuffle.
BROADCAST_BANDS = 50_000


def uniform(key: Column, text: Column, seed: int = 0) -> Column:
    """A fixed number strictly between 0 and 1 for an id and a text, by 52 bits of MD5."""
    of = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(of), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def root_of_size(size: Column) -> Column:
    """The power of two at or below the square root of a size, 1 at least."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), ((F.length(F.bin(F.greatest(size, F.lit(1)))) - 1) / 2).cast("int"))


def inclusion(classes: DataFrame) -> DataFrame:
    """Inclusion probability of each weight of a source.

    ``classes``: source, weight (decimal), words (of all its documents), missing (the
    source's words to draw). With all heavier weights taken out, those left share what
    is missing in proportion; the heaviest weight that stays below 1 sets the factor.
    """
    heavier = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    load = F.col("weight").cast("decimal(18,6)") * F.col("words").cast("decimal(18,0)")
    # Weights that draw nothing take no part.
    left = (
        classes.withColumn("certain", F.coalesce(F.sum("words").over(heavier), F.lit(0)))
        .withColumn("load", F.sum(load).over(lighter).cast("double"))
        .withColumn("factor", F.when(F.col("load") > 0, (F.col("missing") - F.col("certain")) / F.col("load")).otherwise(0.0))
        .withColumn("below", F.col("factor") * F.col("weight").cast("double") < 1)
    )
    first = F.max_by(F.when(F.col("below"), F.col("factor")), F.when(F.col("below"), F.col("weight"))).over(Window.partitionBy("source"))
    p = F.when(F.col("below"), F.greatest(F.lit(0.0), first * F.col("weight").cast("double"))).otherwise(1.0)
    return left.select("source", "weight", p.alias("p"))


def water_fill(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets by weight that stop at ``most`` times a source's size, the excess reshared by weight.

    ``sources`` has ``source`` and ``source_size``, one row each. A source stops at
    its limit if the level (words for each unit of weight) is above limit / weight;
    in that order, the sources before the last one that stops all stop. Every
    source stops if the limits do not sum to the share.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    limit = F.lit(most) * F.col("source_size")
    by_level = Window.orderBy("stops_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("limit", limit)
        .withColumn("stops_at", F.col("limit") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("weight_left"))
        # The level if this and all later sources do not stop; the first source for which it holds gives the level of all.
        .withColumn("holds", F.col("level") <= F.col("stops_at"))
        .withColumn("final", F.min(F.when(F.col("holds"), F.struct("stops_at", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("final").isNull() | (F.col("stops_at") < F.col("final")), F.col("limit")).otherwise(F.col("final") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def pareto_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 0, weight: Column | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, p, copies and taken.

    ``weight``: a document's weight in its source's sample, a number of few values (by
    default ``root_of_size``); none, or one below zero, draws nothing. With ``carry`` all
    columns of ``docs`` come along in a struct, ``carried``, as c0, c1 and so on.
    """
    carried = packed(docs.columns) if carry else F.lit(None).cast("struct<nothing:int>")
    counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), (F.lit(None) if weight is None else weight).cast("decimal(18,6)").alias("given"), carried.alias("carried"))
    own = root_of_size(F.col("size")).cast("decimal(18,6)") if weight is None else F.greatest(F.coalesce("given", F.lit(0)), F.lit(0)).cast("decimal(18,6)")
    sized = materialize(counted.withColumn("weight", F.when(F.col("size") > 0, own).otherwise(F.lit(0).cast("decimal(18,6)"))).drop("given"), "mix-sizes")
    # One row for each source and weight, written once: it is read several times below.
    classes = materialize(sized.groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    targets = water_fill(sources, share, most, weights).join(sources.select(F.col("source").alias("of"), "n_docs"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = targets.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(rate).alias("whole"), (F.col("target") - F.floor(rate) * F.col("source_size")).alias("missing"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_BAND)).alias("bands"),
    )
    planned = materialize(planned, "mix-targets")
    chances = inclusion(classes.join(planned.select("of", "missing"), F.col("source").eqNullSafe(F.col("of"))).select("source", "weight", "words", "missing"))
    with_chance = classes.select("source", "weight", "words").join(chances.select(F.col("source").alias("cs"), F.col("weight").alias("cw"), "p"), F.col("source").eqNullSafe(F.col("cs")) & (F.col("weight") == F.col("cw"))).drop("cs", "cw")
    certain = with_chance.where("p >= 1").groupBy(F.col("source").alias("cs")).agg(F.sum("words").alias("certain"))
    plans = (
        with_chance.join(planned, F.col("source").eqNullSafe(F.col("of"))).drop("of").join(certain, F.col("source").eqNullSafe(F.col("cs")), "left")
        .select(F.col("source").alias("of"), F.col("weight").alias("of_weight"), "p", "source_size", "target", "whole", "bands", (F.col("missing") - F.coalesce("certain", F.lit(0))).alias("missing"))
    )
    plans = materialize(plans, "mix-plans")
    odds = F.col("p") / (1 - F.col("p"))
    ranked = (
        sized.join(plans, F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("of_weight"))).drop("of", "of_weight")
        .withColumn("whole", F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0))
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("u") / (1 - F.col("u")) / odds))
        # rank / (1 + rank) is spread over 0 to 1 and grows with the rank.
        .withColumn("band", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bands")).cast("long"))
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    ranked = ranked.withColumn("of", key)
    up_to = Window.partitionBy("of").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        ranked.where(F.col("rank").isNotNull()).groupBy("of", "band").agg(F.sum("size").alias("in_band"), F.first("missing").alias("missing"))
        .withColumn("before", F.coalesce(F.sum("in_band").over(up_to), F.lit(0)))
        .select(F.col("of").alias("band_of"), F.col("band").alias("band_no"), "before",
                # 1: all of the band is taken, 0: none, null: the cut may fall into it
                F.when(F.col("before") + F.col("in_band") <= F.col("missing"), 1).when(F.col("before") > F.col("missing"), 0).alias("whole_band"))
    )
    # One number comes to the driver.
    n_bands = planned.agg(F.sum("bands")).first()[0] or 0
    bands = F.broadcast(bands) if n_bands <= BROADCAST_BANDS else bands
    joined = ranked.join(bands, (F.col("of") == F.col("band_of")) & (F.col("band") == F.col("band_no")), "left")
    settled = joined.where(F.col("rank").isNull() | F.col("whole_band").isNotNull()).withColumn("extra", F.coalesce("whole_band", F.lit(0)))
    in_order = Window.partitionBy("of", "band").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    words_before = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    at_cut = joined.where(F.col("rank").isNotNull() & F.col("whole_band").isNull()).withColumn("extra", (words_before + F.col("size") / 2 <= F.col("missing")).cast("int"))
    out = ["carried", "doc_id", "source", "size", "source_size", "target", "p", (F.col("whole") + F.col("extra")).alias("copies"), ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken")]
    mixed = settled.select(*out).unionByName(at_cut.select(*out))
    return mixed if carry else mixed.drop("carried")


def op2(spark, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double"), F.col("taken").cast("long"), F.col("copies").cast("long"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS text_md5 FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS lim, (2.0::DOUBLE * source_size) / weight AS stops_at,
         1.5::DOUBLE * sum(source_size) OVER () AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS stopped
  FROM sources
  WINDOW w AS (ORDER BY (2.0::DOUBLE * source_size) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT (total - stopped) / weight_left AS level FROM levels
  WHERE (total - stopped) / weight_left <= stops_at ORDER BY stops_at, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN f.level IS NULL OR stops_at < f.level THEN lim ELSE f.level * weight END AS target
  FROM levels LEFT JOIN final f ON true
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), classed AS (
  SELECT *, CASE WHEN size > 0 THEN (1 << ((length(bin(size)) - 1) // 2)::INT)::BIGINT ELSE 0 END AS weight FROM sized
), classes AS (
  SELECT c.source, c.weight, sum(c.size)::BIGINT AS words, any_value(p.target - floor(p.rate) * p.source_size) AS missing
  FROM classed c JOIN plans p ON c.source IS NOT DISTINCT FROM p.source GROUP BY c.source, c.weight
), loads AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
         sum(weight * words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS load
  FROM classes
), factors AS (
  SELECT *, CASE WHEN load > 0 THEN (missing - certain) / load ELSE 0 END AS factor, CASE WHEN load > 0 THEN (missing - certain) / load ELSE 0 END * weight < 1 AS below FROM loads
), chances AS (
  SELECT source, weight, words,
         CASE WHEN below THEN greatest(0.0::DOUBLE, max_by(factor, weight) FILTER (below) OVER (PARTITION BY source) * weight) ELSE 1 END AS p
  FROM factors
), certain AS (
  SELECT source, sum(words) AS words FROM chances WHERE p >= 1 GROUP BY source
), ranked AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, c.p, floor(p.rate)::BIGINT + CASE WHEN c.p >= 1 THEN 1 ELSE 0 END AS whole,
         p.target - floor(p.rate) * p.source_size - coalesce(t.words, 0) AS missing,
         (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':0:' || s.text_md5), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM classed s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND s.weight = c.weight
       LEFT JOIN certain t ON s.source IS NOT DISTINCT FROM t.source
), ordered AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM ranked
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered
), counted AS (
  SELECT *, whole + CASE WHEN rank IS NOT NULL AND before + size / 2.0 <= missing THEN 1 ELSE 0 END AS copies FROM summed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
"""
