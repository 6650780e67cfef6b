"""Process steps and emissions: counts by category, distances, greenhouse gases, and the map of places.

All results are for every product at once, keyed by tree_id. Where two figures of
one name differ (rounding, what is counted once, what is zero-filled), both are here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sum
from ..functions.scalars import classify_step, map_category, rounded
from .trees import first_visits

#: Fixed values.
CATEGORIES = ("transport", "production", "secondary")
SCOPES = ("Scope 1", "Scope 2", "Scope 3")
#: What makes two emission records of one step the same.
SAME_RECORD = ["tree_id", "step_key", "scope", "category", "quantity", "factor", "kg", "method"]


def _counts() -> list[Column]:
    kind = classify_step(F.col("type"))
    return [*(F.count_if(kind == c).alias(c) for c in CATEGORIES), F.count("*").alias("total")]


def _km() -> list[Column]:
    km = lambda owner: F.coalesce(exact_sum(F.when(F.col("owner_kind") == owner, F.col("distance_km"))), F.lit(0.0))
    return [km("part").alias("p"), km("material").alias("m")]


def _rounded_km() -> list[Column]:
    return [rounded(F.col("p"), 3).alias("parts_km"), rounded(F.col("m"), 3).alias("materials_km"), rounded(F.col("p") + F.col("m"), 3).alias("total_km")]


def category_counts(steps: DataFrame) -> DataFrame:
    """Steps of parts and materials by the category that their type's name suggests."""
    return steps.groupBy("tree_id").agg(*_counts())


def transport_km(steps: DataFrame, transports_only: bool = False) -> DataFrame:
    """Distances of parts, materials and both, to three places; of any step that has one, or of transports only."""
    rows = steps.where(F.col("type") == "TransportStep") if transports_only else steps
    return rows.groupBy("tree_id").agg(*_km()).select("tree_id", *_rounded_km())


def counts_and_km(steps: DataFrame) -> DataFrame:
    """``category_counts`` and ``transport_km`` of any step in one pass over the steps."""
    return steps.groupBy("tree_id").agg(*_counts(), *_km()).select("tree_id", *CATEGORIES, "total", *_rounded_km())


def ghg_by_scope(emissions: DataFrame) -> DataFrame:
    """All records by scope, nothing left out or counted once; scopes without records have no row, a record without scope is Unknown."""
    return emissions.withColumn("scope", F.coalesce("scope", F.lit("Unknown"))).groupBy("tree_id", "scope").agg(exact_sum(F.col("kg")).alias("kg")).select("tree_id", "scope", rounded(F.col("kg"), 3).alias("kg"))


def ghg_by_category(emissions: DataFrame) -> DataFrame:
    """By category: of scope 3 its own, if it has one; the other scopes together are "direct"."""
    named = emissions.withColumn("category", F.when(F.col("scope") == "Scope 3", F.coalesce("category", F.lit("Uncategorized"))).otherwise("direct"))
    return named.groupBy("tree_id", "category").agg(exact_sum(F.col("kg")).alias("kg")).select("tree_id", "category", rounded(F.col("kg"), 3).alias("kg"))


def ghg_total(emissions: DataFrame) -> DataFrame:
    """The total, added up from scopes already rounded."""
    return ghg_by_scope(emissions).groupBy("tree_id").agg(exact_sum(F.col("kg")).alias("kg")).select("tree_id", rounded(F.col("kg"), 3).alias("kg"))


def counted_records(emissions: DataFrame) -> DataFrame:
    """Records that a footprint counts: of a part its first visit, not excluded, and each once within its step."""
    named = first_visits(emissions, "visit").where(~F.col("excluded")).withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    return named.dropDuplicates(SAME_RECORD)


def footprint(emissions: DataFrame) -> DataFrame:
    """Per product all three scopes, zero where there is nothing."""
    of = lambda s: F.coalesce(exact_sum(F.when(F.col("scope") == s, F.col("kg"))), F.lit(0.0))
    counted = counted_records(emissions).groupBy("tree_id").agg(*(of(s).alias(s) for s in SCOPES))
    scopes = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"`{s}`").alias("kg")) for s in SCOPES)))
    return counted.select("tree_id", scopes.alias("s")).select("tree_id", "s.scope", rounded(F.col("s.kg"), 6).alias("kg"))


def footprint_by_category(emissions: DataFrame) -> DataFrame:
    """By scope and category; all but scope 3 are "direct"."""
    named = counted_records(emissions).withColumn("category", F.when(F.col("scope") == "Scope 3", F.col("category")).otherwise("direct"))
    sums = named.groupBy("tree_id", F.coalesce("scope", F.lit("")).alias("scope"), "category").agg(exact_sum(F.col("kg")).alias("kg"))
    return sums.select("tree_id", "scope", "category", rounded(F.col("kg"), 6).alias("kg"))


def _mappable(places: DataFrame) -> DataFrame:
    return places.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def map_nodes(steps: DataFrame, places: DataFrame) -> DataFrame:
    """Places with coordinates and how many steps of each category happened there; a destination is a place even if nothing did.

    A part counts where a walk level by level meets it first.
    """
    steps = first_visits(steps, "level_visit")
    kind = map_category(F.col("type"))
    seen = F.explode(F.array(F.struct(F.col("place_id").alias("at"), kind.alias("kind")), F.struct(F.col("dest_id").alias("at"), F.lit(None).cast("string").alias("kind"))))
    counts = (
        steps.select("tree_id", seen.alias("s")).where(F.col("s.at").isNotNull()).groupBy("tree_id", F.col("s.at").alias("place_id"))
        .agg(*(F.count_if(F.col("s.kind") == c).alias(c) for c in CATEGORIES))
    )
    return counts.join(_mappable(places), "place_id").select("tree_id", "place_id", "name", "latitude", "longitude", *CATEGORIES)


def map_edges(steps: DataFrame, places: DataFrame) -> DataFrame:
    """Transports between places that both have coordinates, with direction and middle; loops stay. Parts count once."""
    steps = first_visits(steps, "level_visit")
    moves = steps.where((map_category(F.col("type")) == "transport") & F.col("dest_id").isNotNull() & F.col("place_id").isNotNull()).groupBy("tree_id", "place_id", "dest_id").agg(F.count("*").alias("n"))
    at = _mappable(places).select("place_id", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    to = _mappable(places).select(F.col("place_id").alias("dest_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    a, b, turn = F.radians("lat1"), F.radians("lat2"), F.radians(F.col("lon2") - F.col("lon1"))
    bearing = F.pmod(F.degrees(F.atan2(F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn))) + 360.0, F.lit(360.0))
    return moves.join(at, "place_id").join(to, "dest_id").select(
        "tree_id", F.col("place_id").alias("source"), F.col("dest_id").alias("target"), F.lit("transport").alias("category"), "n",
        rounded(bearing, 6).alias("bearing"), ((F.col("lat1") + F.col("lat2")) / 2.0).alias("mid_lat"), ((F.col("lon1") + F.col("lon2")) / 2.0).alias("mid_lon"))


def map_totals(steps: DataFrame) -> DataFrame:
    """Steps by category whether or not their place is known. Parts count once."""
    steps = first_visits(steps, "level_visit")
    kind = map_category(F.col("type"))
    return steps.groupBy("tree_id").agg(*(F.count_if(kind == c).alias(c) for c in CATEGORIES), F.count("*").alias("total"))
