"""The library's canonical tables, from relational order, part and event tables.

Each function gives one canonical table: parts as a forest, their uses of materials,
emissions, transports, service steps, places, organisations and passports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import dealt

FAN_OUT = 8
PARTS_IN_SERVICE = 200
#: Which service an event stands for.
EVENT_STEPS = {"view": "CleaningServiceStep", "click": "RepairServiceStep", "purchase": "ReplaceServiceStep", "signup": "RefurbishmentServiceStep", "error": "RecyclingStep"}
SCOPES = {"A": "Scope 1", "N": "Scope 2", "R": "Scope 3"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(column, values: dict):
    """A CASE over fixed values."""
    out = F
    for k, v in values.items():
        out = out.when(column == k, v)
    return out


def part_of_line():
    """Which part of its product a line item stands for. Several lines of an order may be one part: visits of it."""
    return F.col("l_partkey") % 20


def lines_of_products(spark: SparkSession, sf_dir: str, also: DataFrame, same: Column) -> DataFrame:
    """Line items with what they are joined to, dealt out by their order, by which all that takes them groups them."""
    lines = read(spark, sf_dir, "lineitem")
    return dealt(lines.join(also, same), lines.count(), "l_orderkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, parent_id (null for roots), name, is_modular, has_failstate, mtbf_hrs."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("part_id"), F.when(key >= FAN_OUT, F.floor(key / FAN_OUT).cast("bigint")).alias("parent_id"), F.col("p_name").alias("name"),
        (F.col("p_size") % 2 == 0).alias("is_modular"), (key % 17 == 0).alias("has_failstate"), (F.col("p_size") * 1000).cast("double").alias("mtbf_hrs"),
        F.col("p_type").alias("part_type"),
    )


def part_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the static part they are of; some have no name or no MTBF of their own, some no static part."""
    key = F.col("p_partkey")
    static = read(spark, sf_dir, "part").select(key.alias("of"), F.when(key % 7 != 3, F.col("p_brand")).alias("part_static_id"))
    gaps = {"name": F.when(F.col("part_id") % 4 == 0, "").when(F.col("part_id") % 4 != 1, F.col("name")), "mtbf_hrs": F.when(F.col("part_id") % 5 != 2, F.col("mtbf_hrs"))}
    return parts(spark, sf_dir).withColumns(gaps).join(static, F.col("part_id") == F.col("of")).drop("of")


def part_statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static parts by supplier: part_static_id, name (sometimes empty), mtbf_hrs (sometimes unknown)."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Brand#"), key).alias("part_static_id"), F.when(key % 4 == 0, "").otherwise(F.col("s_name")).alias("name"), F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal")).alias("mtbf_hrs"))


def material_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return (
        read(spark, sf_dir, "part").select(
            F.concat(brand, F.lit("/"), F.col("p_type")).alias("material_static_id"), F.col("p_type").alias("material_name"),
            brand.isin("Brand#1", "Brand#2").alias("rare"), brand.isin("Brand#3", "Brand#4").alias("hazardous"),
            F.when(brand == "Brand#3", F.array(F.lit("H302"), F.lit("H319"))).when(brand == "Brand#4", F.array(F.lit("H319"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        ).distinct()
    )


def material_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per material in a part of a product, with its static data."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    brand, line = F.col("p_brand"), F.col("l_linenumber")
    return (
        lines_of_products(spark, sf_dir, part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("tree_id"), part_of_line().alias("part_id"), ((F.col("l_partkey") + F.col("l_suppkey")) % 30).alias("material_instance_id"),
            F.concat(brand, F.lit("/"), F.col("p_type")).alias("material_static_id"), F.col("p_type").alias("material_name"),
            brand.isin("Brand#1", "Brand#2").alias("rare"), brand.isin("Brand#3", "Brand#4").alias("hazardous"),
            F.when(brand == "Brand#3", F.array(F.lit("H302"), F.lit("H319"))).when(brand == "Brand#4", F.array(F.lit("H319"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
            F.col("l_quantity").alias("weight_g"), (F.col("l_discount") * 1000.0).alias("pct_recycled"),
            F.when(line % 2 == 0, (1.0 - F.col("l_tax")) * 100.0).otherwise(1.0 - F.col("l_tax")).alias("purity"),
            # where it is in its product; no two uses that differ have the same place
            F.struct(line.cast("bigint").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("supplier")).alias("place"),
        )
        .withColumn("visit", F.col("place"))  # each line is a visit of its part
    )


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = F.col("l_linenumber")
    return (
        lines_of_products(spark, sf_dir, part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("tree_id"), part_of_line().alias("part_id"), F.struct(line.alias("line"), F.col("l_partkey").alias("part")).alias("visit"),
            F.struct(F.col("l_partkey").alias("part"), line.alias("line")).alias("step_key"),
            F.when(F.col("l_suppkey") % 23 != 0, lookup(F.col("l_returnflag"), SCOPES)).alias("scope"), F.when(line % 3 != 1, F.col("p_type")).alias("category"),
            F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("factor"), (F.col("l_extendedprice") / 1000.0).alias("kg"),
            F.lit("calculated").alias("method"), ((F.col("l_linestatus") == "F") & (line % 3 == 0)).alias("excluded"),
        )
    )


def process_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of products' parts and materials: a transport per line, and what its flags say was done at its origin."""
    kinds = {"A": "ProductionStep", "N": "TransportStep", "R": "RemanufacturingServiceStep"}
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    kind = lookup(F.col("l_returnflag"), kinds)
    return (
        lines_of_products(spark, sf_dir, suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("tree_id"), part_of_line().alias("part_id"), F.when(F.col("l_linestatus") == "F", "material").otherwise("part").alias("owner_kind"), kind.alias("type"),
            F.col("s_nationkey").alias("place_id"), F.when(kind == "TransportStep", F.col("c_nationkey")).alias("dest_id"),
            F.when((kind == "TransportStep") | (F.col("l_linenumber") == 1), F.col("l_quantity") * 10.0).alias("distance_km"),
            F.struct((F.col("l_partkey") % 2).alias("lvl"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("key")).alias("level_visit"),
        )
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    known = key != 24
    return read(spark, sf_dir, "nation").select(
        key.alias("place_id"), F.col("n_name").alias("name"), F.when(known, (key * 7 - 84).cast("double")).alias("latitude"), F.when(known, (key * 14 - 168).cast("double")).alias("longitude"), F.col("n_regionkey").alias("managed_by"),
        F.col("n_name").alias("country"), F.lit(None).cast("string").alias("city"), F.lpad(key.cast("string"), 5, "0").alias("postal_code"),
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("M"), F.col("s_suppkey")).alias("org_id"), F.col("s_name").alias("name"), F.lit("Manufacturer").alias("type"), F.concat(F.lit("https://s"), F.col("s_suppkey"), F.lit(".example")).alias("url"), F.concat(F.lit("DE"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("eori"), F.lit(None).cast("string").alias("trade_name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("DE"), F.lpad(F.col("s_suppkey").cast("string"), 20, "0"))).alias("lucid"))
    importers = read(spark, sf_dir, "customer").select(F.concat(F.lit("I"), F.col("c_custkey")).alias("org_id"), F.col("c_name").alias("name"), F.lit("Importer").alias("type"), F.concat(F.lit("https://c"), F.col("c_custkey"), F.lit(".example")).alias("url"), F.lit(None).cast("string").alias("eori"), F.concat(F.lit("T "), F.col("c_name")).alias("trade_name"), F.lit(None).cast("string").alias("lucid"))
    return makers.unionByName(importers)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who manages places: of, and the organisation as ``owner``."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    named = F.struct(F.concat(F.lit("R"), F.col("r_regionkey")).alias("org_id"), F.col("r_name").alias("name"), none("trade_name"), none("url"), none("eori"), none("lucid"), F.lit("Operator").alias("type"))
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("of"), named.alias("owner"))


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product instances: instance_id, static_id, declared_at, operating_hrs, discontinued, root_part_id, counters."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("instance_id"), (F.col("o_custkey") % 50).alias("static_id"), F.col("o_orderdate").alias("declared_at"), (F.col("o_totalprice") / 10.0).alias("operating_hrs"),
        (F.col("o_orderstatus") == "F").alias("discontinued"), (key % PARTS_IN_SERVICE).alias("root_part_id"), F.concat(F.lit("Product "), F.col("o_orderpriority")).alias("product_name"),
        (key % 13).cast("double").alias("cleaning_count"), (key % 7).cast("double").alias("chalk_count"), (key % 29).cast("double").alias("brewing_count"), (key % 31).cast("double").alias("grinding_count"),
        F.concat(F.lit("M"), F.col("o_custkey") % 10).alias("manufacturer_id"), F.when(key % 3 == 0, F.concat(F.lit("I"), F.col("o_custkey"))).alias("importer_id"),
    )


def service_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service steps on products' root parts; ``seen`` is the order in which they would be read."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    symptom = lambda n: F.concat(F.lit("S"), (k % n).cast("string"))
    user = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        "event_id", user.alias("instance_id"), (user % 10).alias("static_id"), lookup(F.col("event_type"), EVENT_STEPS).alias("type"), F.col("value").alias("cost"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("D"), (k % 5).cast("string"))).alias("diagnose"), F.array(symptom(7), symptom(3)).alias("symptoms"),
        F.array(F.col("event_id") % PARTS_IN_SERVICE).alias("target_ids"), F.col("ts").alias("begin_at"),
        F.timestamp_add("HOUR", user, F.lit("2024-01-01").cast("timestamp_ntz")).alias("declared_at"), (user * 1000000000 + F.col("event_id") * 10).alias("seen"),
    )


def service_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products, also those without any service; some have no root part."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        (key % 10).alias("static_id"), key.alias("instance_id"), F.when(key % 11 != 5, key % PARTS_IN_SERVICE).alias("root_part_id"),
        (key % 13).cast("double").alias("cleaning_count"), (key % 7).cast("double").alias("chalk_count"), (key % 29).cast("double").alias("brewing_count"), (key % 31).cast("double").alias("grinding_count"),
    )


def tree_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services on any part of a product: those on root parts, and remanufacturing of parts below; products without a root part have none."""
    on_root = service_steps(spark, sf_dir).select("event_id", "instance_id", "static_id", "type", "cost", "diagnose", "symptoms", "seen")
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    below = (
        read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").select(
            (-(order * 10 + line)).alias("event_id"), order.alias("instance_id"), (order % 10).alias("static_id"), F.lit("RemanufacturingServiceStep").alias("type"), F.col("l_quantity").alias("cost"),
            F.when(line % 2 == 0, "").otherwise(F.concat(F.lit("D"), line.cast("string"))).alias("diagnose"), F.array(F.lit(""), F.concat(F.lit(" S"), (line % 3).cast("string"))).alias("symptoms"),
            # after the steps of the root part; lines of one order and number are alike
            (order * 1000000000 + 900000000 + line * 10).alias("seen"))
    )
    return on_root.unionByName(below).where(F.col("instance_id") % 11 != 5)
