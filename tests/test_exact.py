"""Sums of doubles against the standard library's."""

import math
import random
from collections import defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from bomwright.functions.exact import exact_sum, with_exact_sum
from bomwright.operators import materials


def test_sums_equal_fsum(spark):
    """Values of all sizes and signs, some of which cancel, by group and by window."""
    r, rows = random.Random(2), []
    for group in range(300):
        low, high = r.choice([(-3, 3), (-20, 20), (0, 70), (-90, -60), (-60, 60)])
        values = [r.choice([1, 1, -1]) * r.random() * 2.0 ** r.uniform(low, high) for _ in range(r.randint(1, 40))]
        rows += [(group, v) for v in values + [-v for v in values[: len(values) // 2 * (group % 5 == 0)]]]
    rows += [(300, 4e-7)] * 3 + [(301, 5e12), (301, 1e-9), (301, -5e12), (302, 5e12), (303, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(8)
    values = defaultdict(list)
    for g, v in rows:
        values[g].append(v)
    expected = {g: None if vs == [None] else math.fsum(vs) for g, vs in values.items()}
    assert {x.g: x.s for x in df.groupBy("g").agg(exact_sum(F.col("v")).alias("s")).collect()} == expected
    assert {x.g: x.s for x in df.select("g", exact_sum(F.col("v"), Window.partitionBy("g")).alias("s")).collect()} == expected
    assert expected[300] == 1.2e-06 and expected[301] == 1e-9 and expected[302] == 5e12


def test_sums_beyond_all_parts(spark):
    df = spark.createDataFrame([(1, 1e300), (1, 5.0), (2, math.nan), (2, 1.0), (3, math.inf)], "g int, v double")
    found = {x.g: x.s for x in df.groupBy("g").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert found[1] == 1e300 and math.isnan(found[2]) and found[3] == math.inf


def test_window_sums_are_worked_out_once(spark):
    """Nine whole numbers and the rest for each sum, however often the total names them; totals as of ``fsum``."""
    r = random.Random(3)
    rows = [(g, f"m{m}", r.random() * 2.0 ** r.uniform(-20, 20)) for g in range(20) for m in range(r.randint(1, 30))]
    df = spark.createDataFrame(rows, "tree_id int, material_name string, grams double").repartition(8)
    slices = materials.pie(df)
    assert slices._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition(") <= 20
    ordered = {g: [x for _, x in sorted(((-x, m), x) for t, m, x in rows if t == g)] for g in range(20)}
    expected = sorted(math.fsum(xs[: k + 1]) / math.fsum(xs) for xs in ordered.values() for k in range(len(xs)))
    assert sorted(x.to_share for x in slices.collect()) == expected
    kept = with_exact_sum(df, "total", F.col("grams"), Window.partitionBy("tree_id"))
    assert kept.columns == [*df.columns, "total"] and {x.tree_id: x.total for x in kept.collect()} == {g: math.fsum(xs) for g, xs in ordered.items()}
