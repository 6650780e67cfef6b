"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from bomwright.plans import registry
from bomwright.session import session_builder

HEADLINE = (
    "material_mass_by_name", "material_summary_by_name", "rare_earth_metrics", "hazardous_locations", "tree_flatten", "tree_descendant_counts", "ghg_footprint_dedup",
    "step_category_counts", "map_nodes", "map_edges", "service_rollup_ancestors", "mtbf_exceeded_counts", "symptom_top2_diagnoses", "diagnosis_summary_argmax",
    "top10_parts_by_operation", "service_modular_by_line", "mutation_replace_part", "jsonld_passport", "user_summary", "end_of_life_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session_builder(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["material_mass_by_name"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first query also starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
