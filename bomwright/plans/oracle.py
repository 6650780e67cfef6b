"""The same rows in plain SQL, for checking against another engine."""

from __future__ import annotations

import json

from ..operators.jsonld import CONTEXT as FORMAT_CONTEXT
from .views import CLOSURE, EMISSIONS, NODE, ORGANISATIONS, PARTS, PASSPORTS, PLACES, PRODUCT_NODE, PRODUCT_ONLY, SERVICES, STEPS, SYMPTOMS, USES, exact, rounded, with_views

SERVICE_KINDS = ("Repair", "Replace", "Cleaning", "Remanufacturing", "Refurbishment")
TYPES = ("RepairServiceStep", "ReplaceServiceStep", "CleaningServiceStep", "RemanufacturingServiceStep", "RefurbishmentServiceStep", "RecyclingStep")
CATEGORIES = {"transport": "TransportStep", "production": "ProductionStep", "secondary": "RemanufacturingServiceStep"}


def kinds(of: str = "type") -> str:
    return ", ".join(f"count(*) FILTER ({of} = '{k}ServiceStep') AS {k.lower()}" for k in SERVICE_KINDS)


#: By type for the map; by name, remanufacturing is production.
MAP_COUNTS = ", ".join(f"count(*) FILTER (kind = '{t}') AS {c}" for c, t in CATEGORIES.items())
NAME_COUNTS = "count(*) FILTER (type = 'TransportStep') AS transport, count(*) FILTER (type IN ('ProductionStep', 'RemanufacturingServiceStep')) AS production, 0::BIGINT AS secondary, count(*) AS total"

NAMED_MASS = f"named AS (SELECT tree_id, material_name, {exact('weight_g')} AS grams, {exact('weight_g * pct_recycled')} AS wp, bool_or(rare) AS rare FROM uses GROUP BY ALL)"
OVERALL = f"""overall AS (
  SELECT tree_id, {exact('weight_g')} AS grams, {exact('weight_g * pct_recycled')} AS wp,
         coalesce({exact('CASE WHEN name_rare THEN weight_g ELSE 0 END')}, 0) AS rare_g
  FROM (SELECT *, bool_or(rare) OVER (PARTITION BY tree_id, material_name) AS name_rare FROM uses) GROUP BY tree_id
)"""
BY_STATIC = f"""sums AS (
  SELECT tree_id, material_static_id, material_name, {exact('weight_g')} AS g, {exact('weight_g * pct_recycled')} AS wp, bool_or(rare) AS rare, bool_or(hazardous) AS hazardous
  FROM once GROUP BY ALL
), totals AS (SELECT tree_id, CASE WHEN {exact('g')} > 0 THEN {exact('g')} ELSE 1 END AS total FROM sums GROUP BY ALL), shares AS (
  SELECT tree_id, material_static_id, material_name, rare, hazardous, {rounded('g::DOUBLE', 2)} AS grams,
         {rounded('CASE WHEN g::DOUBLE > 0 THEN wp / g::DOUBLE ELSE 0 END', 2)} AS recycled_percent, {rounded('g::DOUBLE / total * 100.0::DOUBLE', 2)} AS percent
  FROM sums JOIN totals USING (tree_id)
)"""
PURITY = f"""pure AS (
  SELECT tree_id, material_name, {exact('weight_g * least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN purity > 1.5 THEN purity / 100.0::DOUBLE ELSE purity END))')} / {exact('weight_g')} AS mean_purity
  FROM uses WHERE weight_g > 0 GROUP BY ALL
)"""
MTBF = """CASE WHEN mtbf_hrs IS NOT NULL THEN greatest(0.0, mtbf_hrs - operating_hrs) END AS remaining_hrs, coalesce(operating_hrs >= mtbf_hrs, false) AS exceeded"""
STATICS = """shown_parts AS (
  SELECT p_partkey, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, CASE WHEN p_partkey % 4 > 1 THEN nullif(p_name, '') END, p_partkey::VARCHAR) AS shown,
    coalesce(CASE WHEN s_acctbal > 2000 THEN s_acctbal END, CASE WHEN p_partkey % 5 <> 2 THEN (p_size * 1000)::DOUBLE END) AS shown_mtbf
  FROM part LEFT JOIN supplier ON p_partkey % 7 <> 3 AND p_brand = 'Brand#' || s_suppkey
)"""
RECORDS = """records AS (SELECT l_orderkey AS tree_id, l_partkey, l_linenumber, l_tax - 0.02::DOUBLE AS factor, l_quantity - 4 AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BUCKETS = f"bucketed AS (SELECT instance_id, {exact('cost')} AS cost_eur, {kinds()} FROM services WHERE type <> 'RecyclingStep' GROUP BY ALL)"
MICROS = "(epoch_us(begin_at) - epoch_us(declared_at))"
LINES = """listed AS (
  SELECT o_custkey % 50 AS static_id, min('Product ' || o_orderpriority) AS product_name FROM orders GROUP BY ALL
)"""
MODULAR = """modular AS (
  SELECT l.static_id, l.instance_id, count(s.event_id) FILTER (type = 'RepairServiceStep') AS repairs, count(s.event_id) FILTER (type = 'ReplaceServiceStep') AS replaces,
         coalesce(any_value(m), 0)::BIGINT AS modulars
  FROM lines l LEFT JOIN tree_services s USING (instance_id) LEFT JOIN (SELECT ancestor, count(*) FILTER (is_modular) AS m FROM closure GROUP BY ALL) ON ancestor = l.root_part_id
  GROUP BY ALL
)"""

#: Blocks of the views, as text.
LINKED = """linked_rows AS (
  SELECT p.instance_id, c.descendant AS part_id, n.name AS part_name, r.linked_id, q.product_name AS linked_name FROM passports p JOIN closure c ON c.ancestor = p.root_part_id AND c.distance > 0
  JOIN (SELECT root_part_id, min(instance_id) AS linked_id FROM passports GROUP BY ALL) r ON r.root_part_id = c.descendant AND r.linked_id <> p.instance_id
  JOIN passports q ON q.instance_id = r.linked_id JOIN node n ON n.part_id = c.descendant
), linked_text AS (SELECT instance_id AS of, string_agg(concat_ws(':', part_name, part_id, linked_id, linked_name), ';' ORDER BY part_name, part_id) AS linked FROM linked_rows GROUP BY ALL)"""
PART_TEXT = """part_text AS (
  SELECT part_id AS of, first_level, n_parts, n_fail FROM (SELECT ancestor AS part_id, count(*) AS n_parts, count(*) FILTER (has_failstate) AS n_fail FROM closure GROUP BY ALL)
  LEFT JOIN (SELECT parent_id, string_agg(concat_ws(':', part_id, name, is_modular, has_failstate), ';' ORDER BY part_id) AS first_level FROM node WHERE parent_id IS NOT NULL GROUP BY ALL) ON parent_id = part_id
)"""


def thousandths(x: str, times: int = 1000) -> str:
    return f"floor({x} * {times}.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


MATERIAL_TEXT = f"""heavy AS (
  SELECT tree_id, material_name, {exact('weight_g')} AS g, {exact('weight_g * pct_recycled')} AS wp FROM uses GROUP BY ALL
), totalled AS (SELECT *, {exact('g', 'OVER (PARTITION BY tree_id)')} AS total FROM heavy
), percents AS (SELECT *, CASE WHEN g > 0 THEN wp / g ELSE 0 END AS recycled, CASE WHEN total > 0 THEN g / total ELSE 0 END * 100.0::DOUBLE AS share FROM totalled
), material_text AS (
  SELECT tree_id AS of, string_agg(concat_ws(':', material_name, {thousandths('g')}, {thousandths('share', 100)}, {thousandths('recycled', 100)}, {thousandths('(100.0::DOUBLE - recycled)', 100)}), ';' ORDER BY g DESC, material_name) AS materials
  FROM percents GROUP BY ALL
)"""
HELD = f"""{PRODUCT_ONLY}, bearing AS (
  SELECT tree_id, kind, material_name, part_id, {exact('weight_g')} AS g, list(warnings) AS w
  FROM (SELECT *, unnest([CASE WHEN rare THEN 'rare' END, CASE WHEN hazardous THEN 'hazardous' END]) AS kind FROM uses) WHERE kind IS NOT NULL GROUP BY ALL
), crumbs AS (SELECT tree_id AS of_tree, part_id, array_to_string(names, ' → ') AS crumb FROM pnode), held AS (
  SELECT tree_id, kind, material_name, {exact('g')} AS grams, list_sort(list_distinct(flatten(flatten(list(w))))) AS warnings,
         string_agg(coalesce(crumb, b.part_id::VARCHAR) || '=' || {thousandths('g::DOUBLE')}, '+' ORDER BY b.part_id) AS parts
  FROM bearing b JOIN passports p ON p.instance_id = b.tree_id LEFT JOIN crumbs c ON c.of_tree = p.root_part_id AND c.part_id = b.part_id GROUP BY ALL
), held_text AS (
  SELECT tree_id AS of, string_agg(shown, ';' ORDER BY material_name) FILTER (kind = 'rare') AS rare, string_agg(shown, ';' ORDER BY material_name) FILTER (kind = 'hazardous') AS hazardous
  FROM (SELECT *, concat_ws(':', material_name, {thousandths('grams')}, array_to_string(warnings, '+'), parts) AS shown FROM held) GROUP BY ALL
)"""


def document(kind: str, n: int, field: str) -> str:
    """Name or address of a line's document; lines whose number n divides have none."""
    address = f"'https://docs.example/{kind}/' || static_id"
    name = f"CASE WHEN static_id % 2 = 0 THEN '{kind}' ELSE {address} END"
    return f"CASE WHEN static_id % {n} <> 0 THEN {name if field == 'name' else address} END"


def top2(days: str) -> str:
    return with_views([SYMPTOMS], f"""
, counts AS (SELECT static_id, symptom, diagnose, count(*) AS n, min(seen) AS first FROM symptom_rows GROUP BY ALL), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY static_id, symptom)::BIGINT AS total, row_number() OVER (PARTITION BY static_id, symptom ORDER BY n DESC, first) AS rank FROM counts
), timed AS (SELECT *, {days} AS days FROM services WHERE diagnose <> ''), figures AS (
  SELECT static_id, diagnose, {exact('coalesce(cost, 0)')} / count(*) AS avg_cost, {exact('CASE WHEN days >= 0 THEN days END', bits=80)} / nullif(count(*) FILTER (days >= 0), 0) AS avg_days FROM timed GROUP BY ALL
)
SELECT r.static_id, r.symptom, r.rank::INT AS rank, r.diagnose, r.n, r.n / r.total AS probability, f.avg_cost, f.avg_days
FROM ranked r LEFT JOIN figures f USING (static_id, diagnose) WHERE rank <= 2""".lstrip())


def top10(keys: str) -> str:
    return with_views([SERVICES, PARTS], f"""
, named AS (SELECT {keys}, coalesce(name, target::VARCHAR) AS name, seen FROM services LEFT JOIN parts ON target = part_id), counts AS (SELECT {keys}, name, count(*) AS n, min(seen) AS first FROM named GROUP BY ALL)
SELECT {keys}, name, n, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first)::INT AS rank FROM counts QUALIFY rank <= 10""".lstrip())


CONTEXT = '{"@context":' + json.dumps(FORMAT_CONTEXT, separators=(",", ":")) + ","


def text(column: str) -> str:
    """A JSON text of a string column."""
    return f"to_json({column})"


def value(key: str, name: str, of: str, unit: str = "") -> str:
    """A property value or quantity of a column, left out where it is null."""
    return f"""coalesce(',"{key}":{{"@type":"schema:QuantitativeValue","name":"{name}","value":' || {of} || '{unit and f',"unitCode":"{unit}"'}}}', '')"""


def identifier(key: str, name: str, of: str) -> str:
    return f"""coalesce(',"{key}":{{"@type":"schema:PropertyValue","propertyID":"{name}","value":' || to_json({of}::VARCHAR) || '}}', '')"""


LINE_NODE = """'"@type":"schema:ProductModel","@id":"' || static_id || '","schema:name":' || to_json(product_name) || '}'"""
COUNTED = """'{"@type":"schema:PropertyValue","name":"cleaningCount","value":' || (instance_id % 13)::DOUBLE || '},{"@type":"schema:PropertyValue","name":"chalkCount","value":' || (instance_id % 7)::DOUBLE || '},'
  || '{"@type":"schema:PropertyValue","name":"brewingCount","value":' || (instance_id % 29)::DOUBLE || '},{"@type":"schema:PropertyValue","name":"coffeeGrindingCount","value":' || (instance_id % 31)::DOUBLE || '},'
  || '{"@type":"schema:PropertyValue","name":"operatingHRS","value":' || operating_hrs || ',"unitCode":"HRS"}'"""


def passport_json(variant: str) -> str:
    return f"""'{CONTEXT}"@type":"schema:Product","@id":"' || instance_id || '"' || {identifier("dpp:SGTIN", "SGTIN", "instance_id")} || {variant}
  || ',"dpp:dateOfDeclaration":"' || strftime(declared_at, '%Y-%m-%dT%H:%M:%S') || '","schema:additionalProperty":[' || {COUNTED} || '],"dpp:discontinued":' || discontinued || '}}'"""


def nested_parts(depth: int = 12) -> str:
    """Part trees, put together from the deepest level up."""
    ctes = f""", own AS (SELECT tree_id, part_id, parent_id, lvl, '{{"@type":"schema:Product","@id":"' || part_id || '","dpp:isModular":' || is_modular || ',"dpp:hasFailstate":' || has_failstate AS own FROM node),
 j{depth} AS (SELECT tree_id, part_id, parent_id, own || '}}' AS json FROM own WHERE lvl = {depth})"""
    for k in range(depth - 1, -1, -1):
        ctes += f""", j{k} AS (SELECT tree_id, part_id, parent_id, own || coalesce(',"dpp:compositeParts":[' || inner_json || ']', '') || '}}' AS json
 FROM own LEFT JOIN (SELECT parent_id AS pid, string_agg(json, ',' ORDER BY part_id) AS inner_json FROM j{k + 1} GROUP BY ALL) ON pid = part_id WHERE lvl = {k})"""
    return ctes + " SELECT tree_id, json FROM j0"


ENTITIES = """, org_json AS (
  SELECT id, '{"id":"' || id || '","name":' || to_json(name) || '}' AS json FROM (
    SELECT 'M' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'I' || c_custkey, c_name FROM customer UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)
), place_json AS (
  SELECT n_nationkey AS id, '{"id":"' || n_nationkey || '","name":' || to_json(n_name) || ',"managedBy":' || o.json || '}' AS json FROM nation JOIN org_json o ON o.id = 'R' || n_regionkey
), part_json AS (SELECT p_partkey AS id, '{"id":"' || p_partkey || '","name":' || to_json(p_name) || '}' AS json FROM part
), line_json AS (
  SELECT static_id, '{"id":"' || static_id || '","product_name":' || to_json(product_name)
      || ',"returningPlaces":[' || (SELECT string_agg(coalesce(p.json, 'null'), ',' ORDER BY n) FROM (SELECT unnest([static_id % 25, static_id % 7, static_id + 10]) AS t, unnest([0, 1, 2]) AS n) LEFT JOIN place_json p ON p.id = t)
      || '],"spareParts":[' || (SELECT string_agg(coalesce(p.json, 'null'), ',' ORDER BY n) FROM (SELECT unnest([static_id, static_id * 3, static_id + 1000000]) AS t, unnest([0, 1, 2]) AS n) LEFT JOIN part_json p ON p.id = t) || ']}' AS json
  FROM listed
)"""

SQL: dict[str, str] = {
    "material_mass_by_name": with_views([USES, NAMED_MASS], f"SELECT tree_id, material_name, grams, CASE WHEN total > 0 THEN grams / total ELSE 0 END * 100.0::DOUBLE AS percent FROM named JOIN (SELECT tree_id, {exact('weight_g')} AS total FROM uses GROUP BY ALL) USING (tree_id)"),
    "material_recycled_share": with_views([USES, NAMED_MASS], "SELECT tree_id, material_name, grams, CASE WHEN grams > 0 THEN wp / grams ELSE 0 END AS recycled_percent, 100.0::DOUBLE - CASE WHEN grams > 0 THEN wp / grams ELSE 0 END AS virgin_percent FROM named"),
    "material_overall_shares": with_views([USES, OVERALL], "SELECT tree_id, grams, CASE WHEN grams > 0 THEN wp / grams ELSE 0 END AS recycled_percent, CASE WHEN grams > 0 THEN rare_g / grams ELSE 0 END * 100.0::DOUBLE AS rare_percent FROM overall"),
    "material_purity_mean": with_views([USES, PURITY], "SELECT * FROM pure"),
    "rare_earth_metrics": with_views([USES], f""", named AS (SELECT tree_id, material_name, {exact('weight_g')} AS g, bool_or(rare) AS rare FROM once_material GROUP BY ALL), totals AS (SELECT tree_id, {exact('g')} AS total FROM named GROUP BY ALL)
SELECT tree_id, material_name, {rounded('g::DOUBLE', 4)} AS grams, {rounded('CASE WHEN total > 0 THEN g::DOUBLE / total ELSE 0 END * 100.0::DOUBLE', 2)} AS percent FROM named JOIN totals USING (tree_id) WHERE rare"""),
    "material_shares_by_static": with_views([USES, BY_STATIC], "SELECT * FROM shares"),
    "material_summary_by_name": with_views([USES, BY_STATIC, PURITY], f""", named AS (
  SELECT tree_id, material_name, bool_or(rare) AS rare, bool_or(hazardous) AS hazardous, {exact('grams')} AS g, {exact('grams * recycled_percent')} AS wp FROM shares GROUP BY ALL
), all_grams AS (SELECT tree_id, {exact('g')} AS total FROM named GROUP BY ALL)
SELECT tree_id, material_name, rare, hazardous, {rounded('g::DOUBLE', 4)} AS grams, {rounded('CASE WHEN all_grams.total > 0 THEN g::DOUBLE / all_grams.total ELSE 0 END * 100.0::DOUBLE', 2)} AS percent,
       {rounded('CASE WHEN g > 0 THEN wp / g::DOUBLE ELSE 0 END', 2)} AS recycled_percent, mean_purity
FROM named JOIN all_grams USING (tree_id) LEFT JOIN pure USING (tree_id, material_name)"""),
    "hazardous_locations": with_views([USES, BY_STATIC], f""", mass AS (SELECT tree_id, {exact('grams')} AS total FROM shares GROUP BY ALL), flat AS (SELECT DISTINCT tree_id, material_name, part_id, unnest(warnings) AS w FROM once WHERE hazardous), found AS (
  SELECT tree_id, material_name, part_id, {exact('weight_g')} AS grams FROM once WHERE hazardous GROUP BY ALL
), said AS (SELECT tree_id, material_name, part_id, string_agg(w, ',' ORDER BY w) AS warnings FROM flat GROUP BY ALL)
SELECT tree_id, material_name, part_id, grams, warnings, grams / CASE WHEN mass.total > 0 THEN mass.total ELSE 1 END * 100.0::DOUBLE AS percent FROM found JOIN said USING (tree_id, material_name, part_id) JOIN mass USING (tree_id)"""),
    "end_of_life_buckets": with_views([USES], f""", rows AS (SELECT *, 'rare' AS bucket FROM uses WHERE rare UNION ALL SELECT *, 'hazardous' FROM uses WHERE hazardous), ids AS (SELECT DISTINCT tree_id, bucket, material_name, part_id FROM rows)
SELECT tree_id, bucket, material_name, grams, parts FROM (SELECT tree_id, bucket, material_name, {exact('weight_g')} AS grams FROM rows GROUP BY ALL) JOIN (SELECT tree_id, bucket, material_name, string_agg(part_id::VARCHAR, ',' ORDER BY part_id) AS parts FROM ids GROUP BY ALL) USING (tree_id, bucket, material_name)"""),
    "pie_cumulative_share": with_views([USES, NAMED_MASS], f"""SELECT tree_id, material_name, (upto - grams) / total AS from_share, upto / total AS to_share FROM (
  SELECT *, {exact('grams', 'OVER (PARTITION BY tree_id ORDER BY grams DESC, material_name ROWS UNBOUNDED PRECEDING)')} AS upto, {exact('grams', 'OVER (PARTITION BY tree_id)')} AS total FROM named)"""),
    "tree_flatten": with_views(NODE, "SELECT tree_id, part_id, parent_id, lvl, name, is_modular, has_failstate, mtbf_hrs FROM node"),
    "tree_breadcrumbs": with_views(NODE, "SELECT tree_id, part_id, lvl, array_to_string(names, ' → ') AS breadcrumb FROM node"),
    "tree_descendant_counts": with_views(PRODUCT_NODE, "SELECT a.tree_id, a.part_id, count(*) AS n_parts, count(*) FILTER (d.has_failstate) AS n_fail, count(*) FILTER (d.is_modular) AS n_modular FROM pnode a JOIN (SELECT *, unnest(path) AS above FROM pnode) d ON d.tree_id = a.tree_id AND d.above = a.part_id GROUP BY ALL"),
    "tree_direct_children": with_views(PRODUCT_NODE, "SELECT tree_id, parent_id, part_id, name, is_modular, has_failstate, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY coalesce(name, ''), part_id)::INT AS pos FROM pnode WHERE parent_id IS NOT NULL"),
    "tree_first_level": with_views(NODE, "SELECT tree_id, part_id, name, is_modular, has_failstate FROM node WHERE lvl = 1"),
    "tree_fail_counts": with_views(PRODUCT_NODE, "SELECT tree_id, count(*) AS n_parts, count(*) FILTER (has_failstate) AS n_fail, count(*) FILTER (has_failstate AND lvl <= 1) AS n_top_fail, count(*) FILTER (is_modular) AS n_modular, max(lvl) AS depth, greatest(0, count(*) - count(*) FILTER (has_failstate)) AS n_healthy FROM pnode GROUP BY ALL"),
    "failing_parts": with_views(NODE, "SELECT tree_id, part_id, name, array_to_string(names, ' → ') AS breadcrumb, array_to_string(path, '/') AS path FROM node WHERE has_failstate"),
    "tree_expanded": with_views(NODE, "SELECT tree_id, part_id, lvl, row_number() OVER (PARTITION BY tree_id ORDER BY lvl, path)::INT AS pos FROM node QUALIFY pos <= 2000"),
    "tree_layout": with_views(PRODUCT_NODE, """, leaves AS (SELECT tree_id, path, row_number() OVER (PARTITION BY tree_id ORDER BY path) AS row FROM pnode WHERE part_id NOT IN (SELECT parent_id FROM parts WHERE parent_id IS NOT NULL))
SELECT tree_id, part_id, (min(row) + max(row)) / 2.0::DOUBLE AS y FROM (SELECT tree_id, unnest(path) AS part_id, row FROM leaves) GROUP BY ALL"""),
    "linked_sub_passports": with_views([CLOSURE, PASSPORTS], """, roots AS (SELECT root_part_id, min(instance_id) AS linked_id FROM passports GROUP BY ALL)
SELECT p.instance_id, c.descendant AS part_id, t.name AS part_name, r.linked_id FROM passports p JOIN closure c ON p.root_part_id = c.ancestor AND distance > 0 JOIN roots r ON r.root_part_id = c.descendant JOIN parts t ON t.part_id = c.descendant WHERE r.linked_id <> p.instance_id"""),
    "step_category_counts": with_views(STEPS, f"SELECT tree_id, {NAME_COUNTS} FROM steps GROUP BY ALL"),
    "transport_km": with_views(STEPS, f""", sums AS (SELECT tree_id, coalesce({exact("CASE WHEN owner_kind = 'part' THEN distance_km END")}, 0) AS p, coalesce({exact("CASE WHEN owner_kind = 'material' THEN distance_km END")}, 0) AS m FROM steps GROUP BY ALL)
SELECT tree_id, {rounded('p', 3)} AS parts_km, {rounded('m', 3)} AS materials_km, {rounded('p + m', 3)} AS total_km FROM sums"""),
    "transport_km_transports_only": with_views(STEPS, f""", sums AS (SELECT tree_id, coalesce({exact("CASE WHEN owner_kind = 'part' THEN distance_km END")}, 0) AS p, coalesce({exact("CASE WHEN owner_kind = 'material' THEN distance_km END")}, 0) AS m FROM steps WHERE type = 'TransportStep' GROUP BY ALL)
SELECT tree_id, {rounded('p', 3)} AS parts_km, {rounded('m', 3)} AS materials_km, {rounded('p + m', 3)} AS total_km FROM sums"""),
    "ghg_by_scope": with_views(EMISSIONS, f"SELECT tree_id, coalesce(scope, 'Unknown') AS scope, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY ALL"),
    "ghg_by_category": with_views(EMISSIONS, f"SELECT tree_id, CASE WHEN scope = 'Scope 3' THEN coalesce(category, 'Uncategorized') ELSE 'direct' END AS category, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY 1, 2"),
    "ghg_total": with_views(EMISSIONS, f"SELECT tree_id, {rounded(exact('kg'), 3)} AS kg FROM (SELECT tree_id, scope, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY ALL) GROUP BY tree_id"),
    "ghg_sums_of_all_sizes": with_views(EMISSIONS, f""", sized AS (SELECT tree_id, quantity * [4e-9::DOUBLE, 1e11::DOUBLE, 0.1::DOUBLE][step_line % 3 + 1] AS kg FROM emissions)
SELECT tree_id, {exact('kg', bits=81)} AS kg, coalesce({exact('CASE WHEN kg <= 1e10 THEN kg END', bits=81)}, 0) AS small_kg FROM sized GROUP BY ALL"""),
    "ghg_footprint_dedup": with_views(EMISSIONS, f"SELECT t.tree_id, s.scope, {rounded('coalesce(kg, 0)', 6)} AS kg FROM (SELECT DISTINCT tree_id FROM counted) t CROSS JOIN (VALUES ('Scope 1'), ('Scope 2'), ('Scope 3')) s(scope) LEFT JOIN (SELECT tree_id, scope, {exact('kg')} AS kg FROM counted GROUP BY ALL) c ON c.tree_id = t.tree_id AND c.scope = s.scope"),
    "ghg_footprint_by_category": with_views(EMISSIONS, f"SELECT tree_id, coalesce(scope, '') AS scope, CASE WHEN scope = 'Scope 3' THEN category ELSE 'direct' END AS category, {rounded(exact('kg'), 6)} AS kg FROM counted GROUP BY 1, 2, 3"),
    "map_nodes": with_views([STEPS, PLACES], f""", seen AS (SELECT tree_id, place_id, type AS kind FROM mapped UNION ALL SELECT tree_id, dest_id, NULL FROM mapped WHERE dest_id IS NOT NULL)
SELECT tree_id, place_id, name, latitude, longitude, {MAP_COUNTS} FROM seen JOIN places USING (place_id) WHERE latitude IS NOT NULL GROUP BY ALL"""),
    "map_edges": with_views([STEPS, PLACES], f""", moves AS (SELECT tree_id, a.place_id AS source, b.place_id AS target, a.latitude AS lat1, a.longitude AS lon1, b.latitude AS lat2, b.longitude AS lon2, count(*) AS n
  FROM mapped s JOIN places a ON s.place_id = a.place_id JOIN places b ON s.dest_id = b.place_id WHERE s.type = 'TransportStep' AND a.latitude IS NOT NULL AND b.latitude IS NOT NULL GROUP BY ALL), turned AS (
  SELECT *, degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360.0::DOUBLE AS b FROM moves)
SELECT tree_id, source, target, 'transport' AS category, n, {rounded('CASE WHEN b >= 360 THEN b - 360 ELSE b END', 6)} AS bearing, (lat1 + lat2) / 2.0::DOUBLE AS mid_lat, (lon1 + lon2) / 2.0::DOUBLE AS mid_lon FROM turned"""),
    "map_totals": with_views(STEPS, f"SELECT tree_id, {MAP_COUNTS}, count(*) AS total FROM (SELECT tree_id, type AS kind FROM mapped) GROUP BY tree_id"),
    "service_bucket_totals": with_views([SERVICES, BUCKETS], "SELECT * FROM bucketed"),
    "service_rollup_ancestors": with_views([CLOSURE, SERVICES], f"SELECT instance_id, ancestor AS part_id, {exact('cost')} AS cost_eur, {kinds()}, count(*) AS n_steps FROM services JOIN closure ON target = descendant GROUP BY instance_id, ancestor"),
    "mtbf_remaining": with_views([PARTS, PASSPORTS], f"SELECT instance_id, mtbf_hrs, {MTBF} FROM passports LEFT JOIN parts ON root_part_id = part_id"),
    "mtbf_exceeded_counts": with_views([CLOSURE, PASSPORTS], ", kinds AS (SELECT ancestor, mtbf_hrs, count(*) AS n FROM closure GROUP BY ALL) SELECT instance_id, sum(n)::BIGINT AS n_parts, sum(CASE WHEN operating_hrs >= mtbf_hrs THEN n ELSE 0 END)::BIGINT AS n_exceeded, min(greatest(0.0, mtbf_hrs - operating_hrs)) AS least_remaining_hrs FROM passports JOIN kinds ON root_part_id = ancestor GROUP BY instance_id"),
    "symptom_top2_diagnoses": top2(f"floor({MICROS} / 86400000000.0::DOUBLE)"),
    "symptom_top2_fractional_days": top2(f"{MICROS} / 86400000000.0::DOUBLE"),
    "symptom_instance_counts": with_views(SYMPTOMS, "SELECT static_id, symptom, count(DISTINCT instance_id) AS n_instances, row_number() OVER (PARTITION BY static_id ORDER BY count(DISTINCT instance_id) DESC, min(seen))::INT AS pos FROM symptom_rows GROUP BY static_id, symptom"),
    "diagnosis_summary_argmax": with_views(SERVICES, """, raw AS (SELECT static_id, instance_id, diagnose, seen + i - 1 AS seen, symptoms[i] AS symptom FROM (SELECT *, unnest([1, 2]) AS i FROM tree_services)), said AS (SELECT * FROM raw WHERE symptom <> ''),
 counts AS (SELECT static_id, symptom, diagnose, count(*) AS n, min(seen) AS first FROM said GROUP BY ALL)
SELECT static_id, symptom, first(diagnose ORDER BY n DESC, first) AS most_likely, (SELECT count(DISTINCT instance_id) FROM said r WHERE r.static_id = c.static_id AND r.symptom = c.symptom) AS n_instances, any_value(total_instances) AS total_instances,
       string_agg(diagnose || '=' || n, ',' ORDER BY diagnose) AS diagnosis_counts
FROM counts c JOIN totals USING (static_id) GROUP BY static_id, symptom"""),
    "operation_totals": with_views(SERVICES, """, products AS (SELECT static_id, count(*) AS p FROM lines GROUP BY ALL), rows AS (SELECT static_id, type FROM services UNION ALL SELECT static_id, 'SecondaryValueStep' FROM services)
SELECT static_id, type, count(*) AS n, count(*) / any_value(p) AS avg_per_instance FROM rows JOIN products USING (static_id) GROUP BY static_id, type"""),
    "top10_parts_overall": top10("static_id"),
    "top10_parts_by_operation": top10("static_id, type"),
    "secondary_steps_aggregate": with_views(SERVICES, f"SELECT l.static_id, t.type, count(s.event_id) AS n, any_value(total_instances) AS total_instances FROM totals l CROSS JOIN (VALUES {', '.join(f'({t!r})' for t in TYPES)}) t(type) LEFT JOIN tree_services s ON s.static_id = l.static_id AND s.type = t.type GROUP BY ALL"),
    "secondary_entries": with_views(SERVICES, "SELECT static_id, instance_id, event_id, type, cost, diagnose, 0.0::DOUBLE AS cleaning_count, 0.0::DOUBLE AS chalk_count, 0.0::DOUBLE AS brewing_count, 0.0::DOUBLE AS grinding_count FROM tree_services"),
    "secondary_entries_true_counters": with_views(SERVICES, "SELECT static_id, instance_id, event_id, type, cost, diagnose, coalesce((o_orderkey % 13)::DOUBLE, 0) AS cleaning_count, coalesce((o_orderkey % 7)::DOUBLE, 0) AS chalk_count, coalesce((o_orderkey % 29)::DOUBLE, 0) AS brewing_count, coalesce((o_orderkey % 31)::DOUBLE, 0) AS grinding_count FROM tree_services LEFT JOIN orders ON o_orderkey = instance_id"),
    "tree_static_names": with_views([CLOSURE, STATICS], "SELECT tree_id, descendant AS part_id, max(CASE WHEN distance = 0 THEN shown END) AS name, max(CASE WHEN distance = 0 THEN shown_mtbf END) AS mtbf_hrs, string_agg(shown, ' → ' ORDER BY distance DESC) AS trail FROM closure JOIN shown_parts ON ancestor = p_partkey GROUP BY ALL"),
    "part_mtbf_static": with_views([CLOSURE, PASSPORTS, STATICS], f"SELECT instance_id, part_id, mtbf_hrs, {MTBF} FROM (SELECT instance_id, operating_hrs, descendant AS part_id, shown_mtbf AS mtbf_hrs FROM passports JOIN closure ON root_part_id = ancestor JOIN shown_parts ON descendant = p_partkey)"),
    "part_mtbf": with_views([CLOSURE, PASSPORTS], f"SELECT instance_id, descendant AS part_id, mtbf_hrs, {MTBF} FROM passports JOIN closure ON root_part_id = ancestor"),
    "part_picker": with_views(PRODUCT_NODE, "SELECT tree_id, part_id, coalesce(name, part_id::VARCHAR) AS label, row_number() OVER (PARTITION BY tree_id ORDER BY coalesce(name, part_id::VARCHAR), part_id)::INT AS pos FROM pnode"),
    "service_modular_counts": with_views([CLOSURE, SERVICES, MODULAR], "SELECT * FROM modular"),
    "service_modular_by_line": with_views([CLOSURE, SERVICES, MODULAR], "SELECT static_id, count(*) AS n_instances, " + ", ".join(f"sum({k})::BIGINT AS {k}" for k in ("repairs", "replaces", "modulars")) + ", " + ", ".join(f"{rounded(f'sum({k}) / count(*)', 2)} AS avg_{k}" for k in ("repairs", "replaces", "modulars")) + " FROM modular GROUP BY static_id"),
    "service_history": with_views(SERVICES, "SELECT instance_id, event_id, replace(replace(type, 'ServiceStep', ''), 'Step', '') AS type, nullif(cost, 0) AS cost, diagnose, array_to_string(symptoms, ',') AS symptoms, begin_at FROM services"),
    "service_history_cost": with_views(SERVICES, f"SELECT instance_id, {exact('coalesce(cost, 0)')} AS total_cost FROM services GROUP BY ALL"),
    "passport_organisations": with_views([PASSPORTS, ORGANISATIONS], "SELECT p.instance_id, m.name AS manufacturer, m.eori AS manufacturer_eori, i.name AS importer, i.url AS importer_url FROM passports p LEFT JOIN organisations m ON m.org_id = manufacturer_id LEFT JOIN organisations i ON i.org_id = importer_id"),
    "returning_places": with_views([LINES, PLACES], ", asked AS (SELECT static_id, unnest([0, 1, 2]) AS pos, unnest([static_id % 25, static_id % 7, static_id + 10]) AS of FROM listed) SELECT static_id, pos, place_id, name, latitude, longitude FROM asked JOIN places ON of = place_id"),
    "spare_parts": with_views([LINES, PARTS], ", asked AS (SELECT static_id, unnest([0, 1, 2]) AS pos, unnest([static_id, static_id * 3, static_id + 1000000]) AS spare_id FROM listed) SELECT static_id, pos, spare_id, coalesce(name, spare_id::VARCHAR) AS name FROM asked LEFT JOIN parts ON spare_id = part_id"),
    "passport_search": with_views(PASSPORTS, "SELECT instance_id, product_name, discontinued, row_number() OVER (ORDER BY discontinued, product_name, instance_id) AS pos FROM passports WHERE contains(lower(product_name), 'urgent') OR contains(instance_id::VARCHAR, 'urgent')"),
    "passport_ages": with_views(PASSPORTS, "SELECT instance_id, greatest(0.0, floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(declared_at)) / 86400000000.0::DOUBLE)) AS age_days FROM passports"),
    "gs1_check_digit": """WITH bodies AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 12, '4') AS body FROM orders)
SELECT o_orderkey, body, ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(reverse(body), i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10)::INT AS check_digit FROM bodies""",
    "scalar_shapes": f"""SELECT c_custkey, {rounded("c_acctbal * CASE c_custkey % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1e-6::DOUBLE ELSE 1e-3::DOUBLE END", 6)} AS kg,
  CASE WHEN c_custkey < 60 THEN c_custkey || ' days' WHEN c_custkey < 365 THEN floor(c_custkey / 30.0::DOUBLE + 0.5)::BIGINT || ' months' ELSE (floor(c_custkey / 365.0::DOUBLE * 10 + 0.5) / 10)::VARCHAR || ' years' END AS age,
  least(100.0, greatest(0.0, floor(c_acctbal / 5000.0::DOUBLE * 100 + 0.5))) AS percent FROM customer""",
    "validation_rejects": with_views(ORGANISATIONS, """, checked AS (SELECT org_id, type, CASE WHEN regexp_extract(org_id, '[0-9]+')::INT % 7 = 0 THEN 'DE1' ELSE eori END AS eori FROM organisations)
SELECT org_id, concat_ws(',', CASE WHEN eori = 'DE1' THEN 'eori' END, CASE WHEN type <> 'Manufacturer' THEN 'manufacturer' END) AS reasons FROM checked WHERE eori = 'DE1' OR type <> 'Manufacturer'"""),
    "validation_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) AS n, 'unique' AS reasons FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "validation_passports": """WITH judged AS (
  SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 19 = 0 THEN 'sgtin' END, CASE WHEN o_orderkey % 40 = 0 THEN 'timeline' END, CASE WHEN o_orderkey % 13 = 0 THEN 'cleaning_count' END,
    CASE WHEN o_orderkey % 17 = 0 THEN 'chalk_count' END, CASE WHEN o_custkey % 53 NOT IN (SELECT o_custkey % 50 FROM orders) THEN 'line' END,
    CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 27 NOT IN (SELECT n_nationkey FROM nation) THEN 'location' END) AS reasons FROM orders
) SELECT o_orderkey, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL""",
    "validation_steps": with_views(STEPS, """, judged AS (
  SELECT tree_id, concat_ws(',', CASE WHEN part_id = 7 OR place_id NOT IN (SELECT n_nationkey FROM nation) THEN 'place' END, CASE WHEN part_id = 0 THEN 'cost' END,
    CASE WHEN dest_id IS NOT NULL AND (distance_km > 450 OR dest_id NOT IN (SELECT n_nationkey FROM nation)) THEN 'destination' END) AS reasons FROM steps
) SELECT tree_id, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL"""),
    "validation_emissions": f"""WITH {RECORDS}, judged AS (SELECT tree_id, concat_ws(',', CASE WHEN factor < 0 THEN 'factor' END, CASE WHEN quantity < 0 THEN 'quantity' END) AS reasons FROM records)
SELECT tree_id, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL""",
    "validation_steps_with_records": f"""WITH {RECORDS}, bad AS (SELECT DISTINCT tree_id, l_partkey, l_linenumber FROM records WHERE factor < 0 OR quantity < 0)
SELECT l.l_orderkey AS tree_id, 'emissions' AS reasons, count(*) AS n FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
SEMI JOIN bad b ON l.l_orderkey = b.tree_id AND l.l_partkey = b.l_partkey AND l.l_linenumber = b.l_linenumber GROUP BY ALL""",
    "validation_transport": "SELECT 'M' || s_suppkey AS org_id, 'transport_number' AS reasons, 1::BIGINT AS n FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 6",
    "validation_lines": with_views([LINES, ORGANISATIONS], """, asked AS (
  SELECT static_id AS line, 'M' || static_id AS maker, CASE WHEN static_id % 2 = 0 THEN 'I' ELSE 'M' END || static_id AS operator, CASE WHEN static_id % 3 = 0 THEN CASE WHEN static_id % 5 = 0 THEN 'M' ELSE 'I' END || static_id END AS importer,
         [static_id % 25, static_id % 7, static_id + 10] AS back, [static_id, static_id * 3, static_id + 1000000] AS spares FROM listed
), judged AS (
  SELECT line, concat_ws(',', CASE WHEN line % 7 = 0 THEN 'gtin' END, CASE WHEN line < 2 THEN 'mtbf' END,
    CASE WHEN maker NOT IN (SELECT org_id FROM organisations WHERE type = 'Manufacturer') THEN 'manufacturer' END, CASE WHEN operator NOT IN (SELECT org_id FROM organisations) THEN 'operator' END,
    CASE WHEN importer IS NOT NULL AND importer NOT IN (SELECT org_id FROM organisations WHERE type = 'Importer') THEN 'importer' END,
    CASE WHEN len(list_distinct(spares)) < 3 OR NOT list_has_all((SELECT list(p_partkey) FROM part), spares) THEN 'spares' END,
    CASE WHEN len(list_distinct(back)) < 3 OR NOT list_has_all((SELECT list(n_nationkey) FROM nation), back) THEN 'returning_places' END) AS reasons FROM asked
) SELECT line, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL"""),
    "validation_material_statics": """WITH made AS (SELECT p_partkey, p_type || '/' || p_size AS name, CASE WHEN p_partkey % 41 = 0 THEN -1 ELSE p_partkey % 41 END AS maker FROM part), judged AS (
  SELECT p_partkey, concat_ws(',', CASE WHEN maker NOT IN (SELECT s_suppkey FROM supplier) THEN 'manufacturer' END, CASE WHEN count(*) OVER (PARTITION BY name, maker) > 1 THEN 'name' END) AS reasons FROM made
) SELECT p_partkey, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL""",
    "step_places": with_views([STEPS, PLACES], "SELECT tree_id, owner_kind, type, p.name AS place, p.latitude, d.name AS destination, count(*) AS n FROM steps s LEFT JOIN places p ON s.place_id = p.place_id LEFT JOIN places d ON dest_id = d.place_id GROUP BY ALL"),
    "mutation_toggle_fail": with_views(NODE, "SELECT tree_id, part_id, CASE WHEN part_id % 10 = 3 THEN NOT has_failstate ELSE has_failstate END AS has_failstate FROM node"),
    "mutation_replace_part": with_views(CLOSURE, """, asked AS (
  SELECT tree_id, part_id AS old_id, -(part_id * 2 + again) - 1 AS new_id, (part_id * 7919) % 100003 * 2 + again AS seq, parent_id, lvl, path
  FROM (SELECT *, unnest(CASE WHEN part_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS again FROM node WHERE part_id % 7 = 3)
), judged AS (
  SELECT *, parent_id IS NULL AS is_root, EXISTS (SELECT 1 FROM asked e WHERE e.tree_id = a.tree_id AND e.seq < a.seq AND e.parent_id IS NOT NULL AND list_contains(a.path, e.old_id)) AS gone FROM asked a
), done AS (SELECT * FROM judged WHERE NOT is_root AND NOT gone), fresh AS (
  SELECT tree_id, new_id AS part_id, parent_id, lvl, path[:-2] AS over, old_id, [new_id] AS own FROM done
  UNION ALL SELECT tree_id, new_id - 1000000, new_id, lvl + 1, path[:-2], old_id, [new_id, new_id - 1000000] FROM done
), above AS (  -- the innermost part that was taken out at or above a place
  SELECT n.tree_id, n.part_id, max_by(d.old_id, d.lvl) AS with_id FROM node n JOIN done d ON d.tree_id = n.tree_id AND list_contains(n.path, d.old_id) GROUP BY ALL
), again AS (  -- new parts that are to be swapped in turn, later
  SELECT j.*, j.new_id - 10000000000 AS newer, NOT j.is_root AND NOT j.gone AND NOT EXISTS (SELECT 1 FROM asked e WHERE e.tree_id = j.tree_id AND e.seq * 2 < j.seq * 2 + 60001 AND e.parent_id IS NOT NULL AND list_contains(j.path[:-2], e.old_id)) AS fits
  FROM judged j WHERE j.old_id % 21 = 3 AND j.new_id = -j.old_id * 2 - 1
), newest AS (
  SELECT tree_id, newer AS part_id, parent_id, lvl, path[:-2] AS over, [newer] AS own FROM again WHERE fits
  UNION ALL SELECT tree_id, newer - 1000000, newer, lvl + 1, path[:-2], [newer, newer - 1000000] FROM again WHERE fits
), put AS (
  SELECT f.tree_id, f.part_id, f.parent_id, f.lvl, f.over, f.own, g.new_id AS swapped FROM fresh f LEFT JOIN again g ON g.fits AND g.tree_id = f.tree_id AND g.new_id = f.own[1]
  UNION ALL SELECT tree_id, part_id, parent_id, lvl, over, own, NULL FROM newest
), over AS (
  SELECT f.tree_id, f.part_id, max_by(d.old_id, d.lvl) AS with_id FROM put f JOIN done d ON d.tree_id = f.tree_id AND list_contains(f.over, d.old_id) GROUP BY ALL
), ended AS (SELECT f.*, coalesce(f.swapped, o.with_id) AS with_id FROM put f LEFT JOIN over o ON o.tree_id = f.tree_id AND o.part_id = f.part_id)
SELECT 'kept' AS kind, tree_id, part_id, parent_id, lvl, array_to_string(path, '/') AS path, NULL::VARCHAR AS note FROM node n WHERE NOT EXISTS (SELECT 1 FROM above a WHERE a.tree_id = n.tree_id AND a.part_id = n.part_id)
UNION ALL SELECT 'detached', n.tree_id, n.part_id, n.parent_id, n.lvl, array_to_string(n.path, '/'), with_id::VARCHAR FROM node n JOIN above a ON a.tree_id = n.tree_id AND a.part_id = n.part_id
UNION ALL SELECT CASE WHEN with_id IS NULL THEN 'kept' ELSE 'detached' END, tree_id, part_id, parent_id, lvl, array_to_string(list_concat(over, own), '/'), with_id::VARCHAR FROM ended
UNION ALL SELECT 'failed', tree_id, new_id, NULL, NULL, NULL, 'no such part' FROM again WHERE NOT fits
UNION ALL SELECT 'failed', tree_id, old_id, NULL, NULL, NULL, CASE WHEN is_root THEN 'root cannot be replaced' ELSE 'no such part' END FROM judged WHERE is_root OR gone"""),
    "mutation_graft": with_views(NODE, """, asked AS (
  SELECT n.tree_id, n.part_id AS parent_id, n.lvl, n.path, CASE WHEN n.part_id % 60 = 7 THEN n.path[1] ELSE n.part_id + 1 END AS child_id FROM node n WHERE n.part_id % 30 = 7
), judged AS (
  SELECT a.*, c.path AS child_path, CASE WHEN c.part_id IS NULL THEN 'no such part' WHEN c.parent_id = a.parent_id THEN 'already a child' WHEN list_contains(a.path, a.child_id) THEN 'would be below itself' END AS reason
  FROM asked a LEFT JOIN node c ON c.part_id = a.child_id
)
SELECT tree_id, part_id, parent_id, lvl, array_to_string(path, '/') AS path, NULL::VARCHAR AS reason FROM node
UNION ALL SELECT j.tree_id, n.part_id, CASE WHEN n.part_id = j.child_id THEN j.parent_id ELSE n.parent_id END, j.lvl + 1 + n.lvl - (len(j.child_path) - 1), array_to_string(list_concat(j.path, n.path[len(j.child_path):]), '/'), NULL
  FROM judged j JOIN node n ON list_contains(n.path, j.child_id) WHERE j.reason IS NULL
UNION ALL SELECT tree_id, child_id, parent_id, NULL, NULL, reason FROM judged WHERE reason IS NOT NULL"""),
    "mutation_recycle": with_views(SERVICES, "SELECT static_id, instance_id, instance_id IN (SELECT instance_id FROM services WHERE type = 'RecyclingStep' AND cost > 50) AS discontinued FROM lines"),
    "mutation_recycle_failed": with_views(SERVICES, "SELECT event_id, instance_id, 'no such product' AS reason FROM services WHERE type = 'RecyclingStep' AND cost > 50 AND instance_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"),
    "mutation_add_spare": with_views(LINES, "SELECT static_id, concat_ws(',', static_id, static_id * 3, static_id + 1000000, CASE WHEN static_id + 7 NOT IN (static_id, static_id * 3, static_id + 1000000) THEN static_id + 7 END) AS spare_ids FROM listed"),
    "jsonld_place": with_views(PLACES, f"""SELECT place_id, '{CONTEXT}"@type":"schema:Place","@id":"' || place_id || '","schema:name":' || {text('name')} || {identifier("schema:identifier", "GLN", "place_id")}
  || ',"schema:address":{{"@type":"schema:PostalAddress","addressCountry":' || {text('name')} || ',"postalCode":"' || lpad(place_id::VARCHAR, 5, '0') || '"}},"schema:geo":{{"@type":"schema:GeoCoordinates"'
  || coalesce(',"schema:latitude":' || latitude || ',"schema:longitude":' || longitude, '') || '}},"dpp:managedBy":{{"@type":"schema:Organisation","@id":"R' || r_regionkey || '","schema:name":' || {text('r_name')}
  || {identifier("schema:identifier", "GLN", "'R' || r_regionkey")} || ',"dpp:subtype":"Operator","schema:additionalType":"dpp:Operator"}}}}' AS json FROM places JOIN region ON managed_by = r_regionkey"""),
    "jsonld_organisation": f"""SELECT org_id, '{CONTEXT}"@type":"schema:Organisation","@id":"' || org_id || '","schema:name":' || {text('name')} || coalesce(',"schema:alternateName":' || {text('trade_name')}, '') || ',"schema:url":"' || url || '"'
  || {identifier("schema:identifier", "GLN", "org_id")} || {identifier("dpp:eoriNumber", "EORI", "eori")} || {identifier("dpp:lucidNumber", "LUCID", "lucid")} || ',"dpp:subtype":"' || type || '","schema:additionalType":"dpp:' || type || '"}}' AS json FROM (
  SELECT 'M' || s_suppkey AS org_id, s_name AS name, NULL AS trade_name, 'Manufacturer' AS type, 'https://s' || s_suppkey || '.example' AS url, 'DE' || lpad(s_suppkey::VARCHAR, 10, '0') AS eori, CASE WHEN s_suppkey % 2 = 0 THEN 'DE' || lpad(s_suppkey::VARCHAR, 20, '0') END AS lucid FROM supplier
  UNION ALL SELECT 'I' || c_custkey, c_name, 'T ' || c_name, 'Importer', 'https://c' || c_custkey || '.example', NULL, NULL FROM customer)""",
    "jsonld_material": with_views(USES, f""", statics AS (SELECT DISTINCT p_brand || '/' || p_type AS id, p_type AS name, p_brand IN ('Brand#3', 'Brand#4') AS hazardous, p_brand IN ('Brand#1', 'Brand#2') AS rare, CASE p_brand WHEN 'Brand#3' THEN '"H302","H319"' WHEN 'Brand#4' THEN '"H319"' ELSE '' END AS w FROM part)
SELECT id AS material_static_id, '{CONTEXT}"@type":"schema:ProductModel","@id":' || {text('id')} || ',"schema:name":' || {text('name')} || ',"dpp:hazardous":' || hazardous || ',"dpp:rareEarth":' || rare || ',"dpp:warnings":[' || w || ']}}' AS json FROM statics"""),
    "jsonld_part_static": with_views(PARTS, f"""SELECT part_id, '{CONTEXT}"@type":"schema:ProductModel","@id":"' || part_id || '","schema:name":' || {text('name')} || {value("dpp:mtbf", "MTBF", "mtbf_hrs", "HRS")} || '}}' AS json FROM parts"""),
    "jsonld_service_step": with_views(SERVICES, """SELECT event_id, '{"@type":"' || CASE type WHEN 'RepairServiceStep' THEN 'schema:RepairAction' WHEN 'CleaningServiceStep' THEN 'schema:CleanAction' WHEN 'RecyclingStep' THEN 'dpp:RecyclingStep' ELSE 'schema:UpdateAction' END || '","dpp:stepType":"' || type || '"'
  || ',"startTime":"' || strftime(begin_at, '%Y-%m-%dT%H:%M:%S') || '"' || coalesce(',"priceSpecification":{"@type":"schema:PriceSpecification","schema:price":' || cost || ',"schema:priceCurrency":"EUR"}', '')
  || CASE WHEN diagnose <> '' THEN ',"dpp:diagnose":"' || diagnose || '"' ELSE '' END || ',"dpp:observedSymptoms":["' || symptoms[1] || '","' || symptoms[2] || '"]'
  || CASE type WHEN 'RepairServiceStep' THEN ',"dpp:repairedPartId":"' || target || '"' WHEN 'ReplaceServiceStep' THEN ',"dpp:replacedPartId":"' || target || '"' ELSE '' END || '}' AS json FROM services"""),
    "jsonld_line": with_views(LINES, f"SELECT static_id, '{CONTEXT}' || {LINE_NODE} AS json FROM listed"),
    "jsonld_passport": with_views([PASSPORTS, LINES], f"""SELECT instance_id, {passport_json(f"""',"isVariantOf":{{' || (SELECT {LINE_NODE.replace('static_id', 'l.static_id').replace('product_name', 'l.product_name')} FROM listed l WHERE l.static_id = p.static_id)""")} AS json FROM passports p"""),
    "jsonld_bundle": with_views([PASSPORTS, LINES], f""", products AS (SELECT static_id, string_agg({passport_json("''")}, ',' ORDER BY instance_id) AS inner_json FROM passports GROUP BY static_id)
SELECT static_id, '[{CONTEXT}' || {LINE_NODE} || ',' || inner_json || ']' AS json FROM listed JOIN products USING (static_id)"""),
    "jsonld_part_tree": with_views(NODE, nested_parts()),
    "jsonld_deep": with_views([PASSPORTS, LINES], ENTITIES + """
SELECT instance_id::VARCHAR AS id, '{"id":"' || instance_id || '","product_name":' || to_json(product_name) || ',"importer":' || coalesce(i.json, 'null') || ',"line":' || l.json || ',"manufacturer":' || coalesce(m.json, 'null') || '}' AS json
FROM passports JOIN line_json l USING (static_id) LEFT JOIN org_json i ON i.id = importer_id LEFT JOIN org_json m ON m.id = manufacturer_id"""),
    "links_reached": with_views([PASSPORTS, LINES], ENTITIES + """, hops AS (
  SELECT 'product' AS kind, instance_id::VARCHAR AS id, 'line' AS to_kind, static_id::VARCHAR AS to_id FROM passports
  UNION ALL SELECT 'product', instance_id::VARCHAR, 'organisation', unnest([manufacturer_id, importer_id]) FROM passports
  UNION ALL SELECT 'line', static_id::VARCHAR, 'place', unnest([static_id % 25, static_id % 7, static_id + 10])::VARCHAR FROM listed
  UNION ALL SELECT 'line', static_id::VARCHAR, 'part', unnest([static_id, static_id * 3, static_id + 1000000])::VARCHAR FROM listed
  UNION ALL SELECT 'place', n_nationkey::VARCHAR, 'organisation', 'R' || n_regionkey FROM nation
), walked AS (
  SELECT kind AS start_kind, id AS start_id, to_kind AS kind, to_id AS id, 1 AS depth FROM hops WHERE to_id IS NOT NULL
  UNION SELECT w.start_kind, w.start_id, h.to_kind, h.to_id, w.depth + 1 FROM walked w JOIN hops h USING (kind, id) WHERE h.to_id IS NOT NULL
) SELECT start_kind, start_id, kind, id, min(depth)::INT AS depth FROM walked GROUP BY ALL"""),
    "user_summary": with_views([CLOSURE, PASSPORTS, USES, OVERALL, STEPS, EMISSIONS], f""", t AS (SELECT ancestor, count(*) AS n_parts, count(*) FILTER (has_failstate) AS n_fail, count(*) FILTER (is_modular) AS n_modular FROM closure GROUP BY ALL),
 m AS (SELECT tree_id, {rounded('grams', 3)} AS grams, {rounded('CASE WHEN grams > 0 THEN wp / grams ELSE 0 END', 2)} AS recycled_percent, {rounded('CASE WHEN grams > 0 THEN rare_g / grams ELSE 0 END * 100.0::DOUBLE', 2)} AS rare_percent FROM overall),
 c AS (SELECT tree_id, {NAME_COUNTS.replace('AS total', 'AS steps')}, coalesce({exact("CASE WHEN owner_kind = 'part' THEN distance_km END")}, 0) + coalesce({exact("CASE WHEN owner_kind = 'material' THEN distance_km END")}, 0) AS km FROM steps GROUP BY ALL),
 g AS (SELECT tree_id, {rounded(exact('kg'), 3)} AS kg FROM (SELECT tree_id, scope, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY ALL) GROUP BY tree_id)
SELECT instance_id, static_id, root_part_id, coalesce(grams, 0) AS grams, coalesce(recycled_percent, 0) AS recycled_percent, coalesce(rare_percent, 0) AS rare_percent, coalesce(transport, 0) AS transport, coalesce(production, 0) AS production, coalesce(secondary, 0) AS secondary, coalesce(steps, 0) AS steps,
       {rounded('coalesce(km, 0)', 3)} AS total_km, coalesce(kg, 0) AS ghg_kg, coalesce(n_parts, 0) AS n_parts, coalesce(n_fail, 0) AS n_fail, coalesce(n_modular, 0) AS n_modular
FROM passports p LEFT JOIN t ON root_part_id = ancestor LEFT JOIN m ON m.tree_id = instance_id LEFT JOIN c ON c.tree_id = instance_id LEFT JOIN g ON g.tree_id = instance_id"""),
    "end_of_life_summary": with_views([CLOSURE, PASSPORTS, USES, OVERALL, SERVICES, BUCKETS], f""", t AS (SELECT ancestor, count(*) AS n_parts FROM closure GROUP BY ALL),
 b AS (SELECT tree_id, coalesce({exact('CASE WHEN rare THEN weight_g END')}, 0) AS rare_g, coalesce({exact('CASE WHEN hazardous THEN weight_g END')}, 0) AS hazardous_g FROM uses GROUP BY ALL)
SELECT p.instance_id, static_id, root_part_id, discontinued, coalesce(grams, 0) AS mass_g, coalesce(CASE WHEN grams > 0 THEN wp / grams ELSE 0 END, 0) AS recycled_percent, coalesce(CASE WHEN grams > 0 THEN o.rare_g / grams ELSE 0 END, 0) * 100.0::DOUBLE AS rare_percent,
       coalesce(b.rare_g, 0) AS rare_g, coalesce(hazardous_g, 0) AS hazardous_g, coalesce(cost_eur, 0) AS cost_eur, {', '.join(f'coalesce({k.lower()}, 0) AS {k.lower()}' for k in SERVICE_KINDS)}, coalesce(n_parts, 0) AS n_parts
FROM passports p LEFT JOIN t ON root_part_id = ancestor LEFT JOIN overall o ON o.tree_id = p.instance_id LEFT JOIN b ON b.tree_id = p.instance_id LEFT JOIN bucketed s ON s.instance_id = p.instance_id"""),
    "service_summary": with_views([CLOSURE, PASSPORTS, SERVICES, BUCKETS], f""", near AS (SELECT ancestor, count(*) FILTER (has_failstate) AS n_top_fail FROM closure WHERE distance <= 1 GROUP BY ALL)
SELECT p.instance_id, static_id, root_part_id, operating_hrs, mtbf_hrs, {MTBF}, coalesce(cost_eur, 0) AS cost_eur, {', '.join(f'coalesce({k.lower()}, 0) AS {k.lower()}' for k in SERVICE_KINDS)}, coalesce(n_top_fail, 0) AS n_top_fail
FROM passports p LEFT JOIN parts ON root_part_id = part_id LEFT JOIN near ON root_part_id = ancestor LEFT JOIN bucketed s ON s.instance_id = p.instance_id"""),
    "utility_summary": with_views([SYMPTOMS, PARTS], """, n AS (SELECT static_id, count(*) AS n_instances FROM lines GROUP BY ALL), o AS (SELECT static_id, count(*) AS operations FROM services GROUP BY ALL),
 counts AS (SELECT static_id, coalesce(name, target::VARCHAR) AS name, count(*) AS n, min(seen) AS first FROM services LEFT JOIN parts ON target = part_id GROUP BY ALL), p AS (SELECT static_id, first(name ORDER BY n DESC, first) AS top_part FROM counts GROUP BY ALL),
 y AS (SELECT static_id, symptom, count(DISTINCT instance_id) AS n, min(seen) AS first FROM symptom_rows GROUP BY ALL), z AS (SELECT static_id, first(symptom ORDER BY n DESC, first) AS top_symptom FROM y GROUP BY ALL)
SELECT static_id, n_instances, operations, operations / n_instances AS avg_per_instance, top_part, top_symptom FROM n JOIN o USING (static_id) JOIN p USING (static_id) JOIN z USING (static_id)"""),
    "user_view": with_views([CLOSURE, PASSPORTS, ORGANISATIONS, USES, OVERALL, STEPS, EMISSIONS, PLACES, LINES, LINKED, PART_TEXT, MATERIAL_TEXT], f""", m AS (
  SELECT tree_id AS of, {rounded('CASE WHEN grams > 0 THEN wp / grams ELSE 0 END', 2)} AS recycled_percent, {rounded('CASE WHEN grams > 0 THEN rare_g / grams ELSE 0 END * 100.0::DOUBLE', 2)} AS rare_percent FROM overall
), c AS (
  SELECT tree_id AS of, {NAME_COUNTS.replace('AS total', 'AS n_steps')}, coalesce({exact("CASE WHEN owner_kind = 'part' THEN distance_km END")}, 0) AS p, coalesce({exact("CASE WHEN owner_kind = 'material' THEN distance_km END")}, 0) AS m FROM steps GROUP BY ALL
), s AS (SELECT tree_id, coalesce(scope, 'Unknown') AS scope, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY ALL
), g AS (SELECT tree_id AS of, {rounded(exact('kg'), 3)} AS ghg_kg, string_agg(scope || ':' || {thousandths('kg')}, ';' ORDER BY scope) AS scopes FROM s GROUP BY ALL
), k AS (SELECT tree_id, CASE WHEN scope = 'Scope 3' THEN coalesce(category, 'Uncategorized') ELSE 'direct' END AS category, {rounded(exact('kg'), 3)} AS kg FROM emissions GROUP BY 1, 2
), h AS (SELECT tree_id AS of, string_agg(category || ':' || {thousandths('kg')}, ';' ORDER BY category) AS categories FROM k GROUP BY ALL
), b AS (SELECT static_id AS of, string_agg(name, ';' ORDER BY pos) AS returning_places FROM (SELECT static_id, unnest([0, 1, 2]) AS pos, unnest([static_id % 25, static_id % 7, static_id + 10]) AS asked FROM listed) JOIN places ON asked = place_id GROUP BY ALL
), d AS (
  SELECT static_id AS of, concat_ws(';', {', '.join(document(kind, n + 3, 'name') for n, kind in enumerate(('data_sheet', 'operating_guide', 'repair_manual', 'disassembly', 'recycling')))}) AS documents,
         {document('ce_conformity', 8, 'name')} AS ce_conformity, (static_id + 3)::DOUBLE AS weight_g, CASE WHEN static_id % 3 = 0 THEN '/images/' || static_id || '/images/' || static_id ELSE '' END AS images FROM listed
) SELECT instance_id, product_name, mo.name AS manufacturer, io.name AS importer, oo.name AS operator, (instance_id % 29)::DOUBLE AS brewing_count, coalesce(recycled_percent, 0) AS recycled_percent, coalesce(rare_percent, 0) AS rare_percent,
  coalesce(transport, 0) AS transport, coalesce(production, 0) AS production, coalesce(secondary, 0) AS secondary, coalesce(n_steps, 0) AS n_steps,
  {rounded('coalesce(c.p, 0)', 3)} AS parts_km, {rounded('coalesce(c.m, 0)', 3)} AS materials_km, {rounded('coalesce(c.p + c.m, 0)', 3)} AS total_km, coalesce(ghg_kg, 0) AS ghg_kg, coalesce(n_parts, 0) AS n_parts, coalesce(n_fail, 0) AS n_fail,
  ce_conformity, weight_g, coalesce(first_level, '') AS first_level, coalesce(materials, '') AS materials, coalesce(linked, '') AS linked, coalesce(scopes, '') AS scopes, coalesce(categories, '') AS categories,
  coalesce(returning_places, '') AS returning_places, documents, images
FROM passports x LEFT JOIN organisations mo ON mo.org_id = manufacturer_id LEFT JOIN organisations io ON io.org_id = importer_id LEFT JOIN organisations oo ON oo.org_id = 'M' || (static_id * 2)
  LEFT JOIN m ON m.of = instance_id LEFT JOIN c ON c.of = instance_id LEFT JOIN g ON g.of = instance_id LEFT JOIN h ON h.of = instance_id LEFT JOIN linked_text l ON l.of = instance_id LEFT JOIN material_text mt ON mt.of = instance_id
  LEFT JOIN part_text pt ON pt.of = root_part_id LEFT JOIN b ON b.of = static_id LEFT JOIN d ON d.of = static_id"""),
    "end_of_life_view": with_views([CLOSURE, PASSPORTS, ORGANISATIONS, USES, OVERALL, SERVICES, BUCKETS, LINKED, PART_TEXT, MATERIAL_TEXT, HELD], f"""
SELECT x.instance_id, oo.name AS operator, coalesce(grams, 0) AS grams, coalesce(CASE WHEN grams > 0 THEN wp / grams ELSE 0 END, 0) AS recycled_percent, coalesce(CASE WHEN grams > 0 THEN o.rare_g / grams ELSE 0 END, 0) * 100.0::DOUBLE AS rare_percent,
  coalesce(cost_eur, 0) AS cost_eur, {', '.join(f'coalesce({k.lower()}, 0) AS {k.lower()}' for k in SERVICE_KINDS)}, coalesce(n_parts, 0) AS n_parts, coalesce(n_fail, 0) AS n_fail,
  {document('disassembly', 6, 'url')} AS disassembly, {document('recycling', 7, 'name')} AS recycling, coalesce(first_level, '') AS first_level, coalesce(materials, '') AS materials, coalesce(linked, '') AS linked, coalesce(rare, '') AS rare, coalesce(hazardous, '') AS hazardous
FROM passports x LEFT JOIN organisations oo ON oo.org_id = 'M' || (static_id * 2) LEFT JOIN overall o ON o.tree_id = x.instance_id LEFT JOIN bucketed s ON s.instance_id = x.instance_id LEFT JOIN linked_text l ON l.of = x.instance_id
  LEFT JOIN material_text mt ON mt.of = x.instance_id LEFT JOIN held_text ht ON ht.of = x.instance_id LEFT JOIN part_text pt ON pt.of = root_part_id"""),
    "service_windows": with_views(SERVICES, f"SELECT date_trunc('day', begin_at)::TIMESTAMP AS from_at, (date_trunc('day', begin_at) + INTERVAL 1 DAY)::TIMESTAMP AS to_at, type, count(*) AS n, {exact('cost')} AS cost FROM services GROUP BY ALL"),
}
