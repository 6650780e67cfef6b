"""The canonical tables as SQL over the relational ones, for the queries' SQL."""

from __future__ import annotations

PARTS = """parts AS (
  SELECT p_partkey AS part_id, CASE WHEN p_partkey >= 8 THEN p_partkey // 8 END AS parent_id, p_name AS name, p_size % 2 = 0 AS is_modular,
         p_partkey % 17 = 0 AS has_failstate, (p_size * 1000)::DOUBLE AS mtbf_hrs FROM part
)"""
NODE = f"""{PARTS}, node AS (
  SELECT part_id AS tree_id, part_id, parent_id, 0 AS lvl, [part_id] AS path, [coalesce(name, part_id::VARCHAR)] AS names, name, is_modular, has_failstate, mtbf_hrs
  FROM parts WHERE parent_id IS NULL
  UNION ALL
  SELECT n.tree_id, p.part_id, p.parent_id, n.lvl + 1, list_append(n.path, p.part_id), list_append(n.names, coalesce(p.name, p.part_id::VARCHAR)), p.name, p.is_modular, p.has_failstate, p.mtbf_hrs
  FROM node n JOIN parts p ON p.parent_id = n.part_id
)"""
CLOSURE = f"""{NODE}, closure AS (
  SELECT tree_id, part_id AS descendant, path[i] AS ancestor, lvl - (i - 1) AS distance, has_failstate, is_modular, mtbf_hrs
  FROM (SELECT *, unnest(range(1, lvl + 2)) AS i FROM node)
)"""
#: Each product's own tree: that of its root part, which may be in other products' trees too.
PRODUCT_ONLY = """pnode AS (
  SELECT part_id AS tree_id, part_id, NULL::BIGINT AS parent_id, 0 AS lvl, [part_id] AS path, [coalesce(name, part_id::VARCHAR)] AS names, name, is_modular, has_failstate, mtbf_hrs
  FROM parts WHERE part_id IN (SELECT o_orderkey % 200 FROM orders)
  UNION ALL
  SELECT n.tree_id, p.part_id, p.parent_id, n.lvl + 1, list_append(n.path, p.part_id), list_append(n.names, coalesce(p.name, p.part_id::VARCHAR)), p.name, p.is_modular, p.has_failstate, p.mtbf_hrs
  FROM pnode n JOIN parts p ON p.parent_id = n.part_id
)"""
PRODUCT_NODE = f"{PARTS}, {PRODUCT_ONLY}"
USES = """uses AS (
  SELECT l_orderkey AS tree_id, l_partkey % 20 AS part_id, (l_partkey + l_suppkey) % 30 AS material_instance_id, p_brand || '/' || p_type AS material_static_id, p_type AS material_name,
         p_brand IN ('Brand#1', 'Brand#2') AS rare, p_brand IN ('Brand#3', 'Brand#4') AS hazardous,
         CASE WHEN p_brand = 'Brand#3' THEN ['H302', 'H319'] WHEN p_brand = 'Brand#4' THEN ['H319'] ELSE [] END AS warnings,
         l_quantity AS weight_g, l_discount * 1000.0::DOUBLE AS pct_recycled,
         CASE WHEN l_linenumber % 2 = 0 THEN (1.0::DOUBLE - l_tax) * 100.0::DOUBLE ELSE 1.0::DOUBLE - l_tax END AS purity,
         l_linenumber AS line, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_partkey AS key, l_suppkey AS supplier
  FROM lineitem JOIN part ON l_partkey = p_partkey
), once AS (
  -- each line is a visit of its part; the first visit counts, with all its materials
  SELECT * FROM uses QUALIFY row_number() OVER (PARTITION BY tree_id, part_id ORDER BY line, weight_g, price, discount, tax, key, supplier) = 1
), once_material AS (
  SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY tree_id, material_instance_id ORDER BY line, weight_g, price, discount, tax, key, supplier) = 1
)"""
EMISSIONS = """emissions AS (
  SELECT l_orderkey AS tree_id, l_partkey % 20 AS part_id, l_partkey AS step_part, l_linenumber AS step_line,
         CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Scope 1' WHEN l_returnflag = 'N' THEN 'Scope 2' WHEN l_returnflag = 'R' THEN 'Scope 3' END AS scope,
         CASE WHEN l_linenumber % 3 <> 1 THEN p_type END AS category, l_quantity AS quantity, l_tax AS factor, l_extendedprice / 1000.0::DOUBLE AS kg, l_linestatus = 'F' AND l_linenumber % 3 = 0 AS excluded
  FROM lineitem JOIN part ON l_partkey = p_partkey
), visited AS (
  -- of a part that is there several times only the first visit counts
  SELECT *, min({'line': step_line, 'key': step_part}) OVER (PARTITION BY tree_id, part_id) AS first FROM emissions
), counted AS (
  SELECT DISTINCT tree_id, step_part, step_line, scope, coalesce(category, 'Uncategorized') AS category, quantity, factor, kg FROM visited
  WHERE NOT excluded AND step_line = first.line AND step_part = first.key
)"""
STEPS = """steps AS (
  SELECT l_orderkey AS tree_id, l_partkey % 20 AS part_id, CASE WHEN l_linestatus = 'F' THEN 'material' ELSE 'part' END AS owner_kind,
         CASE l_returnflag WHEN 'A' THEN 'ProductionStep' WHEN 'N' THEN 'TransportStep' WHEN 'R' THEN 'RemanufacturingServiceStep' END AS type,
         s_nationkey AS place_id, CASE WHEN l_returnflag = 'N' THEN c_nationkey END AS dest_id,
         CASE WHEN l_returnflag = 'N' OR l_linenumber = 1 THEN l_quantity * 10.0::DOUBLE END AS distance_km, l_partkey % 2 AS lvl, l_linenumber AS line, l_partkey AS key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), mapped AS (
  -- the map walks level by level and takes each part where it meets it first
  SELECT * FROM (SELECT *, min({'lvl': lvl, 'line': line, 'key': key}) OVER (PARTITION BY tree_id, part_id) AS first FROM steps)
  WHERE lvl = first.lvl AND line = first.line AND key = first.key
)"""
PLACES = """places AS (
  SELECT n_nationkey AS place_id, n_name AS name, CASE WHEN n_nationkey <> 24 THEN (n_nationkey * 7 - 84)::DOUBLE END AS latitude,
         CASE WHEN n_nationkey <> 24 THEN (n_nationkey * 14 - 168)::DOUBLE END AS longitude, n_regionkey AS managed_by FROM nation
)"""
PASSPORTS = """passports AS (
  SELECT o_orderkey AS instance_id, o_custkey % 50 AS static_id, o_orderdate AS declared_at, o_totalprice / 10.0::DOUBLE AS operating_hrs, o_orderstatus = 'F' AS discontinued,
         o_orderkey % 200 AS root_part_id, 'Product ' || o_orderpriority AS product_name, 'M' || (o_custkey % 10) AS manufacturer_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'I' || o_custkey END AS importer_id FROM orders
)"""
ORGANISATIONS = """organisations AS (
  SELECT 'M' || s_suppkey AS org_id, s_name AS name, 'Manufacturer' AS type, 'https://s' || s_suppkey || '.example' AS url, 'DE' || lpad(s_suppkey::VARCHAR, 10, '0') AS eori FROM supplier
  UNION ALL
  SELECT 'I' || c_custkey, c_name, 'Importer', 'https://c' || c_custkey || '.example', NULL FROM customer
)"""
SERVICES = """ev AS (
  SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events
), services AS (
  SELECT event_id, user_id AS instance_id, user_id % 10 AS static_id,
         CASE event_type WHEN 'view' THEN 'CleaningServiceStep' WHEN 'click' THEN 'RepairServiceStep' WHEN 'purchase' THEN 'ReplaceServiceStep' WHEN 'signup' THEN 'RefurbishmentServiceStep' WHEN 'error' THEN 'RecyclingStep' END AS type,
         value AS cost, CASE WHEN k % 5 = 0 THEN '' ELSE 'D' || (k % 5) END AS diagnose, ['S' || (k % 7), 'S' || (k % 3)] AS symptoms, event_id % 200 AS target,
         ts AS begin_at, TIMESTAMP '2024-01-01' + to_hours(user_id) AS declared_at, user_id * 1000000000 + event_id * 10 AS seen
  FROM ev
), lines AS (SELECT o_orderkey % 10 AS static_id, o_orderkey AS instance_id, CASE WHEN o_orderkey % 11 <> 5 THEN o_orderkey % 200 END AS root_part_id FROM orders),
 totals AS (SELECT static_id, count(*) AS total_instances FROM lines GROUP BY ALL), tree_services AS (
  -- services on root parts and on parts below, of products that have a root part
  SELECT event_id, instance_id, static_id, type, cost, diagnose, symptoms, seen FROM services WHERE instance_id % 11 <> 5
  UNION ALL
  SELECT -(l_orderkey * 10 + l_linenumber), l_orderkey, l_orderkey % 10, 'RemanufacturingServiceStep', l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'D' || l_linenumber END, ['', ' S' || (l_linenumber % 3)],
         l_orderkey * 1000000000 + 900000000 + l_linenumber * 10
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey % 11 <> 5
)"""
SYMPTOMS = f"""{SERVICES}, symptom_rows AS (
  SELECT static_id, instance_id, diagnose, seen + i - 1 AS seen, symptoms[i] AS symptom FROM (SELECT *, unnest([1, 2]) AS i FROM services)
)"""


def rounded(x: str, digits: int) -> str:
    """By the C library, half to even on the exact binary value; never minus zero."""
    return f"(printf('%.{digits}f', {x})::DOUBLE + 0.0::DOUBLE)"


def exact(x: str, over: str = "", bits: int = 64) -> str:
    """A sum as whole multiples of 2 ** -bits, which these values are, rounded once: the first 59 bits or so of the total and one for the rest."""
    p = "(2.0::DOUBLE ** greatest(0, floor(log2(greatest(abs(v), 1)::DOUBLE))::INT - 58))::HUGEINT"
    near = f"list_transform([{p}], lambda p: sign(v) * (abs(v) // p * 2 + CASE WHEN abs(v) % p > 0 THEN 1 ELSE 0 END)::DOUBLE * p::DOUBLE)[1]"
    return f"(list_transform([sum((({x})::DOUBLE * {2.0 ** bits!r}::DOUBLE)::HUGEINT) {over}], lambda v: {near})[1] / {2.0 ** (bits + 1)!r}::DOUBLE)"


def with_views(views: str | list[str], body: str) -> str:
    return f"WITH RECURSIVE {views if isinstance(views, str) else ', '.join(views)}\n{body}"
