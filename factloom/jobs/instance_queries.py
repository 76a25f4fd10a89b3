"""Queries of the instance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import instances as I, trees as R
from ..shared import shuffled
from ..sources.facts import fact, with_facts as _F

Q: dict = {}
O: dict = {}


def _add(name, query, sql):
    Q[name], O[name] = query, sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col
_P = lambda s, d: fact(s, d, "parameters")


def _sql(s, d, sql, table="part"):
    return s.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace("//", "div"), **{table: _t(s, d, table)})


_MAPS = "SELECT 'i' || cast(p_partkey AS string) AS instance, CASE WHEN p_size % 2 = 0 THEN 'Type' ELSE 'Size' END AS parameter, CASE WHEN p_size % 3 = 0 THEN 'lit' || cast(p_size AS string) END AS literal, 'v' || cast(p_partkey * 2 AS string) AS source FROM part WHERE p_size % 4 < 3"
_add("d1_resolve_parameter_values", lambda s, d: I.resolve_parameter_values(_P(s, d).select("moduletype", "instance").distinct(), _sql(s, d, _MAPS), fact(s, d, "declarations").where("init_value > 10").select(c("var_key").alias("source"), c("init_value").cast("string").alias("init")), _P(s, d).groupBy("moduletype", "parameter").agg(F.min(F.when(c("value") < "P", c("value"))).alias("default"))),
     _F(f"""SELECT i.moduletype, i.instance, t.parameter, CASE WHEN m.instance IS NOT NULL THEN coalesce(literal, v.init) ELSE dflt END AS value,
     CASE WHEN (CASE WHEN m.instance IS NOT NULL THEN coalesce(literal, v.init) ELSE dflt END) IS NOT NULL THEN 'resolved' WHEN m.instance IS NOT NULL THEN 'unresolved_mapping' ELSE 'unknown' END AS status
     FROM (SELECT DISTINCT moduletype, instance FROM parameters) i JOIN (SELECT moduletype, parameter, min(CASE WHEN value < 'P' THEN value END) AS dflt FROM parameters GROUP BY ALL) t USING (moduletype)
     LEFT JOIN ({_MAPS}) m ON m.instance = i.instance AND m.parameter = t.parameter LEFT JOIN (SELECT var_key, cast(init_value AS string) AS init FROM declarations WHERE init_value > 10) v ON v.var_key = m.source""", "parameters", "declarations"))
_DR = "(SELECT moduletype, parameter, count(DISTINCT value) AS variants FROM parameters GROUP BY ALL HAVING count(DISTINCT instance) >= 2 AND variants >= 2)"
_add("d2_parameter_drift", lambda s, d: I.parameter_drift(_P(s, d)), _F(f"SELECT moduletype, parameter, instance, value, variants FROM parameters JOIN {_DR} USING (moduletype, parameter) WHERE value IS NOT NULL", "parameters"))
_add("d3_config_drift", lambda s, d: I.config_drift(_P(s, d)), _F(f"SELECT moduletype, parameters, instance, \"values\" FROM (SELECT moduletype, instance, string_agg(parameter || '=' || value, ',' ORDER BY parameter || '=' || value) AS \"values\" FROM parameters JOIN {_DR} USING (moduletype, parameter) GROUP BY ALL) JOIN (SELECT moduletype, string_agg(parameter, ',' ORDER BY parameter) AS parameters FROM {_DR} GROUP BY 1) USING (moduletype)", "parameters"))
# trees of four levels over the parts; leaves are missing, frames or typed here and there
_TREE = """SELECT DISTINCT 'p' || cast(p_partkey // 1024 AS string) AS program, 'Root' || cast(p_partkey // 64 AS string) AS path, 'single' AS kind FROM part
 UNION ALL SELECT DISTINCT 'p' || cast(p_partkey // 1024 AS string), 'Root' || cast(p_partkey // 64 AS string) || '.u' || cast(p_partkey // 16 % 4 AS string), CASE WHEN p_partkey // 16 % 9 = 0 THEN 'frame' ELSE 'single' END FROM part
 UNION ALL SELECT DISTINCT 'p' || cast(p_partkey // 1024 AS string), 'ROOT' || cast(p_partkey // 64 AS string) || '.U' || cast(p_partkey // 16 % 4 AS string) || '.s' || cast(p_partkey // 4 % 4 AS string), 'single' FROM part
 UNION ALL SELECT 'p' || cast(p_partkey // 1024 AS string), 'Root' || cast(p_partkey // 64 AS string) || '.u' || cast(p_partkey // 16 % 4 AS string) || '.s' || cast(p_partkey // 4 % 4 AS string) || '.T' || cast(p_partkey % 4 AS string),
 CASE WHEN p_size = 3 THEN 'frame' WHEN p_size < 6 THEN 'instance:' || p_brand ELSE 'single' END FROM part WHERE p_size > 1"""
_ITEM = """SELECT 'p' || cast(p_partkey // 1024 AS string) AS program, 'root' || cast(p_partkey // 64 AS string) || '.u' || cast(p_partkey // 16 % 4 AS string) || '.s' || cast(p_partkey // 4 % 4 AS string) || '.t' || cast(p_partkey % 4 AS string) AS path, 'parameters' AS section, 'Size' AS item, CASE WHEN p_size % 10 = 0 THEN 'b' ELSE 'a' END AS value FROM part
 UNION ALL SELECT DISTINCT 'p' || cast(p_partkey // 1024 AS string), 'root' || cast(p_partkey // 64 AS string) || '.u' || cast(p_partkey // 16 % 4 AS string) || '.s' || cast(p_partkey // 4 % 4 AS string), 'equations', 'e' || cast(p_partkey // 4 % 7 // 6 AS string), CASE WHEN p_partkey // 4 % 5 = 0 THEN NULL ELSE 'x := y' END FROM part"""
_VAR = f"""m AS (SELECT DISTINCT program, lower(path) AS path, lower(kind) AS kind, list_last(string_split(lower(path), '.')) AS name, array_to_string(list_slice(string_split(lower(path), '.'), 1, -2), '.') AS parent FROM ({_TREE.replace('//', '/+/')})),
 below(program, root, rel, path, kind) AS (SELECT program, parent, name, path, kind FROM m WHERE parent <> '' UNION ALL SELECT b.program, b.root, b.rel || '.' || m.name, m.path, m.kind FROM below b JOIN m ON m.program = b.program AND m.parent = b.path),
 st AS (SELECT program, root AS path, string_agg(rel || ':' || kind, ',' ORDER BY rel, kind) AS tree FROM below GROUP BY ALL), it AS (SELECT DISTINCT program, lower(path) AS path, section, lower(item) AS item, value FROM ({_ITEM.replace('//', '/+/')})),
 ow AS (SELECT program, path, string_agg(section || '/' || item || '=' || coalesce(value, '-'), ',' ORDER BY section, item, value) AS own FROM it GROUP BY ALL),
 va AS (SELECT program, name, tree, own, count(*) AS instances, min(path) AS first FROM m LEFT JOIN st USING (program, path) LEFT JOIN ow USING (program, path) WHERE kind = 'single' GROUP BY ALL),
 vs AS (SELECT *, count(*) OVER (PARTITION BY program, name) AS variants, row_number() OVER (PARTITION BY program, name ORDER BY first) AS variant FROM va)""".replace("/+/", "//")
_add("d4_version_drift", lambda s, d: R.version_drift(_sql(s, d, _TREE), _sql(s, d, _ITEM)),
     f"""WITH RECURSIVE {_VAR} SELECT program, name, count(DISTINCT variant) AS variants, count(*) AS instances, CASE WHEN count(DISTINCT string_split(path, '.')[1]) > 1 THEN '' WHEN count(DISTINCT path) = 1 THEN min(path) WHEN count(DISTINCT string_split(path, '.')[2]) > 1 THEN min(string_split(path, '.')[1]) WHEN count(DISTINCT string_split(path, '.')[3]) > 1 THEN min(string_split(path, '.')[1] || '.' || string_split(path, '.')[2]) ELSE 'deeper' END AS prefix
     FROM m LEFT JOIN st USING (program, path) LEFT JOIN ow USING (program, path) JOIN vs ON vs.program = m.program AND vs.name = m.name AND vs.tree IS NOT DISTINCT FROM st.tree AND vs.own IS NOT DISTINCT FROM ow.own WHERE m.kind = 'single' AND variants >= 2 GROUP BY ALL""".replace("SELECT program, name, count(DISTINCT variant)", "SELECT m.program, m.name, count(DISTINCT variant)").replace("GROUP BY ALL\"", "").replace("variants >= 2 GROUP BY ALL", "variants >= 2 GROUP BY m.program, m.name"))
_add("d5_variant_diff", lambda s, d: R.variant_diff(_sql(s, d, _TREE), _sql(s, d, _ITEM)),
     f"""WITH RECURSIVE {_VAR}, x AS (SELECT v.program, name, section, item, variant, variants, value FROM vs v JOIN it ON it.program = v.program AND it.path = first WHERE variants >= 2),
     c AS (SELECT *, (SELECT count(DISTINCT variant) FROM x y WHERE y.program = x.program AND y.name = x.name AND y.section = x.section AND y.item = x.item) AS has, (SELECT count(DISTINCT coalesce(value, '-')) FROM x y WHERE y.program = x.program AND y.name = x.name AND y.section = x.section AND y.item = x.item) AS vals FROM x),
     t AS (SELECT v.program, v.name, rel, b.kind, variant, variants FROM vs v JOIN below b ON b.program = v.program AND b.root = first WHERE variants >= 2), u AS (SELECT *, count(*) OVER (PARTITION BY program, name, rel, kind) AS has FROM t)
     SELECT program, name, section, item, CASE WHEN has < variants THEN 'only' ELSE 'modified' END AS change, variant, value FROM c WHERE has < variants OR vals > 1
     UNION ALL SELECT program, name, 'submodules', rel, 'only', variant, kind FROM u WHERE has < variants""")
_add("d6_missing_initial_values", lambda s, d: I.missing_initial_values(_P(s, d).withColumn("value", F.when(c("value") != "0", c("value"))), ("size", "value")), _F("SELECT moduletype, instance FROM parameters GROUP BY ALL HAVING NOT bool_or(parameter = 'Size' AND value <> '0')", "parameters"))
_add("d7_unsafe_defaults", lambda s, d: I.unsafe_defaults(fact(s, d, "declarations").withColumn("init_true", c("init_value") % 2 == 1), ("bypass", "enable", "red")), _F("SELECT var_key, name FROM declarations WHERE init_value % 2 = 1 AND len(list_intersect(string_split(name, ' '), ['bypass', 'enable', 'red'])) > 0", "declarations"))
_add("d8_alarm_candidates", lambda s, d: I.alarm_candidates(fact(s, d, "alarms").withColumn("tag", F.when(c("tag") != "TAG7", c("tag"))).withColumn("condition", F.when(c("condition") > "3", c("condition"))).unpivot(["instance"], ["tag", "priority", "condition"], "parameter", "value")), _F("SELECT * FROM (SELECT instance, CASE WHEN tag <> 'TAG7' THEN tag END AS tag, priority, CASE WHEN condition > '3' THEN condition END AS condition FROM alarms) WHERE tag IS NOT NULL AND (priority IS NOT NULL OR condition IS NOT NULL)", "alarms"))
_add("d8_duplicate_alarm_tags", lambda s, d: I.duplicate_alarms(fact(s, d, "alarms"), "tag"), _F("SELECT tag AS key, instance, n FROM alarms JOIN (SELECT tag, count(*) AS n FROM alarms GROUP BY 1 HAVING n >= 2) USING (tag)", "alarms"))
_add("d8_duplicate_alarm_conditions", lambda s, d: I.duplicate_alarms(fact(s, d, "alarms"), "condition"), _F("SELECT condition AS key, instance, n FROM alarms JOIN (SELECT condition, count(*) AS n FROM alarms GROUP BY 1 HAVING n >= 2) USING (condition)", "alarms"))
_add("d9_conflicting_priorities", lambda s, d: I.conflicting_priorities(fact(s, d, "alarms")), _F("SELECT 'tag' AS scope, tag AS key, instance, priority FROM alarms WHERE priority IS NOT NULL AND tag IN (SELECT tag FROM alarms GROUP BY 1 HAVING count(DISTINCT priority) >= 2) UNION ALL SELECT 'condition', condition, instance, priority FROM alarms WHERE priority IS NOT NULL AND condition IN (SELECT condition FROM alarms GROUP BY 1 HAVING count(DISTINCT priority) >= 2)", "alarms"))
_SY = "SELECT p_brand AS kind, CASE p_size % 5 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN '_' || p_name ELSE replace(p_name, ' ', '_') END AS name, p_partkey AS n FROM part"
_AW = "SELECT DISTINCT p_brand AS kind, upper(replace(p_name, ' ', '')) AS name FROM part WHERE p_size % 3 = 0"
_DEC = f"""s AS (SELECT kind, name, n, lower(name) AS key, CASE WHEN starts_with(name, '_') THEN 'unknown' WHEN name = upper(name) THEN 'upper_snake' WHEN contains(name, '_') THEN 'snake' ELSE 'lower' END AS style FROM ({_SY}) x WHERE NOT EXISTS (SELECT 1 FROM ({_AW}) w WHERE w.kind = x.kind AND lower(w.name) = lower(x.name))),
 m AS (SELECT kind, style, count(*) AS k FROM (SELECT kind, key, arg_min(style, n) AS style FROM s GROUP BY ALL) WHERE style <> 'unknown' GROUP BY ALL), r AS (SELECT kind, style, rank() OVER (PARTITION BY kind ORDER BY k DESC) AS r FROM m), w AS (SELECT kind, min(style) AS dominant FROM r WHERE r = 1 GROUP BY 1 HAVING count(*) = 1)"""
_add("d10_naming_consistency", lambda s, d: I.naming_consistency(_sql(s, d, _SY), _sql(s, d, _AW), {"Brand#1": "pascal"}), f"WITH {_DEC} SELECT kind, name, style, CASE WHEN kind = 'Brand#1' THEN 'pascal' ELSE dominant END AS dominant FROM s LEFT JOIN w USING (kind) WHERE style <> CASE WHEN kind = 'Brand#1' THEN 'pascal' ELSE dominant END")
_ND = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'step' ELSE 'transition' END AS node_type, CASE p_partkey % 4 WHEN 0 THEN 'ST_' || p_type WHEN 1 THEN 'TR_' || p_type WHEN 2 THEN NULL ELSE p_type END AS name FROM part"
_add("d11_spec_rules", lambda s, d: I.spec_rules(_sql(s, d, _ND)), f"SELECT * FROM (SELECT id, CASE WHEN node_type = 'step' AND (name IS NULL OR NOT starts_with(name, 'ST_')) THEN 'step_prefix' WHEN node_type = 'transition' AND name IS NULL THEN 'transition_unnamed' WHEN node_type = 'transition' AND NOT starts_with(name, 'TR_') THEN 'transition_prefix' END AS issue FROM ({_ND})) WHERE issue IS NOT NULL")
_EN = "SELECT p_partkey AS item, CASE p_size % 7 WHEN 0 THEN 'basepicture' WHEN 1 THEN 'frame' WHEN 2 THEN 'module' WHEN 3 THEN 'module' ELSE 'moduletype-instance' END AS module_kind, CASE WHEN p_partkey % 3 = 0 THEN 'Unit.' || p_type END AS unit_structure_path, CASE WHEN p_partkey % 5 = 0 THEN 'EM.' || p_type END AS equipment_module_structure_path, 'a.' || p_brand AS relative_module_path, p_type AS moduletype_name, p_name AS module_name FROM part"
_EV = "SELECT p_partkey AS item, 'invocation.layer' AS field, cast(p_size % 5 AS string) AS actual FROM part UNION ALL SELECT p_partkey, 'moduledef.grid', CASE WHEN p_size % 2 = 0 THEN 'fine' END FROM part WHERE p_size % 3 > 0"
_RU = """SELECT DISTINCT 'u' || p_type AS rule, 'any' AS module_kind, upper('unit.' || p_type) AS unit_structure_path, NULL AS equipment_module_structure_path, NULL AS relative_module_path, NULL AS moduletype_name, 'ignored' AS module_name FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT DISTINCT 'e' || p_type, 'frame', NULL, 'em.' || p_type, NULL, NULL, NULL FROM part UNION ALL SELECT DISTINCT 't' || p_type, 'moduletype', NULL, NULL, NULL, lower(p_type), NULL FROM part
 UNION ALL SELECT DISTINCT 'r' || p_brand, 'moduletype', NULL, NULL, 'A.' || p_brand, 'ECONOMY', NULL FROM part UNION ALL SELECT DISTINCT 'n' || p_name, 'single', NULL, '', NULL, NULL, upper(p_name) FROM part WHERE p_size < 9
 UNION ALL SELECT DISTINCT 'x' || p_brand, 'single', 'nowhere.' || p_brand, NULL, NULL, NULL, NULL FROM part UNION ALL SELECT DISTINCT 'all', 'any', NULL, NULL, NULL, NULL, NULL FROM part"""
_EX = "SELECT DISTINCT rule, 'invocation.layer' AS field, '3' AS expected FROM rules WHERE rule <> 'all' UNION ALL SELECT DISTINCT rule, 'moduledef.grid', 'fine' FROM rules WHERE left(rule, 1) IN ('u', 'n', 'a')"
_rules = lambda s, d: _sql(s, d, _RU)
_expect = lambda s, d: s.sql(_EX.replace("FROM rules", "FROM {rules}"), rules=_rules(s, d))
_SELN = "CASE WHEN coalesce(unit_structure_path, '') <> '' THEN 'unit:' || unit_structure_path WHEN coalesce(equipment_module_structure_path, '') <> '' THEN 'equipment:' || equipment_module_structure_path WHEN coalesce(relative_module_path, '') <> '' THEN 'path:' || relative_module_path ELSE coalesce(module_name, '') END"
_MET = f"""rules AS ({_RU}), named AS (SELECT *, CASE WHEN module_kind = 'moduletype' THEN 'moduletype:' || moduletype_name || '@' || {_SELN} ELSE module_kind || ':' || {_SELN} END AS name FROM rules),
 met AS (SELECT item, rule, name FROM ({_EN}) e JOIN named r ON e.module_kind <> 'basepicture' AND (r.module_kind = 'any' OR r.module_kind = CASE e.module_kind WHEN 'module' THEN 'single' WHEN 'moduletype-instance' THEN 'moduletype' ELSE e.module_kind END)
 AND (coalesce(r.unit_structure_path, '') = '' OR lower(r.unit_structure_path) = lower(e.unit_structure_path)) AND (coalesce(r.equipment_module_structure_path, '') = '' OR lower(r.equipment_module_structure_path) = lower(e.equipment_module_structure_path)) AND (coalesce(r.relative_module_path, '') = '' OR lower(r.relative_module_path) = lower(e.relative_module_path))
 AND CASE WHEN r.module_kind = 'moduletype' THEN lower(r.moduletype_name) = lower(e.moduletype_name) WHEN coalesce(r.unit_structure_path, '') <> '' OR coalesce(r.equipment_module_structure_path, '') <> '' OR coalesce(r.relative_module_path, '') <> '' OR coalesce(r.module_name, '') = '' THEN true ELSE lower(r.module_name) = lower(e.module_name) END)"""
_add("d12_graphics_rules_check", lambda s, d: I.graphics_rules_check(_sql(s, d, _EN), _sql(s, d, _EV), _rules(s, d), _expect(s, d)), f"WITH {_MET} SELECT item, name AS rule, field, expected, actual FROM met JOIN ({_EX}) USING (rule) LEFT JOIN ({_EV}) USING (item, field) WHERE actual IS DISTINCT FROM expected")
_add("d12_unmatched_rules", lambda s, d: I.unmatched_rules(_sql(s, d, _EN), _rules(s, d)), f"WITH {_MET} SELECT DISTINCT name AS rule FROM named WHERE name NOT IN (SELECT name FROM met)")
_LD = "SELECT CASE WHEN p_size % 9 = 0 THEN 'basepicture' ELSE p_type END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE upper(p_brand) END AS name, cast(p_size % 2 AS string) AS w, CASE WHEN p_partkey % 40 > 0 THEN '5' END AS h, '1' AS z FROM part"
_add("d13_layout_drift", lambda s, d: I.layout_drift(_sql(s, d, _LD), ["w", "h", "z"]), f"SELECT kind, lower(name) AS name, count(*) AS entries, field, count(DISTINCT coalesce(value, '-')) AS variants FROM (SELECT kind, name, unnest(['w', 'h', 'z']) AS field, unnest([w, h, z]) AS value FROM ({_LD}) WHERE kind <> 'basepicture') GROUP BY 1, 2, 4 HAVING variants >= 2")
_IN = "SELECT p_type AS moduletype, 'i' || cast(p_partkey AS string) AS instance, CASE WHEN p_size % 3 = 0 THEN 'Control' ELSE p_name END AS name FROM part"
_IV = "SELECT 'i' || cast(p_partkey AS string) AS instance, CASE WHEN p_size % 2 = 0 THEN 'Max_Try' ELSE 'UseSignature' END AS parameter, CASE p_size % 5 WHEN 0 THEN NULL ELSE cast(p_size % 3 * 10 AS string) END AS value, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_size % 4 = 0 THEN 'unresolved_mapping' ELSE 'unknown' END ELSE 'resolved' END AS status FROM part"
_NM = "SELECT DISTINCT upper(p_type) AS moduletype, 'Control' AS name FROM part WHERE p_type < 'M'"
_PM = "SELECT DISTINCT lower(p_type) AS moduletype, 'MAX_TRY' AS parameter, '10' AS value, true AS allowed FROM part WHERE p_type < 'P' UNION ALL SELECT DISTINCT p_type, 'useSignature', '20', false FROM part"
_add("d11_instance_rules", lambda s, d: I.instance_rules(_sql(s, d, _IN), _sql(s, d, _IV), _sql(s, d, _NM), _sql(s, d, _PM)),
     f"""WITH i AS ({_IN}), v AS ({_IV}), p AS ({_PM}) SELECT instance, 'name' AS rule, 'Control' AS expected, name AS actual FROM i WHERE moduletype < 'M' AND name <> 'Control'
     UNION ALL SELECT i.instance, 'MAX_TRY', '10', v.value FROM i LEFT JOIN v ON v.instance = i.instance AND v.parameter = 'Max_Try' WHERE moduletype < 'P' AND CASE WHEN status = 'resolved' THEN v.value <> '10' ELSE status IS DISTINCT FROM 'unresolved_mapping' END
     UNION ALL SELECT i.instance, 'useSignature', '20', v.value FROM i JOIN v ON v.instance = i.instance AND v.parameter = 'UseSignature' WHERE status = 'resolved' AND v.value = '20'""")
_add("d14_layout_overlaps", lambda s, d: I.layout_overlaps(fact(s, d, "placements")), _F("SELECT a.container, a.item, b.item AS other FROM placements a JOIN placements b ON a.container = b.container AND a.item < b.item AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.layer = b.layer", "placements"))
# modules within modules, each invocation scaled, one in three clipped
_PL = """SELECT p_partkey AS item, CASE WHEN p_partkey >= 8 THEN p_partkey // 8 END AS container, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS layer, cast(p_partkey % 8 * 3 AS double) / 4 AS x, cast(p_size % 16 AS double) / 8 AS y,
 cast(1 + p_size % 4 AS double) / 2 AS width, cast(p_partkey % 3 - 1 AS double) + 0.5 AS height, CASE WHEN p_size % 3 = 1 THEN -0.25D END AS cx0, CASE WHEN p_size % 3 = 1 THEN 0.5D END AS cy0, CASE WHEN p_size % 3 = 1 THEN 0.75D END AS cx1, CASE WHEN p_size % 3 = 1 THEN -0.5D END AS cy1 FROM part"""
_PLD = _PL.replace("D END", "::DOUBLE END")
_RECT = f"SELECT *, x + coalesce(cx0, 0) * width AS a, x + coalesce(cx1, 1) * width AS b, y + coalesce(cy0, 0) * height AS e, y + coalesce(cy1, 1) * height AS f FROM ({_PLD})"


def _nested(s, d):
    """Overlaps of siblings, with the rectangle that they share in the coordinates of the outermost container."""
    p = _sql(s, d, _PL).withColumn("container", F.coalesce("container", F.lit(-1)))
    r = R.module_rectangles(p)
    pairs = I.layout_overlaps(r)
    side = lambda x: r.select("container", c("item").alias(x), *(c(k).alias(f"{x}_{k}") for k in ("x0", "y0", "x1", "y1")))
    both = pairs.join(shuffled(side("item")), ["container", "item"]).join(shuffled(side("other")), ["container", "other"])
    frame = R.absolute_frames(p).select(c("item").alias("container"), "ox", "oy", "sx", "sy")
    x = both.join(shuffled(frame), "container", "left")
    at = lambda o, k, scale, pick: F.coalesce(c(o), F.lit(0.0)) + pick(f"item_{k}", f"other_{k}") * F.coalesce(c(scale), F.lit(1.0))
    return x.select("container", "item", "other", at("ox", "x0", "sx", F.greatest).alias("left"), at("ox", "x1", "sx", F.least).alias("right"), at("oy", "y0", "sy", F.greatest).alias("top"), at("oy", "y1", "sy", F.least).alias("bottom"))


_add("d14_nested_overlaps", _nested,
     f"""WITH RECURSIVE r AS ({_RECT}), q AS (SELECT coalesce(container, -1) AS container, item, nullif(trim(layer), '') AS layer, least(a, b) AS x0, least(e, f) AS y0, greatest(a, b) AS x1, greatest(e, f) AS y1 FROM r),
     fr(item, ox, oy, sx, sy) AS (SELECT item, x, y, width, height FROM r WHERE container IS NULL OR container NOT IN (SELECT item FROM r) UNION ALL SELECT r.item, ox + r.x * sx, oy + r.y * sy, sx * r.width, sy * r.height FROM fr JOIN r ON r.container = fr.item)
     SELECT a.container, a.item, b.item AS other, coalesce(ox, 0) + greatest(a.x0, b.x0) * coalesce(sx, 1) AS "left", coalesce(ox, 0) + least(a.x1, b.x1) * coalesce(sx, 1) AS "right", coalesce(oy, 0) + greatest(a.y0, b.y0) * coalesce(sy, 1) AS top, coalesce(oy, 0) + least(a.y1, b.y1) * coalesce(sy, 1) AS bottom
     FROM q a JOIN q b ON a.container = b.container AND a.item < b.item AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND (a.layer IS NULL OR b.layer IS NULL OR a.layer = b.layer) LEFT JOIN fr ON fr.item = a.container""")
_add("d15_dependency_version_conflicts", lambda s, d: I.dependency_version_conflicts(_sql(s, d, "SELECT p_brand AS library, p_name AS name, CASE WHEN p_size > 3 THEN p_size % 4 END AS datecode FROM part")), "SELECT lower(p_name) AS name, count(DISTINCT p_size % 4) AS versions FROM part WHERE p_size > 3 GROUP BY 1 HAVING versions >= 2 AND count(DISTINCT p_brand) >= 2")
# trees of six levels, wrappers within wrappers
_MO = """SELECT DISTINCT 'p' AS program, 'Plant' AS path, cast(NULL AS string) AS moduletype, cast(NULL AS string) AS label FROM part
 UNION ALL SELECT DISTINCT 'p', 'Plant.unit' || cast(p_partkey // 32 AS string), CASE WHEN p_partkey // 32 % 3 = 0 THEN 'Unit' END, CASE WHEN p_partkey // 32 % 3 = 0 THEN 'lib:Unit' END FROM part
 UNION ALL SELECT DISTINCT 'p', 'Plant.unit' || cast(p_partkey // 32 AS string) || '.' || CASE p_partkey // 16 % 2 WHEN 0 THEN 'L' || cast(p_partkey // 16 AS string) ELSE 'part' || cast(p_partkey // 16 AS string) END, CASE WHEN p_partkey // 16 % 5 = 0 THEN 'Panel' END, NULL FROM part
 UNION ALL SELECT DISTINCT 'p', 'Plant.unit' || cast(p_partkey // 32 AS string) || '.' || CASE p_partkey // 16 % 2 WHEN 0 THEN 'L' || cast(p_partkey // 16 AS string) ELSE 'part' || cast(p_partkey // 16 AS string) END || '.' || CASE p_partkey // 8 % 3 WHEN 0 THEN 'Display' WHEN 1 THEN 'OprFrame' ELSE 'Em_x' END || CASE WHEN p_partkey // 8 % 3 = 2 THEN cast(p_partkey // 8 AS string) ELSE '' END, NULL, NULL FROM part
 UNION ALL SELECT 'p', 'Plant.unit' || cast(p_partkey // 32 AS string) || '.' || CASE p_partkey // 16 % 2 WHEN 0 THEN 'L' || cast(p_partkey // 16 AS string) ELSE 'part' || cast(p_partkey // 16 AS string) END || '.' || CASE p_partkey // 8 % 3 WHEN 0 THEN 'Display' WHEN 1 THEN 'OprFrame' ELSE 'Em_x' END || CASE WHEN p_partkey // 8 % 3 = 2 THEN cast(p_partkey // 8 AS string) ELSE '' END || '.' || CASE p_size % 6 WHEN 0 THEN 'rp_' WHEN 1 THEN 'MES_' WHEN 2 THEN 'coordinate_' ELSE 'm' END || cast(p_partkey AS string),
 CASE p_size % 8 WHEN 0 THEN 'EquipModule' WHEN 1 THEN 'UsrPar' WHEN 2 THEN 'Marker' WHEN 3 THEN 'xEngParx' ELSE p_type END, CASE p_size % 8 WHEN 2 THEN 'lib:Marker' WHEN 4 THEN 'lib:' || p_type END FROM part"""
_RUL = "SELECT DISTINCT 'em' AS category, 'desc_label' AS match, 'marker' AS pattern FROM part UNION ALL SELECT DISTINCT 'ops', 'label', 'other:' || upper(p_type) FROM part WHERE p_type = 'LARGE' UNION ALL SELECT DISTINCT 'up', 'name', 'CONO' FROM part UNION ALL SELECT DISTINCT 'ep', 'desc_name', 'tanda' FROM part"
_PAR = "SELECT DISTINCT 'p' AS program, 'plant.unit' || cast(p_partkey // 32 AS string) || '.part' || cast(p_partkey // 16 AS string) AS path, CASE WHEN p_partkey // 16 % 3 = 0 THEN 'MediaName' ELSE 'other' END AS parameter FROM part"
_LOW = f"""m AS (SELECT DISTINCT program, lower(path) AS path, lower(coalesce(moduletype, '')) AS ty, lower(coalesce(label, moduletype, '')) AS la, list_last(string_split(lower(path), '.')) AS name, array_to_string(list_slice(string_split(lower(path), '.'), 1, -2), '.') AS parent, len(string_split(path, '.')) AS depth FROM ({_MO})),
 w AS (SELECT *, name IN {R.WRAPPERS} OR ty IN {R.WRAPPERS} OR regexp_full_match(name, 'l[0-9]+') AS wraps FROM m),
 mk AS (SELECT program, path, parent, depth, 'em' AS category FROM w WHERE la = 'lib:marker' OR la = 'marker' UNION ALL SELECT program, path, parent, depth, 'ep' FROM w WHERE contains(ty, 'tanda')),
 an AS (SELECT k.program, k.category, k.path AS mark, k.parent, arg_max(a.path, a.depth) AS anchor FROM mk k LEFT JOIN w a ON a.program = k.program AND NOT a.wraps AND a.depth BETWEEN 2 AND k.depth - 1 AND starts_with(k.path, a.path || '.') GROUP BY ALL),
 cat AS (SELECT program, path, 'em' AS category FROM w WHERE NOT wraps AND NOT contains(name, 'coordinate') AND NOT contains(ty, 'coordinate') AND (starts_with(name, 'em_') OR contains(ty, 'equipmod')) UNION SELECT program, path, 'ops' FROM w WHERE NOT wraps AND list_last(string_split(parent, '.')) = 'oprframe' AND NOT starts_with(name, 'mes_')
 UNION SELECT program, path, k FROM w, (VALUES ('rp', 'rp_', 'recpar'), ('ep', 'ep_', 'engpar'), ('up', 'up_', 'usrpar')) AS v(k, a, b) WHERE NOT wraps AND (starts_with(name, a) OR starts_with(name, b) OR contains(ty, a) OR contains(ty, b))
 UNION SELECT program, path, 'ops' FROM w WHERE list_last(string_split(la, ':')) = 'large' UNION SELECT program, path, 'up' FROM w WHERE contains(ty, 'cono') UNION SELECT program, coalesce(anchor, parent), category FROM an WHERE coalesce(anchor, parent) IN (SELECT path FROM m))"""
_add("d16_classify_modules", lambda s, d: R.classify_modules(_sql(s, d, _MO), _sql(s, d, _RUL)), f"WITH {_LOW} FROM cat")


def _units(s, d):
    from ..shared import stored

    m = _sql(s, d, _MO)
    return R.unit_roots(m, stored(R.classify_modules(m, _sql(s, d, _RUL)), "categories"), _sql(s, d, _PAR))


_add("d16_unit_roots", _units, f"WITH {_LOW} SELECT program, path FROM w WHERE NOT wraps AND path NOT IN (SELECT path FROM cat) AND EXISTS (SELECT 1 FROM cat WHERE category IN ('em', 'ops') AND starts_with(cat.path, w.path || '.')) AND (path IN (SELECT path FROM ({_PAR}) WHERE parameter = 'MediaName') OR (ty <> '' AND depth <= 3))")
_add("d17_structure_metrics", lambda s, d: I.structure_metrics(fact(s, d, "accesses").select("program", "kind")), _F("SELECT program, kind, count(*) AS n FROM accesses GROUP BY ROLLUP (program, kind)", "accesses"))
_add("d17_top_findings", lambda s, d: I.top_findings(fact(s, d, "findings").select(c("category").alias("program"), c("rule_id").alias("kind"))), _F("SELECT category AS program, rule_id AS kind, count(*) AS n FROM findings GROUP BY ALL ORDER BY n DESC, program, kind LIMIT 10", "findings"))
