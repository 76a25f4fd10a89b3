"""Queries of the usage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources.facts import fact, with_facts

Q: dict = {}
O: dict = {}


def _add(name, query, sql):
    Q[name], O[name] = query, sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col
_A = lambda s, d: fact(s, d, "accesses")
_D = lambda s, d: fact(s, d, "declarations")


def _sql(s, d, sql, table):
    return s.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: _t(s, d, table)})


_USE = """u AS (SELECT d.*, coalesce(read, false) AS read, coalesce(written, false) AS written, coalesce(ui_read, false) AS ui_read, coalesce(non_ui_read, false) AS non_ui_read, coalesce(readers, 0) AS readers, coalesce(writers, 0) AS writers
 FROM declarations d LEFT JOIN (SELECT var_key, bool_or(kind = 'read') AS read, bool_or(kind = 'write') AS written, bool_or(kind = 'read' AND is_ui) AS ui_read, bool_or(kind = 'read' AND NOT is_ui) AS non_ui_read,
 count(DISTINCT CASE WHEN kind = 'read' THEN module_path END) AS readers, count(DISTINCT CASE WHEN kind = 'write' THEN module_path END) AS writers FROM accesses GROUP BY var_key) a USING (var_key))"""
_F = lambda sql, *n: with_facts(sql, *n)
_U = lambda sql: with_facts("", "declarations", "accesses").rstrip() + ", " + _USE + "\n" + sql

_add("c2_usage_summary", lambda s, d: U.usage_summary(_D(s, d), _A(s, d)), _U("SELECT * FROM u"))
# facts with every kind of use: accesses of nine variables in ten, by the user interface alone for some, without reads or writes for others
_MIX = "SELECT *, cast(substr(var_key, 2) AS bigint) % 10 AS k FROM accesses"
_VARIED = f"SELECT var_key, field, module_path, CASE WHEN k = 3 THEN 'write' WHEN k IN (4, 5) THEN 'read' ELSE kind END AS kind, CASE WHEN k IN (5, 8) THEN true WHEN k = 4 THEN false ELSE is_ui END AS is_ui FROM ({_MIX}) WHERE k <> 7"
_varied = lambda s, d: s.sql(_VARIED.replace("FROM accesses", "FROM {accesses}"), accesses=_A(s, d))
_BOUND = "SELECT var_key FROM declarations WHERE init_value < 20"
_EFF = "SELECT var_key FROM declarations WHERE init_value % 2 = 0"
_keys = lambda s, d, sql: s.sql(sql.replace("FROM declarations", "FROM {declarations}"), declarations=_D(s, d))
_V = lambda sql: _U(sql).replace("FROM accesses GROUP BY var_key", f"FROM ({_VARIED}) GROUP BY var_key")
_IGN = "SELECT var_key FROM declarations WHERE init_value % 7 = 0"
_FIX = "SELECT var_key FROM declarations WHERE init_value % 11 = 0"
_add("c3_classify_usage", lambda s, d: U.classify_usage(_D(s, d), _varied(s, d), _keys(s, d, _EFF), _keys(s, d, _BOUND), _keys(s, d, _IGN), _keys(s, d, _FIX)),
     _V(f"""SELECT u.*, CASE WHEN NOT (read OR written) THEN 'unused' WHEN init_value < 20 AND written AND NOT non_ui_read THEN 'procedure_status' WHEN ui_read AND NOT non_ui_read THEN 'ui_only' WHEN role = 'local' AND read AND NOT written AND NOT is_const AND init_value % 11 <> 0 THEN 'read_only_non_const'
     WHEN role = 'local' AND written AND NOT read AND init_value % 7 <> 0 THEN 'never_read' WHEN read AND written AND init_value % 2 <> 0 AND init_value >= 20 THEN 'write_without_effect' END AS issue FROM u"""))
_LINKS = "SELECT 'v' || cast(p_partkey // 10 AS string) AS parent_key, 'v' || cast(p_partkey AS string) AS child_key, CASE WHEN p_size % 2 = 0 THEN 'sub' ELSE '' END AS prefix, 9 - length(cast(p_partkey AS string)) AS level FROM part WHERE p_partkey >= 10"
_ALIAS = ("var_key", "field", "module_path", "kind", "is_ui")
_add("c4_propagate_aliases", lambda s, d: U.distinct_counts(U.propagate_aliases(_A(s, d).select(*_ALIAS).distinct(), _sql(s, d, _LINKS.replace("//", "div"), "part")), "var_key", "field", "kind"),
     _F(f""", l AS ({_LINKS}), walk AS (SELECT DISTINCT {', '.join(_ALIAS)} FROM accesses UNION
     SELECT parent_key, CASE WHEN prefix <> '' AND field <> '' THEN prefix || '.' || field ELSE prefix || field END, module_path, kind, is_ui FROM walk JOIN l ON child_key = var_key)
     SELECT var_key, field, kind, count(*) AS n FROM walk GROUP BY ALL""", "accesses").replace("\n,", ",", 1).replace("WITH ", "WITH RECURSIVE ", 1))
_REC = "SELECT DISTINCT lower(p_type) AS record_key, 'f' || cast(p_size % 3 AS string) AS field, CASE p_size % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'pair' ELSE lower(p_type) END AS datatype FROM part UNION SELECT DISTINCT 'pair', 'left' || cast(p_size % 2 AS string), 'integer' FROM part"
_LEAF = f"""rec AS ({_REC}), walk(var_key, leaf, type, seen, done) AS (SELECT var_key, '', datatype, [datatype], false FROM declarations
 UNION ALL SELECT w.var_key, CASE WHEN leaf = '' THEN field ELSE leaf || '.' || field END, r.datatype, list_append(seen, r.datatype), list_contains(seen, r.datatype) FROM walk w JOIN rec r ON r.record_key = w.type WHERE NOT w.done)"""


def _rec(s, d):
    return s.sql(_REC.replace("FROM part", "FROM {part}"), part=_t(s, d, "part"))


_recursive = lambda sql, *n: with_facts("", *n).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _LEAF + "\n" + sql
_LEAVES = "SELECT var_key, leaf, type AS datatype FROM walk w WHERE done OR NOT EXISTS (SELECT 1 FROM rec r WHERE r.record_key = w.type)"
_add("c1_expand_leaf_fields", lambda s, d: U.expand_leaf_fields(_D(s, d), _rec(s, d)), _recursive(_LEAVES, "declarations"))
_FLD = "CASE field WHEN 'a' THEN 'f0' WHEN 'a.x' THEN 'f1.left0' WHEN 'a.y' THEN 'f1.left1' WHEN 'b' THEN 'f2' ELSE field END"
# whole accesses with a low literal are told as accesses of a part, so that not every leaf is covered
_FLD6 = f"CASE WHEN field = '' AND literal <= 48 THEN 'f1' ELSE {_FLD} END"
_add("c6_field_asymmetry", lambda s, d: U.field_asymmetry(U.expand_leaf_fields(_D(s, d), _rec(s, d)), _A(s, d).withColumn("field", F.expr(_FLD6))),
     _recursive(f"""SELECT var_key, leaf, CASE WHEN r THEN 'read_never_written' ELSE 'written_never_read' END AS issue FROM (SELECT l.var_key, leaf, bool_or(kind = 'read') AS r, bool_or(kind = 'write') AS w
     FROM ({_LEAVES}) l JOIN (SELECT DISTINCT var_key, {_FLD6} AS field, kind FROM accesses) a ON a.var_key = l.var_key AND (field = '' OR starts_with(leaf || '.', field || '.')) GROUP BY ALL) WHERE r <> w""", "declarations", "accesses"))
# most accesses are of one field; a few records are accessed whole
_FLD7 = f"CASE WHEN literal > 49 AND var_key LIKE '%77' THEN '' WHEN literal > 46 AND var_key LIKE '%3' AND field <> '' THEN {_FLD} ELSE 'f0' END"
_of_record = lambda s, d: U.expand_leaf_fields(_D(s, d), _rec(s, d)).join(_D(s, d).select("var_key", F.concat("scope", F.lit("/"), "datatype").alias("record")), "var_key").select("record", "var_key", "leaf")
_add("c7_unused_record_fields", lambda s, d: U.unused_record_fields(_of_record(s, d), _A(s, d).withColumn("field", F.expr(_FLD7))),
     _recursive(f"""SELECT DISTINCT record, leaf FROM (SELECT l.*, scope || '/' || d.datatype AS record FROM ({_LEAVES}) l JOIN declarations d USING (var_key)) x
     WHERE record IN (SELECT record FROM t WHERE record NOT IN (SELECT record FROM t WHERE field = '')) AND NOT EXISTS (SELECT 1 FROM t WHERE t.record = x.record AND starts_with(x.leaf || '.', t.field || '.'))""", "declarations", "accesses").replace(", rec AS", f", t AS (SELECT DISTINCT scope || '/' || datatype AS record, {_FLD7} AS field FROM accesses JOIN declarations USING (var_key)), rec AS", 1))
_add("c8_root_access_by_module", lambda s, d: U.root_access_by_module(_A(s, d)), _F("SELECT var_key, module_path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, bool_or(field = '') AS root_level FROM accesses GROUP BY ALL", "accesses"))
_add("c9_hidden_coupling", lambda s, d: U.hidden_coupling(_A(s, d)), _F("SELECT var_key, count(DISTINCT module_path) AS modules, count(DISTINCT CASE WHEN kind = 'write' THEN module_path END) AS writers, string_agg(DISTINCT module_path, ', ' ORDER BY module_path) AS module_list FROM accesses GROUP BY 1 HAVING modules >= 2 AND writers >= 1", "accesses"))
_add("c10_high_fan_in_out", lambda s, d: U.high_fan_in_out(_A(s, d), 22), _F("SELECT var_key, count(DISTINCT CASE WHEN kind = 'read' THEN module_path END) AS readers, count(DISTINCT CASE WHEN kind = 'write' THEN module_path END) AS writers FROM accesses GROUP BY 1 HAVING readers >= 22 OR writers >= 22", "accesses"))
_LOCAL = "SELECT var_key, CASE WHEN cast(substr(var_key, 2) AS bigint) % 3 = 0 THEN 'b' ELSE field END AS field, CASE WHEN cast(substr(var_key, 2) AS bigint) % 2 = 0 THEN 'r1.g' || cast(cast(substr(var_key, 2) AS bigint) % 5 AS string) || substr(module_path, instr(module_path, '.m')) ELSE module_path END AS module_path FROM accesses"
_local = lambda s, d: s.sql(_LOCAL.replace("FROM accesses", "FROM {accesses}"), accesses=_A(s, d))
_add("c11_scope_minimization", lambda s, d: U.scope_minimization(_local(s, d), 1),
     _F("""SELECT var_key, CASE WHEN count(DISTINCT module_path) = 1 THEN min(module_path) ELSE min(string_split(module_path, '.')[1] || '.' || string_split(module_path, '.')[2]) END AS scope FROM (""" + _LOCAL + """) GROUP BY var_key
     HAVING NOT bool_or(field = '') AND count(DISTINCT string_split(module_path, '.')[1] || '.' || string_split(module_path, '.')[2]) = 1""", "accesses"))
_add("c12_duplicate_complex_types", lambda s, d: U.duplicate_complex_types(_D(s, d), _rec(s, d).where("record_key < 'p'").select(c("record_key").alias("datatype")).distinct()), _F("SELECT scope, datatype, count(*) AS n FROM declarations WHERE datatype >= 'p' GROUP BY ALL HAVING count(*) >= 2", "declarations"))
_LOC = "SELECT p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'r' || cast(p_partkey % 7 AS string) WHEN 1 THEN 'r' || cast(p_partkey % 7 AS string) || '.s' || cast(p_partkey % 14 AS string) ELSE 'r' || cast(p_partkey % 7 AS string) || '.s' || cast(p_partkey % 14 AS string) || '.t' || cast(p_partkey % 28 AS string) END AS path FROM part"
_add("c13_shadowing", lambda s, d: U.shadowing(_sql(s, d, _LOC, "part")), f"WITH l AS ({_LOC}) SELECT id, hidden_id FROM (SELECT a.id, b.id AS hidden_id, row_number() OVER (PARTITION BY a.id ORDER BY length(b.path) DESC, b.id) AS n FROM l a JOIN l b ON lower(a.name) = lower(b.name) AND starts_with(a.path, b.path || '.')) WHERE n = 1")
_add("c14_name_collisions", lambda s, d: U.name_collisions(_D(s, d)), _F("SELECT scope, lower(name) AS key FROM declarations GROUP BY ALL HAVING count(DISTINCT role) = 2", "declarations"))
_add("c15_magic_numbers", lambda s, d: U.magic_numbers(_A(s, d)), _F("SELECT literal, count(*) AS n FROM accesses WHERE kind = 'write' AND literal <> 0 GROUP BY 1", "accesses"))
_NAMED = "SELECT * REPLACE (name || CASE init_value % 4 WHEN 0 THEN 'Cmd' WHEN 1 THEN 'STATUS' WHEN 2 THEN 'Alarm' ELSE '' END AS name) FROM declarations"
_named = lambda s, d: _D(s, d).withColumn("name", F.concat("name", F.when(c("init_value") % 4 == 0, "Cmd").when(c("init_value") % 4 == 1, "STATUS").when(c("init_value") % 4 == 2, "Alarm").otherwise("")))
_add("c17_naming_role_mismatch", lambda s, d: U.naming_role_mismatch(U.usage_summary(_named(s, d), _varied(s, d)), _keys(s, d, "SELECT var_key FROM declarations WHERE is_state"), _keys(s, d, _BOUND)),
     _V(f"""SELECT var_key, CASE init_value % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'status' ELSE 'alarm' END AS role, CASE init_value % 4 WHEN 0 THEN 'command_as_internal_state' WHEN 1 THEN 'status_written' ELSE 'alarm_as_control_input' END AS issue
     FROM u WHERE init_value % 4 = 0 AND read AND written AND NOT is_state OR init_value % 4 = 1 AND written AND var_key NOT IN ({_BOUND}) OR init_value % 4 = 2 AND non_ui_read"""))
_add("c19_usage_trace", lambda s, d: U.usage_trace(_A(s, d)), _F("SELECT var_key, field, module_path, count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'write') AS writes, CASE WHEN writes = 0 THEN 'READ' WHEN reads = 0 THEN 'WRITE' ELSE 'READ+WRITE' END AS usage FROM accesses GROUP BY ALL", "accesses"))
_P = lambda s, d: fact(s, d, "parameters")
_add("c20_required_parameters_missing", lambda s, d: U.required_parameters_missing(_P(s, d).select("moduletype", "parameter").distinct(), _P(s, d).select("moduletype", "instance").distinct(), _P(s, d)),
     _F("SELECT i.moduletype, instance, r.parameter FROM (SELECT DISTINCT moduletype, instance FROM parameters) i JOIN (SELECT DISTINCT moduletype, parameter FROM parameters) r USING (moduletype) WHERE NOT EXISTS (SELECT 1 FROM parameters p WHERE p.instance = i.instance AND p.parameter = r.parameter)", "parameters"))
_add("c21_unknown_parameter_targets", lambda s, d: U.unknown_parameter_targets(_P(s, d), _P(s, d).where("value <> '1'").select("moduletype", "parameter").where("moduletype < 'Brand#2' or parameter = 'Size'").distinct()),
     _F("SELECT * FROM parameters p WHERE NOT EXISTS (SELECT 1 FROM parameters q WHERE q.value <> '1' AND (q.moduletype < 'Brand#2' OR q.parameter = 'Size') AND q.moduletype = p.moduletype AND q.parameter = p.parameter)", "parameters"))
_MAP = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'String' WHEN 1 THEN 'tagstring' WHEN 2 THEN 'maxstring' ELSE 'integer' END AS source_type, CASE p_partkey % 4 WHEN 0 THEN 'identstring' WHEN 1 THEN 'linestring' WHEN 2 THEN 'AnyType' ELSE 'real' END AS target_type, CASE WHEN p_size % 5 = 0 THEN p_name || p_name || p_name || p_type END AS literal, CASE p_size % 3 WHEN 0 THEN 'MinLevel' WHEN 1 THEN 'Level_MAX' ELSE 'MinMax' END AS source, CASE p_partkey % 2 WHEN 0 THEN 'maxLevel' ELSE 'Low' END AS target FROM part"
_add("c22_string_narrowing", lambda s, d: U.string_narrowing(_sql(s, d, _MAP, "part")),
     f"WITH m AS (SELECT *, CASE lower(source_type) WHEN 'string' THEN 40 WHEN 'tagstring' THEN 30 WHEN 'maxstring' THEN 140 END AS a, CASE target_type WHEN 'identstring' THEN 15 WHEN 'linestring' THEN 80 END AS b FROM ({_MAP})) SELECT id, CASE WHEN literal IS NOT NULL THEN 'literal_too_long' ELSE 'narrowing' END AS issue FROM m WHERE (literal IS NOT NULL AND length(literal) > b) OR (literal IS NULL AND a > b)")
_add("c23_min_max_crossed", lambda s, d: U.min_max_crossed(_sql(s, d, _MAP, "part"), ("min", "minimum", "low"), ("max", "maximum", "high")), f"SELECT id FROM ({_MAP}) WHERE (source = 'MinLevel' AND target = 'maxLevel') OR (source = 'Level_MAX' AND target = 'Low')")
_add("c24_contract_mismatch", lambda s, d: U.contract_mismatch(_sql(s, d, _MAP, "part")), f"SELECT id, source_type, target_type, NULL AS field FROM ({_MAP}) WHERE target_type <> 'AnyType' AND NOT (source_type <> 'integer' AND target_type <> 'real')")
# parameters of any type, handed on from owner to owner; what the innermost use, the outermost need
_DIR = "SELECT DISTINCT 'O' || cast(p_partkey % 90 AS string) AS owner, 'par' AS parameter, CASE p_size % 5 WHEN 0 THEN 'F0' WHEN 1 THEN 'f1.left0' WHEN 2 THEN 'f2' WHEN 3 THEN 'left1' ELSE 'none.x' END AS field FROM part WHERE p_partkey % 90 >= 60"
_HAND = "SELECT DISTINCT 'o' || cast(p_partkey % 90 AS string) AS owner, 'Par' AS parameter, CASE WHEN p_partkey % 4 = 0 THEN 'f1' ELSE '' END AS prefix, 'o' || cast(p_partkey % 90 + 17 AS string) AS child_owner, 'PAR' AS child_parameter FROM part WHERE p_partkey % 90 < 73 UNION ALL SELECT DISTINCT 'o5', 'par', '', 'o5', 'par' FROM part"
_ANY = "SELECT p_partkey AS id, 'o' || cast(p_partkey % 90 AS string) AS owner, 'PAR' AS target, CASE WHEN p_size % 6 = 0 THEN 'real' ELSE 'AnyType' END AS target_type, CASE WHEN p_size % 9 = 0 THEN 'Pair' ELSE p_type END AS source_type, CASE WHEN p_size % 4 = 0 THEN 'F1' ELSE '' END AS source_field FROM part"
_add("c24_anytype_contracts", lambda s, d: U.contract_mismatch(_sql(s, d, _ANY, "part"), U.anytype_requirements(_sql(s, d, _DIR, "part"), _sql(s, d, _HAND, "part")), _rec(s, d)),
     f"""WITH RECURSIVE rec AS ({_REC}), di AS ({_DIR}), li AS ({_HAND}), rq(owner, field) AS (SELECT DISTINCT lower(owner), lower(field) FROM di UNION SELECT lower(li.owner), CASE WHEN prefix = '' THEN '' ELSE lower(prefix) || '.' END || rq.field FROM rq JOIN li ON lower(child_owner) = rq.owner),
     a AS (SELECT id, source_type, target_type, rq.field, CASE WHEN source_field = '' THEN '' ELSE lower(source_field) || '.' END || rq.field AS way FROM ({_ANY}) m JOIN rq ON rq.owner = m.owner WHERE target_type = 'AnyType'),
     w(id, source_type, target_type, field, type, rest) AS (SELECT id, source_type, target_type, field, lower(source_type), string_split(way, '.') FROM a UNION ALL SELECT w.id, w.source_type, w.target_type, w.field, lower(rec.datatype), w.rest[2:] FROM w JOIN rec ON rec.record_key = w.type AND lower(rec.field) = w.rest[1] WHERE len(w.rest) > 0)
     SELECT id, source_type, target_type, NULL AS field FROM ({_ANY}) WHERE target_type = 'real' UNION ALL SELECT a.id, a.source_type, a.target_type, a.field FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.id = a.id AND w.field = a.field AND len(w.rest) = 0)""")
_CALL = "SELECT l_orderkey * 10 + l_linenumber AS site, CASE WHEN l_returnflag = 'A' THEN 'OpenFile' ELSE 'closefile' END AS function, l_linenumber % 3 AS arg_pos, 'v' || cast(l_partkey AS string) AS var_key FROM lineitem"
_SG = "SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'openfile' ELSE 'CloseFile' END AS function, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS arg_pos FROM lineitem"
_add("c16_procedure_status_ignored", lambda s, d: U.procedure_status_ignored(_sql(s, d, _CALL, "lineitem"), _sql(s, d, _SG, "lineitem"), U.usage_summary(_D(s, d), _varied(s, d))),
     _V(f"SELECT site, var_key, CASE WHEN ui_read THEN 'ui_only' ELSE 'ignored' END AS issue FROM ({_CALL}) c JOIN u USING (var_key) WHERE NOT non_ui_read AND ((function = 'OpenFile' AND arg_pos = 1) OR (function = 'closefile' AND arg_pos = 2))"))
_add("c18_record_order_dependence", lambda s, d: U.record_order_dependence(_sql(s, d, "SELECT p_brand AS record, p_partkey AS site, p_size % 7 AS pos FROM part", "part"), _sql(s, d, "SELECT DISTINCT p_brand AS record, p_size % 5 AS pos, 'f' || cast(p_size % 5 AS string) AS field FROM part", "part")),
     "SELECT record, site, field FROM (SELECT p_brand AS record, min(p_partkey) AS site, arg_min(p_size % 7, p_partkey) AS pos FROM part GROUP BY 1) LEFT JOIN (SELECT DISTINCT p_brand AS record, p_size % 5 AS pos, 'f' || (p_size % 5) AS field FROM part) USING (record, pos)")
_SYM = "SELECT DISTINCT p_brand || '.' || p_type || '.' || replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '.' ELSE '_' END) AS path FROM part"
_add("b18_search_symbols", lambda s, d: U.search_symbols(_sql(s, d, _SYM, "part"), "none.ECONOMY.red.widget", 15),
     f"SELECT path, CASE WHEN lower(path) LIKE '%.economy.red.widget' THEN 3 WHEN lower(path) LIKE '%.red.widget' THEN 2 ELSE 1 END AS rank FROM ({_SYM}) WHERE lower(path) LIKE '%.widget' ORDER BY rank DESC, len(string_split(path, '.')), path LIMIT 15")
