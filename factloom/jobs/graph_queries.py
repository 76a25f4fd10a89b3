"""Queries of the graph and inventory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G, inventory as V
from ..sources.facts import fact, with_facts as _F

Q: dict = {}
O: dict = {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col


def _sql(s, d, sql, table):
    return s.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace("//", "div"), **{table: _t(s, d, table)})


_R = lambda sql, *n: _F(sql, *n).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n,", ",", 1)
# an acyclic dependency of parts, and one with cycles
_DAG = "SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0 AND p_size > 5"
_CYC = "SELECT p_partkey AS src, (p_partkey // 10) * 10 + (p_partkey * 7 + 3) % 10 AS dst FROM part WHERE p_size > 12"
_CLO = "clo(src, dst) AS (SELECT DISTINCT src, dst FROM e UNION SELECT clo.src, e.dst FROM clo JOIN e ON e.src = clo.dst)"
_add("c5_effective_outputs", lambda s, d: G.effective_outputs(_sql(s, d, _DAG, "part"), _sql(s, d, "SELECT DISTINCT p_partkey // 50 AS node FROM part WHERE p_partkey % 50 = 1", "part")), f"WITH RECURSIVE e AS ({_DAG}), k(node) AS (SELECT DISTINCT p_partkey // 50 FROM part WHERE p_partkey % 50 = 1 UNION SELECT e.src FROM k JOIN e ON e.dst = k.node) SELECT node FROM k")
_add("f1_dependency_graph", lambda s, d: G.dependency_graph(fact(s, d, "lib_edges")), _F("SELECT lower(source) AS source, lower(target) AS target, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries FROM lib_edges GROUP BY 1, 2", "lib_edges"))
_add("f2_access_graph", lambda s, d: G.access_graph(fact(s, d, "accesses"), fact(s, d, "declarations").select("var_key", c("scope").alias("owner"))), _F("SELECT module_path, scope AS owner, count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'write') AS writes, count(DISTINCT var_key) AS symbols FROM accesses JOIN declarations USING (var_key) GROUP BY ALL", "accesses", "declarations"))
_IMP = "i AS (SELECT node, (SELECT count(*) FROM e WHERE e.dst = node) AS direct, (SELECT count(*) FROM clo WHERE clo.dst = node) AS transitive FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))"
_add("f3_reverse_impact", lambda s, d: G.reverse_impact(_sql(s, d, _CYC, "part").unionByName(_sql(s, d, _DAG, "part"))), f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_CYC} UNION ALL {_DAG}) WHERE src <> dst), {_CLO}, {_IMP} FROM i")
# edges with what they carry; an edge into a node is met by every path that leads on from there
_CAR = ", cast(p_size % 4 AS bigint) AS reads, cast(p_size % 3 AS bigint) AS writes, 's' || cast(p_size % 7 AS string) AS symbol FROM part"
_CARRY = f"{_CYC.replace(' FROM part', _CAR)} UNION ALL {_DAG.replace(' FROM part', _CAR)}"
_carried = lambda s, d: _sql(s, d, _CARRY, "part").withColumn("symbols", F.array("symbol"))
_add("f3_module_impact", lambda s, d: G.reverse_impact(_carried(s, d), list_fields=("symbols",), count_fields=("reads", "writes")).withColumn("direct_symbols", F.array_join("direct_symbols", ",")).withColumn("transitive_symbols", F.array_join("transitive_symbols", ",")),
     f"""WITH RECURSIVE r AS (SELECT * FROM ({_CARRY}) WHERE src <> dst), e AS (SELECT DISTINCT src, dst FROM r), {_CLO}, {_IMP}, v AS (SELECT node, node AS at FROM i UNION SELECT dst, src FROM clo),
     w AS (SELECT v.node, v.node = v.at AS own, reads, writes, symbol FROM v JOIN r ON r.dst = v.at),
     x AS (SELECT node, sum(reads) FILTER (own)::BIGINT AS direct_reads, sum(reads)::BIGINT AS transitive_reads, sum(writes) FILTER (own)::BIGINT AS direct_writes, sum(writes)::BIGINT AS transitive_writes, string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (own) AS direct_symbols, count(DISTINCT symbol) FILTER (own) AS direct_symbols_count, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS transitive_symbols, count(DISTINCT symbol) AS transitive_symbols_count FROM w GROUP BY 1)
     SELECT node, direct, transitive, coalesce(direct_reads, 0) AS direct_reads, coalesce(transitive_reads, 0) AS transitive_reads, coalesce(direct_writes, 0) AS direct_writes, coalesce(transitive_writes, 0) AS transitive_writes,
     coalesce(direct_symbols, '') AS direct_symbols, coalesce(direct_symbols_count, 0) AS direct_symbols_count, coalesce(transitive_symbols, '') AS transitive_symbols, coalesce(transitive_symbols_count, 0) AS transitive_symbols_count FROM i LEFT JOIN x USING (node)""")
_SEL = "SELECT 'library' AS selector_kind, cast(p_partkey * 3 AS string) AS selector FROM part UNION ALL SELECT 'module', cast(p_partkey + 5 AS string) FROM part UNION ALL SELECT 'entry_file', CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand || '.s' END FROM part"
_ENT = "SELECT p_brand AS entry_file, CASE WHEN p_size % 3 = 0 THEN 'library' ELSE 'module' END AS kind, p_partkey AS node FROM part WHERE p_size % 5 < 4"
_both = lambda s, d: G.reverse_impact(_sql(s, d, _DAG, "part")).withColumn("kind", F.lit("library")).unionByName(G.reverse_impact(_sql(s, d, _CYC, "part")).withColumn("kind", F.lit("module")))
_add("f4_impact_selection", lambda s, d: G.impact_selection(_both(s, d), _sql(s, d, _SEL, "part"), _sql(s, d, _ENT, "part")),
     f"""WITH RECURSIVE e AS (SELECT DISTINCT 'library' AS kind, src, dst FROM ({_DAG}) WHERE src <> dst UNION SELECT DISTINCT 'module', src, dst FROM ({_CYC}) WHERE src <> dst), clo(kind, src, dst) AS (SELECT * FROM e UNION SELECT clo.kind, clo.src, e.dst FROM clo JOIN e ON e.src = clo.dst AND e.kind = clo.kind),
     i AS (SELECT kind, node, (SELECT count(*) FROM e WHERE e.dst = node AND e.kind = n.kind) AS direct, (SELECT count(*) FROM clo WHERE clo.dst = node AND clo.kind = n.kind) AS transitive FROM (SELECT kind, src AS node FROM e UNION SELECT kind, dst FROM e) n), q AS (SELECT DISTINCT * FROM ({_SEL})), n AS ({_ENT})
     SELECT q.*, i.kind, node, direct, transitive, NULL AS error FROM q JOIN i ON i.kind = selector_kind AND cast(node AS string) = selector
     UNION ALL SELECT q.*, i.kind, i.node, direct, transitive, NULL FROM q JOIN (SELECT DISTINCT * FROM n) n ON selector_kind = 'entry_file' AND lower(selector) = lower(entry_file) JOIN i ON i.kind = n.kind AND i.node = n.node
     UNION ALL SELECT q.*, NULL, NULL, NULL, NULL, 'unknown ' || replace(selector_kind, '_', ' ') || ' selector' FROM q WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.kind = selector_kind AND cast(node AS string) = selector) AND NOT EXISTS (SELECT 1 FROM n WHERE selector_kind = 'entry_file' AND lower(selector) = lower(entry_file))""")
# signals that flow to the half of their number, some in circles of 16; names of every class, repeated, and within type definitions
_SIG = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_partkey, (p_partkey // 16) * 16 + (p_partkey * 5 + 1) % 16 FROM part WHERE p_size % 4 = 0"
_NAM = "SELECT p_partkey AS node, CASE p_size % 12 WHEN 0 THEN 'Unit.Mes_In' || cast(p_partkey % 9 AS string) WHEN 1 THEN 'area.Sensor-' || cast(p_partkey % 5 AS string) || '.Value' WHEN 2 THEN 'Plant.Inter-lock.O' || cast(p_partkey % 3 AS string) WHEN 3 THEN 'TypeDef:Valve.' || p_type WHEN 4 THEN 'Plant.TRIP' ELSE 'n' || cast(p_partkey % 7 AS string) || '.x' END AS name FROM part"
_USES = "SELECT p_partkey AS node, 'm' || cast(p_partkey // 64 AS string) AS module FROM part WHERE p_size % 9 > 0 UNION ALL SELECT p_partkey, 'other' FROM part WHERE p_size % 17 = 0"
_add("f5_taint_traces", lambda s, d: G.taint_traces(_sql(s, d, _SIG, "part"), _sql(s, d, _NAM, "part"), _sql(s, d, _USES, "part")),
     f"""WITH RECURSIVE n AS (SELECT node, name, lower(name) AS low FROM ({_NAM}) WHERE NOT starts_with(name, 'TypeDef:')), a AS ({_SIG}), e AS (SELECT DISTINCT a.src, a.dst FROM a JOIN n x ON x.node = a.src JOIN n y ON y.node = a.dst WHERE src <> dst),
     so AS (SELECT node, CASE WHEN contains(low, 'mes_in') THEN 'mes' ELSE 'sensor' END AS source_kind FROM n WHERE (contains(low, 'mes_in') OR contains(low, 'sensor-')) AND node NOT IN (SELECT dst FROM a)), si AS (SELECT node FROM n WHERE contains(low, 'inter-lock') OR contains(low, 'trip')),
     b(sink, node, rest) AS (SELECT node, node, 0 FROM si UNION SELECT b.sink, e.src, b.rest + 1 FROM b JOIN e ON e.dst = b.node WHERE b.rest < 40), m AS (SELECT sink, node, min(rest) AS rest FROM b GROUP BY ALL),
     nx AS (SELECT x.sink, x.node, arg_min(y.node, (n.low, y.node)) AS next FROM m x JOIN e ON e.src = x.node JOIN m y ON y.sink = x.sink AND y.node = e.dst AND y.rest = x.rest - 1 JOIN n ON n.node = y.node GROUP BY ALL),
     w(source, source_kind, sink, node, hop) AS (SELECT so.node, source_kind, sink, so.node, 0 FROM so JOIN m USING (node) WHERE rest > 0 UNION ALL SELECT source, source_kind, w.sink, next, hop + 1 FROM w JOIN nx ON nx.sink = w.sink AND nx.node = w.node WHERE w.node <> w.sink),
     u AS (SELECT source, sink, count(DISTINCT module) AS modules FROM w JOIN ({_USES}) USING (node) GROUP BY ALL)
     SELECT source, source_kind, sink, max(hop) AS depth, string_agg(name, '>' ORDER BY hop) AS path, coalesce(any_value(modules), 0) AS modules, coalesce(any_value(modules), 0) > 1 AS multi_module FROM w JOIN n USING (node) LEFT JOIN u USING (source, sink) GROUP BY ALL""")
_SAFE = "SELECT var_key, CASE init_value % 4 WHEN 0 THEN 'Unit.Emergency-Stop.' || name WHEN 1 THEN name || '.Shut_Down' WHEN 2 THEN 'Pump.' || name ELSE 'E.stop.x' END AS name FROM declarations"
_add("f6_safety_traces", lambda s, d: G.safety_traces(fact(s, d, "accesses"), s.sql(_SAFE.replace("FROM declarations", "FROM {declarations}"), declarations=fact(s, d, "declarations"))),
     _F("SELECT var_key, count(DISTINCT CASE WHEN kind = 'write' THEN module_path END) AS writers, count(DISTINCT CASE WHEN kind = 'read' THEN module_path END) AS readers, count(DISTINCT module_path) > 1 AS spans_modules FROM accesses JOIN declarations USING (var_key) WHERE init_value % 4 < 2 GROUP BY 1", "accesses", "declarations"))
_BW = "SELECT p_partkey AS block, 'x' || cast(p_partkey AS string) AS var_key FROM part"
_BR = "SELECT (p_partkey // 10) * 10 + (p_partkey * 7 + 3) % 10 AS block, 'x' || cast(p_partkey AS string) AS var_key FROM part WHERE p_size > 12"
_SCC = "SELECT a.src AS node, min(a.dst) AS component FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src GROUP BY 1"
_add("f7_block_loops", lambda s, d: G.block_loops(_sql(s, d, _BW, "part"), _sql(s, d, _BR, "part")), f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_CYC}) WHERE src <> dst), {_CLO}, m AS ({_SCC}) SELECT node, component, size FROM m JOIN (SELECT component, count(*) AS size FROM m GROUP BY 1) USING (component) WHERE size >= 2")
_add("f8_dependency_cycles", lambda s, d: G.cycles(_sql(s, d, _CYC, "part")), f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_CYC})), {_CLO} {_SCC}")
_add("f8_load_order", lambda s, d: G.load_order(_sql(s, d, _DAG, "part")), f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_DAG})), w(node, level) AS (SELECT dst, 0 FROM e UNION SELECT src, 0 FROM e UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, max(level) AS level FROM w GROUP BY 1")
_IM = "SELECT 'pkg.' || p_type || '.' || p_brand AS source, 'pkg.' || CASE WHEN p_size % 3 = 0 THEN 'LARGE' ELSE 'other' END || '.' || p_brand AS target FROM part"
_LA = "SELECT DISTINCT 'pkg.' || p_type AS prefix, length(p_type) AS layer FROM part UNION SELECT DISTINCT 'pkg.' || p_type || '.Brand#1', 9 FROM part WHERE p_type = 'LARGE'"
_FO = "SELECT DISTINCT 'pkg.' || p_type AS source_prefix, 'pkg.LARGE.' || p_brand AS target_prefix FROM part WHERE p_size = 3"
_add("f9_layer_violations", lambda s, d: G.layer_violations(_sql(s, d, _IM, "part"), s.sql(_LA.replace("FROM part", "FROM {part}"), part=_t(s, d, "part")), _sql(s, d, _FO, "part")),
     f"""WITH i AS (SELECT DISTINCT * FROM ({_IM})), l AS ({_LA}), n AS (SELECT name, arg_max(layer, length(prefix)) AS layer FROM (SELECT source AS name FROM i UNION SELECT target FROM i) JOIN l ON starts_with(name || '.', prefix || '.') GROUP BY 1),
     x AS (SELECT i.*, EXISTS (SELECT 1 FROM ({_FO}) f WHERE starts_with(i.source || '.', source_prefix || '.') AND starts_with(i.target || '.', target_prefix || '.')) AS bad FROM i)
     SELECT source, target, 'forbidden' AS rule FROM x WHERE bad UNION ALL SELECT source, target, 'upward' FROM x JOIN n a ON a.name = source JOIN n b ON b.name = target WHERE NOT bad AND b.layer > a.layer""")
_T = lambda s, d: fact(s, d, "ext_tags")
_add("g1_duplicate_tags", lambda s, d: V.duplicate_tags(_T(s, d)), _F("SELECT source_kind, lower(external_tag) AS key, count(*) AS n FROM ext_tags GROUP BY ALL HAVING count(*) >= 2", "ext_tags"))
_add("g2_tag_datatype_mismatch", lambda s, d: V.tag_datatype_mismatch(_T(s, d)), _F("SELECT lower(external_tag) AS key, string_agg(DISTINCT datatype, ',' ORDER BY datatype) AS datatypes FROM ext_tags GROUP BY 1 HAVING count(DISTINCT datatype) >= 2", "ext_tags"))
_add("g3_tag_naming_drift", lambda s, d: V.tag_naming_drift(_T(s, d)), _F("SELECT 'tag|' || regexp_extract(external_tag, '[0-9]+') || '|a' AS family, string_agg(DISTINCT external_tag, ',' ORDER BY external_tag) AS spellings FROM ext_tags GROUP BY 1 HAVING count(DISTINCT external_tag) >= 2", "ext_tags"))
_add("g4_dead_tags", lambda s, d: V.dead_tags(_T(s, d), fact(s, d, "accesses").where("kind = 'write' and literal > 45").select("var_key")), _F("SELECT var_key, external_tag FROM ext_tags WHERE direction = 'outgoing' AND var_key NOT IN (SELECT var_key FROM accesses WHERE kind = 'write' AND literal > 45)", "ext_tags", "accesses"))
# lines of interface files: an order a unit, its lines headers and entries
_LN = """SELECT 'f' || cast(l_suppkey AS string) AS file, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS line_no, CASE l_linenumber WHEN 1 THEN ' [Unit u' || cast(l_partkey AS string) || '] ' WHEN 2 THEN '[OPERATION o' || cast(l_partkey AS string) || ']'
 WHEN 3 THEN '[Journal j ' || cast(l_partkey AS string) || ' ]' WHEN 4 THEN CASE WHEN l_tax > 0.06 THEN '[Other]' WHEN l_tax > 0.04 THEN '[Group]' ELSE '[Group g' || cast(l_partkey AS string) || ']' END WHEN 5 THEN CASE WHEN l_tax > 0.04 THEN ' ; note = 1' ELSE '[open = F::x:y' END WHEN 6 THEN '= ' || cast(l_partkey AS string) ELSE 'key[' || cast(l_linenumber AS string) || '] =F::P:a = b' || cast(l_partkey AS string) END AS line FROM lineitem"""
_H = lambda n: f"last_value(CASE WHEN k = {n} THEN line_no END IGNORE NULLS) OVER w AS l{n}, last_value(CASE WHEN k = {n} THEN h END IGNORE NULLS) OVER w AS h{n}"
_add("a4_icf_entries", lambda s, d: V.icf_entries(_sql(s, d, _LN, "lineitem")),
     f"""WITH x AS (SELECT file, line_no, trim(line) AS line, CASE WHEN NOT ends_with(trim(line), ']') OR contains(line, '=') THEN NULL WHEN starts_with(trim(line), '[U') THEN 1 WHEN starts_with(line, '[O') AND NOT starts_with(line, '[Ot') THEN 2 WHEN starts_with(line, '[J') THEN 3 WHEN starts_with(line, '[G') THEN 4 ELSE 5 END AS k, coalesce(trim(regexp_extract(trim(line), '^[^ ]+ (.*)\\]$', 1)), '') AS h FROM ({_LN})),
     y AS (SELECT *, {', '.join(map(_H, (1, 2, 3, 4, 5)))} FROM x WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING))
     SELECT file, line_no, h1 AS unit, CASE WHEN l2 > greatest(coalesce(l1, -1), coalesce(l5, -1)) THEN h2 END AS operation, CASE WHEN l3 > greatest(coalesce(l1, -1), coalesce(l2, -1), coalesce(l5, -1)) THEN h3 END AS journal,
     CASE WHEN l4 > greatest(coalesce(l1, -1), coalesce(l2, -1), coalesce(l3, -1), coalesce(l5, -1)) AND h4 <> '' THEN h4 END AS grp, trim(line[:instr(line, '=') - 1]) AS key, trim(line[instr(line, '=') + 1:]) AS value FROM y WHERE contains(line, '=') AND NOT starts_with(line, ';')""")
_IE = "SELECT p_partkey AS id, p_brand AS program, CASE p_size % 8 WHEN 0 THEN 'X::.' WHEN 1 THEN 'plain' WHEN 2 THEN 'F::' || p_brand || ':A.' || p_type WHEN 3 THEN lower(p_brand) || ':a.' || p_type || '.F1' WHEN 4 THEN 'T::' || p_brand || ':A.' || p_type || '.f1.x' WHEN 5 THEN 'T::' || p_brand || ':a.' || p_type || '.f1.y.z' WHEN 6 THEN p_brand || ':b.' || p_type ELSE 'F::Other:q' END AS value FROM part"
_IS = "SELECT DISTINCT 'a.' || upper(p_type) AS path, CASE WHEN p_type < 'M' THEN 'Rec' ELSE 'real' END AS datatype FROM part WHERE p_type < 'S'"
_IR = "SELECT DISTINCT 'rec' AS record_key, 'f1' AS field, 'Pair' AS datatype FROM part UNION ALL SELECT DISTINCT 'PAIR', 'X', 'real' FROM part"
_add("g5_icf_validate", lambda s, d: V.icf_validate(_sql(s, d, _IE, "part"), _sql(s, d, _IS, "part"), _sql(s, d, _IR, "part")), "SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'unparseable' WHEN 7 THEN 'program_mismatch' WHEN 6 THEN 'unresolved_path' ELSE CASE WHEN p_type >= 'S' THEN 'unresolved_path' WHEN p_size % 8 = 2 OR p_type < 'M' AND p_size % 8 < 5 THEN 'valid' ELSE 'invalid_field' END END AS status FROM part")
_CT = "SELECT p_partkey AS id, CASE WHEN p_size % 11 > 0 THEN p_type END AS unit, CASE p_size % 3 WHEN 0 THEN 'JournalData' WHEN 1 THEN 'other' END AS grp, CASE WHEN p_partkey % 2 = 0 THEN 'Opr_Id' ELSE 'cycle' END AS key, CASE WHEN p_size % 2 = 0 THEN 'a.' || lower(p_type) ELSE 'a.x' || p_type END || CASE p_partkey % 5 WHEN 0 THEN '.T.OPR_ID' WHEN 1 THEN '.my_T.opr_id' WHEN 2 THEN '.S.old_CYCLE' ELSE '.q' END AS path FROM part"
_SU = "SELECT DISTINCT 'journaldata' AS grp, 'OPR_ID' AS key, 't.OPR_ID' AS suffix FROM part UNION ALL SELECT DISTINCT 'JOURNALDATA', 'cycle', 'T.CYCLE' FROM part UNION ALL SELECT DISTINCT 'JOURNALDATA', 'cycle', 's.CYCLE' FROM part"
_add("g6_icf_context_check", lambda s, d: V.icf_context_check(_sql(s, d, _CT, "part"), _sql(s, d, _SU, "part")), "SELECT p_partkey AS id, 'unit_mismatch' AS issue FROM part WHERE p_size % 2 = 1 AND p_size % 11 > 0 UNION ALL SELECT p_partkey, 'group_mismatch' FROM part WHERE p_size % 3 = 0 AND NOT CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 IN (0, 1) ELSE p_partkey % 5 = 2 END")
_add("g7_icf_case_mismatch", lambda s, d: V.icf_case_mismatch(_sql(s, d, "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS path FROM part", "part"), _sql(s, d, "SELECT p_name AS path FROM part WHERE p_size > 10", "part")), "SELECT p_partkey AS id, upper(p_name) AS path, p_name AS spelled FROM part WHERE p_size % 2 = 1 AND p_name IN (SELECT p_name FROM part WHERE p_size > 10)")
_add("g8_icf_mixed_prefix", lambda s, d: V.icf_mixed_prefix(_sql(s, d, "SELECT p_name AS file, CASE WHEN p_size % 9 = 0 THEN 'T' ELSE 'f' END || '::P:x' AS value FROM part", "part")), "SELECT p_name AS file, 'F,T' AS prefixes FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 9 = 0) = 2")
_PR = "SELECT p_brand AS record, p_type || CASE WHEN p_size % 2 = 0 THEN '.x' ELSE '' END AS field FROM part WHERE p_size > 40"
_add("g9_icf_record_completeness", lambda s, d: V.icf_record_completeness(_sql(s, d, "SELECT p_brand AS record, 'k' AS kind FROM part", "part"), _sql(s, d, _PR, "part"), _sql(s, d, "SELECT DISTINCT 'k' AS kind, p_type AS field FROM part", "part")), "SELECT record, field FROM (SELECT DISTINCT p_brand AS record FROM part), (SELECT DISTINCT p_type AS field FROM part) EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 40")
_UD = "SELECT p_brand AS kind, 'u' || cast(p_partkey % 40 AS string) AS unit, p_size AS line_no, 'u' || cast(p_partkey % 40 AS string) || '.' || p_type AS entry FROM part WHERE p_size < 4"
_add("g10_icf_unit_drift", lambda s, d: V.icf_unit_drift(_sql(s, d, _UD, "part")), f"WITH g AS (SELECT kind, unit, string_agg(replace(entry, unit, '<unit>'), '|' ORDER BY line_no, entry) AS sig FROM ({_UD}) GROUP BY ALL), f AS (SELECT kind, min(unit) AS first_unit, arg_min(sig, unit) AS fs FROM g GROUP BY 1) SELECT kind, unit, first_unit FROM g JOIN f USING (kind) WHERE sig <> fs")
