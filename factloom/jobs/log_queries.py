"""Queries of the log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources.facts import fact, with_facts as _F

Q: dict = {}
O: dict = {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col
_A = lambda s, d: fact(s, d, "accesses")
_D = lambda s, d: fact(s, d, "declarations")


def _sql(s, d, sql, table):
    return s.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace("//", "div"), **{table: _t(s, d, table)})


_INIT = lambda s, d: _D(s, d).where("init_value > 40").select("var_key")
_add("e1_read_before_write", lambda s, d: L.read_before_write(_A(s, d), _INIT(s, d)), _F("SELECT module_path, var_key FROM accesses GROUP BY ALL HAVING min(seq) FILTER (kind = 'read') < coalesce(min(seq) FILTER (kind = 'write'), 9223372036854775807) AND var_key NOT IN (SELECT var_key FROM declarations WHERE init_value > 40)", "accesses", "declarations"))
# blocks within blocks within blocks: 64, 8 and 2 orders long, in branches of 16, 4 and 1
_BR = """SELECT module_path, 'w' || right(var_key, 1) AS var_key, seq, kind, parallel_id // 64 * 10 + 1 AS b1, parallel_id // 16 % 4 AS r1, parallel_id // 16 * 10 + 2 AS b2, parallel_id % 8 // 4 AS r2, parallel_id // 4 * 10 + 3 AS b3, parallel_id % 2 AS r3,
 CASE WHEN parallel_id // 64 % 2 = 1 THEN 0 WHEN parallel_id % 16 < 8 THEN 1 WHEN parallel_id % 4 < 2 THEN 2 ELSE 3 END AS depth FROM accesses"""
_BK = "SELECT DISTINCT module_path, parallel_id // 64 * 10 + 1 AS block, 4 + cast(parallel_id // 64 % 6 = 0 AS int) AS branches FROM accesses UNION ALL SELECT DISTINCT module_path, parallel_id // 16 * 10 + 2, 2 FROM accesses UNION ALL SELECT DISTINCT module_path, parallel_id // 4 * 10 + 3, 2 + cast(parallel_id // 4 % 5 = 0 AS int) FROM accesses"
_acc = lambda s, d, sql: s.sql(sql.replace("FROM accesses", "FROM {accesses}").replace("//", "div"), accesses=_A(s, d))
_guards = lambda x: x.withColumn("guard", F.slice(F.array(*(F.struct(c(f"b{k}").alias("block"), c(f"r{k}").alias("branch")) for k in (1, 2, 3))), F.lit(1), c("depth")))
_WI = lambda s, d: s.sql("SELECT 'w3' AS var_key")
# innermost first: the first sure write of each branch, then of each block that all its branches are sure of
_FOLD = f"""l AS ({_BR}), k AS ({_BK}), m3 AS (SELECT module_path, var_key, b1, r1, b2, r2, b3, r3, min(seq) AS w FROM l WHERE depth = 3 AND kind = 'write' GROUP BY ALL),
 f3 AS (SELECT x.* FROM (SELECT module_path, var_key, b1, r1, b2, r2, b3, count(*) AS n, max(w) AS w FROM m3 GROUP BY ALL) x JOIN k ON k.module_path = x.module_path AND block = b3 AND n >= branches),
 m2 AS (SELECT module_path, var_key, b1, r1, b2, r2, min(w) AS w FROM (SELECT module_path, var_key, b1, r1, b2, r2, seq AS w FROM l WHERE depth = 2 AND kind = 'write' UNION ALL SELECT module_path, var_key, b1, r1, b2, r2, w FROM f3) GROUP BY ALL),
 f2 AS (SELECT x.* FROM (SELECT module_path, var_key, b1, r1, b2, count(*) AS n, max(w) AS w FROM m2 GROUP BY ALL) x JOIN k ON k.module_path = x.module_path AND block = b2 AND n >= branches),
 m1 AS (SELECT module_path, var_key, b1, r1, min(w) AS w FROM (SELECT module_path, var_key, b1, r1, seq AS w FROM l WHERE depth = 1 AND kind = 'write' UNION ALL SELECT module_path, var_key, b1, r1, w FROM f2) GROUP BY ALL),
 f1 AS (SELECT x.* FROM (SELECT module_path, var_key, b1, count(*) AS n, max(w) AS w FROM m1 GROUP BY ALL) x JOIN k ON k.module_path = x.module_path AND block = b1 AND n >= branches),
 m0 AS (SELECT module_path, var_key, min(w) AS w FROM (SELECT module_path, var_key, seq AS w FROM l WHERE depth = 0 AND kind = 'write' UNION ALL SELECT module_path, var_key, w FROM f1) GROUP BY ALL)"""
_add("e1_read_before_write_branches", lambda s, d: L.read_before_write_branches(_guards(_acc(s, d, _BR)), _acc(s, d, _BK), _WI(s, d)),
     _F(f""", {_FOLD} SELECT DISTINCT l.module_path, l.var_key FROM l LEFT JOIN m0 USING (module_path, var_key) LEFT JOIN m1 ON l.depth >= 1 AND m1.module_path = l.module_path AND m1.var_key = l.var_key AND m1.b1 = l.b1 AND m1.r1 = l.r1
     LEFT JOIN m2 ON l.depth >= 2 AND m2.module_path = l.module_path AND m2.var_key = l.var_key AND m2.b2 = l.b2 AND m2.r2 = l.r2 LEFT JOIN m3 ON l.depth = 3 AND m3.module_path = l.module_path AND m3.var_key = l.var_key AND m3.b3 = l.b3 AND m3.r3 = l.r3
     WHERE kind = 'read' AND l.var_key <> 'w3' AND NOT coalesce(least(m0.w, m1.w, m2.w, m3.w) < l.seq, false)""", "accesses").replace("\n,", ",", 1))
_add("e2_unconsumed_writes", lambda s, d: L.unconsumed_writes(_A(s, d)), _F("SELECT module_path, var_key, max(CASE WHEN kind = 'write' THEN seq END) AS seq FROM accesses GROUP BY module_path, var_key HAVING max(CASE WHEN kind = 'write' THEN seq END) > coalesce(max(CASE WHEN kind = 'read' THEN seq END), -1)", "accesses"))
_add("e3_dead_overwrites", lambda s, d: L.dead_overwrites(_A(s, d).drop("field")), _F("SELECT module_path, var_key, seq, next_seq FROM (SELECT *, lead(kind) OVER w AS nk, lead(seq) OVER w AS next_seq FROM accesses WINDOW w AS (PARTITION BY module_path, var_key ORDER BY seq)) WHERE kind = 'write' AND nk = 'write'", "accesses"))
_W3 = "SELECT module_path, 'w' || right(var_key, 1) AS var_key, field, seq, kind FROM accesses"
_add("e3_dead_field_overwrites", lambda s, d: L.dead_overwrites(s.sql(_W3.replace("FROM accesses", "FROM {accesses}"), accesses=_A(s, d))),
     _F(f""", l AS ({_W3}), nw AS (SELECT w.module_path, w.var_key, w.field, w.seq, min(x.seq) AS next_seq FROM l w JOIN l x ON x.module_path = w.module_path AND x.var_key = w.var_key AND x.seq > w.seq AND x.kind = 'write' AND x.field IN ('', w.field) WHERE w.kind = 'write' GROUP BY ALL)
     SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM l r WHERE r.kind = 'read' AND r.module_path = nw.module_path AND r.var_key = nw.var_key AND r.seq > nw.seq AND r.seq < nw.next_seq AND (r.field = '' OR nw.field = '' OR starts_with(r.field || '.', nw.field || '.') OR starts_with(nw.field || '.', r.field || '.')))""", "accesses").replace("\n,", ",", 1))
_FLOW = "SELECT 'm' || cast(l_suppkey AS string) AS module_path, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq, 'v' || cast(l_partkey % 60 AS string) AS target, 'v' || cast((l_partkey * 7 + l_linenumber) % 60 AS string) AS source FROM lineitem"
_add("e4_initialization_order_hazards", lambda s, d: L.initialization_order_hazards(_sql(s, d, _FLOW, "lineitem"), _sql(s, d, _FLOW, "lineitem").select("module_path", "seq", c("target").alias("var_key")), _INIT(s, d)),
     _F(f", fl AS ({_FLOW}) SELECT DISTINCT f.module_path, target, source FROM fl f LEFT JOIN (SELECT module_path, target AS source, min(seq) AS w FROM fl GROUP BY ALL) x USING (module_path, source) WHERE (w IS NULL OR w >= seq) AND source NOT IN (SELECT var_key FROM declarations WHERE init_value > 40)", "declarations").replace("\n,", ",", 1))
_add("e5_dependency_chains", lambda s, d: L.dependency_chains(_sql(s, d, _FLOW, "lineitem")),
     f"""WITH RECURSIVE fl AS ({_FLOW}), p AS (SELECT a.*, b.seq AS prev FROM fl a ASOF LEFT JOIN fl b ON a.module_path = b.module_path AND a.source = b.target AND a.seq > b.seq),
     walk AS (SELECT module_path, seq, target || '<-' || source AS chain, 2 AS n FROM p WHERE prev IS NULL UNION ALL SELECT p.module_path, p.seq, p.target || '<-' || chain, n + 1 FROM walk w JOIN p ON p.module_path = w.module_path AND p.prev = w.seq)
     SELECT DISTINCT module_path, chain FROM walk WHERE n >= 3""")
_OPS = "SELECT user_id AS handle, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'acquire' ELSE 'release' END AS op FROM events"
_add("e6_resource_pairing", lambda s, d: L.resource_pairing(_sql(s, d, _OPS, "events")), f"WITH x AS (SELECT *, lag(op) OVER w AS b, lead(op) OVER w AS a FROM ({_OPS}) WINDOW w AS (PARTITION BY handle ORDER BY seq)) SELECT handle, seq, 'double_acquire' AS issue FROM x WHERE op = 'acquire' AND b = 'acquire' UNION ALL SELECT handle, seq, 'release_without_acquire' FROM x WHERE op = 'release' AND (b IS NULL OR b = 'release') UNION ALL SELECT handle, seq, 'leak' FROM x WHERE op = 'acquire' AND a IS NULL")
_add("e7_conflicting_setpoints", lambda s, d: L.conflicting_setpoints(_A(s, d)), _F("SELECT module_path, var_key, array_to_string(list_sort(list(DISTINCT literal)), ',') AS literals FROM accesses WHERE kind = 'write' GROUP BY ALL HAVING count(DISTINCT literal) >= 2", "accesses"))
_CON = "SELECT p_brand AS scope, CASE WHEN p_size % 2 = 0 THEN 'Min' || p_type ELSE p_type || '_Max' END AS name, cast(p_size AS bigint) AS value FROM part"
_WR = "SELECT p_brand AS scope, p_type AS name, cast(p_partkey % 60 AS bigint) AS literal FROM part"
_add("e8_limit_violations", lambda s, d: L.limit_violations(_sql(s, d, _WR, "part"), _sql(s, d, _CON, "part")), f"SELECT w.scope, w.name, literal, lo, hi FROM ({_WR}) w JOIN (SELECT p_brand AS scope, p_type AS name, max(p_size) FILTER (p_size % 2 = 0) AS lo, min(p_size) FILTER (p_size % 2 = 1) AS hi FROM part GROUP BY ALL) b USING (scope, name) WHERE literal < lo OR literal > hi")
# booleans of scopes of a hundred suppliers; two variables in three are named faults or alarms, some are only written
_FA = "SELECT substr(module_path, 1, 2) AS module_path, var_key, CASE cast(substr(var_key, 2) AS bigint) % 3 WHEN 0 THEN 'PumpFault' WHEN 1 THEN 'highALARM' ELSE 'Level' END AS name, cast(substr(var_key, 2) AS bigint) % 5 > 0 AS is_boolean, CASE WHEN cast(substr(var_key, 2) AS bigint) % 7 = 0 THEN 'write' ELSE kind END AS kind, CASE WHEN literal < 12 THEN NULL ELSE literal <= 47 END AS value FROM accesses"
_add("e9_fault_handling", lambda s, d: L.fault_handling(_acc(s, d, _FA)),
     _F(f""", l AS ({_FA}), w AS (SELECT DISTINCT module_path, var_key FROM l WHERE is_boolean AND name <> 'Level' AND kind = 'write' AND value)
     SELECT module_path, var_key, 'missing_recovery' AS issue FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.module_path = w.module_path AND l.var_key = w.var_key AND kind = 'write' AND NOT value)
     UNION ALL SELECT module_path, var_key, 'unhandled_fault' FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.module_path = w.module_path AND l.var_key = w.var_key AND kind = 'read')""", "accesses").replace("\n,", ",", 1))
_B = lambda s, d: _A(s, d).select("var_key", "kind", (c("literal") <= 47).alias("value"))
_add("e10_alarm_never_cleared", lambda s, d: L.alarm_never_cleared(_B(s, d)), _F("SELECT var_key FROM accesses WHERE kind = 'write' GROUP BY 1 HAVING bool_and(literal <= 47)", "accesses"))
_PAR = lambda s, d: _A(s, d).withColumn("var_key", F.concat(F.lit("w"), F.substring("var_key", -1, 1)))
_P = "lower(v || CASE WHEN {0} = '' THEN '' ELSE '.' || {0} END)"
_REP = f"CASE WHEN len(string_split({_P.format('g')}, '.')) < len(string_split({_P.format('f')}, '.')) THEN {_P.format('g')} ELSE {_P.format('f')} END"
_CONF = f"(starts_with({_P.format('f')} || '.', {_P.format('g')} || '.') OR starts_with({_P.format('g')} || '.', {_P.format('f')} || '.'))"
_add("e11_parallel_conflicts", lambda s, d: L.parallel_conflicts(_PAR(s, d)), _F(f", e AS (SELECT DISTINCT parallel_id, branch, 'w' || right(var_key, 1) AS v, field AS f, kind FROM accesses) SELECT parallel_id, {_REP} AS path, CASE WHEN bool_or(kind = 'write' AND k = 'write') THEN 'write/write' ELSE 'read/write' END AS conflict FROM (SELECT a.*, b.f AS g, b.kind AS k FROM e a JOIN e b ON a.parallel_id = b.parallel_id AND a.v = b.v AND a.branch < b.branch AND (a.kind = 'write' OR b.kind = 'write')) WHERE {_CONF} GROUP BY ALL", "accesses").replace("\n,", ",", 1))


def _hazards(user: str, need_write: str, where: str = "true") -> str:
    """All pairs of different users, as the definition has them."""
    return _F(f""", e AS (SELECT DISTINCT program, var_key AS v, field AS f, {user} AS u, kind, site FROM accesses WHERE {where}),
     p AS (SELECT program, {_REP} AS path, u, kind, site, u2, k2, s2 FROM (SELECT a.*, b.f AS g, b.u AS u2, b.kind AS k2, b.site AS s2 FROM e a JOIN e b ON a.program = b.program AND a.v = b.v AND a.u <> b.u AND {need_write}) WHERE {_CONF}),
     q AS (SELECT program, path, u AS "user", kind, site FROM p UNION SELECT program, path, u2, k2, s2 FROM p), h AS (SELECT program, path, count(DISTINCT "user") AS users FROM q GROUP BY ALL HAVING bool_or(kind = 'read') AND bool_or(kind = 'write'))
     SELECT program, path, users, "user", string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT site, ',' ORDER BY site) AS sites FROM q JOIN h USING (program, path) GROUP BY ALL""", "accesses").replace("\n,", ",", 1)


_add("e12_shared_access_hazards", lambda s, d: L.shared_access_hazards(_A(s, d)), _hazards("module_path", "(a.kind = 'write' OR b.kind = 'write')"))
_add("e13_non_state_multi_site", lambda s, d: L.shared_access_hazards(_A(s, d).join(_D(s, d).where("not is_state").select("var_key"), "var_key", "left_semi"), "site", False), _hazards("site", "true", "var_key IN (SELECT 'v' || p_partkey FROM part WHERE p_size % 5 <> 0)"))
_add("e14_unsafe_scan_calls", lambda s, d: L.unsafe_scan_calls(_sql(s, d, "SELECT event_id AS site, upper(event_type) AS function FROM events", "events"), _sql(s, d, "SELECT DISTINCT event_type AS function, length(event_type) = 5 AS safe FROM events WHERE event_type <> 'view'", "events")), "SELECT event_id AS site, upper(event_type) AS function FROM events WHERE event_type <> 'view' AND length(event_type) <> 5")
_CX = "SELECT 'm' || cast(l_suppkey AS string) AS module_path, 's' || cast(l_orderkey % 50 AS string) AS step, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS decisions FROM lineitem"
_add("e15_complexity", lambda s, d: L.complexity(_sql(s, d, _CX, "lineitem"), 200, 6), f"SELECT module_path, NULL AS step, cast(sum(decisions) + 1 AS bigint) AS complexity FROM ({_CX}) GROUP BY 1 HAVING complexity > 200 UNION ALL SELECT module_path, step, cast(sum(decisions) + 1 AS bigint) AS complexity FROM ({_CX}) GROUP BY ALL HAVING complexity > 6")
_NO = "SELECT l_orderkey AS sequence, l_suppkey % 2 AS branch, l_linenumber * 100000 + l_partkey AS node, CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'break' WHEN l_quantity = 7 THEN 'fork' ELSE 'step' END AS type, CASE WHEN l_tax > 0.04 THEN 'A = B' ELSE 'a  =b' END || cast(l_linenumber % 3 AS string) AS guard FROM lineitem"
_add("e16_unreachable_nodes", lambda s, d: L.unreachable_nodes(_sql(s, d, _NO, "lineitem")), f"WITH n AS ({_NO}) SELECT sequence, branch, node FROM n JOIN (SELECT sequence, branch, min(node) AS stop FROM n WHERE type <> 'step' GROUP BY ALL) USING (sequence, branch) WHERE node > stop")
_add("e17_duplicate_guards", lambda s, d: L.duplicate_guards(_sql(s, d, _NO, "lineitem")), f"SELECT sequence, branch, lower(replace(guard, ' ', '')) AS guard, count(*) AS n FROM ({_NO}) GROUP BY 1, 2, 3 HAVING count(*) >= 2")
_GU = "SELECT l_orderkey AS sequence, l_suppkey % 2 AS branch, l_linenumber AS node, CASE WHEN l_linenumber < 7 THEN 'k' || cast(l_partkey % 9 AS string) END AS key, CASE WHEN l_returnflag = 'R' THEN '<>' ELSE '=' END AS op, CASE WHEN l_linenumber < 7 THEN cast(l_partkey % 2 AS string) WHEN l_returnflag = 'A' THEN 'True' ELSE 'false' END AS value FROM lineitem"
_KN = "SELECT DISTINCT 'k' || cast(p_partkey % 4 AS string) AS key, cast(p_partkey % 4 % 2 AS string) AS value FROM part"
_add("e17_constant_guards", lambda s, d: L.constant_guards(_sql(s, d, _GU, "lineitem"), _sql(s, d, _KN, "part")),
     f"WITH h AS (SELECT sequence, branch, node, CASE WHEN g.key IS NULL THEN lower(g.value) = 'true' WHEN op = '=' THEN k.value = g.value ELSE k.value <> g.value END AS h FROM ({_GU}) g LEFT JOIN ({_KN}) k ON k.key = g.key) SELECT sequence, branch, node, count(*) = count(*) FILTER (h) AS value FROM h GROUP BY 1, 2, 3 HAVING count(*) = count(*) FILTER (h) OR count(*) FILTER (NOT h) > 0")
_add("e18_illegal_step_combinations", lambda s, d: L.illegal_step_combinations(_sql(s, d, "SELECT l_orderkey AS instant, l_suppkey AS step FROM lineitem", "lineitem"), _sql(s, d, "SELECT s_suppkey % 9 AS grp, s_suppkey AS step FROM supplier", "supplier")), "SELECT l_orderkey AS instant, l_suppkey % 9 AS grp FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2")
_SC = "SELECT DISTINCT l_suppkey AS step, 'v' || cast(l_partkey % 400 AS string) AS var_key, CASE WHEN l_linestatus = 'O' THEN 'enter' ELSE 'exit' END AS phase FROM lineitem"
# what steps write: a line in four writes another variable than its contract has
_SW = _SC.replace("l_partkey % 400", "(l_partkey + CASE WHEN l_quantity % 4 = 0 THEN 1 ELSE 0 END) % 400")
_add("e19_step_contracts", lambda s, d: L.step_contracts(_sql(s, d, _SC, "lineitem"), _sql(s, d, _SW, "lineitem")),
     f"""WITH k AS ({_SC}), w AS ({_SW}), h AS (FROM k INTERSECT FROM w), m AS (FROM k EXCEPT FROM w)
     SELECT step, var_key, phase, phase = 'enter' AND (SELECT max(h.step) FROM h WHERE h.var_key = m.var_key AND h.step < m.step AND h.phase = 'enter') > coalesce((SELECT max(h.step) FROM h WHERE h.var_key = m.var_key AND h.step < m.step AND h.phase = 'exit'), -1) IS TRUE AS leaked FROM m""")
_RS = "SELECT l_suppkey AS sequence, l_linenumber AS path_id, 'v' || cast(l_partkey % 20 AS string) AS var_key, l_tax > 0.04 AS value FROM lineitem"
# what reset paths write: nothing in sequences 1 to 9, else a variable or the one before it
_RR = "SELECT l_suppkey AS sequence, l_linenumber % 3 AS path_id, 'v' || cast((l_partkey - CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) % 20 AS string) AS var_key FROM lineitem WHERE l_suppkey > 9"
_RF = "SELECT DISTINCT l_suppkey AS sequence FROM lineitem WHERE l_suppkey % 7 > 0"
_KO = "SELECT DISTINCT l_suppkey AS sequence, 'v' || cast(l_partkey % 20 AS string) AS var_key FROM lineitem WHERE l_partkey % 20 = l_suppkey % 20"
_add("e20_reset_contamination", lambda s, d: L.reset_contamination(_sql(s, d, _RS, "lineitem"), _sql(s, d, _RR, "lineitem"), _sql(s, d, _RF, "lineitem"), _sql(s, d, _KO, "lineitem")), f"WITH r AS ({_RR}), k AS ({_KO}) SELECT sequence, var_key FROM (SELECT DISTINCT sequence, var_key FROM ({_RS})) x LEFT JOIN (SELECT sequence, count(DISTINCT path_id) AS total FROM r GROUP BY 1) USING (sequence) LEFT JOIN (SELECT sequence, var_key, count(DISTINCT path_id) AS hit FROM r GROUP BY ALL) USING (sequence, var_key) WHERE (total IS NULL OR coalesce(hit, 0) < total) AND sequence % 7 > 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.sequence = x.sequence AND k.var_key = x.var_key)")
_AL = "SELECT l_suppkey AS sequence, l_linenumber + 10 * (l_suppkey % 2) AS path_id FROM lineitem UNION ALL SELECT l_suppkey, l_linenumber FROM lineitem"
_add("e21_implicit_latch", lambda s, d: L.implicit_latch(_sql(s, d, _RS, "lineitem"), _sql(s, d, _AL, "lineitem")), f"SELECT sequence, var_key FROM (SELECT sequence, var_key, count(DISTINCT CASE WHEN NOT value THEN path_id END) + count(DISTINCT CASE WHEN value THEN path_id END) AS n, bool_or(value) AS t FROM ({_RS}) GROUP BY ALL) JOIN (SELECT sequence, count(DISTINCT path_id) AS total FROM ({_AL}) GROUP BY 1) USING (sequence) WHERE t AND n < total")
_CO = "SELECT l_orderkey AS condition, l_suppkey % 5 AS key, CASE WHEN l_returnflag = 'R' THEN '<>' ELSE '=' END AS op, l_partkey % 3 AS value FROM lineitem"
_add("e22_contradictory_conditions", lambda s, d: L.contradictory_conditions(_sql(s, d, _CO, "lineitem")), f"SELECT condition, key FROM ({_CO}) GROUP BY ALL HAVING count(DISTINCT value) FILTER (op = '=') >= 2 OR len(list_intersect(list(value) FILTER (op = '='), list(value) FILTER (op = '<>'))) > 0")
_TA = "SELECT l_orderkey AS condition, 'k' || cast(l_suppkey % 5 AS string) AS key, CASE WHEN l_returnflag = 'R' THEN '<>' ELSE '=' END AS op, CASE WHEN l_linenumber = 5 THEN 'K' || cast(l_partkey % 5 AS string) ELSE cast(l_partkey % 3 AS string) END AS value FROM lineitem"
_add("e22_tautologies", lambda s, d: L.tautologies(_sql(s, d, _TA, "lineitem")),
     f"WITH t AS ({_TA}) SELECT DISTINCT condition, key, 'self_compare' AS issue FROM t WHERE lower(key) = lower(value) UNION ALL SELECT DISTINCT a.condition, a.key, 'tautology' FROM t a JOIN t b USING (condition, key, value) WHERE a.op = '=' AND b.op = '<>'")
