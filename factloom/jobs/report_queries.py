"""Queries of the findings, telemetry and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import finding_fingerprint
from ..operators import findings as H, telemetry as T, text as X
from ..sources.facts import fact, with_facts as _F

Q: dict = {}
O: dict = {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col
_W = lambda *n: (lambda sql: _F(sql, *n).replace("\n,", ",", 1))
_fi = lambda s, d: fact(s, d, "findings")
_BASE = lambda s, d: _fi(s, d).where("doc_id % 5 <> 0")
_CUR = lambda s, d: _fi(s, d).where("doc_id % 7 <> 0").withColumn("severity", F.when(c("doc_id") % 3 == 0, "high").otherwise(c("severity"))).withColumn("message", F.when(c("doc_id") % 4 == 0, "moved").otherwise(c("message")))
_fp = lambda: finding_fingerprint(c("rule_id"), c("path"), c("line"), c("symbol"), c("message"))
_w = _W("findings")
_BC = ", b AS (SELECT * FROM findings WHERE doc_id % 5 <> 0), k AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE severity END AS severity, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE message END AS message) FROM findings WHERE doc_id % 7 <> 0)"
_K = "rule_id, path, line, symbol"
_add("h1_apply_rule_profile", lambda s, d: H.apply_rule_profile(_fi(s, d).withColumn("severity", F.when(c("severity") != "low", c("severity"))), _fi(s, d).groupBy("rule_id").agg(F.lit("info").alias("severity")), _fi(s, d).where("rule_id < 'semantic.src15'").groupBy("rule_id").agg((F.max("doc_id") % 3 == 0).alias("disabled"), F.when(F.max("doc_id") % 2 == 0, "critical").alias("severity"))),
     _w("SELECT f.* REPLACE (coalesce(p.severity, CASE WHEN f.severity <> 'low' THEN f.severity END, 'info') AS severity) FROM findings f LEFT JOIN (SELECT rule_id, max(doc_id) % 3 = 0 AS disabled, CASE WHEN max(doc_id) % 2 = 0 THEN 'critical' END AS severity FROM findings WHERE rule_id < 'semantic.src15' GROUP BY 1) p USING (rule_id) WHERE NOT coalesce(disabled, false)"))
_add("h2_findings_diff", lambda s, d: H.findings_diff(_BASE(s, d), _CUR(s, d)),
     # the n-th of a fingerprint with the n-th, be their severities what they are; then by anchor in the order of the message
     _w(_BC + f""", b1 AS (SELECT *, row_number() OVER (PARTITION BY {_K}, message ORDER BY severity) AS n FROM b), k1 AS (SELECT *, row_number() OVER (PARTITION BY {_K}, message ORDER BY severity) AS n FROM k),
     f AS (SELECT {_K}, message, n, b1.severity AS os, k1.severity AS ns, b1.doc_id IS NOT NULL AS o, k1.doc_id IS NOT NULL AS w FROM b1 FULL JOIN k1 USING ({_K}, message, n)),
     lo AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY message, os) AS m FROM f WHERE NOT w), lw AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY message, ns) AS m FROM f WHERE NOT o)
     SELECT 'unchanged' AS status, {_K}, '' AS changed FROM f WHERE o AND w
     UNION ALL SELECT CASE WHEN lo.message IS NULL THEN 'new' WHEN lw.message IS NULL THEN 'resolved' ELSE 'changed' END, {_K}, CASE WHEN lo.message IS NULL OR lw.message IS NULL THEN '' ELSE concat_ws(',', CASE WHEN lo.message <> lw.message THEN 'message' END, CASE WHEN lo.os <> lw.ns THEN 'severity' END) END FROM lo FULL JOIN lw USING ({_K}, m)"""))
_add("h3_findings_set_diff", lambda s, d: H.findings_set_diff(_BASE(s, d).withColumn("fingerprint", _fp()), _CUR(s, d).withColumn("fingerprint", _fp()), ["fingerprint"]),
     _w(_BC + ", x AS (SELECT DISTINCT rule_id || '|' || path || '|' || line || '|' || symbol || '|' || message AS fingerprint FROM b), y AS (SELECT DISTINCT rule_id || '|' || path || '|' || line || '|' || symbol || '|' || message AS fingerprint FROM k) SELECT coalesce(x.fingerprint, y.fingerprint) AS fingerprint, CASE WHEN x.fingerprint IS NULL THEN 'added' WHEN y.fingerprint IS NULL THEN 'removed' ELSE 'surviving' END AS status FROM x FULL JOIN y ON x.fingerprint = y.fingerprint"))
_add("h3_severity_drift", lambda s, d: H.severity_drift(_fi(s, d).where("doc_id % 40 > 0 or rule_id < 'semantic.src5'"), _fi(s, d)), _w("SELECT DISTINCT rule_id FROM findings WHERE doc_id % 40 = 0 AND rule_id >= 'semantic.src5'"))
_add("h4_findings_summary", lambda s, d: H.findings_summary(_fi(s, d)), _w("SELECT CASE WHEN g = 3 THEN 'rule' WHEN g = 5 THEN 'category' ELSE 'severity' END AS grp, coalesce(rule_id, category, severity) AS value, n FROM (SELECT rule_id, category, severity, count(*) AS n, grouping(rule_id, category, severity) AS g FROM findings GROUP BY GROUPING SETS ((rule_id), (category), (severity)))"))
_add("h5_rule_metrics", lambda s, d: H.rule_metrics(_fi(s, d).where("rule_id <> 'semantic.src3'"), _fi(s, d).select("rule_id")), _w("SELECT rule_id, count(*) FILTER (rule_id <> 'semantic.src3') AS fires, count(DISTINCT CASE WHEN rule_id <> 'semantic.src3' THEN path END) AS targets, rule_id = 'semantic.src3' AS never_triggered FROM findings GROUP BY 1"))
_FSEV = "*, CASE WHEN doc_id % 11 = 0 THEN 'critical' WHEN doc_id % 13 = 0 THEN NULL ELSE severity END AS sev"
_AN = "SELECT cast(doc_id AS string) AS fingerprint, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'missed_issue' ELSE 'false_positive' END AS annotation, CASE WHEN doc_id % 5 > 0 THEN 'rule' || cast(doc_id % 4 AS string) END AS rule_id FROM labels"
_add("h6_accuracy", lambda s, d: H.accuracy(_fi(s, d).selectExpr("*", _FSEV[3:]).select(c("doc_id").cast("string").alias("fingerprint"), "rule_id", c("sev").alias("severity")), s.sql(_AN.replace("FROM labels", "FROM {labels}"), labels=_t(s, d, "labels"))),
     _w(f""", v AS (SELECT CASE WHEN a.fingerprint IS NULL THEN f.rule_id ELSE coalesce(a.rule_id, 'unknown') END AS rule_id, CASE WHEN a.fingerprint IS NOT NULL THEN annotation WHEN sev IN ('high', 'critical') THEN 'missed_issue' ELSE 'correct' END AS v FROM (SELECT {_FSEV} FROM findings) f LEFT JOIN ({_AN}) a ON a.fingerprint = cast(doc_id AS string))
     SELECT rule_id, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'false_positive') AS false_positive, count(*) FILTER (v = 'missed_issue') AS missed_issue, count(*) AS total, round_even(count(*) FILTER (v = 'correct') / count(*), 4) AS precision FROM v GROUP BY GROUPING SETS ((rule_id), ())"""))
_MARKS = "CASE WHEN doc_id % 6 = 0 THEN 'x|Ignored' WHEN doc_id % 7 = 0 THEN 'fixed' ELSE 'new' END"
_add("h7_findings_per_kloc", lambda s, d: H.findings_per_kloc(_fi(s, d).where("severity = 'high'").withColumn("fingerprint", F.expr(_MARKS)), _t(s, d, "documents").select(c("lang").alias("category"), F.size(F.split("text", "\n")).cast("long").alias("lines"))), _w(f"SELECT category, coalesce(findings, 0) AS findings, round_even(coalesce(findings, 0) / k, 2) AS per_kloc, coalesce(ignored, 0) AS ignored, coalesce(fixed, 0) AS fixed FROM (SELECT lang AS category, greatest(sum(len(string_split(text, chr(10)))) // 1000, 1) AS k FROM documents GROUP BY 1) LEFT JOIN (SELECT category, count(*) AS findings, count(*) FILTER (doc_id % 6 = 0) AS ignored, count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 7 = 0) AS fixed FROM findings WHERE severity = 'high' GROUP BY 1) USING (category)"))
_add("h7_rule_frequency", lambda s, d: H.rule_frequency(_fi(s, d).withColumn("rule_id", F.when(c("line") > 0, c("rule_id")))), _w("SELECT category, CASE WHEN line > 0 THEN rule_id ELSE 'unknown' END AS rule_id, count(*) AS n FROM findings GROUP BY 1, 2"))
_RUN = "SELECT 'r' || cast(id AS string) AS run_id, ts AS captured_at, operation AS kind, CASE WHEN success THEN 'pass' WHEN id % 3 > 0 THEN 'fail' END AS status, CASE id % 4 WHEN 0 THEN 'full' WHEN 1 THEN '' END AS surface, CASE WHEN id % 5 = 0 THEN 'blocked' END AS gate, id % 7 AS nf, session % 9 AS nc, id FROM telemetry"
_runs = lambda s, d: s.sql(_RUN.replace("FROM telemetry", "FROM {telemetry}"), telemetry=_te(s, d)).withColumn("failures", F.transform(F.expr("sequence(0, nf)"), lambda i: F.when(i > 0, F.concat(F.lit("t"), i.cast("string"))).otherwise(""))).withColumn("checks", F.expr("transform(filter(sequence(0, nc), i -> i > 0), i -> 'c' || cast(i AS string))"))
_SIGN = f"""x AS (SELECT *, [coalesce(kind, 'audit')] || list_filter([nullif(surface, ''), 'finish:' || gate], lambda x: x IS NOT NULL) || CASE WHEN nf > 0 THEN list_transform(range(1, least(nf, 5) + 1), lambda i: 't' || i) ELSE list_transform(range(1, least(nc, 5) + 1), lambda i: 'c' || i) END AS p FROM ({_RUN}) WHERE status IS DISTINCT FROM 'pass'), y AS (SELECT array_to_string(p, '|') AS signature, run_id, captured_at FROM x WHERE len(p) > 1)"""
_add("h8_failure_patterns", lambda s, d: H.failure_patterns(_runs(s, d)), _W("telemetry")(f", {_SIGN} SELECT signature, count(*) AS occurrences, arg_max(run_id, (captured_at, run_id)) AS latest_run, max(captured_at) AS latest_at FROM y GROUP BY 1"))
_add("h8_failure_runs", lambda s, d: H.failure_runs(_runs(s, d)), _W("telemetry")(f", {_SIGN} FROM y"))
_add("h9_corpus_evaluation", lambda s, d: H.corpus_evaluation(_fi(s, d).groupBy(c("category").alias("case_id")).agg(F.collect_set(F.when(c("line") < 2, c("rule_id"))).alias("expected"), F.collect_set(F.when(c("line") == 9, c("symbol"))).alias("forbidden")), _fi(s, d).where("line > 6").select(c("category").alias("case_id"), F.explode(F.array("rule_id", "symbol")).alias("id")).where("id <> 'semantic.src3'")),
     _w(""", a AS (SELECT DISTINCT category AS case_id, unnest([rule_id, symbol]) AS id FROM findings WHERE line > 6), e AS (SELECT DISTINCT category AS case_id, rule_id AS id FROM findings WHERE line < 2), g AS (SELECT DISTINCT category AS case_id, symbol AS id FROM findings WHERE line = 9),
     m AS (SELECT case_id, string_agg(id, ',' ORDER BY id) AS missing FROM (FROM e EXCEPT SELECT * FROM a WHERE id <> 'semantic.src3') GROUP BY 1), h AS (SELECT case_id, string_agg(id, ',' ORDER BY id) AS hits FROM (FROM g INTERSECT SELECT * FROM a WHERE id <> 'semantic.src3') GROUP BY 1)
     SELECT case_id, coalesce(missing, '') AS missing, coalesce(hits, '') AS forbidden_hits, missing IS NULL AND hits IS NULL AS passed FROM (SELECT DISTINCT category AS case_id FROM findings) LEFT JOIN m USING (case_id) LEFT JOIN h USING (case_id)"""))
_add("h10_ratchet_check", lambda s, d: H.ratchet_check(_fi(s, d).where("severity <> 'low'").groupBy(c("rule_id").alias("metric")).agg(F.count("*").alias("value")), _fi(s, d).groupBy(c("rule_id").alias("metric")).agg(F.expr("count(*) * 2 div 3").alias("max_value"), F.expr("count(*) * 3 div 5").alias("min_value"))),
     _w("SELECT metric, value, max_value, min_value FROM (SELECT rule_id AS metric, count(*) FILTER (severity <> 'low') AS value, count(*) * 2 // 3 AS max_value, count(*) * 3 // 5 AS min_value FROM findings GROUP BY 1) WHERE value > max_value OR value < min_value"))
_add("h11_change_coverage", lambda s, d: H.change_coverage(_fi(s, d).where("doc_id % 3 > 0 and path not like '%7.s'").select("path", "line", (c("doc_id") % 2).alias("hits")), _fi(s, d).select("path", ((c("line") + 1) % 10).alias("line"))),
     _w(", l AS (SELECT path, line, max(doc_id % 2) AS hits FROM findings WHERE doc_id % 3 > 0 AND path NOT LIKE '%7.s' GROUP BY ALL), p AS (SELECT path, count(hits) AS measured, count(*) FILTER (hits > 0) AS covered, count(*) FILTER (hits IS NULL) AS unmeasured, path IN (SELECT path FROM l) AS reported FROM (SELECT DISTINCT path, (line + 1) % 10 AS line FROM findings) LEFT JOIN l USING (path, line) GROUP BY path) SELECT * FROM p UNION ALL SELECT NULL, sum(measured)::BIGINT, sum(covered)::BIGINT, sum(unmeasured)::BIGINT, bool_or(reported) FROM p"))
_te = lambda s, d: fact(s, d, "telemetry")
_tr = lambda s, d: fact(s, d, "transcript")
_T, _R = _W("telemetry"), _W("transcript")
_add("i1_operation_summary", lambda s, d: T.operation_summary(_te(s, d)), _T("SELECT coalesce(operation, 'unknown') AS operation, count(*) AS n, round(sum(ms), 3) AS total_ms, max(ms) AS max_ms, round(avg(ms), 3) AS avg_ms, count(*) FILTER (NOT success) AS failures, count(*) FILTER (cancelled) AS cancelled FROM (SELECT *, cast(duration AS double) AS ms FROM telemetry) GROUP BY 1"))
_maps = lambda s, d: _te(s, d).where("operation is not null").select("id", F.create_map(c("operation"), c("duration").cast("double"), F.lit("total"), c("duration").cast("double") * (c("id") % 2), F.lit("zz"), F.lit(3.0)).alias("timings"))
_ML = "(SELECT id, unnest([operation, 'total', 'zz']) AS name, unnest([cast(duration AS double), cast(duration AS double) * (id % 2), 3.0]) AS ms FROM telemetry WHERE operation IS NOT NULL)"
_add("i2_named_timings", lambda s, d: T.named_timings(_maps(s, d)), _T(f"SELECT name, count(*) AS n, round(sum(ms), 3) AS total_ms, max(ms) AS max_ms FROM {_ML} GROUP BY 1"))
_PH = "SELECT id, 'phase' || cast(id % 6 AS string) AS p1, CASE WHEN id % 4 > 0 THEN 'load' END AS p2, CASE WHEN id % 9 = 0 THEN 'n/a' ELSE duration END AS d1, '-' || duration AS d2, coalesce(operation, 'none') AS a FROM telemetry"
_phases = lambda s, d: s.sql(_PH.replace("FROM telemetry", "FROM {telemetry}"), telemetry=_te(s, d)).withColumn("x", F.array(*(F.struct(c(f"p{k}").alias("phase"), c(f"d{k}").alias("duration_ms")) for k in (1, 2))))
_PL = f"SELECT p1 AS p, try_cast(d1 AS double) AS ms, a FROM ({_PH}) UNION ALL SELECT p2, 0.0, a FROM ({_PH})"
_add("i2_phase_timings", lambda s, d: T.named_timings(_phases(s, d), "x"), _T(f"SELECT p AS name, count(*) AS n, round(sum(round_even(ms, 3)), 3) AS total_ms, max(round_even(ms, 3)) AS max_ms FROM ({_PL}) WHERE p IS NOT NULL AND ms IS NOT NULL GROUP BY 1"))
_add("i2_analyzer_phase_timings", lambda s, d: T.named_timings(_phases(s, d).withColumn("m", F.create_map("a", "x")), "m"), _T(f"SELECT a || ':' || p AS name, count(*) AS n, round(sum(round_even(ms, 3)), 3) AS total_ms, max(round_even(ms, 3)) AS max_ms FROM ({_PL}) WHERE p IS NOT NULL AND ms IS NOT NULL GROUP BY 1"))
_add("i3_bottleneck", lambda s, d: T.bottleneck(_maps(s, d)), _T(f"SELECT id, name, ms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ms DESC, name DESC) AS r FROM {_ML}) WHERE r = 1"))
_add("i4_analyzer_bottlenecks", lambda s, d: T.analyzer_bottlenecks(_te(s, d).where("operation is not null").select(c("operation").alias("analyzer"), (c("id") % 5).alias("issues"), c("duration").cast("double").alias("ms"))), _T("SELECT operation AS analyzer, count(*) AS entries, cast(sum(id % 5) AS bigint) AS issues, round(sum(cast(duration AS double)), 3) AS total_ms, max(cast(duration AS double)) AS max_ms, round(avg(cast(duration AS double)), 3) AS avg_ms FROM telemetry WHERE operation IS NOT NULL GROUP BY 1"))
_add("i5_phase_spans", lambda s, d: T.phase_spans(_te(s, d).select((c("id") % 500).alias("phase"), (c("id") % 7 * c("duration").cast("double")).alias("offset_ms"))), _T("SELECT phase, span_ms, span_ms >= 25 AS slow, span_ms > 50 AS over_budget FROM (SELECT id % 500 AS phase, round(max(id % 7 * cast(duration AS double)) - min(id % 7 * cast(duration AS double)), 3) AS span_ms FROM telemetry GROUP BY 1)"))
_SS = "(SELECT session, count(*) FILTER (type = 'user') AS users, count(*) FILTER (type = 'assistant') AS assistants, count(*) FILTER (type = 'assistant' AND content = '') AS empty_assistants, count(*) FILTER (type = 'tool.start') AS tool_calls, count(*) FILTER (type = 'tool.complete' AND NOT success) AS failures, CASE WHEN contains(coalesce(arg_min(content, seq) FILTER (type = 'user'), ''), 'review') THEN 'review' ELSE 'other' END AS bucket FROM transcript GROUP BY 1)"
_add("i6_session_summary", lambda s, d: T.session_summary(_tr(s, d)), _R(f"FROM {_SS}"))
_DI = "(SELECT session, CASE WHEN first IS NOT NULL THEN coalesce(n, 0) END AS discovery FROM (SELECT DISTINCT session FROM transcript) LEFT JOIN (SELECT session, min(seq) AS first FROM transcript WHERE type = 'tool.start' AND tool <> 'grep_search' GROUP BY 1) USING (session) LEFT JOIN (SELECT t.session, count(*) AS n FROM transcript t JOIN (SELECT session, min(seq) AS first FROM transcript WHERE type = 'tool.start' AND tool <> 'grep_search' GROUP BY 1) f ON f.session = t.session AND seq < first WHERE type = 'tool.start' AND tool = 'grep_search' GROUP BY 1) USING (session))"
_add("i7_discovery_before_action", lambda s, d: T.discovery_before_action(_tr(s, d)), _R(f"FROM {_DI}"))
_RE = "(SELECT session, count(*) FILTER (type = 'tool.start' AND bt = 'tool.complete' AND b = tool) AS retries FROM (SELECT *, lag(type) OVER w AS bt, lag(tool) OVER w AS b FROM transcript WHERE type IN ('tool.start', 'tool.complete') AND (type = 'tool.start' OR NOT success) WINDOW w AS (PARTITION BY session ORDER BY seq)) GROUP BY 1)"
_add("i8_same_tool_retries", lambda s, d: T.same_tool_retries(_tr(s, d)), _R(f"FROM {_RE}"))
_add("i9_tool_counts", lambda s, d: T.tool_counts(_tr(s, d)), _R("SELECT tool, count(*) AS n FROM transcript WHERE type = 'tool.start' GROUP BY 1"))
_add("i9_top_tools", lambda s, d: T.top_tools(_tr(s, d).withColumn("tool", F.concat("tool", (c("seq") % 9).cast("string")))), _R("SELECT tool || (seq % 9) AS tool, count(*) AS n FROM transcript WHERE type = 'tool.start' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
_BU = f"(SELECT bucket, count(*) AS sessions, CASE WHEN sum(assistants) > 0 THEN round(sum(empty_assistants) / sum(assistants), 4) ELSE 0 END AS empty_rate, cast(sum(failures) AS bigint) AS failures, round(avg(discovery), 4) AS avg_discovery, max(discovery) AS max_discovery FROM {_SS} s LEFT JOIN {_DI} USING (session) GROUP BY 1)"
_bu = lambda s, d: T.bucket_summary(T.session_summary(_tr(s, d)), T.discovery_before_action(_tr(s, d)))
_add("i10_bucket_summary", _bu, _R(f"FROM {_BU}"))
_CASED = "CASE WHEN seq % 2 = 0 THEN 'Src/F' ELSE 'src/f' END || cast(seq % 11 AS string)"
_gr = lambda s, d: T.grounding_overlap(_tr(s, d).groupBy("session").agg(F.collect_set(F.when((c("seq") % 9 == 0) & (c("session") % 7 > 0), F.expr(_CASED))).alias("candidates"), F.collect_set(F.when((c("seq") % 13 < 4) & (c("session") % 5 > 0), F.expr(_CASED))).alias("referenced")))
_GR = f"SELECT session, n AS overlap, CASE WHEN t > 0 THEN round(n / t, 4) ELSE 0.0 END AS ratio, CASE WHEN t = 0 THEN 'no-results' WHEN n = 0 THEN 'ungrounded' ELSE 'ok' END AS status FROM (SELECT session, len(list_filter(a, lambda x: list_contains(b, lower(x)))) AS n, len(a) AS t FROM (SELECT session, coalesce(list(DISTINCT {_CASED}) FILTER (seq % 9 = 0 AND session % 7 > 0), []) AS a, coalesce(list(DISTINCT lower({_CASED})) FILTER (seq % 13 < 4 AND session % 5 > 0), []) AS b FROM transcript GROUP BY 1))"
_add("i11_grounding_overlap", _gr, _R(_GR))
_add("i12_chat_findings", lambda s, d: T.chat_findings(_bu(s, d), T.same_tool_retries(_tr(s, d)), _gr(s, d), 0.1, 0.5, 0.9), _R(f"SELECT 'empty_messages' AS rule, bucket AS subject FROM {_BU} WHERE empty_rate >= 0.1 UNION ALL SELECT 'much_discovery', bucket FROM {_BU} WHERE avg_discovery >= 0.5 UNION ALL SELECT 'tool_retries', cast(session AS string) FROM {_RE} WHERE retries > 0 UNION ALL SELECT 'low_grounding', 'sessions' FROM ({_GR}) HAVING count(*) > 0 AND count(*) FILTER (overlap > 0) < 0.9 * count(*)"))
_docs = lambda s, d: _t(s, d, "documents").select(c("doc_id").alias("id"), "text")
_q = lambda x: x.replace("'", "''")
_L = " UNION ALL ".join(f"SELECT id, line_no, '{r}' AS rule, unnest(" + (f"regexp_extract_all(line, '{_q(p)}', 1)[1:1]" if r == "private_key" else f"regexp_extract_all(line, '{_q(p)}', 1)") + ") AS value FROM l" for r, p, _ in X.LEAKS)
# some lines are turned into leaks, and into what only looks like one
_LEAKY = "replace(replace(replace(text, 'The ', 'password = \"hunter22\" token: ''<mine>'' C:\\Users\\MyUser\\x '), 'und ', 'd:/data/y secret = open8chars api_key=''EXAMPLE'' '), 'de ', '-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY----- /home/me/z 127.0.0.1:80 ')"
_add("j1_leak_scan", lambda s, d: X.leak_scan(_t(s, d, "documents").select(c("doc_id").alias("id"), F.expr(_LEAKY.replace("\\", "\\\\").replace("''", "\\'")).alias("text"))), f"WITH l AS (SELECT id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM (SELECT doc_id AS id, string_split({_LEAKY}, chr(10)) AS p FROM documents)), m AS (SELECT id, line_no, rule, CASE WHEN rule = 'secret' THEN trim(value) ELSE value END AS value FROM ({_L})) SELECT id, line_no AS line, rule, CASE WHEN rule = 'email' THEN left(value, 1) || '***@' || list_last(string_split(value, '@')) WHEN length(value) <= 6 THEN '<redacted>' ELSE left(value, 2) || '...' || right(value, 2) END AS detail FROM m WHERE NOT (rule = 'secret' AND (lower(value) IN ('changeme', 'example', 'example-token', 'example-secret', 'placeholder') OR starts_with(value, '<'))) AND NOT (rule = 'windows_path' AND (contains(value, '%USERPROFILE%') OR contains(value, 'C:\\Users\\MyUser')))")
_add("j2_identifier_scan", lambda s, d: X.identifier_scan(_docs(s, d), _t(s, d, "part").select(F.explode(F.array(F.lit("The"), F.lit("idiot"), F.lit("clown"), "p_type")).alias("identifier")).distinct()), "SELECT id, identifier, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS key FROM documents) JOIN (SELECT 'The' AS identifier UNION SELECT 'idiot' UNION SELECT 'clown' UNION SELECT p_type FROM part) ON key = lower(identifier) GROUP BY ALL")
_add("j3_comments_with_code", lambda s, d: X.comments_with_code(_t(s, d, "pages").select(c("page_id").alias("id"), F.replace(F.replace("html", F.lit("<script>"), F.lit("(*")), F.lit("</script>"), F.lit("*)")).alias("text"))))
_PA = "(SELECT 'n' || doc_id AS name, text FROM documents WHERE doc_id % 5 > 0), o AS (SELECT 'n' || doc_id AS name, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), '  ' || chr(10)) || chr(10) || '' ELSE text || chr(10) || 'new line' || chr(10) || 'new line' END AS text FROM documents WHERE doc_id % 7 > 0)"
_dr = lambda s, d: _t(s, d, "documents").where("doc_id % 5 > 0").select(F.concat(F.lit("n"), c("doc_id").cast("string")).alias("name"), "text")
_of = lambda s, d: _t(s, d, "documents").where("doc_id % 7 > 0").select(F.concat(F.lit("n"), c("doc_id").cast("string")).alias("name"), F.when(c("doc_id") % 3 == 0, c("text")).when(c("doc_id") % 3 == 1, F.concat(F.replace("text", F.lit("\n"), F.lit("  \n")), F.lit("\n"))).otherwise(F.concat("text", F.lit("\nnew line\nnew line"))).alias("text"))
_NL = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n{{2,}}', chr(10)), '\n+$', '')"
_add("j4_pair_classification", lambda s, d: X.pair_classification(_dr(s, d), _of(s, d)), f"WITH d AS {_PA} SELECT coalesce(d.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'draft_only' WHEN d.name IS NULL THEN 'official_only' WHEN d.text = o.text THEN 'identical' WHEN {_NL('d.text')} = {_NL('o.text')} THEN 'layout_only' ELSE 'structural' END AS status FROM d FULL JOIN o ON d.name = o.name")
_add("j5_line_change_counts", lambda s, d: X.line_change_counts(_dr(s, d), _of(s, d)), f"WITH d AS {_PA}, x AS (SELECT name, unnest(string_split(text, chr(10))) AS line FROM d), y AS (SELECT name, unnest(string_split(text, chr(10))) AS line FROM o) SELECT name, cast(sum(greatest(n, 0)) AS bigint) AS added, cast(sum(greatest(-n, 0)) AS bigint) AS deleted FROM (SELECT name, line, sum(k) AS n FROM (SELECT *, 1 AS k FROM y UNION ALL SELECT *, -1 FROM x) GROUP BY ALL) GROUP BY 1")
_add("j5_line_diff_counts", lambda s, d: X.line_diff_counts(_dr(s, d), _of(s, d)))
_add("j6_entity_delta", lambda s, d: X.entity_delta(fact(s, d, "declarations").where("init_value > 5").select(c("var_key").alias("name"), "datatype", "role"), fact(s, d, "declarations").where("init_value < 45").select(F.upper("var_key").alias("name"), F.when(c("is_state"), "real").otherwise(c("datatype")).alias("datatype"), F.when(c("is_const"), "local").otherwise(c("role")).alias("role")), "name", ["datatype", "role"]),
     _W("declarations")("SELECT * FROM (SELECT var_key AS key, CASE WHEN init_value <= 5 THEN 'added' WHEN init_value >= 45 THEN 'removed' WHEN is_state OR (is_const AND role <> 'local') THEN 'changed' END AS status, CASE WHEN init_value <= 5 OR init_value >= 45 THEN '' ELSE CASE WHEN is_state AND is_const AND role <> 'local' THEN 'datatype,role' WHEN is_state THEN 'datatype' WHEN is_const AND role <> 'local' THEN 'role' ELSE '' END END AS changed FROM declarations) WHERE status IS NOT NULL"))
