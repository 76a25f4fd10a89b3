"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.facts import fact, with_facts

Q: dict = {}
O: dict = {}


def _add(name, query, sql):
    Q[name], O[name] = query, sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col

_add("b1_name_key", lambda s, d: S.dedupe_names(_t(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey"), "SELECT lower(trim(p_name)) AS key, arg_min(p_name, (p_partkey, p_name)) AS name FROM part WHERE trim(p_name) <> '' GROUP BY 1")
_add("b2_path_conflicts", lambda s, d: fact(s, d, "accesses").select("var_key", "field").distinct().withColumn("p", F.concat_ws(".", "var_key", F.when(c("field") != "", c("field")))).select("p", S.path_conflicts(c("p"), F.concat(c("var_key"), F.lit(".a"))).alias("conflict"), S.conflict_rep(c("p"), F.concat(c("var_key"), F.lit(".a"))).alias("rep")),
     with_facts("SELECT p, starts_with(p || '.', var_key || '.a.') OR starts_with(var_key || '.a.', p || '.') AS conflict, CASE WHEN 2 < len(string_split(p, '.')) THEN var_key || '.a' ELSE p END AS rep FROM (SELECT DISTINCT var_key, field, var_key || CASE WHEN field = '' THEN '' ELSE '.' || field END AS p FROM accesses)", "accesses"))
_NAMES = "SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '' ELSE 'XY9' END) AS n FROM part UNION ALL SELECT p_partkey, upper(replace(p_name, ' ', '_')) FROM part UNION ALL SELECT p_partkey, replace(p_brand, '#', '') || upper(left(p_name, 1)) || substr(p_name, 2, 3) || 'Value' FROM part"


def _names(s, d):
    return s.sql(_NAMES.replace("FROM part", "FROM {part}"), part=_t(s, d, "part"))


_add("b3_identifier_tokens", lambda s, d: _names(s, d).select("p_partkey", "n", F.array_join(S.identifier_tokens(c("n")), "|").alias("tokens")),
     f"SELECT p_partkey, n, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), '|') AS tokens FROM ({_NAMES})")
_add("b4_identifier_style", lambda s, d: _names(s, d).select("p_partkey", "n", S.identifier_style(c("n")).alias("style")),
     f"""SELECT p_partkey, n, CASE WHEN regexp_full_match(n, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'upper_snake' WHEN regexp_full_match(n, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake'
     WHEN NOT regexp_full_match(n, '[A-Za-z][A-Za-z0-9]*') THEN 'unknown' WHEN left(n, 1) = upper(left(n, 1)) THEN CASE WHEN n <> upper(n) OR length(n) = 1 OR try_cast(substr(n, 2) AS HUGEINT) IS NOT NULL THEN 'pascal' ELSE 'upper' END WHEN regexp_full_match(n, '[a-z][a-z0-9]*') THEN 'lower' WHEN regexp_full_match(n, '[a-z][A-Za-z0-9]*') THEN 'camel' ELSE 'unknown' END AS style FROM ({_NAMES})""")
_add("b5_tag_keys", lambda s, d: fact(s, d, "ext_tags").select("var_key", S.tag_key(c("external_tag")).alias("key"), S.tag_family_key(c("external_tag")).alias("family")),
     with_facts("SELECT var_key, lower(external_tag) AS key, array_to_string(list_transform(regexp_extract_all(regexp_replace(external_tag, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), '|') AS family FROM ext_tags", "ext_tags"))
_LIM = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Min-' || p_type || '_' WHEN 1 THEN p_type || '_max' WHEN 2 THEN 'MAXIMUM_' || p_type WHEN 3 THEN lower(p_type) || 'Minimum' ELSE p_type END AS n FROM part"
_add("b6_limit_binding", lambda s, d: s.sql(_LIM.replace("FROM part", "FROM {part}"), part=_t(s, d, "part")).withColumn("x", S.limit_binding(c("n"))).select("p_partkey", "n", "x.bound", "x.body"),
     f"SELECT p_partkey, n, CASE p_partkey % 5 WHEN 0 THEN 'min' WHEN 1 THEN 'max' WHEN 2 THEN 'max' WHEN 3 THEN 'min' END AS bound, CASE WHEN p_partkey % 5 < 4 THEN regexp_extract(lower(n), '^(minimum|maximum|min|max)?[_-]?(.+?)_?(minimum|maximum|min|max)?$', 2) END AS body FROM ({_LIM})")
_add("b7_literal_signature", lambda s, d: fact(s, d, "parameters").select("instance", "parameter", S.literal_signature(c("value"), F.when(c("parameter") == "Type", "string").otherwise("integer")).alias("signature")),
     with_facts("SELECT instance, parameter, CASE WHEN parameter = 'Type' THEN 'string:' || lower(trim(value)) ELSE 'integer:' || value END AS signature FROM parameters", "parameters"))
_ICF = "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN ' F::' || c_mktsegment || ':a.b' || cast(c_custkey AS string) WHEN 1 THEN 'x::. ' WHEN 2 THEN 'plain' WHEN 3 THEN 'Tr::P:Q' WHEN 4 THEN c_mktsegment || ':a.b' WHEN 5 THEN ':x:y' WHEN 6 THEN 'h::' || c_mktsegment ELSE 'F::P: ' END AS v FROM customer"
_add("b8_icf_refs", lambda s, d: s.sql(_ICF.replace("FROM customer", "FROM {customer}"), customer=_t(s, d, "customer")).withColumn("r", S.icf_ref(c("v"))).select("c_custkey", "r.program", "r.path", S.icf_prefix(c("v")).alias("prefix"), S.icf_is_placeholder(c("v")).alias("placeholder")),
     """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'x' WHEN 3 THEN 'Tr' WHEN 4 THEN c_mktsegment WHEN 5 THEN 'x' WHEN 6 THEN 'h' WHEN 7 THEN 'F' END AS program, CASE c_custkey % 8 WHEN 0 THEN 'a.b' || c_custkey WHEN 1 THEN ':.' WHEN 3 THEN ':P:Q' WHEN 4 THEN 'a.b' WHEN 5 THEN 'y' WHEN 6 THEN ':' || c_mktsegment WHEN 7 THEN ':P:' END AS path,
     CASE c_custkey % 8 WHEN 0 THEN 'F' WHEN 1 THEN 'X' WHEN 6 THEN 'H' WHEN 7 THEN 'F' END AS prefix, c_custkey % 8 = 1 AS placeholder FROM customer""")
_SIG = "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Unit.Mes_Recipe.Value' WHEN 1 THEN 'Unit.Sensor1.Operator' WHEN 2 THEN 'Plant.Inter-lock_1.Out' WHEN 3 THEN 'Area.Emergency-Stop' WHEN 4 THEN 'Set_Point.X' ELSE s_name END AS p FROM supplier"
_add("b9_classify_signal_path", lambda s, d: s.sql(_SIG.replace("FROM supplier", "FROM {supplier}"), supplier=_t(s, d, "supplier")).select("s_suppkey", S.classify_signal_path(c("p")).alias("class"), S.holds_keyword(c("p")).alias("sink"), S.holds_keyword(c("p"), S.SAFETY_KEYWORDS).alias("safety")),
     "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'mes' WHEN 1 THEN 'sensor' WHEN 4 THEN 'operator' END AS class, s_suppkey % 6 IN (2, 3) AS sink, s_suppkey % 6 = 3 AS safety FROM supplier")
_PROMPT = "CASE conv_id % 6 WHEN 0 THEN 'Please Implement THIS plan: ' WHEN 1 THEN 'Review how we implement the new plan ' WHEN 2 THEN 'implement plan, then review ' WHEN 3 THEN 'Revalidate ' WHEN 4 THEN 'An AUDIT to validate ' END"
_add("b10_prompt_bucket", lambda s, d: _t(s, d, "conversations").select("conv_id", "turn", S.prompt_bucket(F.concat(F.coalesce(F.expr(_PROMPT), F.lit("")), F.coalesce("text", F.lit("")))).alias("bucket")),
     "SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'implement-this-plan' WHEN 1 THEN 'review' WHEN 2 THEN 'implement-this-plan' WHEN 3 THEN 'validate' WHEN 4 THEN 'audit' ELSE 'other' END AS bucket FROM conversations")
_add("b11_redact", lambda s, d: _t(s, d, "customer").select("c_custkey", S.redact_value(F.substring("c_name", 1, 5)).alias("short"), S.redact_value(c("c_name")).alias("long"), S.redact_email(F.concat(c("c_name"), F.lit("@x.example"))).alias("email")),
     "SELECT c_custkey, '<redacted>' AS short, left(c_name, 2) || '...' || right(c_name, 2) AS long, left(c_name, 1) || '***@x.example' AS email FROM customer")
_add("b12_severity_for_path", lambda s, d: fact(s, d, "findings").withColumn("p", F.when(c("doc_id") % 3 == 0, F.concat(F.lit("tests/"), c("path"))).when(c("doc_id") % 3 == 1, F.concat(F.lit("Libs/"), c("path"))).otherwise(c("path"))).select("doc_id", S.severity_for_path(c("p"), c("severity")).alias("severity")),
     with_facts("SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND severity = 'high' THEN 'medium' ELSE severity END AS severity FROM findings", "findings"))
_add("b13_sanitize_path", lambda s, d: fact(s, d, "findings").select("doc_id", S.sanitize_path(F.when(c("doc_id") % 2 == 0, F.concat(F.lit("/work\\"), c("path"))).otherwise(F.concat(F.lit("/else/"), c("path"))), "/work").alias("path")),
     with_facts("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN path ELSE '<external>/' || list_last(string_split(path, '/')) END AS path FROM findings", "findings"))
# comments of a program; every kind of code, and words that only look like it
_COM = "SELECT p_partkey, p_name || CASE p_partkey % 9 WHEN 0 THEN ' := 1;' WHEN 1 THEN ' < ' || p_type WHEN 2 THEN '. IF ' || p_type || ' THEN;' WHEN 3 THEN '. If only, else' WHEN 4 THEN ' == 2' WHEN 5 THEN ' = old' WHEN 6 THEN '(' || p_type || ', 2)' WHEN 7 THEN ' ( ) 3 <= 4' ELSE '; casement' END AS t FROM part"
_add("b14_code_hints", lambda s, d: s.sql(_COM.replace("FROM part", "FROM {part}"), part=_t(s, d, "part")).withColumn("x", S.code_hints(c("t"))).select("p_partkey", "x.*"),
     "SELECT p_partkey, p_partkey % 9 IN (0, 5) AS assignment, p_partkey % 9 = 6 AS call, p_partkey % 9 IN (2, 3) AS control, p_partkey % 9 = 1 AS comparison, p_partkey % 9 IN (0, 1, 2, 5, 6) AS like_code FROM part")
_LAID = "CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(9) || chr(13) || chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' ' || chr(10) ELSE '' END"
_add("b15_normalize_layout", lambda s, d: _t(s, d, "documents").select("doc_id", F.md5(S.normalize_layout(F.expr(_LAID)).cast("binary")).alias("digest")),
     # line by line: white space off its end, an empty line after an empty one left out, none at the end
     f"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(replace({_LAID}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '')) AS a FROM documents),
     k AS (SELECT doc_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i > 1 AND a[i] = '' AND a[i - 1] = '' THEN NULL ELSE a[i] END), lambda x: x IS NOT NULL) AS b FROM l)
     SELECT doc_id, md5(array_to_string(CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END, chr(10)) || chr(10)) AS digest FROM k""")
_add("b16_finding_fingerprint", lambda s, d: fact(s, d, "findings").select("doc_id", S.finding_fingerprint(c("rule_id"), c("path"), F.when(c("line") > 0, c("line")), c("symbol"), c("message")).alias("fingerprint")),
     with_facts("SELECT doc_id, rule_id || '|' || path || '|' || CASE WHEN line > 0 THEN cast(line AS string) ELSE '' END || '|' || symbol || '|' || message AS fingerprint FROM findings", "findings"))
_add("b17_duration_ms", lambda s, d: fact(s, d, "telemetry").select("id", S.duration_ms(F.when(c("id") % 3 == 0, "n/a").when(c("id") % 3 == 1, F.concat(F.lit("-"), c("duration"))).otherwise(c("duration"))).alias("ms")),
     with_facts("SELECT id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE round_even(cast(duration AS double), 3) END AS ms FROM telemetry", "telemetry"))
