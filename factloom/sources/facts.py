"""The driver's tables seen as program facts.

Each fact is one projection in SQL that Spark and DuckDB both run, so that a query and its oracle see the
same facts. Operators never see the driver's column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FACTS = {
    "accesses": """
        SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS seq,
          'p' || cast(l_suppkey % 5 AS string) AS program, 'v' || cast(l_partkey AS string) AS var_key,
          CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'a' WHEN 3 THEN 'a.x' WHEN 4 THEN 'a.y' ELSE 'b' END AS field,
          'r' || cast(l_suppkey % 4 AS string) || '.g' || cast(l_suppkey % 20 AS string) || '.m' || cast(l_suppkey AS string) AS module_path,
          CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind, l_returnflag = 'A' AS is_ui,
          cast(l_quantity AS bigint) AS literal, 'm' || cast(l_suppkey AS string) || ':' || l_linestatus AS site,
          l_orderkey AS parallel_id, l_linenumber % 3 AS branch
        FROM lineitem""",
    "declarations": """
        SELECT 'v' || cast(p_partkey AS string) AS var_key, p_name AS name, lower(p_type) AS datatype, p_brand AS scope,
          cast(p_size AS bigint) AS init_value, p_size % 2 = 0 AS is_const, p_size % 5 = 0 AS is_state,
          CASE p_size % 3 WHEN 0 THEN 'parameter' ELSE 'local' END AS role
        FROM part""",
    "parameters": """
        SELECT p_brand AS moduletype, 'i' || cast(p_partkey AS string) AS instance, 'Type' AS parameter, p_type AS value FROM part
        UNION ALL
        SELECT p_brand, 'i' || cast(p_partkey AS string), 'Size', cast(p_size % 3 AS string) FROM part WHERE p_size % 7 <> 0""",
    "alarms": """
        SELECT 'o' || cast(o_orderkey AS string) AS instance, 'TAG' || cast(o_custkey AS string) AS tag, o_orderpriority AS condition,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS priority
        FROM orders""",
    "flow_edges": """
        SELECT DISTINCT l_partkey % 1000 AS src, l_suppkey % 1000 + 1000 AS dst FROM lineitem WHERE l_linenumber = 1
        UNION
        SELECT DISTINCT l_suppkey % 1000 + 1000, (l_partkey * 7 + 3) % 1000 + 3000 FROM lineitem WHERE l_linenumber = 2""",
    "lib_edges": """
        SELECT 'Lib' || cast(p_partkey AS string) AS source, 'LIB' || cast(p_partkey // 3 AS string) AS target, p_brand AS entry
        FROM part WHERE p_size > 10""",
    "placements": """
        SELECT p_brand AS container, p_partkey AS item, p_type AS layer, cast(p_size AS double) AS x0, cast(p_partkey % 50 AS double) AS y0,
          cast(p_size + p_size % 5 + 1 AS double) AS x1, cast(p_partkey % 50 + p_partkey % 4 + 1 AS double) AS y1
        FROM part""",
    "ext_tags": """
        SELECT c_mktsegment AS source_kind, 'Tag_' || cast(c_custkey % 97 AS string) || CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END AS external_tag,
          CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'type' || cast(c_nationkey % 4 AS string) END AS datatype,
          CASE WHEN c_nationkey % 2 = 0 THEN 'outgoing' ELSE 'incoming' END AS direction, 'v' || cast(c_custkey AS string) AS var_key
        FROM customer""",
    "telemetry": """
        SELECT event_id AS id, ts, user_id AS session, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS operation,
          cast(value AS string) AS duration, event_type <> 'error' AS success, event_id % 13 = 0 AS cancelled
        FROM events""",
    "transcript": """
        SELECT event_id AS seq, user_id AS session, ts,
          CASE WHEN event_type = 'error' THEN 'tool.complete' WHEN event_type = 'signup' THEN 'assistant' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'user' ELSE 'tool.start' END AS type,
          CASE WHEN event_id % 4 < 2 THEN 'grep_search' WHEN event_id % 4 = 2 THEN 'edit' ELSE 'run' END AS tool,
          event_type <> 'error' AS success, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'review the plan ' || cast(event_id AS string) END AS content
        FROM events""",
    "findings": """
        SELECT doc_id, 'semantic.' || source AS rule_id, lang AS category, 'src/' || lang || '/' || cast(doc_id % 50 AS string) || '.s' AS path,
          doc_id % 10 AS line, 'sym' || cast(doc_id % 7 AS string) AS symbol, CASE WHEN n_chars % 3 = 0 THEN 'high' WHEN n_chars % 3 = 1 THEN 'medium' ELSE 'low' END AS severity,
          'message ' || cast(doc_id % 4 AS string) AS message
        FROM documents""",
}


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact over the driver's tables in sf_dir."""
    sql = FACTS[name].replace(" // ", " div ")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **tables)


def with_facts(sql: str, *names: str) -> str:
    """Oracle SQL over facts."""
    return "WITH " + ("RECURSIVE " if "UNION_REC" in sql else "") + ",\n".join(f"{n} AS ({FACTS[n]})" for n in names) + "\n" + sql.replace("UNION_REC", "UNION")
