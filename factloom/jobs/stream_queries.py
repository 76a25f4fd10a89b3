"""Queries of the streaming jobs and the file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import fresh_path
from ..sources import files as S
from ..sources.facts import fact, with_facts as _F
from ..streaming import rollups as R

Q: dict = {}
O: dict = {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
c = F.col


def _stream(s, d) -> DataFrame:
    """The events table as a stream."""
    # a glob, as a stream's plain path must be a folder and a table may be one file
    e = s.readStream.schema(_t(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return e.select(c("event_id").alias("seq"), c("ts").cast("timestamp").alias("ts"), c("user_id").alias("session"), F.when(c("event_id") % 11 != 0, c("event_type")).alias("operation"), (c("event_type") != "error").alias("success"))


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_add("k1_stream_operation_rollup", lambda s, d: R.drained(R.operation_rollup(_stream(s, d)), "rollup"), _F(f"SELECT date_trunc('hour', ts) AS start, coalesce(operation, 'unknown') AS operation, count(*) AS n, count(*) FILTER (NOT success) AS failures FROM telemetry GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK}", "telemetry"))
_add("k2_stream_session_rollup", lambda s, d: R.drained(R.session_rollup(_stream(s, d)), "sessions"), f"SELECT session, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts) AS g FROM (SELECT user_id AS session, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY session, g HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK}")
_add("k3_stream_new_findings", lambda s, d: R.drained(R.new_findings(_stream(s, d), ["session", "operation"]), "new"), _F("SELECT DISTINCT session, operation FROM telemetry", "telemetry"))


_add("k1_stream_sliding_rollup", lambda s, d: R.drained(R.operation_rollup(_stream(s, d), "2 hours", slide="30 minutes"), "sliding"),
     _F(f"SELECT start, coalesce(operation, 'unknown') AS operation, count(*) AS n, count(*) FILTER (NOT success) AS failures FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM telemetry, range(4) r(k)) GROUP BY ALL HAVING start + INTERVAL 2 HOUR <= {_MARK}", "telemetry"))


def _retries(s, d):
    e = _stream(s, d).withColumn("type", F.when(c("success"), "tool.start").otherwise("tool.complete")).withColumn("tool", F.when(c("seq") % 4 < 2, "search").otherwise("edit"))
    return R.drained(R.tool_retries(e), "retries", R.ROCKSDB).groupBy("session").agg(F.sum("retries").alias("retries"))


_add("k4_stream_tool_retries", _retries, f"SELECT session, count(*) AS retries FROM (SELECT session, tool, s, lag(s) OVER w AS bs, lag(tool) OVER w AS b FROM (SELECT user_id AS session, event_id, ts, event_type <> 'error' AS s, CASE WHEN event_id % 4 < 2 THEN 'search' ELSE 'edit' END AS tool FROM events WHERE date_trunc('millisecond', ts) < date_trunc('millisecond', {_MARK})) WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)) WHERE s AND NOT bs AND b = tool GROUP BY 1")


def _discovered(s, d):
    """Documents as program files, one text file a language and kind, found again."""
    at = fresh_path(s, "tree")
    rows = _t(s, d, "documents").select(F.concat("lang", F.lit("="), "source").alias("name"), F.concat_ws(" ", "lang", "source", c("doc_id").cast("string")).alias("value"))
    rows.write.partitionBy("name").text(at)
    f = S.discover_sources(s, at, kinds=(("txt", "program"),))
    lines = S.decode_text(f).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.split("line", " ")[0].alias("lang")).agg(F.count("*").alias("n"))


_add("a1_discover_and_decode", _discovered, "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
_add("a2_decode_text", lambda s, d: S.decode_text(_t(s, d, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("content"))).select("doc_id", F.md5(c("text").cast("binary")).alias("digest")), "SELECT doc_id, md5(text) AS digest FROM documents")
_add("a3_dependency_edges", lambda s, d: S.dependency_edges(_t(s, d, "documents").select(F.concat(F.lit("Stem"), c("doc_id").cast("string")).alias("stem"), "text")).select("source", F.md5(c("target").cast("binary")).alias("target")).groupBy("source", "target").agg(F.count("*").alias("n")),
     "SELECT source, md5(target) AS target, count(*) AS n FROM (SELECT 'stem' || doc_id AS source, lower(trim(rtrim(unnest(string_split(text, chr(10))), chr(13)), ' ')) AS target FROM documents) WHERE target <> '' GROUP BY ALL")


def _found(s, d):
    """Findings written as collections of a bounded size, a file each, and read back."""
    at = fresh_path(s, "findings")
    f = fact(s, d, "findings").withColumn("line", c("line").cast("int"))
    one = f.groupBy("rule_id", "category", F.floor(c("doc_id") / 1000)).agg(F.collect_list(F.struct("rule_id", "severity", "message", F.struct("path", "line", "symbol").alias("location"))).alias("findings"))
    one.select("findings").write.option("maxRecordsPerFile", 1).json(at)
    return S.read_findings(s, at)


_add("a5_read_findings", _found, _F("SELECT rule_id, severity, message, path, line, symbol FROM findings", "findings"))


def _covered(s, d):
    """Coverage XML of findings, written as text and read back."""
    at = fresh_path(s, "coverage")
    line = F.concat(F.lit('<line number="'), c("line").cast("string"), F.lit('" hits="'), (c("doc_id") % 3).cast("string"), F.lit('"/>'))
    x = fact(s, d, "findings").withColumn("path", F.when(c("doc_id") % 4 == 0, F.concat(F.lit("tests/"), "path")).otherwise(c("path"))).groupBy("path", F.floor(c("doc_id") / 10_000)).agg(F.array_join(F.collect_list(line), "").alias("lines"))
    x.select(F.concat(F.lit('<coverage><class filename="'), "path", F.lit('"><lines>'), "lines", F.lit("</lines></class></coverage>")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return S.read_coverage(s, at)


_add("a7_read_coverage", _covered, _F("SELECT path, line, doc_id % 3 AS hits FROM findings WHERE doc_id % 4 <> 0", "findings"))
_add("a6_read_jsonl", lambda s, d: S.read_jsonl(_t(s, d, "events").groupBy(F.expr("event_id div 500").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("event_id", F.when(c("event_id") % 10 == 3, F.lit("oops")).when(c("event_id") % 10 == 4, F.lit(" ")).otherwise(c("props")).alias("p")))).getField("p"), "\n").alias("text")), "k long").select("file", "line_no", "bad", "row.k"),
     "SELECT file, line_no, CASE WHEN e % 10 = 3 THEN 'oops' END AS bad, CASE WHEN e % 10 <> 3 THEN cast(json_extract(props, '$.k') AS bigint) END AS k FROM (SELECT event_id // 500 AS file, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS line_no, event_id AS e, props FROM events) WHERE e % 10 <> 4")


def _report(s, d):
    at = fresh_path(s, "report")
    S.write_report(fact(s, d, "accesses").groupBy("program", "kind").agg(F.count("*").alias("n")), at)
    return s.read.parquet(at).select(c("program").cast("string"), "kind", "n")


_add("a8_write_report", _report, _F("SELECT program, kind, count(*) AS n FROM accesses GROUP BY ALL", "accesses"))
