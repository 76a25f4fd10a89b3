"""Telemetry and transcripts: durations, sessions, tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.scalars import duration_ms, prompt_bucket

c = F.col


def operation_summary(telemetry: DataFrame) -> DataFrame:
    """(operation, n, total_ms, max_ms, avg_ms, failures, cancelled); a missing name is unknown; only success = false fails. Sums are rounded once, to three digits."""
    ms = duration_ms(c("duration"))
    return telemetry.groupBy(F.coalesce("operation", F.lit("unknown")).alias("operation")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(ms), F.lit(0.0)), 3).alias("total_ms"), F.max(ms).alias("max_ms"), F.round(F.avg(ms), 3).alias("avg_ms"), F.count_if(~c("success")).alias("failures"), F.count_if("cancelled").alias("cancelled"))


def named_timings(events: DataFrame, field: str = "timings") -> DataFrame:
    """(name, n, total_ms, max_ms) of the timings in a column; durations below 0 are 0, what is no number is left out.

    field: map<string, number or text>; or a list of struct<phase, duration_ms>; or a map of such lists by analyzer, whose
    names are analyzer:phase. Sums are rounded once, to three digits.
    """
    kind = events.schema[field].dataType
    phases = lambda df: df.select(c("x.phase").alias("name"), c("x.duration_ms").cast("string").alias("ms"))
    if isinstance(kind, T.ArrayType):
        x = phases(events.select(F.explode(field).alias("x")))
    elif isinstance(kind.valueType, T.ArrayType):
        each = events.select(F.explode(field).alias("analyzer", "phases")).select("analyzer", F.explode("phases").alias("x"))
        x = each.select(F.concat("analyzer", F.lit(":"), "x.phase").alias("name"), c("x.duration_ms").cast("string").alias("ms"))
    else:
        x = events.select(F.explode(field).alias("name", "ms")).withColumn("ms", c("ms").cast("string"))
    x = x.withColumn("ms", duration_ms(c("ms"))).where("name is not null and ms is not null")
    return x.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 3).alias("total_ms"), F.max("ms").alias("max_ms"))


def bottleneck(events: DataFrame, field: str = "timings") -> DataFrame:
    """(id, name, ms): each event's longest timing; of equals the greater name."""
    longest = F.array_max(F.transform(F.map_entries(field), lambda e: F.struct(e["value"].alias("ms"), e["key"].alias("name"))))
    return events.select("id", longest.alias("x")).where("x is not null").select("id", "x.name", "x.ms")


def analyzer_bottlenecks(runs: DataFrame) -> DataFrame:
    """(analyzer, entries, issues, total_ms, max_ms, avg_ms). runs: (analyzer, issues, ms)."""
    return runs.groupBy("analyzer").agg(F.count("*").alias("entries"), F.sum("issues").alias("issues"), F.round(F.sum("ms"), 3).alias("total_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("ms"), 3).alias("avg_ms"))


def phase_spans(trace: DataFrame, slow_ms: float = 25.0, budget_ms: float = 50.0) -> DataFrame:
    """(phase, span_ms, slow, over_budget): from a phase's first to its last event. trace: (phase, offset_ms)."""
    x = trace.groupBy("phase").agg(F.round(F.max("offset_ms") - F.min("offset_ms"), 3).alias("span_ms"))
    return x.select("phase", "span_ms", (c("span_ms") >= slow_ms).alias("slow"), (c("span_ms") > budget_ms).alias("over_budget"))


def session_summary(events: DataFrame) -> DataFrame:
    """Per session: user, assistant and empty assistant messages, tool starts, failures, bucket of the first prompt."""
    n = lambda x: F.count_if(F.expr(x))
    first = F.min_by("content", F.when(c("type") == "user", c("seq")))
    return events.groupBy("session").agg(n("type = 'user'").alias("users"), n("type = 'assistant'").alias("assistants"), n("type = 'assistant' and trim(content) = ''").alias("empty_assistants"), n("type = 'tool.start'").alias("tool_calls"), n("type = 'tool.complete' and not success").alias("failures"), prompt_bucket(first).alias("bucket"))


#: Tools that look and don't act.
DISCOVERY_TOOLS = ("fetch_webpage", "file_search", "get_errors", "grep_search", "list_dir", "memory", "read_file", "semantic_search", "session_store_sql")


def discovery_before_action(events: DataFrame) -> DataFrame:
    """(session, discovery): starts of discovery tools before the first other tool; null where there is none. Two aggregates, no window."""
    starts = events.where("type = 'tool.start'")
    first = starts.where(~c("tool").isin(*DISCOVERY_TOOLS)).groupBy("session").agg(F.min("seq").alias("first"))
    counted = starts.where(c("tool").isin(*DISCOVERY_TOOLS)).join(first, "session").where("seq < first").groupBy("session").agg(F.count("*").alias("n"))
    return events.select("session").distinct().join(first, "session", "left").join(counted, "session", "left").select("session", F.when(c("first").isNotNull(), F.coalesce("n", F.lit(0))).alias("discovery"))


def same_tool_retries(events: DataFrame) -> DataFrame:
    """(session, retries): starts of the tool whose completion just failed, without another start between."""
    e = events.where("type in ('tool.start', 'tool.complete')").where("type = 'tool.start' or not success")
    w = W.partitionBy("session").orderBy("seq")
    x = e.withColumn("before", F.lag(F.struct("type", "tool")).over(w))
    hit = (c("type") == "tool.start") & (c("before.type") == "tool.complete") & (c("before.tool") == c("tool"))
    return x.groupBy("session").agg(F.count_if(hit).alias("retries"))


def tool_counts(events: DataFrame) -> DataFrame:
    """(tool, n) of tool starts."""
    return events.where("type = 'tool.start'").groupBy("tool").agg(F.count("*").alias("n"))


def top_tools(events: DataFrame, k: int = 10) -> DataFrame:
    """The k tools started most often, then by name: a report's top list."""
    return tool_counts(events).orderBy(c("n").desc(), "tool").limit(k)


def bucket_summary(sessions: DataFrame, discovery: DataFrame) -> DataFrame:
    """(bucket, sessions, empty_rate, failures, avg_discovery, max_discovery)."""
    x = sessions.join(discovery, "session", "left")
    rate = F.when(F.sum("assistants") > 0, F.round(F.sum("empty_assistants") / F.sum("assistants"), 4)).otherwise(0.0)
    return x.groupBy("bucket").agg(F.count("*").alias("sessions"), rate.alias("empty_rate"), F.sum("failures").alias("failures"), F.round(F.avg("discovery"), 4).alias("avg_discovery"), F.max("discovery").alias("max_discovery"))


def grounding_overlap(sessions: DataFrame) -> DataFrame:
    """(session, overlap, ratio, status) of candidate and referenced files (arrays): no-results without candidates, ungrounded without a match, else ok. Paths match without regard to case."""
    found = F.array_distinct(F.coalesce("candidates", F.array().cast("array<string>")))
    known = F.transform(F.coalesce("referenced", F.array().cast("array<string>")), lambda x: F.lower(x))
    n, total = F.size(F.filter(found, lambda x: F.array_contains(known, F.lower(x)))), F.size(found)
    ratio = F.when(total > 0, F.round(n / total, 4)).otherwise(0.0)
    return sessions.select("session", n.cast("long").alias("overlap"), ratio.alias("ratio"), F.when(total == 0, "no-results").when(n == 0, "ungrounded").otherwise("ok").alias("status"))


def chat_findings(buckets: DataFrame, retries: DataFrame, grounding: DataFrame, empty_rate: float = 0.2, discovery: float = 5.0, match_rate: float = 0.5) -> DataFrame:
    """(rule, subject): buckets with many empty messages or much discovery, sessions with retries, and low_grounding if under match_rate of the sessions searched are ok. grounding: grounding_overlap's rows."""
    a = buckets.where(c("empty_rate") >= empty_rate).select(F.lit("empty_messages").alias("rule"), c("bucket").alias("subject"))
    b = buckets.where(c("avg_discovery") >= discovery).select(F.lit("much_discovery").alias("rule"), c("bucket").alias("subject"))
    r = retries.where("retries > 0").select(F.lit("tool_retries").alias("rule"), c("session").cast("string").alias("subject"))
    some = grounding.agg(F.count("*").alias("n"), F.count_if(c("status") == "ok").alias("hit"))
    g = some.where((c("n") > 0) & (c("hit") < match_rate * c("n"))).select(F.lit("low_grounding").alias("rule"), F.lit("sessions").alias("subject"))
    return a.unionByName(b).unionByName(r).unionByName(g)
