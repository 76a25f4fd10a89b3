"""Text at scale: leaks, identifiers, pairs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import code_hints, normalize_layout, redact_email, redact_value

c = F.col
#: Patterns of leaks, one group each, and texts of which a line with a match has one at least.
LEAKS = (
    ("windows_path", r"(?:^|[^\w/])([A-Za-z]:[\\/][^\s'\">|]+)", (":\\", ":/")),
    ("home_path", r"(?:^|[^\w.])(/(?:home|Users|mnt/c|mnt/[A-Za-z]/Users)/[^\s'\">]+)", ("/home/", "/Users/", "/mnt/")),
    ("local_endpoint", r"\b((?:localhost|127(?:\.\d{1,3}){3}|[a-z0-9-]+\.local)(?::\d{2,5})?)\b", ("localhost", "127.", ".local")),
    ("email", r"(?i)\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b", ("@",)),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ("-----BEGIN ",)),
    ("secret", r"(?i)[\"']?[a-z0-9_-]*?(?:api[_-]?key|token|secret|password|passwd|connection[_-]?string)[\"']?\s*[:=]\s*[\"']([^'\"]+)[\"']", ("\"", "'")),
)
#: Secrets that are none, and parts of paths that are examples.
PLACEHOLDERS = ("<repo-url>", "<repository-url>", "<token>", "<secret>", "changeme", "example", "example-token", "example-secret", "placeholder")
EXAMPLE_PATHS = ("%USERPROFILE%", r"C:\Users\MyUser")


def leak_scan(texts: DataFrame) -> DataFrame:
    """(id, line, rule, detail) for every match of every rule, a private key once a line; details are redacted. texts: (id, text).

    Secrets are quoted values; those of PLACEHOLDERS, or that begin with <, are none. Windows paths with a part of EXAMPLE_PATHS
    are none. A line is searched for a rule's pattern only if it has one of the rule's texts: most lines have none.
    """
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    none = F.array().cast("array<struct<rule string, value string>>")

    def matches(rule: str, pattern: str, needs: tuple):
        has = F.lit(False)
        for x in needs:
            has = has | F.contains("line", F.lit(x))
        found = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        return F.when(has, F.transform(F.slice(found, 1, 1) if rule == "private_key" else found, _named(rule))).otherwise(none)

    x = lines.select("id", (c("at") + 1).alias("line"), F.explode(F.concat(*(matches(*rule) for rule in LEAKS))).alias("m")).select("id", "line", "m.rule", F.when(c("m.rule") == "secret", F.trim("m.value")).otherwise(c("m.value")).alias("value"))
    example = F.lit(False)
    for p in EXAMPLE_PATHS:
        example = example | F.contains("value", F.lit(p))
    spared = ((c("rule") == "secret") & (F.lower("value").isin(*PLACEHOLDERS) | F.startswith("value", F.lit("<")))) | ((c("rule") == "windows_path") & example)
    detail = F.when(c("rule") == "email", redact_email(c("value"))).otherwise(redact_value(c("value")))
    return x.where(~spared).select("id", "line", "rule", detail.alias("detail"))


def _named(rule: str):
    return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("value"))


def identifier_scan(texts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(id, identifier, n): whole-word hits of single-token identifiers, without regard to case: a join of tokens, not a regex each. identifiers: (identifier)."""
    tokens = texts.select("id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("key")).where("key <> ''")
    per = tokens.groupBy("id", "key").agg(F.count("*").alias("n"))
    return per.join(identifiers.select("identifier", F.lower("identifier").alias("key")).distinct(), "key").select("id", "identifier", "n")


def comment_spans(texts: DataFrame) -> DataFrame:
    """(id, start_line, end_line, text) of comments (* ... *), which may nest; an unclosed one ends with the text. texts: (id, text)."""

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                text = text or ""
                depth, begin, i = 0, 0, 0
                while i < len(text):
                    two = text[i : i + 2]
                    if two == "(*":
                        begin = i if depth == 0 else begin
                        depth, i = depth + 1, i + 2
                    elif two == "*)" and depth:
                        depth, i = depth - 1, i + 2
                        if not depth:
                            rows.append((id_, text.count("\n", 0, begin) + 1, text.count("\n", 0, i) + 1, text[begin + 2 : i - 2]))
                    else:
                        i += 1
                if depth:
                    rows.append((id_, text.count("\n", 0, begin) + 1, text.count("\n") + 1, text[begin + 2 :]))
            yield pd.DataFrame(rows, columns=["id", "start_line", "end_line", "text"])

    return texts.select("id", "text").mapInPandas(scan, "id long, start_line long, end_line long, text string")


def comments_with_code(texts: DataFrame) -> DataFrame:
    """comment_spans that look like code, with a preview of 60 characters."""
    return comment_spans(texts).where(code_hints(c("text"))["like_code"]).select("id", "start_line", "end_line", F.left(F.trim("text"), F.lit(60)).alias("preview"))


def pair_classification(draft: DataFrame, official: DataFrame) -> DataFrame:
    """(name, status): identical, layout_only, structural, draft_only or official_only. Both: (name, text)."""
    x = draft.select("name", c("text").alias("a"), F.lit(1).alias("ia")).join(official.select("name", c("text").alias("b"), F.lit(1).alias("ib")), "name", "full_outer")
    status = F.when(c("ib").isNull(), "draft_only").when(c("ia").isNull(), "official_only").when(c("a").eqNullSafe(c("b")), "identical").when(normalize_layout(c("a")).eqNullSafe(normalize_layout(c("b"))), "layout_only").otherwise("structural")
    return x.select("name", status.alias("status"))


def line_change_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, added, deleted): lines of each pair as bags. Both: (name, text). A line's copies are summed before they meet."""
    lines = lambda df, n: df.select("name", F.explode(F.split("text", "\n")).alias("line")).groupBy("name", "line").agg(F.count("*").alias(n))
    x = lines(old, "o").join(lines(new, "n"), ["name", "line"], "full_outer")
    d = F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0))
    return x.groupBy("name").agg(F.sum(F.greatest(d, F.lit(0))).alias("added"), F.sum(F.greatest(-d, F.lit(0))).alias("deleted"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of lines at a time (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def line_diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, kept, added, deleted): lines of each pair in order, kept being their longest common subsequence. Both: (name, text). A null text has no lines; a pair is one row's work."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for name, a, b in zip(batch["name"], batch["a"], batch["b"], strict=True):
                a, b = (x.split("\n") if isinstance(x, str) else [] for x in (a, b))
                n = lcs_length(a, b)
                rows.append((name, n, len(b) - n, len(a) - n))
            yield pd.DataFrame(rows, columns=["name", "kept", "added", "deleted"])

    pairs = old.select("name", c("text").alias("a")).join(new.select("name", c("text").alias("b")), "name", "full_outer")
    return pairs.mapInPandas(count, "name string, kept long, added long, deleted long")


def entity_delta(old: DataFrame, new: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, status, changed): added, removed or changed entities, with the attributes that changed."""
    a = old.select(F.lower(key).alias("key"), *(c(x).alias(f"o_{x}") for x in attributes), F.lit(1).alias("io"))
    b = new.select(F.lower(key).alias("key"), *(c(x).alias(f"n_{x}") for x in attributes), F.lit(1).alias("in_"))
    changed = F.concat_ws(",", *(F.when(~c(f"o_{x}").eqNullSafe(c(f"n_{x}")), F.lit(x)) for x in attributes))
    both = c("io").isNotNull() & c("in_").isNotNull()
    x = a.join(b, "key", "full_outer").select("key", F.when(c("io").isNull(), "added").when(c("in_").isNull(), "removed").when(changed != "", "changed").alias("status"), F.when(both, changed).otherwise("").alias("changed"))
    return x.where("status is not null")
