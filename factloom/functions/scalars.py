"""Scalar functions over names, paths, tags and texts: columns in, columns out, built-in functions only.

Null in gives null out unless a function says otherwise. Keys are lower-cased with `lower`, not casefolded:
the two differ for a few letters such as the German sharp s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def name_key(c: Column) -> Column:
    """Case-insensitive key of a name."""
    return F.lower(F.trim(c))


def dedupe_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row per key: the first spelling by order, then by spelling; blank names are dropped."""
    keyed = df.withColumn("key", name_key(F.col(name))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct(order, name)).alias("x")).select("key", F.col(f"x.{name}").alias("name"))


def path_conflicts(a: Column, b: Column) -> Column:
    """Whether one dotted path is a prefix of the other, by segments and without regard to case."""
    a, b = F.lower(a), F.lower(b)
    return F.startswith(F.concat(a, F.lit(".")), F.concat(b, F.lit("."))) | F.startswith(F.concat(b, F.lit(".")), F.concat(a, F.lit(".")))


def conflict_rep(a: Column, b: Column) -> Column:
    """Of two conflicting paths, the shorter by segments; of equals the first argument."""
    n = lambda c: F.size(F.split(c, r"\."))
    return F.when(n(b) < n(a), b).otherwise(a)


def identifier_tokens(c: Column) -> Column:
    """Lower-cased tokens: split at anything but letters and digits, then at case changes and digit runs."""
    parted = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(parted, F.lit("([A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1)), F.lower)


def identifier_style(c: Column) -> Column:
    """upper_snake, snake, pascal, upper, lower, camel or unknown; the first that fits. One letter, or one with digits, is pascal."""
    return (
        F.when(F.rlike(c, F.lit("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$")), "upper_snake")
        .when(F.rlike(c, F.lit("^[a-z][a-z0-9]*(_[a-z0-9]+)+$")), "snake")
        .when(F.rlike(c, F.lit("^[A-Z]([0-9]*|[A-Z0-9]*[a-z][A-Za-z0-9]*)$")), "pascal")
        .when(F.rlike(c, F.lit("^[A-Z][A-Z0-9]*$")), "upper")
        .when(F.rlike(c, F.lit("^[a-z][a-z0-9]*$")), "lower")
        .when(F.rlike(c, F.lit("^[a-z][A-Za-z0-9]*$")), "camel")
        .otherwise("unknown")
    )


def tag_key(c: Column) -> Column:
    """Trimmed lower-cased tag; null for blank and numeric ones."""
    t = F.lower(F.trim(c))
    return F.when((t != "") & ~F.rlike(t, F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?$")), t)


def tag_family_key(c: Column) -> Column:
    """Tokens of a tag, joined by a bar; null for blank and numeric ones."""
    return F.when(tag_key(c).isNotNull(), F.array_join(identifier_tokens(F.trim(c)), "|"))


def limit_binding(c: Column) -> Column:
    """struct(bound, body) of names like MinX, X_max or x-min: prefix first, then suffix; the body has no _ or - at its ends; null for others."""
    body = "([^_-]|[^_-].*[^_-])"
    pre, post = f"(?i)^(minimum|maximum|min|max)[_-]*{body}[_-]*$", f"(?i)^[_-]*{body}[_-]*(minimum|maximum|min|max)$"
    bound = lambda x: F.lower(F.substring(x, 1, 3))
    first = F.struct(bound(F.regexp_extract(c, pre, 1)).alias("bound"), F.lower(F.regexp_extract(c, pre, 2)).alias("body"))
    last = F.struct(bound(F.regexp_extract(c, post, 2)).alias("bound"), F.lower(F.regexp_extract(c, post, 1)).alias("body"))
    return F.when(F.rlike(c, F.lit(pre)), first).when(F.rlike(c, F.lit(post)), last)


def literal_signature(value: Column, kind: Column) -> Column:
    """kind:value, with string values trimmed and lower-cased."""
    return F.concat(kind, F.lit(":"), F.when(kind == "string", F.lower(F.trim(value))).otherwise(value))


#: White space that trimming takes off: what counts as such in Unicode.
BLANK = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


#: Program and path after a prefix of one letter and two colons, which may be missing.
ICF_REF = r"^(?:^|.*?)(?:[A-Za-z]::)?([^:]+):(.+)$"


def icf_ref(c: Column) -> Column:
    """struct(program, path) of F::Program:Path or Program:Path; null for others."""
    t = stripped(c)
    program, path = (stripped(F.regexp_extract(t, ICF_REF, k)) for k in (1, 2))
    return F.when(F.rlike(t, F.lit(ICF_REF)) & (program != "") & (path != ""), F.struct(program.alias("program"), path.alias("path")))


def icf_prefix(c: Column) -> Column:
    """Upper-cased letter before the double colon; null without."""
    p = "^([A-Za-z])::"
    return F.when(F.rlike(stripped(c), F.lit(p)), F.upper(F.regexp_extract(stripped(c), p, 1)))


def icf_is_placeholder(c: Column) -> Column:
    """Whether a value is a placeholder such as X::."""
    return F.rlike(stripped(c), F.lit(r"^[A-Za-z]::\.$"))


#: Keywords by class, in the order in which classes are tried.
SIGNAL_KEYWORDS = (
    ("mes", ("mes", "mms", "opc", "batch")),
    ("operator", ("operator", "manual", "command", "cmd", "setpoint")),
    ("sensor", ("sensor", "measurement", "measured", "feedback", "probe", "transmitter")),
)
SINK_KEYWORDS = ("emergency", "shutdown", "estop", "interlock", "trip")
SAFETY_KEYWORDS = ("emergency", "shutdown", "estop")


def classify_signal_path(path: Column, keywords=SIGNAL_KEYWORDS) -> Column:
    """Class of the first segment of a dotted path that holds a keyword; within a segment, the first class that fits."""
    segments = F.transform(F.split(F.lower(path), r"\."), lambda s: F.regexp_replace(s, "[^a-z0-9]", ""))
    kind = lambda s: F.coalesce(*(F.when(F.rlike(s, F.lit("|".join(words))), F.lit(name)) for name, words in keywords))
    return F.get(F.filter(F.transform(segments, kind), lambda k: k.isNotNull()), F.lit(0))


def holds_keyword(path: Column, words=SINK_KEYWORDS) -> Column:
    """Whether any segment of a dotted path, without its punctuation, holds a keyword."""
    return F.exists(F.split(F.lower(path), r"\."), lambda s: F.rlike(F.regexp_replace(s, "[^a-z0-9]", ""), F.lit("|".join(words))))


def prompt_bucket(c: Column) -> Column:
    """implement-this-plan, review, audit, validate or other; the first whose phrase the prompt holds."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(t, F.lit("implement this plan")) | F.contains(t, F.lit("implement plan")), "implement-this-plan").when(F.contains(t, F.lit("review")), "review").when(F.contains(t, F.lit("audit")), "audit").when(F.contains(t, F.lit("validate")), "validate").otherwise("other")


def redact_value(c: Column) -> Column:
    """<redacted> up to six characters, else the first and last two."""
    return F.when(F.length(c) <= 6, "<redacted>").otherwise(F.concat(F.left(c, F.lit(2)), F.lit("..."), F.right(c, F.lit(2))))


def redact_email(c: Column) -> Column:
    """First letter and domain of an address."""
    return F.concat(F.left(c, F.lit(1)), F.lit("***@"), F.element_at(F.split(c, "@"), -1))


def severity_for_path(path: Column, default: Column) -> Column:
    """default, but medium instead of high under tests/ and Libs/."""
    return F.when((F.startswith(path, F.lit("tests/")) | F.startswith(path, F.lit("Libs/"))) & (default == "high"), "medium").otherwise(default)


def sanitize_path(path: Column, root: str) -> Column:
    """Path with slashes, relative to root; <external>/name for others."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(root + "/")), F.substring(p, len(root) + 2, 10**6)).otherwise(F.concat(F.lit("<external>/"), F.element_at(F.split(p, "/"), -1)))


#: What assignments, calls, control words and comparisons look like. A word begins where no letter, digit or _ is before it.
_WORD = r"(?:^|[^\p{L}\p{N}_])"
CODE = (
    ("assignment", _WORD + r"[A-Za-z_][A-Za-z0-9_:.]*\s*(?::=|=(?:[^=]|$))"),
    ("call", _WORD + r"[A-Za-z_][A-Za-z0-9_]*\s*\([^()\n]*\S[^()\n]*\)"),
    ("control", r"(?i)" + _WORD + r"(?:IF|THEN|ELSIF|ELSE|ENDIF|FOR|WHILE|REPEAT|UNTIL|CASE|ENDCASE|SEQUENCE|ENDSEQUENCE|EQUATIONBLOCK|MODULECODE|LOCALVARIABLES|TYPEDEFINITIONS)(?:[^\p{L}\p{N}_]|$)"),
    ("comparison", _WORD + r"[A-Za-z_][A-Za-z0-9_:.]*\s*(?:<=|>=|<>|<|>)"),
)


def code_hints(text: Column) -> Column:
    """struct(assignment, call, control, comparison, like_code): like_code is an assignment, call or comparison, or a control word with a semicolon."""
    has = {name: F.rlike(text, F.lit(p)) for name, p in CODE}
    like = has["assignment"] | has["call"] | has["comparison"] | (has["control"] & F.contains(text, F.lit(";")))
    return F.struct(*(x.alias(name) for name, x in has.items()), like.alias("like_code"))


def normalize_layout(text: Column) -> Column:
    """One kind of line end, no white space at line ends, runs of empty lines as one, none at the end of the text, and a line feed there."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    blank = BLANK.replace(r"\n", "")
    t = F.regexp_replace(F.regexp_replace(t, f"{blank}+\n", "\n"), blank + r"+\z", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\n{2,}", "\n")
    return F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n"))


def finding_fingerprint(rule: Column, path: Column, line: Column, symbol: Column, message: Column) -> Column:
    """rule|path|line|symbol|message, with missing parts empty."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (rule, path, line, symbol, message)))


def duration_ms(c: Column) -> Column:
    """A number or a numeric string as milliseconds, not below 0, to three digits (half to even); null for others."""
    x = c.try_cast("double")
    return F.when(x.isNotNull(), F.bround(F.greatest(x, F.lit(0.0)), 3))
