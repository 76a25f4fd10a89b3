"""External interface inventories: tags and ICF entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import icf_is_placeholder, icf_prefix, icf_ref, stripped, tag_family_key, tag_key
from ..shared import stored

c = F.col


def duplicate_tags(tags: DataFrame) -> DataFrame:
    """(source_kind, key, n): a tag twice or more within one kind of source."""
    return tags.withColumn("key", tag_key(c("external_tag"))).where("key is not null").groupBy("source_kind", "key").agg(F.count("*").alias("n")).where("n >= 2")


def tag_datatype_mismatch(tags: DataFrame) -> DataFrame:
    """(key, datatypes): tags with two known datatypes or more."""
    x = tags.withColumn("key", tag_key(c("external_tag"))).where("key is not null").groupBy("key").agg(F.sort_array(F.collect_set("datatype")).alias("d"))
    return x.where(F.size("d") >= 2).select("key", F.array_join("d", ",").alias("datatypes"))


def tag_naming_drift(tags: DataFrame) -> DataFrame:
    """(family, spellings): families of tags with two spellings or more."""
    x = tags.withColumn("family", tag_family_key(c("external_tag"))).where("family is not null").groupBy("family").agg(F.sort_array(F.collect_set(F.trim("external_tag"))).alias("s"))
    return x.where(F.size("s") >= 2).select("family", F.array_join("s", ",").alias("spellings"))


def dead_tags(tags: DataFrame, writes: DataFrame) -> DataFrame:
    """Outgoing tags whose variable nothing writes: (var_key, external_tag). writes: (var_key)."""
    return tags.where("direction = 'outgoing'").join(writes.select("var_key").distinct(), "var_key", "left_anti").select("var_key", "external_tag")


def icf_entries(lines: DataFrame) -> DataFrame:
    """key=value lines with the headers above them: (file, line_no, unit, operation, journal, grp, key, value). lines: (file, line_no, line).

    [Unit x] [Operation y] [Journal z] [Group g] headers hold until one of the same or an outer level; an
    unknown header clears all but the unit; ; and # start comments. A header without a name takes away what it would
    name. Any other line with = is an entry: its key is what stands before the first one, be it nothing.
    """
    text = stripped(c("line"))
    tag = r"^\[([^\]\s]+)(?:\s+(.+?))?\]$"
    header, label = F.regexp_extract(text, tag, 1), stripped(F.regexp_extract(text, tag, 2))
    name = F.when(label != "", label)
    level = F.when(header == "", None).when(F.lower(header) == "unit", 1).when(F.lower(header) == "operation", 2).when(F.lower(header) == "journal", 3).when(F.lower(header) == "group", 4).otherwise(5)
    x = lines.where(~F.rlike(text, F.lit("^[;#]"))).withColumn("level", level).withColumn("name", name)
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    for n in (1, 2, 3, 4):
        x = x.withColumn(f"at{n}", F.last(F.when(c("level") == n, F.struct("line_no", "name")), ignorenulls=True).over(w))
    x = x.withColumn("unknown", F.last(F.when(c("level") == 5, c("line_no")), ignorenulls=True).over(w))

    def held(n: int):
        # cut off by a later header of an outer level, or (but for the unit) by an unknown one
        outer = [c(f"at{m}.line_no") for m in range(1, n)] + ([c("unknown")] if n > 1 else [])
        alive = F.lit(True)
        for o in outer:
            alive = alive & (o.isNull() | (o < c(f"at{n}.line_no")))
        return F.when(alive, c(f"at{n}.name"))

    x = x.where(c("level").isNull() & F.contains(text, F.lit("=")))
    key = stripped(F.substring_index(text, "=", 1))
    value = stripped(F.substr(text, F.locate("=", text) + 1))
    return x.select("file", "line_no", held(1).alias("unit"), held(2).alias("operation"), held(3).alias("journal"), held(4).alias("grp"), key.alias("key"), value.alias("value"))


def icf_validate(entries: DataFrame, symbols: DataFrame, record_fields: DataFrame) -> DataFrame:
    """(id, status), the first that fits: placeholder, unparseable, program_mismatch, unresolved_path, invalid_field, valid.

    entries: (id, program, value); symbols: (path, datatype) of variables; record_fields: (record_key, field, datatype). A path
    is resolved by the longest symbol that it begins with; what follows are fields, looked up a segment a round from the
    symbol's type on. Names are compared without regard to case.
    """
    ref = icf_ref(c("value"))
    early = F.when(icf_is_placeholder(c("value")), "placeholder").when(ref.isNull(), "unparseable").when(F.lower(ref["program"]) != F.lower("program"), "program_mismatch")
    x = stored(entries.select("id", early.alias("status"), F.lower(ref["path"]).alias("path")), "references")
    steps = F.split("path", r"\.")
    open_ = x.where("status is null").select("id", "path")
    up = open_.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(steps, F.lit(1), n), ".").alias("symbol")))).alias("u")).select("id", "path", "u.n", "u.symbol")
    known = symbols.groupBy(F.lower("path").alias("symbol")).agg(F.min(F.lower("datatype")).alias("type"))
    found = up.join(known, "symbol").groupBy("id", "path").agg(F.max(F.struct("n", "type")).alias("x"))
    now = found.select("id", c("x.type").alias("type"), F.slice(steps, c("x.n") + 1, F.size(steps)).alias("way"))
    field = record_fields.groupBy(F.lower("record_key").alias("type"), F.lower("field").alias("step")).agg(F.min(F.lower("datatype")).alias("next"))
    now, told = stored(now, "fields"), None
    while True:
        done = now.where("size(way) = 0").select("id", F.lit("valid").alias("late"))
        told = done if told is None else told.unionByName(done)
        more = now.where("size(way) > 0")
        if more.isEmpty():
            break
        on = more.withColumn("step", F.element_at("way", 1)).join(field, ["type", "step"], "left")
        told = told.unionByName(on.where("next is null").select("id", F.lit("invalid_field").alias("late")))
        now = stored(on.where("next is not null").select("id", c("next").alias("type"), F.slice("way", F.lit(2), F.size("way")).alias("way")), "fields")
    return x.join(told, "id", "left").select("id", F.coalesce("status", "late", F.lit("unresolved_path")).alias("status"))


def icf_context_check(entries: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(id, issue): unit_mismatch, an entry whose unit isn't a segment of its path; group_mismatch, one whose path ends with none of the suffixes of its group and key.

    entries: (id, unit, grp, key, path); suffixes: (grp, key, suffix), dotted. A segment is a suffix's if it equals it or ends
    with an underscore and it. Entries without a unit, or of a group and key without suffixes, are right. No regard to case.
    """
    steps = F.split(F.lower("path"), r"\.")
    unit = entries.where("unit <> ''").where(~F.array_contains(steps, F.lower("unit"))).select("id", F.lit("unit_mismatch").alias("issue"))
    low = lambda x: F.lower(x).alias(x)
    asked = entries.select("id", low("grp"), low("key"), steps.alias("steps")).join(suffixes.select(low("grp"), low("key"), F.split(F.lower("suffix"), r"\.").alias("suffix")), ["grp", "key"])
    n = F.size("suffix")
    ends = F.slice("steps", F.greatest(F.size("steps") - n + 1, F.lit(1)), n)
    fits = (F.size("steps") >= n) & F.forall(F.zip_with(ends, "suffix", lambda a, s: (a == s) | F.endswith(a, F.concat(F.lit("_"), s))), lambda x: x)
    bad = asked.groupBy("id").agg(F.bool_or(fits).alias("any")).where("not any")
    return unit.unionByName(bad.select("id", F.lit("group_mismatch").alias("issue")))


def icf_case_mismatch(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, path, spelled): paths that a symbol has in another spelling only."""
    s = symbols.select(c("path").alias("spelled"), F.lower("path").alias("key")).distinct()
    x = entries.withColumn("key", F.lower("path")).join(s, "key")
    exact = x.where("path = spelled").select("id")
    return x.join(exact, "id", "left_anti").groupBy("id", "path").agg(F.min("spelled").alias("spelled"))


def icf_mixed_prefix(entries: DataFrame) -> DataFrame:
    """(file, prefixes) of files with two prefixes or more. entries: (file, value)."""
    x = entries.withColumn("p", icf_prefix(c("value"))).groupBy("file").agg(F.sort_array(F.collect_set("p")).alias("p"))
    return x.where(F.size("p") >= 2).select("file", F.array_join("p", ",").alias("prefixes"))


def icf_record_completeness(records: DataFrame, present: DataFrame, required: DataFrame) -> DataFrame:
    """(record, field): required fields that a record lacks; a field below it (field.x) counts. present: (record, field)."""
    first = present.select("record", F.element_at(F.split("field", r"\."), 1).alias("field")).distinct()
    wanted = records.select("record", "kind").distinct().join(required, "kind")
    return wanted.join(first, ["record", "field"], "left_anti").select("record", "field")


def icf_unit_drift(entries: DataFrame) -> DataFrame:
    """(kind, unit, first_unit): units whose ordered entries, the unit's name masked, differ from those of the kind's first unit. entries: (kind, unit, line_no, entry)."""
    sig = entries.groupBy("kind", "unit").agg(F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.replace("entry", "unit", F.lit("<unit>")).alias("e")))), lambda x: x["e"])), 256).alias("sig"))
    first = sig.groupBy("kind").agg(F.min(F.struct("unit", "sig")).alias("x")).select("kind", c("x.unit").alias("first_unit"), c("x.sig").alias("first_sig"))
    return sig.join(first, "kind").where("sig <> first_sig").select("kind", "unit", "first_unit")
