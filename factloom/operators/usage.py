"""Declarations and accesses: usage, fields, coupling, shadowing, parameters.

Accesses are large; they are aggregated to a row per variable (or variable and module) before any join with
declarations, so the shuffle carries the aggregate. Keys are lower-cased names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import identifier_tokens
from ..shared import discard, freed, shuffled, stored, written

c = F.col


def usage_summary(decls: DataFrame, accesses: DataFrame) -> DataFrame:
    """Per variable: read, written, ui_read, non_ui_read, distinct reader and writer modules. Variables without accesses have false and 0."""
    r, w = c("kind") == "read", c("kind") == "write"
    used = accesses.groupBy("var_key").agg(F.bool_or(r).alias("read"), F.bool_or(w).alias("written"), F.bool_or(r & c("is_ui")).alias("ui_read"), F.bool_or(r & ~c("is_ui")).alias("non_ui_read"), F.count_distinct(F.when(r, c("module_path"))).alias("readers"), F.count_distinct(F.when(w, c("module_path"))).alias("writers"))
    flag = lambda x: F.coalesce(c(x), F.lit(False)).alias(x)
    return decls.join(used, "var_key", "left").select(*decls.columns, *map(flag, ("read", "written", "ui_read", "non_ui_read")), *(F.coalesce(c(x), F.lit(0)).cast("long").alias(x) for x in ("readers", "writers")))


def classify_usage(decls: DataFrame, accesses: DataFrame, effective: DataFrame | None = None, status_bound: DataFrame | None = None, ignorable: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """usage_summary with `issue`, the first that fits; null for none.

    unused: neither read nor written. procedure_status: a procedure reports its status to it, and nothing but the user
    interface reads it. ui_only: read, and by the user interface alone, written or not. read_only_non_const: a local
    that is read, never written and no constant. never_read: a local that is written and never read. write_without_effect:
    read and written, but its value reaches no sink, and no procedure reports to it.

    effective: (var_key) of the variables whose value reaches a sink; without it, no write is without effect. status_bound:
    (var_key) that procedures report their status to. ignorable: (var_key) bound to outputs that may go unread: never
    never_read. fixed: (var_key) that can't be constants: never read_only_non_const.
    """
    u = usage_summary(decls, accesses)

    def held(keys: DataFrame | None, flag: str, missing: bool) -> Column:
        nonlocal u
        if keys is None:
            return F.lit(missing)
        u = u.join(keys.select("var_key").distinct().withColumn(flag, F.lit(True)), "var_key", "left")
        return F.coalesce(c(flag), F.lit(False))

    reaches, bound = held(effective, "_reaches", True), held(status_bound, "_bound", False)
    spared, unfit = held(ignorable, "_ignorable", False), held(fixed, "_fixed", False)
    local = c("role") == "local"
    issue = (
        F.when(~c("read") & ~c("written"), "unused")
        .when(bound & c("written") & ~c("non_ui_read"), "procedure_status")
        .when(c("ui_read") & ~c("non_ui_read"), "ui_only")
        .when(local & c("read") & ~c("written") & ~c("is_const") & ~unfit, "read_only_non_const")
        .when(local & c("written") & ~c("read") & ~spared, "never_read")
        .when(c("read") & c("written") & ~reaches & ~bound, "write_without_effect")
    )
    return u.withColumn("issue", issue).drop("_reaches", "_bound", "_ignorable", "_fixed")


def propagate_aliases(accesses: DataFrame, links: DataFrame) -> DataFrame:
    """Accesses with those of each child variable added for its parent, field prefix first; links (parent_key, child_key, prefix, level), lower levels first.

    The accesses meet all links once, and so does what a level has added those of later levels; what waits for its level is
    written. Nothing of a finished level is left but its table: the shuffles of one write are on disk at a time.
    """
    spark = accesses.sparkSession
    down = stored(links.select(c("child_key").alias("var_key"), "parent_key", "prefix", "level"), "links")
    known = stored(accesses, "accesses")
    field = F.concat_ws(".", F.when(c("prefix") != "", c("prefix")), F.when(c("field") != "", c("field")))
    up = lambda rows, at: rows.join(shuffled(at), "var_key").withColumn("field", field).withColumn("var_key", c("parent_key")).select(*accesses.columns, "level")
    levels = [r[0] for r in down.select("level").distinct().orderBy("level").collect()]  # the depth of the module tree
    out, waiting = [known], [stored(up(known, down), "aliases")]
    freed(spark)
    for n in levels:
        at = [x.where(c("level") == n) for x in waiting]
        added = stored(reduce(DataFrame.unionByName, at).drop("level").distinct(), "aliases")
        out.append(added)
        freed(spark)
        if n != levels[-1]:
            waiting.append(stored(up(added, down.where(c("level") > n)), "waiting"))
            freed(spark)
    discard(*waiting)
    return reduce(DataFrame.unionByName, out)


def distinct_counts(rows: DataFrame, *by: str, slice_rows: int = 20_000_000) -> DataFrame:
    """(*by, n): the distinct rows of each group.

    Distinct rows and groups share one shuffle. Of many rows slices by the first column are counted and written one after
    another, up to 16, so that the shuffle of one slice is on disk at a time.
    """
    slices = min(16, rows.count() // slice_rows + 1)
    out = []
    for i in range(slices):
        part = rows.where(F.pmod(F.xxhash64(by[0]), F.lit(slices)) == i) if slices > 1 else rows
        out.append(stored(part.repartition(*by).distinct().groupBy(*by).agg(F.count("*").alias("n")), "counts"))
        freed(rows.sparkSession)
    return reduce(DataFrame.unionByName, out)


def expand_leaf_fields(decls: DataFrame, record_fields: DataFrame, max_depth: int = 16) -> DataFrame:
    """Rows (var_key, leaf, datatype): every leaf path of a variable; a type without fields, or met again on its own path, is a leaf."""
    now = decls.select("var_key", F.lit("").alias("leaf"), c("datatype").alias("type"), F.array("datatype").alias("seen"))
    fields = record_fields.select(c("record_key").alias("type"), "field", c("datatype").alias("next"))
    out = None
    for _ in range(max_depth):
        joined = now.join(fields, "type", "left")
        done = joined.where("field is null").select("var_key", "leaf", c("type").alias("datatype"))
        open_ = joined.where("field is not null").select("var_key", F.concat_ws(".", F.when(c("leaf") != "", c("leaf")), "field").alias("leaf"), c("next").alias("type"), "seen")
        again = F.array_contains("seen", c("type"))
        done = done.unionByName(open_.where(again).select("var_key", "leaf", c("type").alias("datatype")))
        out = done if out is None else out.unionByName(done)
        now = written(open_.where(~again).withColumn("seen", F.array_append("seen", c("type"))))
        if not now.limit(1).count():
            return out
    raise RuntimeError(f"records nest deeper than {max_depth}")


def field_asymmetry(leaves: DataFrame, accesses: DataFrame) -> DataFrame:
    """Leaves read but never written, or written but never read, also through a prefix of their path: (var_key, leaf, issue)."""
    steps = F.split("leaf", r"\.")
    prefixes = leaves.select("var_key", "leaf", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "."))).alias("field"))
    kinds = accesses.groupBy("var_key", "field").agg(F.bool_or(c("kind") == "read").alias("r"), F.bool_or(c("kind") == "write").alias("w"))
    x = prefixes.join(kinds, ["var_key", "field"]).groupBy("var_key", "leaf").agg(F.bool_or("r").alias("r"), F.bool_or("w").alias("w"))
    return x.where("r <> w").select("var_key", "leaf", F.when(c("r"), "read_never_written").otherwise("written_never_read").alias("issue"))


def unused_record_fields(leaves: DataFrame, accesses: DataFrame) -> DataFrame:
    """(record, leaf) that no variable of the record type touches; types that are accessed whole, or not at all, are skipped. leaves: (record, var_key, leaf)."""
    vars_ = leaves.select("record", "var_key").distinct()
    touched = accesses.select("var_key", "field").distinct().join(vars_, "var_key")
    whole = touched.groupBy("record").agg(F.bool_or(c("field") == "").alias("whole")).where("not whole").select("record")
    used = touched.select("record", "field").distinct()
    candidates = leaves.select("record", "leaf").distinct().join(whole, "record", "left_semi")
    steps = F.split("leaf", r"\.")
    each = candidates.select("record", "leaf", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "."))).alias("field"))
    hit = each.join(used, ["record", "field"], "left_semi").select("record", "leaf").distinct()
    return candidates.join(hit, ["record", "leaf"], "left_anti")


def root_access_by_module(accesses: DataFrame) -> DataFrame:
    """Per variable and module: the sorted kinds of access, and whether one is to the whole variable."""
    return accesses.groupBy("var_key", "module_path").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.bool_or(c("field") == "").alias("root_level"))


def hidden_coupling(accesses: DataFrame) -> DataFrame:
    """Variables that two modules or more use and one or more writes: (var_key, modules, writers, module_list)."""
    per = accesses.groupBy("var_key", "module_path").agg(F.bool_or(c("kind") == "write").alias("w"))
    return per.groupBy("var_key").agg(F.count("*").alias("modules"), F.count_if("w").alias("writers"), F.array_join(F.sort_array(F.collect_list("module_path")), ", ").alias("module_list")).where("modules >= 2 and writers >= 1")


def high_fan_in_out(accesses: DataFrame, threshold: int = 3) -> DataFrame:
    """Variables with threshold or more distinct reader or writer modules."""
    n = lambda k: F.count_distinct(F.when(c("kind") == k, c("module_path")))
    return accesses.groupBy("var_key").agg(n("read").alias("readers"), n("write").alias("writers")).where((c("readers") >= threshold) | (c("writers") >= threshold))


def scope_minimization(accesses: DataFrame, declared_depth: int = 1) -> DataFrame:
    """Variables without whole access whose users share a module path deeper than where they are declared: (var_key, scope).

    The common prefix of all paths is that of the smallest and the largest one.
    """
    ends = accesses.groupBy("var_key").agg(F.bool_or(c("field") == "").alias("root"), F.min("module_path").alias("a"), F.max("module_path").alias("z")).where("not root")
    a, z = F.split("a", r"\."), F.split("z", r"\.")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(z))), lambda n: F.when(F.slice(a, 1, n) == F.slice(z, 1, n), n).otherwise(0))
    x = ends.withColumn("depth", F.array_max(same)).where(c("depth") > declared_depth)
    return x.select("var_key", F.array_join(F.slice(a, F.lit(1), c("depth")), ".").alias("scope"))


def duplicate_complex_types(decls: DataFrame, known_types: DataFrame, least: int = 2) -> DataFrame:
    """(scope, datatype, n) of undeclared types that a scope uses least times or more; anytype is no type."""
    return decls.where("datatype <> 'anytype'").join(known_types, "datatype", "left_anti").groupBy("scope", "datatype").agg(F.count("*").alias("n")).where(c("n") >= least)


def shadowing(locals_: DataFrame) -> DataFrame:
    """Locals that hide the nearest enclosing local of the same name. locals_: (name, path: dotted scope, id). Rows (id, hidden_id).

    Of the locals of one name in one scope the one with the smallest id is hidden, so that each scope above is met once.
    """
    a = locals_.select(F.lower("name").alias("key"), c("path").alias("inner"), "id")
    b = locals_.select(F.lower("name").alias("key"), c("path").alias("outer"), "id").groupBy("key", "outer").agg(F.min("id").alias("hidden_id"))
    steps = F.split("inner", r"\.")
    up = a.withColumn("outer", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), ".")))).where("outer <> inner")
    found = up.join(b, ["key", "outer"])
    return found.groupBy("id").agg(F.max(F.struct(F.size(F.split("outer", r"\.")).alias("d"), (-c("hidden_id")).alias("h"))).alias("x")).select("id", (-c("x.h")).alias("hidden_id"))


def name_collisions(decls: DataFrame) -> DataFrame:
    """(scope, key) declared both as a parameter and as a local."""
    return decls.groupBy("scope", F.lower("name").alias("key")).agg(F.bool_or(c("role") == "parameter").alias("p"), F.bool_or(c("role") == "local").alias("l")).where("p and l").select("scope", "key")


def magic_numbers(accesses: DataFrame, allowed: tuple = (0,)) -> DataFrame:
    """(literal, n) of the numeric literals written in code, but for the allowed ones."""
    return accesses.where((c("kind") == "write") & ~c("literal").isin(*allowed)).groupBy("literal").agg(F.count("*").alias("n"))


#: Prefixes and suffixes of lower-cased names by role, in the order in which roles are tried.
NAMING_ROLES = (("command", (), ("cmd",)), ("status", (), ("status",)), ("alarm", (), ("alarm",)))


def naming_role_mismatch(usage: DataFrame, effective: DataFrame, status_bound: DataFrame, roles: tuple = NAMING_ROLES) -> DataFrame:
    """(var_key, role, issue): variables that aren't used as their name says.

    A command that is read and written and whose value reaches no output is internal state; a status that is written,
    and that no procedure reports to, isn't observed; an alarm that is read outside of the user interface is a control input.
    usage: usage_summary's flags; effective, status_bound: (var_key).
    """
    name = F.lower("name")
    named = lambda pre, post: F.greatest(F.lit(False), *(F.startswith(name, F.lit(x)) for x in pre), *(F.endswith(name, F.lit(x)) for x in post))
    role = F.coalesce(*(F.when(named(pre, post), F.lit(r)) for r, pre, post in roles))
    u = usage.withColumn("role", role).where("role is not null")
    for flag, keys in (("_effective", effective), ("_bound", status_bound)):
        u = u.join(keys.select("var_key").distinct().withColumn(flag, F.lit(True)), "var_key", "left").withColumn(flag, F.coalesce(c(flag), F.lit(False)))
    issue = (
        F.when((c("role") == "command") & c("read") & c("written") & ~c("_effective"), "command_as_internal_state")
        .when((c("role") == "status") & c("written") & ~c("_bound"), "status_written")
        .when((c("role") == "alarm") & c("non_ui_read"), "alarm_as_control_input")
    )
    return u.withColumn("issue", issue).where("issue is not null").select("var_key", "role", "issue")


def usage_trace(accesses: DataFrame) -> DataFrame:
    """Per variable, field and module: reads, writes and the text READ, WRITE or READ+WRITE."""
    p = accesses.groupBy("var_key", "field", "module_path").pivot("kind", ["read", "write"]).count()
    r, w = F.coalesce("read", F.lit(0)).cast("long"), F.coalesce("write", F.lit(0)).cast("long")
    return p.select("var_key", "field", "module_path", r.alias("reads"), w.alias("writes"), F.concat_ws("+", F.when(r > 0, "READ"), F.when(w > 0, "WRITE")).alias("usage"))


def required_parameters_missing(required: DataFrame, instances: DataFrame, mappings: DataFrame) -> DataFrame:
    """(moduletype, instance, parameter): required parameters of a type that an instance doesn't map."""
    return instances.join(required, "moduletype").join(mappings.select("instance", "parameter"), ["instance", "parameter"], "left_anti").select("moduletype", "instance", "parameter")


def unknown_parameter_targets(mappings: DataFrame, declared: DataFrame) -> DataFrame:
    """Mappings to a parameter that the type doesn't declare."""
    return mappings.join(declared, ["moduletype", "parameter"], "left_anti")


#: Characters that each string type holds.
STRING_LIMITS = (("identstring", 15), ("tagstring", 30), ("string", 40), ("linestring", 80), ("maxstring", 140))


def string_capacity(datatype: Column) -> Column:
    """Characters that a string type holds; null for other types."""
    return F.coalesce(*(F.when(F.lower(datatype) == name, n) for name, n in STRING_LIMITS))


def string_narrowing(mappings: DataFrame) -> DataFrame:
    """Mappings whose source type, or literal, is longer than the target type holds. mappings: (id, source_type, target_type, literal)."""
    source, target = string_capacity(c("source_type")), string_capacity(c("target_type"))
    issue = F.when(c("literal").isNotNull() & (F.length("literal") > target), "literal_too_long").when(c("literal").isNull() & (source > target), "narrowing")
    return mappings.withColumn("issue", issue).where("issue is not null").select("id", "issue")


def min_max_crossed(mappings: DataFrame, lo: tuple = ("min", "minimum"), hi: tuple = ("max", "maximum")) -> DataFrame:
    """(id) of mappings whose target name says min and source name max, or the reverse; names that say both are skipped. lo, hi: the words that say so."""
    says = lambda x, words, other: F.exists(identifier_tokens(c(x)), lambda t: t.isin(*words)) & ~F.exists(identifier_tokens(c(x)), lambda t: t.isin(*other))
    crossed = (says("target", lo, hi) & says("source", hi, lo)) | (says("target", hi, lo) & says("source", lo, hi))
    return mappings.where(crossed).select("id")


def anytype_requirements(direct: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(owner, parameter, field): the fields that parameters of any type need, their own and those of the parameters that they are handed on to.

    direct: (owner, parameter, field): fields that the owner uses itself; links: (owner, parameter, prefix, child_owner,
    child_parameter): the parameter, or its part at prefix, is mapped to a parameter of any type inside. Names are
    compared without regard to case. Each round hands on what the last one added.
    """
    key = ["owner", "parameter", "field"]
    low = lambda df, names: df.select(*(F.lower(x).alias(x) for x in names)).distinct()
    up = stored(low(links, ("owner", "parameter", "prefix", "child_owner", "child_parameter")), "links")
    now = stored(low(direct, key), "required")
    out = now
    for _ in range(max_rounds):
        told = now.select(c("owner").alias("child_owner"), c("parameter").alias("child_parameter"), c("field").alias("below")).join(up, ["child_owner", "child_parameter"])
        told = told.select("owner", "parameter", F.concat_ws(".", F.when(c("prefix") != "", c("prefix")), "below").alias("field")).distinct()
        now = stored(told.join(out, key, "left_anti"), "required")
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise RuntimeError(f"parameters are handed on for more than {max_rounds} levels, or round and round")


def contract_mismatch(mappings: DataFrame, required: DataFrame | None = None, record_fields: DataFrame | None = None) -> DataFrame:
    """(id, source_type, target_type, field) of mappings that break the target's contract.

    Types that differ (field null): two string types agree, and anytype takes all. A target of anytype, though, needs the
    fields that its owner uses: for each that the source lacks a row with the field. mappings: (id, source_type, target_type)
    and, with required, owner, target and source_field ('' or the part of the source that is mapped); required:
    anytype_requirements' rows; record_fields: (record_key, field, datatype). A field is looked up a segment a round,
    from the source's type on; a type without the next segment lacks it.
    """
    a, b = F.lower("source_type"), F.lower("target_type")
    both = string_capacity(a).isNotNull() & string_capacity(b).isNotNull()
    out = mappings.where((a != b) & ~both & (b != "anytype")).select("id", "source_type", "target_type", F.lit(None).cast("string").alias("field"))
    if required is None:
        return out
    asked = mappings.where((b == "anytype") & (a != b)).select("id", "source_type", "target_type", a.alias("whole"), F.lower("owner").alias("owner"), F.lower("target").alias("parameter"), F.lower("source_field").alias("part"))
    need = required.select(F.lower("owner").alias("owner"), F.lower("parameter").alias("parameter"), F.lower("field").alias("field")).distinct()
    step = record_fields.select(F.lower("record_key").alias("type"), F.lower("field").alias("step"), F.lower("datatype").alias("next")).distinct()
    # what a mapping lacks depends on its types and names alone: each case is looked up once, however many mappings share it
    case = ["whole", "owner", "parameter", "part"]
    way = F.split(F.concat_ws(".", F.when(c("part") != "", c("part")), "field"), r"\.")
    now = stored(asked.select(*case).distinct().join(need, ["owner", "parameter"]).select(*case, "field", c("whole").alias("type"), way.alias("way")), "asked")
    lacks = now.limit(0).select(*case, "field")
    while not now.isEmpty():
        x = now.withColumn("step", F.element_at("way", 1)).join(step, ["type", "step"], "left")
        lacks = lacks.unionByName(x.where("next is null").select(*case, "field"))
        now = stored(x.where("next is not null and size(way) > 1").select(*case, "field", c("next").alias("type"), F.slice("way", F.lit(2), F.size("way")).alias("way")), "asked")
    lacks = stored(lacks, "lacks")
    same = [asked[k].eqNullSafe(lacks[k]) for k in case]
    return out.unionByName(asked.join(lacks, same).select("id", "source_type", "target_type", "field"))


def procedure_status_ignored(calls: DataFrame, signatures: DataFrame, usage: DataFrame) -> DataFrame:
    """(site, var_key, issue): status outputs of calls that nothing reads (ignored), or only the user interface (ui_only).

    calls: (site, function, arg_pos, var_key); signatures: (function, arg_pos) of status outputs; usage: usage_summary's flags.
    """
    out = calls.withColumn("key", F.lower("function")).join(signatures.select(F.lower("function").alias("key"), "arg_pos"), ["key", "arg_pos"]).join(usage.select("var_key", "ui_read", "non_ui_read"), "var_key")
    return out.where("not non_ui_read").select("site", "var_key", F.when(c("ui_read"), "ui_only").otherwise("ignored").alias("issue"))


def record_order_dependence(sites: DataFrame, record_fields: DataFrame) -> DataFrame:
    """(record, site, field): per record type, its first access of a component by number, with the field's name. sites: (record, site, pos); record_fields: (record, pos, field)."""
    first = sites.groupBy("record").agg(F.min(F.struct("site", "pos")).alias("x")).select("record", "x.site", "x.pos")
    return first.join(record_fields, ["record", "pos"], "left").select("record", "site", "field")


def search_symbols(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(path, rank): symbols found by a dotted query. Symbols that equal it come alone; else those that end with its last segments, the longest suffix first, then the shortest path, then by name; limit is the list's length. symbols: (path)."""
    q = query.lower().split(".")
    s = symbols.select("path", F.lower("path").alias("key")).distinct().withColumn("steps", F.split("key", r"\."))
    suffix = lambda n: F.slice(c("steps"), -n, n) == F.array(*map(F.lit, q[-n:]))
    n = F.coalesce(*(F.when((F.size("steps") >= k) & suffix(k), k) for k in range(len(q), 0, -1)))
    s = s.withColumn("n", n).where("n is not null").withColumn("exact", c("key") == query.lower())
    if s.where("exact").limit(1).count():
        s = s.where("exact")
    return s.orderBy(c("n").desc(), F.size("steps"), "path").limit(limit).select("path", c("n").cast("int").alias("rank"))
