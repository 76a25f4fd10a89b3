"""Instances and configuration: resolution of values, drift, alarms, naming, layout, versions, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import identifier_style, identifier_tokens
from ..shared import shuffled

c = F.col


def resolve_parameter_values(instances: DataFrame, mappings: DataFrame, env: DataFrame, defaults: DataFrame) -> DataFrame:
    """(moduletype, instance, parameter, value, status) for every parameter of every instance's type.

    instances: (moduletype, instance); mappings: (instance, parameter, literal, source); env: (source, init);
    defaults: (moduletype, parameter, default). A literal wins, then the mapped variable's initial value,
    then, for parameters without a mapping only, the type's default: a mapping that can't be resolved is
    unresolved_mapping and doesn't fall back. Without either, the status is unknown.
    """
    x = instances.join(defaults, "moduletype").join(mappings.withColumn("mapped", F.lit(True)), ["instance", "parameter"], "left").join(env, "source", "left")
    value = F.when(c("mapped"), F.coalesce("literal", "init")).otherwise(c("default"))
    status = F.when(value.isNotNull(), "resolved").when(c("mapped"), "unresolved_mapping").otherwise("unknown")
    return x.select("moduletype", "instance", "parameter", value.alias("value"), status.alias("status"))


def _drifting(values: DataFrame) -> DataFrame:
    return values.groupBy("moduletype", "parameter").agg(F.count_distinct("instance").alias("instances"), F.count_distinct("value").alias("variants")).where("instances >= 2 and variants >= 2")


def parameter_drift(values: DataFrame) -> DataFrame:
    """One row per instance of each (moduletype, parameter) with two or more instances and values: (moduletype, parameter, instance, value, variants)."""
    return values.where("value is not null").join(_drifting(values).select("moduletype", "parameter", "variants"), ["moduletype", "parameter"]).select("moduletype", "parameter", "instance", "value", "variants")


def config_drift(values: DataFrame) -> DataFrame:
    """Per type, its drifting parameters (sorted text); per instance of it, its values of them (sorted text)."""
    drift = _drifting(values).groupBy("moduletype").agg(F.array_join(F.sort_array(F.collect_set("parameter")), ",").alias("parameters"))
    held = values.join(_drifting(values).select("moduletype", "parameter"), ["moduletype", "parameter"], "left_semi")
    per = held.groupBy("moduletype", "instance").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "parameter", "value"))), ",").alias("values"))
    return per.join(drift, "moduletype").select("moduletype", "parameters", "instance", "values")


def missing_initial_values(values: DataFrame, value_like: tuple) -> DataFrame:
    """(moduletype, instance) of instances none of whose value-like parameters has a value."""
    like = F.lower("parameter").isin(*value_like)
    return values.groupBy("moduletype", "instance").agg(F.bool_or(like & c("value").isNotNull()).alias("has")).where("not has").select("moduletype", "instance")


def unsafe_defaults(decls: DataFrame, words: tuple = ("bypass", "enable")) -> DataFrame:
    """Declarations that start true and whose name has one of the words as a token: (var_key, name)."""
    return decls.where(c("init_true") & F.exists(identifier_tokens(c("name")), lambda t: t.isin(*words))).select("var_key", "name")


def alarm_candidates(values: DataFrame) -> DataFrame:
    """(instance, tag, priority, condition) of instances with a tag and a priority or a condition. values: (instance, parameter, value), parameters tag, priority, condition."""
    x = values.where("value is not null").groupBy("instance").pivot("parameter", ["tag", "priority", "condition"]).agg(F.min("value"))
    return x.where("tag is not null and (priority is not null or condition is not null)")


def duplicate_alarms(alarms: DataFrame, key: str) -> DataFrame:
    """Alarms that share a tag, or a condition, with another one: (key, instance, n)."""
    n = alarms.where(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n >= 2")
    return alarms.join(n, key).select(c(key).alias("key"), "instance", "n")


def conflicting_priorities(alarms: DataFrame) -> DataFrame:
    """Alarms whose tag, and separately whose condition, has two known priorities or more: (scope, key, instance, priority)."""

    def within(scope: str) -> DataFrame:
        known = alarms.where(c("priority").isNotNull() & c(scope).isNotNull())
        bad = known.groupBy(scope).agg(F.count_distinct("priority").alias("n")).where("n >= 2").select(scope)
        return known.join(bad, scope).select(F.lit(scope).alias("scope"), c(scope).alias("key"), "instance", "priority")

    return within("tag").unionByName(within("condition"))


def naming_consistency(symbols: DataFrame, allowed: DataFrame | None = None, styles: dict | None = None) -> DataFrame:
    """(kind, name, style, dominant): every declaration whose name is in another style than its kind's, an unknown style too.

    A kind's style is that of `styles`, else the dominant one: that of more names than any other, each name counted once
    without regard to case, in the spelling declared first (by n, then name); without a sole winner nothing is
    reported. symbols: (kind, name, n); allowed: (kind, name) that are neither counted nor reported.
    """
    s = symbols.select("kind", "name", "n", F.lower("name").alias("key"))
    if allowed is not None:
        s = s.join(allowed.select("kind", F.lower("name").alias("key")).distinct(), ["kind", "key"], "left_anti")
    first = s.groupBy("kind", "key").agg(F.min(F.struct("n", "name")).alias("x")).select("kind", identifier_style(c("x.name")).alias("style")).where("style <> 'unknown'")
    counts = first.groupBy("kind", "style").agg(F.count("*").alias("n"))
    best = counts.groupBy("kind").agg(F.max("n").alias("n"))
    won = counts.join(best, ["kind", "n"]).groupBy("kind").agg(F.count("*").alias("winners"), F.min("style").alias("dominant")).where("winners = 1").select("kind", "dominant")
    if styles:
        given = F.coalesce(*(F.when(c("kind") == k, F.lit(v)) for k, v in styles.items()))
        won = s.select("kind").distinct().join(won, "kind", "left").select("kind", F.coalesce(given, "dominant").alias("dominant")).where("dominant is not null")
    return s.withColumn("style", identifier_style(c("name"))).join(won, "kind").where("style <> dominant").select("kind", "name", "style", "dominant")


def spec_rules(nodes: DataFrame) -> DataFrame:
    """Steps not named ST_..., transitions without a name or not named TR_...: (id, issue). nodes: (id, node_type, name)."""
    name = F.coalesce("name", F.lit(""))
    issue = F.when((c("node_type") == "step") & ~F.startswith(name, F.lit("ST_")), "step_prefix").when((c("node_type") == "transition") & (name == ""), "transition_unnamed").when((c("node_type") == "transition") & ~F.startswith(name, F.lit("TR_")), "transition_prefix")
    return nodes.withColumn("issue", issue).where("issue is not null").select("id", "issue")


#: Path selectors of graphics rules, of which a rule has one at most.
SELECTORS = ("unit_structure_path", "equipment_module_structure_path", "relative_module_path")


def _rule_key(kind, selector, rest):
    return F.concat_ws("\n", kind, selector, rest)


def _selected(rules: DataFrame) -> DataFrame:
    """rules with `key`, what an entry must be to match, and `name`."""
    text = lambda x: F.coalesce(F.trim(c(x)), F.lit(""))
    path = F.coalesce(*(F.when(text(x) != "", F.concat(F.lit(f"{x}:"), F.lower(text(x)))) for x in SELECTORS), F.lit(""))
    shown = F.coalesce(*(F.when(text(x) != "", F.concat(F.lit(f"{short}:"), text(x))) for x, short in zip(SELECTORS, ("unit", "equipment", "path"))), text("module_name"))
    typed = c("module_kind") == "moduletype"
    rest = F.when(typed, F.concat(F.lit("type:"), F.lower(text("moduletype_name")))).when((path == "") & (text("module_name") != ""), F.concat(F.lit("name:"), F.lower(text("module_name")))).otherwise("")
    name = F.when(typed, F.concat(F.lit("moduletype:"), text("moduletype_name"), F.lit("@"), shown)).otherwise(F.concat("module_kind", F.lit(":"), shown))
    return rules.where(~typed | (text("moduletype_name") != "")).withColumn("key", _rule_key(c("module_kind"), path, rest)).withColumn("name", name)


def _entry_keys(entries: DataFrame) -> DataFrame:
    """(item, key): every key of a rule that an entry would match; at most 14."""
    text = lambda x: F.coalesce(F.trim(c(x)), F.lit(""))
    kind = F.when(c("module_kind") == "module", "single").when(c("module_kind") == "frame", "frame").when(c("module_kind") == "moduletype-instance", "moduletype").otherwise("")
    paths = [F.when(text(x) != "", F.concat(F.lit(f"{x}:"), F.lower(text(x)))) for x in SELECTORS]
    keys = []
    for k in (F.lit("any"), F.when(kind != "moduletype", kind)):
        keys += [F.when(k.isNotNull() & p.isNotNull(), _rule_key(k, p, F.lit(""))) for p in paths]
        keys += [F.when(k.isNotNull(), _rule_key(k, F.lit(""), r)) for r in (F.lit(""), F.concat(F.lit("name:"), F.lower(text("module_name"))))]
    typed = F.concat(F.lit("type:"), F.lower(text("moduletype_name")))
    keys += [F.when((kind == "moduletype") & p.isNotNull(), _rule_key(F.lit("moduletype"), p, typed)) for p in (*paths, F.lit(""))]
    return entries.where("module_kind <> 'basepicture'").select("item", F.explode(F.array_compact(F.array_distinct(F.array(*keys)))).alias("key"))


def graphics_rules_check(entries: DataFrame, values: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """(item, rule, field, expected, actual) of the fields that differ from what a matching rule expects.

    entries: (item, module_kind: module, frame, moduletype-instance or basepicture, the three SELECTORS, moduletype_name, module_name);
    values: (item, field, actual), fields as dotted paths; rules: (rule, module_kind: any, single, frame or moduletype, and the
    same names, null where a rule doesn't ask); expected: (rule, field, expected). A rule matches entries that have all
    that it asks for, without regard to case; a base picture matches none. What a rule asks is one key, and an entry is
    dealt to the few keys that it fits, so that rules and entries meet by an equal key. A field that an entry lacks differs.
    """
    met = _entry_keys(entries).join(_selected(rules).select("rule", "name", "key"), "key").select("item", "rule", "name").distinct()
    x = met.join(expected, "rule").join(values, ["item", "field"], "left")
    return x.where(~c("actual").eqNullSafe(c("expected"))).select("item", c("name").alias("rule"), "field", "expected", "actual")


def unmatched_rules(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule) names of rules that no entry matches; rules of one name match together."""
    named = _selected(rules).select("name", "key").distinct()
    met = named.join(_entry_keys(entries).select("key").distinct(), "key", "left_semi").select("name")
    return named.select("name").distinct().join(met, "name", "left_anti").select(c("name").alias("rule"))


def instance_rules(instances: DataFrame, values: DataFrame, names: DataFrame, parameters: DataFrame) -> DataFrame:
    """(instance, rule, expected, actual) of instances that break a rule of their type.

    instances: (moduletype, instance, name); values: resolve_parameter_values' rows; names: (moduletype, name): the exact name, case
    included, that its instances have, rule name; parameters: (moduletype, parameter, value, allowed): the value that a
    parameter has to have, or with allowed false must not have. A required parameter without a value breaks its rule (actual
    null); one that must not have a value may have none, and one that no one can tell (unresolved_mapping) breaks neither.
    Types and parameters are compared without regard to case.
    """
    low = lambda df: df.withColumn("type", F.lower("moduletype"))
    wrong = low(instances).join(low(names).select("type", c("name").alias("expected")), "type").where("name <> expected").select("instance", F.lit("name").alias("rule"), "expected", c("name").alias("actual"))
    asked = low(instances).select("type", "instance").join(low(parameters).select("type", F.lower("parameter").alias("key"), "parameter", c("value").alias("expected"), "allowed"), "type")
    x = asked.join(values.select("instance", F.lower("parameter").alias("key"), c("value").alias("actual"), "status"), ["instance", "key"], "left")
    same = c("actual").eqNullSafe(c("expected"))
    known = F.coalesce(c("status") == "resolved", F.lit(False))
    breaks = F.when(c("allowed"), (known & ~same) | (~known & ~F.coalesce(c("status") == "unresolved_mapping", F.lit(False)))).otherwise(known & same)
    return wrong.unionByName(x.where(breaks).select("instance", c("parameter").alias("rule"), "expected", "actual"))


def layout_drift(items: DataFrame, fields: list[str]) -> DataFrame:
    """(kind, name, entries, field, variants) of layout fields that differ between modules of one kind and name. items: (kind, name, fields); base pictures are left out, a missing value is a value."""
    i = items.where("kind <> 'basepicture'").withColumn("name", F.lower("name"))
    long = i.select("kind", "name", *(c(x).cast("string").alias(x) for x in fields)).unpivot(["kind", "name"], fields, "field", "value")
    n = F.count_distinct(F.struct("value"))
    return long.groupBy("kind", "name", "field").agg(F.count("*").alias("entries"), n.alias("variants")).where("variants >= 2").select("kind", "name", "entries", "field", "variants")


def layout_overlaps(p: DataFrame, cell: float | None = None) -> DataFrame:
    """(container, item, other): siblings whose open rectangles intersect, unless both layers are known and differ.

    Rectangles are dealt to the grid cells that they touch, so that a container with many items is many
    groups; a pair is reported in the cell that holds the lower left corner of its intersection. Without `cell` a cell
    is as wide and as high as the rectangles' root mean square, so that a rectangle touches four cells on average at
    most, and what meets in a cell lies near. Known layers are part of the key: only rectangles without one meet all.
    """
    wide = high = cell
    if cell is None:
        size = lambda lo, hi: F.sqrt(F.avg(F.pow(c(hi) - c(lo), F.lit(2.0))))
        wide, high = (x or 1.0 for x in p.agg(size("x0", "x1"), size("y0", "y1")).first())
    gx, gy = (lambda x: F.floor(c(x) / wide)), (lambda y: F.floor(c(y) / high))
    dealt = p.withColumn("gx", F.explode(F.sequence(gx("x0"), gx("x1")))).withColumn("gy", F.explode(F.sequence(gy("y0"), gy("y1"))))
    # few bytes make many pairs: a number of partitions that is asked for isn't coalesced by their bytes
    dealt = dealt.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "container", "gx", "gy", "layer")
    other = lambda *key: dealt.select("container", "gx", "gy", *key, *(c(x).alias(f"b_{x}") for x in ("item", "x0", "y0", "x1", "y1", *({"layer"} - set(key)))))
    once = (F.floor(F.greatest("x0", "b_x0") / wide) == c("gx")) & (F.floor(F.greatest("y0", "b_y0") / high) == c("gy"))
    meet = F.expr("x0 < b_x1 and b_x0 < x1 and y0 < b_y1 and b_y0 < y1") & once
    same = dealt.join(shuffled(other("layer")), ["container", "gx", "gy", "layer"]).where(c("item") < c("b_item")).where(meet)
    # a pair of two unknown layers is met from the smaller item, one with a known layer from the unknown one
    free = dealt.where("layer is null").join(shuffled(other()), ["container", "gx", "gy"]).where("item < b_item or item > b_item and b_layer is not null").where(meet)
    told = lambda x: x.select("container", F.least("item", "b_item").alias("item"), F.greatest("item", "b_item").alias("other"))
    return told(same).unionByName(told(free))


def dependency_version_conflicts(types: DataFrame) -> DataFrame:
    """(name, versions) of type names that libraries hold with different dates. types: (library, name, datecode)."""
    return types.where("datecode is not null").groupBy(F.lower("name").alias("name")).agg(F.count_distinct("datecode").alias("versions"), F.count_distinct("library").alias("libraries")).where("versions >= 2 and libraries >= 2").select("name", "versions")


def structure_metrics(facts: DataFrame) -> DataFrame:
    """(program, kind, n) counts per program and kind, per program, and in total (null: all). facts: (program, kind)."""
    return facts.rollup("program", "kind").agg(F.count("*").alias("n"))


def top_findings(facts: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest (program, kind): a report's top list."""
    return facts.groupBy("program", "kind").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "program", "kind").limit(k)
