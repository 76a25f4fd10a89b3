"""Graph questions on one closure: rounds over the edges, each written, until nothing is new.

A closure's size is up to sources times nodes: restrict the sources first where the graph is dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import SAFETY_KEYWORDS, SIGNAL_KEYWORDS, SINK_KEYWORDS, classify_signal_path, holds_keyword
from ..shared import shuffled, stored

c = F.col


def closure(edges: DataFrame, sources: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(src, dst, depth): every node that a source reaches, with its least distance; a node reaches itself only through a cycle.

    edges: (src, dst); sources: (src), all by default. Over all sources distances double: pairs at distance n exactly
    meet those up to n, so that a chain of 1,000 steps takes 10 rounds, and what was known is read that often.
    From given sources it goes a step a round, which keeps to what they reach.
    """
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("depth", F.lit(1)), "edges")
    if sources is not None:
        return _reach(e, sources, max_rounds)
    known, at = e, 1
    for _ in range(64):
        last = known.where(c("depth") == at).select("src", c("dst").alias("via"))
        on = known.select(c("src").alias("via"), "dst", c("depth").alias("rest"))
        more = last.join(shuffled(on), "via").groupBy("src", "dst").agg((F.min("rest") + at).alias("depth")).join(shuffled(known), ["src", "dst"], "left_anti")
        more = stored(more, "closure")
        if more.isEmpty():
            return known
        known, at = known.unionByName(more), 2 * at
    raise RuntimeError("the closure did not end in 64 doublings")


def _reach(e: DataFrame, sources: DataFrame, max_rounds: int) -> DataFrame:
    step = e.select(c("src").alias("via"), c("dst").alias("to"))
    now = stored(e.join(shuffled(sources.select("src").distinct()), "src", "left_semi"), "reach")
    seen = now
    for depth in range(2, max_rounds):
        new = now.select("src", c("dst").alias("via")).join(shuffled(step), "via").select("src", c("to").alias("dst")).distinct().join(shuffled(seen), ["src", "dst"], "left_anti")
        now = stored(new.withColumn("depth", F.lit(depth)), "reach")
        if now.isEmpty():
            return seen
        seen = seen.unionByName(now)
    raise RuntimeError(f"the closure did not end in {max_rounds} rounds")


def reached(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node) of all nodes that any of start reaches, those of start included. start: (node). Nodes only: no pairs are made."""
    e = stored(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges")
    now = stored(start.where("node is not null").select("node").distinct(), "reached")
    seen = now
    for _ in range(max_rounds):
        now = stored(e.join(shuffled(now.select(c("node").alias("src"))), "src", "left_semi").select(c("dst").alias("node")).distinct().join(shuffled(seen), "node", "left_anti"), "reached")
        if now.isEmpty():
            return seen
        seen = seen.unionByName(now)
    raise RuntimeError(f"the search did not end in {max_rounds} rounds")


def effective_outputs(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node) of all nodes whose value can reach a sink, sinks included. sinks: (node)."""
    return reached(edges.select(c("dst").alias("src"), c("src").alias("dst")), sinks)


def dependency_graph(edges: DataFrame) -> DataFrame:
    """(source, target, entries): distinct edges by lower-cased name, with the sorted entries that need them. edges: (source, target, entry)."""
    return edges.groupBy(F.lower("source").alias("source"), F.lower("target").alias("target")).agg(F.array_join(F.sort_array(F.collect_set("entry")), ",").alias("entries"))


def access_graph(accesses: DataFrame, owners: DataFrame) -> DataFrame:
    """(module_path, owner, reads, writes, symbols): accesses of modules to what others declare. owners: (var_key, owner).

    Accesses are summed per module and variable before the join.
    """
    per = accesses.groupBy("module_path", "var_key").agg(F.count_if(c("kind") == "read").alias("r"), F.count_if(c("kind") == "write").alias("w"))
    return per.join(owners, "var_key").groupBy("module_path", "owner").agg(F.sum("r").alias("reads"), F.sum("w").alias("writes"), F.count("*").alias("symbols"))


def reverse_impact(edges: DataFrame, nodes: DataFrame | None = None, list_fields: tuple = (), count_fields: tuple = (), self_edges: bool = False) -> DataFrame:
    """(node, direct, transitive, and for each field direct_<field>, transitive_<field>): what depends on each node, and through which edges.

    edges: (src depends on dst), with array columns list_fields and numbers count_fields; edges of the same ends are one.
    nodes: (node), the ones asked for, all ends of edges by default; one without dependants has 0. A node on a cycle
    depends on itself. Self-edges count if self_edges (libraries), not else (modules). Transitive values are those of
    all edges into the node and into its dependants, each edge once however many paths lead to it: edges are summed
    by the node they enter before they meet the closure. Lists are sorted and distinct, with <field>_count beside.
    """
    e = edges.where("src is not null and dst is not null")
    e = e if self_edges else e.where("src <> dst")
    asked = (e.select(F.explode(F.array("src", "dst")).alias("node")) if nodes is None else nodes.select("node")).distinct()
    back = closure(e.select(c("dst").alias("src"), c("src").alias("dst")), None if nodes is None else asked.select(c("node").alias("src")))
    if not list_fields and not count_fields:
        n = back.groupBy(c("src").alias("node")).agg(F.count_if(c("depth") == 1).alias("direct"), F.count("*").alias("transitive"))
        return asked.join(n, "node", "left").select("node", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("direct", "transitive")))
    # what enters each node, and for each node asked for itself (depth 0) and all that depend on it
    into = e.groupBy(c("dst").alias("at")).agg(*(F.sum(f).alias(f) for f in count_fields), *(F.array_distinct(F.flatten(F.collect_list(f))).alias(f) for f in list_fields))
    into = stored(into, "entering")
    met = back.select(c("src").alias("node"), c("dst").alias("at"), "depth").where("node <> at").unionByName(asked.select("node", c("node").alias("at"), F.lit(0).alias("depth")))
    met = stored(met.join(into, "at", "left"), "met")
    own = c("depth") == 0
    sums = met.groupBy("node").agg(*(x for f in count_fields for x in (F.coalesce(F.sum(F.when(own, c(f))), F.lit(0)).alias(f"direct_{f}"), F.coalesce(F.sum(f), F.lit(0)).alias(f"transitive_{f}"))), F.lit(1).alias("_"))
    n = back.groupBy(c("src").alias("node")).agg(F.count_if(c("depth") == 1).alias("direct"), F.count("*").alias("transitive"))
    out = sums.drop("_").join(n, "node", "left").withColumn("direct", F.coalesce("direct", F.lit(0)).cast("long")).withColumn("transitive", F.coalesce("transitive", F.lit(0)).cast("long"))
    for f in list_fields:
        each = met.select("node", "depth", F.explode(f).alias("x")).groupBy("node", "x").agg(F.min("depth").alias("depth"))
        held = each.groupBy("node").agg(F.sort_array(F.collect_list(F.when(own, c("x")))).alias(f"direct_{f}"), F.sort_array(F.collect_list("x")).alias(f"transitive_{f}"))
        none = F.array().cast(edges.schema[f].dataType)
        out = out.join(held, "node", "left")
        for x in (f"direct_{f}", f"transitive_{f}"):
            out = out.withColumn(x, F.coalesce(x, none)).withColumn(f"{x}_count", F.size(x).cast("long"))
    return out


def impact_selection(impact: DataFrame, selectors: DataFrame, entries: DataFrame) -> DataFrame:
    """(selector_kind, selector, kind, node, direct, transitive, error): impacts of the asked libraries, modules and entry files.

    impact: (kind: library or module, node, direct, transitive); selectors: (selector_kind: library, module or
    entry_file, selector); entries: (entry_file, kind, node), what each entry file expands to. Names are compared without
    regard to case. A selector that nothing has is one row with an error.
    """
    asked = selectors.distinct().withColumn("key", F.lower("selector"))
    known = impact.withColumn("at", F.lower(c("node").cast("string")))
    named = known.select(c("kind").alias("selector_kind"), c("at").alias("key"), "kind", "node", "direct", "transitive")
    opened = entries.select(F.lower("entry_file").alias("key"), "kind", F.lower(c("node").cast("string")).alias("at")).distinct()
    opened = opened.join(known, ["kind", "at"], "left").select(F.lit("entry_file").alias("selector_kind"), "key", "kind", "node", "direct", "transitive")
    x = asked.join(named.unionByName(opened).withColumn("known", F.lit(True)), ["selector_kind", "key"], "left")
    error = F.when(c("known").isNull(), F.concat(F.lit("unknown "), F.replace("selector_kind", F.lit("_"), F.lit(" ")), F.lit(" selector")))
    return x.where("known is null or node is not null").select("selector_kind", "selector", F.when(c("known"), c("kind")).alias("kind"), "node", "direct", "transitive", error.alias("error"))


def taint_traces(edges: DataFrame, names: DataFrame, uses: DataFrame, keywords: tuple = SIGNAL_KEYWORDS, sink_words: tuple = SINK_KEYWORDS, max_rounds: int = 1000) -> DataFrame:
    """(source, source_kind, sink, depth, path, modules, multi_module): a shortest path from each source that nothing feeds to each critical sink.

    edges: (src, dst); names: (node, name), each node's dotted path; uses: (node, module). A source is a node that no edge
    enters and whose name has a source class; a sink's name has a critical word. Nodes within a type definition (a segment
    that begins with TypeDef:) are left out, though what they feed is fed. Of the shortest paths that with the smallest
    names, lower-cased, from the source on; then by node. modules: distinct modules that use any node of the path.

    Only what a source reaches is searched; distances are told backwards from the sinks, and with them each node's next
    one, of those as near to the sink as it has to be that with the smallest name; a path is built for the pairs found
    alone, a step a round.
    """
    n = names.where(~F.exists(F.split(F.lower("name"), r"\."), lambda x: F.startswith(x, F.lit("typedef:"))))
    n = stored(n.select("node", "name", F.lower("name").alias("low")), "names")
    fed = edges.select(c("dst").alias("node")).distinct()
    source = stored(n.withColumn("source_kind", classify_signal_path(c("name"), keywords)).where("source_kind is not null").join(shuffled(fed), "node", "left_anti").select("node", "source_kind"), "sources")
    sink = n.where(holds_keyword(c("name"), sink_words)).select("node")
    e = edges.where("src <> dst").select("src", "dst").distinct().join(shuffled(n.select(c("node").alias("src"))), "src", "left_semi").join(shuffled(n.select(c("node").alias("dst"))), "dst", "left_semi")
    on = reached(e, source)
    e = stored(e.join(shuffled(on.select(c("node").alias("src"))), "src", "left_semi"), "flow")
    back = closure(e.select(c("dst").alias("src"), c("src").alias("dst")), sink.join(shuffled(on), "node", "left_semi").select(c("node").alias("src")), max_rounds)
    back = stored(back.select(c("src").alias("sink"), c("dst").alias("node"), c("depth").alias("rest")).unionByName(sink.select(c("node").alias("sink"), "node", F.lit(0).alias("rest"))), "distances")
    step = e.join(shuffled(n.select(c("node").alias("dst"), "low")), "dst")
    # of each node and sink the next node, once: a round is one join then
    near = back.where("rest > 0").select("sink", c("node").alias("src"), (c("rest") - 1).alias("rest")).join(shuffled(step), "src").join(shuffled(back.withColumnRenamed("node", "dst")), ["sink", "dst", "rest"])
    near = near.groupBy("sink", "src").agg(F.min(F.struct("low", "dst")).alias("x")).select("sink", c("src").alias("node"), c("x.dst").alias("next"))
    near = stored(near.join(shuffled(n.select(c("node").alias("next"), c("name").alias("next_name"))), "next"), "next")
    at = back.where("rest > 0").join(shuffled(source), "node").join(shuffled(n.select("node", "name")), "node")
    at = stored(at.select(c("node").alias("source"), "source_kind", "sink", c("rest").alias("depth"), "node", "rest", F.array(F.struct("node", "name")).alias("way")), "traces")
    done = None
    for _ in range(max_rounds):
        ended = at.where("rest = 0")
        done = ended if done is None else done.unionByName(ended)
        at = at.where("rest > 0")
        if at.isEmpty():
            break
        at = at.join(shuffled(near), ["sink", "node"])
        at = stored(at.select("source", "source_kind", "sink", "depth", c("next").alias("node"), (c("rest") - 1).alias("rest"), F.array_append("way", F.struct(c("next").alias("node"), c("next_name").alias("name"))).alias("way")), "traces")
    used = done.select("source", "sink", F.explode("way.node").alias("node")).join(shuffled(uses.select("node", "module").distinct()), "node").groupBy("source", "sink").agg(F.count_distinct("module").alias("modules"))
    x = done.join(shuffled(used), ["source", "sink"], "left").withColumn("modules", F.coalesce("modules", F.lit(0)).cast("long"))
    return x.select("source", "source_kind", "sink", "depth", F.array_join("way.name", ">").alias("path"), "modules", (c("modules") > 1).alias("multi_module"))


def safety_traces(accesses: DataFrame, names: DataFrame, words: tuple = SAFETY_KEYWORDS) -> DataFrame:
    """(var_key, writers, readers, spans_modules) of accesses to variables whose dotted name holds a safety word. names: (var_key, name)."""
    n = lambda k: F.count_distinct(F.when(c("kind") == k, c("module_path")))
    per = accesses.groupBy("var_key").agg(n("write").alias("writers"), n("read").alias("readers"), (F.count_distinct("module_path") > 1).alias("spans_modules"))
    return per.join(names.where(holds_keyword(c("name"), words)).select("var_key"), "var_key", "left_semi")


def _cyclic_core(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges without most of those that are on no cycle: an edge goes if nothing enters its start or nothing leaves its end, as long as a round still takes a tenth of them."""
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "core")
    n = e.count()
    for _ in range(rounds):
        kept = e.join(e.select(c("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(c("src").alias("dst")).distinct(), "dst", "left_semi")
        e = stored(kept.select("src", "dst"), "core")
        n, before = e.count(), n
        if 10 * n > 9 * before:
            break
    return e


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach themselves, with the smallest node of their strongly connected component."""
    r = closure(_cyclic_core(edges))
    mutual = r.select("src", "dst").join(r.select(c("src").alias("dst"), c("dst").alias("src")), ["src", "dst"])
    return mutual.groupBy(c("src").alias("node")).agg(F.min("dst").alias("component"))


def block_loops(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(node, component, size): blocks of a loop of two or more, where one reads what another writes. writes, reads: (block, var_key)."""
    edges = writes.select(c("block").alias("src"), "var_key").distinct().join(reads.select(c("block").alias("dst"), "var_key").distinct(), "var_key").where("src <> dst").select("src", "dst")
    found = cycles(edges)
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").where("size >= 2").select("node", "component", "size")


def load_order(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level) of an acyclic graph, dependencies first: level 0 depends on nothing, others are one above their deepest dependency. edges: (src depends on dst).

    Each round takes the nodes whose dependencies are all taken; only the edges that are left go on to the next.
    """
    left = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "left")
    out = None
    for level in range(max_rounds):
        if left.isEmpty():
            return out if out is not None else left.select(c("src").alias("node"), F.lit(0).alias("level"))
        ready = stored(left.select(c("dst").alias("node")).distinct().join(left.select(c("src").alias("node")).distinct(), "node", "left_anti"), "ready")
        if ready.isEmpty():
            raise RuntimeError("the graph has a cycle")
        rest = left.join(ready.select(c("node").alias("dst")), "dst", "left_anti")
        # a node whose last dependency went is at the end of no edge that is left, unless others depend on it
        freed = left.select("src").distinct().join(rest.select("src").distinct(), "src", "left_anti").join(left.select(c("dst").alias("src")).distinct(), "src", "left_anti")
        now = ready.select("node", F.lit(level).alias("level")).unionByName(freed.select(c("src").alias("node"), F.lit(level + 1).alias("level")))
        out = now if out is None else out.unionByName(now)
        left = stored(rest.select("src", "dst"), "left")
    raise RuntimeError(f"the graph is deeper than {max_rounds}")


def layer_violations(imports: DataFrame, layers: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(source, target, rule): forbidden, or else upward: an import of a higher layer.

    imports: (source, target); layers: (prefix, layer): the longest dotted prefix of a name counts; names without
    one have no layer. forbidden: (source_prefix, target_prefix): wins over the layers.
    """

    def layered(names: DataFrame) -> DataFrame:
        steps = F.split("name", r"\.")
        up = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "."))).alias("prefix"))
        return up.join(layers, "prefix").groupBy("name").agg(F.max(F.struct(F.length("prefix").alias("n"), "layer")).alias("x")).select("name", "x.layer")

    i = imports.distinct()
    up = lambda x: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(x, r"\."))), lambda n: F.array_join(F.slice(F.split(x, r"\."), 1, n), ".")))
    banned = i.withColumn("source_prefix", up("source")).withColumn("target_prefix", up("target")).join(forbidden, ["source_prefix", "target_prefix"], "left_semi").select("source", "target").distinct()
    known = layered(i.select(c("source").alias("name")).union(i.select("target")).distinct())
    x = i.join(banned, ["source", "target"], "left_anti").join(known.select(c("name").alias("source"), c("layer").alias("a")), "source").join(known.select(c("name").alias("target"), c("layer").alias("b")), "target")
    return banned.withColumn("rule", F.lit("forbidden")).unionByName(x.where("b > a").select("source", "target", F.lit("upward").alias("rule")))
