"""Ordered execution logs: reads and writes in program order, resources, setpoints, concurrency, sequences.

Where an aggregate answers the question no window is used: a window sorts a key's whole history in one task,
an aggregate combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import limit_binding
from ..shared import stored

c = F.col


def read_before_write(log: DataFrame, with_init: DataFrame) -> DataFrame:
    """(module_path, var_key) read before the module's first write of it, straight-line order; variables in with_init count as written."""
    first = log.groupBy("module_path", "var_key").agg(F.min(F.when(c("kind") == "read", c("seq"))).alias("r"), F.min(F.when(c("kind") == "write", c("seq"))).alias("w"))
    return first.where("r is not null and (w is null or r < w)").join(with_init.select("var_key"), "var_key", "left_anti").select("module_path", "var_key")


def read_before_write_branches(log: DataFrame, blocks: DataFrame, with_init: DataFrame | None = None) -> DataFrame:
    """(module_path, var_key) read before a sure write, where blocks of branches nest to any depth.

    log: (module_path, var_key, seq, kind, guard: array<struct<block, branch>>, the branches that a row is in, outermost first;
    empty or null on the straight line). blocks: (module_path, block, branches): how many branches a block has, an else that
    says nothing among them. Branches of a block follow each other. Variables in with_init count as written.

    A write counts for what follows it in its branch; what follows a block is sure of a variable if every branch of the
    block is. Rows are summed to the first read and the first write of each branch; then sure writes are folded from the
    innermost branches out, a level a round: a block in which all branches are sure is a write at its end, in the
    branch around it. A read is looked up in its branch and in those around it. What comes after a module's first write on
    the straight line is left out first: its reads are sure, and its writes, or blocks that need one, are sure of such reads alone.
    """
    key = ["module_path", "var_key"]
    frame = F.transform(F.coalesce("guard", F.array().cast(log.schema["guard"].dataType)), lambda g: F.concat_ws(":", g["block"].cast("string"), g["branch"].cast("string")))
    x = log if with_init is None else log.join(with_init.select("var_key").distinct(), "var_key", "left_anti")
    x = x.select(*key, "seq", "kind", F.array_join(frame, "/").alias("frame"))
    straight = x.where("kind = 'write' and frame = ''").groupBy(*key).agg(F.min("seq").alias("sure_from"))
    x = x.join(straight, key, "left").where("sure_from is null or seq <= sure_from")
    per = x.groupBy(*key, "frame").agg(F.min(F.when(c("kind") == "read", c("seq"))).alias("r"), F.min(F.when(c("kind") == "write", c("seq"))).alias("w"))
    per = stored(per, "branches")
    depth = F.when(c("frame") == "", 0).otherwise(F.size(F.split("frame", "/")))
    direct = per.where("w is not null").select(*key, "frame", "w", depth.alias("depth"))
    deepest = direct.agg(F.max("depth")).first()[0] or 0
    sure, folded = None, None
    of = blocks.select("module_path", c("block").cast("string").alias("block"), "branches").distinct()
    of = stored(of, "blocks") if deepest else of
    for d in range(deepest, -1, -1):
        here = direct.where(c("depth") == d).select(*key, "frame", "w")
        if folded is not None:
            here = here.unionByName(folded).groupBy(*key, "frame").agg(F.min("w").alias("w"))
        here = stored(here, "sure")
        sure = here if sure is None else sure.unionByName(here)
        steps = F.split("frame", "/")
        up = here.where("frame <> ''").select(*key, F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/").alias("frame"), F.element_at(F.split(F.element_at(steps, -1), ":"), 1).alias("block"), "w")
        told = up.groupBy(*key, "frame", "block").agg(F.count("*").alias("n"), F.max("w").alias("w"))
        folded = told.join(of, ["module_path", "block"]).where("n >= branches").select(*key, "frame", "w")
    reads = per.where("r is not null").select(*key, c("frame").alias("own"), "r")
    steps = F.split("own", "/")
    around = F.when(c("own") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    seen = reads.withColumn("frame", F.explode(around)).join(sure, [*key, "frame"]).where("w < r").select(*key, "own").distinct()
    return reads.join(seen, [*key, "own"], "left_anti").select(*key).distinct()


def unconsumed_writes(log: DataFrame) -> DataFrame:
    """(module_path, var_key, seq): a module's last write of a variable with no read after it."""
    last = log.groupBy("module_path", "var_key").agg(F.max(F.when(c("kind") == "write", c("seq"))).alias("seq"), F.max(F.when(c("kind") == "read", c("seq"))).alias("r"))
    return last.where("seq is not null and (r is null or r < seq)").select("module_path", "var_key", "seq")


def dead_overwrites(log: DataFrame) -> DataFrame:
    """(module_path, var_key, seq, next_seq): a write that the next access of the same variable overwrites.

    With a column `field` ('' or a dotted path) the write of a field is overwritten by the next write of the same field or of
    the whole record, unless a read of the field, of a part of it or of what holds it stands between. A whole write is
    overwritten by the next whole write, unless any read stands between.
    """
    if "field" not in log.columns:
        w = W.partitionBy("module_path", "var_key").orderBy("seq")
        x = log.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_seq", F.lead("seq").over(w))
        return x.where("kind = 'write' and next_kind = 'write'").select("module_path", "var_key", "seq", "next_seq")
    # each access is told to every prefix of its field (a read of a part reads what holds it); a whole write, and a read of
    # what holds others, to all fields that the module touches
    steps = F.split("field", r"\.")
    held = F.transform(F.sequence(F.lit(0), F.when(c("field") == "", 0).otherwise(F.size(steps))), lambda n: F.array_join(F.slice(steps, 1, n), "."))
    fields = log.select("module_path", "var_key", c("field").alias("at")).distinct()
    up = log.select("module_path", "var_key", "seq", "kind", "field", F.explode(held).alias("at")).where("kind = 'read' or at = field")
    down = log.join(fields, ["module_path", "var_key"]).where("at <> field and (field = '' or kind = 'read' and startswith(at, field || '.'))")
    every = up.unionByName(down.select("module_path", "var_key", "seq", "kind", "field", "at"))
    w = W.partitionBy("module_path", "var_key", "at").orderBy("seq")
    x = every.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_seq", F.lead("seq").over(w))
    return x.where("kind = 'write' and at = field and next_kind = 'write'").select("module_path", "var_key", "field", "seq", "next_seq")


def initialization_order_hazards(flows: DataFrame, writes: DataFrame, with_init: DataFrame) -> DataFrame:
    """(module_path, target, source): a target set from a source that nothing wrote before and that has no initial value. flows: (module_path, seq, target, source)."""
    first = writes.groupBy("module_path", c("var_key").alias("source")).agg(F.min("seq").alias("w"))
    x = flows.join(first, ["module_path", "source"], "left").where("w is null or w >= seq")
    return x.join(with_init.select(c("var_key").alias("source")), "source", "left_anti").select("module_path", "target", "source").distinct()


def dependency_chains(flows: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(module_path, chain): of each assignment the whole chain target<-...<-source, if it has three names or more. flows: (module_path, seq, target, source), seq unique in its module.

    A source stands for what its last assignment before was made from. Each assignment finds that one in one ordered
    pass; then chains double: a chain takes over the chain, and the end, of the assignment that it ends at, so that the
    rounds needed are the logarithm of the longest chain.
    """
    told = flows.select("module_path", "seq", c("source").alias("name"), F.lit(1).alias("asks"), "target").unionByName(flows.select("module_path", "seq", c("target").alias("name"), F.lit(2).alias("asks"), "target"))
    before = W.partitionBy("module_path", "name").orderBy("seq", "asks").rowsBetween(W.unboundedPreceding, -1)
    x = told.withColumn("last", F.last(F.when(c("asks") == 2, c("seq")), ignorenulls=True).over(before)).where("asks = 1")
    now = stored(x.select("module_path", "seq", F.when(c("last").isNull(), F.concat_ws("<-", "target", "name")).otherwise(c("target")).alias("chain"), "last"), "chains")
    ended = None  # chains that have ended are written once; they are asked for, but ask no more
    for _ in range(max_rounds):
        done, open_ = now.where("last is null"), now.where("last is not null")
        ended = done if ended is None else ended.unionByName(done)
        if open_.isEmpty():
            return ended.where("size(split(chain, '<-')) >= 3").select("module_path", "chain").distinct()
        rest = ended.unionByName(open_).select("module_path", c("seq").alias("last"), c("chain").alias("rest"), c("last").alias("after"))
        told = open_.join(rest, ["module_path", "last"], "left")
        now = stored(told.select("module_path", "seq", F.concat_ws("<-", "chain", "rest").alias("chain"), c("after").alias("last")), "chains")
    raise RuntimeError(f"chains did not end in {max_rounds} doublings")


def resource_pairing(ops: DataFrame) -> DataFrame:
    """(handle, seq, issue): acquired twice, released without acquire, or leaked at the end. ops: (handle, seq, op) with op acquire or release."""
    w = W.partitionBy("handle").orderBy("seq")
    x = ops.withColumn("before", F.lag("op").over(w)).withColumn("after", F.lead("op").over(w))
    issue = F.array(F.when((c("op") == "acquire") & (c("before") == "acquire"), F.lit("double_acquire")), F.when((c("op") == "release") & (c("before").isNull() | (c("before") == "release")), F.lit("release_without_acquire")), F.when((c("op") == "acquire") & c("after").isNull(), F.lit("leak")))
    return x.select("handle", "seq", F.explode(F.array_compact(issue)).alias("issue"))


def conflicting_setpoints(log: DataFrame) -> DataFrame:
    """(module_path, var_key, literals) of variables to which a module writes two literals or more."""
    return log.where("kind = 'write'").groupBy("module_path", "var_key").agg(F.sort_array(F.collect_set("literal")).alias("x")).where(F.size("x") >= 2).select("module_path", "var_key", F.array_join("x", ",").alias("literals"))


def limit_violations(writes: DataFrame, constants: DataFrame) -> DataFrame:
    """(scope, name, literal, lo, hi) written outside of the Min/Max constants of the same scope. writes: (scope, name, literal); constants: (scope, name, value)."""
    b = constants.withColumn("b", limit_binding(c("name"))).where("b is not null").groupBy("scope", c("b.body").alias("key")).agg(F.max(F.when(c("b.bound") == "min", c("value"))).alias("lo"), F.min(F.when(c("b.bound") == "max", c("value"))).alias("hi"))
    return writes.withColumn("key", F.lower("name")).join(b, ["scope", "key"]).where("literal < lo or literal > hi").select("scope", "name", "literal", "lo", "hi")


def fault_handling(log: DataFrame, words: tuple = ("fault", "alarm")) -> DataFrame:
    """(module_path, var_key, issue) of booleans named fault or alarm, per scope: missing_recovery, set true and never false; unhandled_fault, set true and never read. Both may hold.

    log: (module_path, var_key, name, is_boolean, kind, value boolean: null for writes of no literal).
    """
    named = F.lit(False)
    for x in words:
        named = named | F.contains(F.lower("name"), F.lit(x))
    w = c("kind") == "write"
    x = log.where(c("is_boolean") & named).groupBy("module_path", "var_key").agg(F.coalesce(F.bool_or(w & c("value")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(w & ~c("value")), F.lit(False)).alias("f"), F.bool_or(c("kind") == "read").alias("r"))
    issues = F.array_compact(F.array(F.when(~c("f"), F.lit("missing_recovery")), F.when(~c("r"), F.lit("unhandled_fault"))))
    return x.where("t").select("module_path", "var_key", F.explode(issues).alias("issue"))


def alarm_never_cleared(log: DataFrame) -> DataFrame:
    """(var_key) written, and only true."""
    return log.where("kind = 'write'").groupBy("var_key").agg(F.bool_and("value").alias("only")).where("only").select("var_key")


def _rolled_up(log: DataFrame, scope: str, user: str, extra: tuple = ()) -> DataFrame:
    """(scope, at, own, user, kind, ...): each access told to its path and to every path above it; own: whether `at` is its own path. What is asked of them, ends and sets, is the same with repeated rows."""
    path = F.lower(F.concat_ws(".", "var_key", F.when(c("field") != "", c("field"))))
    root = F.size(F.split(F.lower("var_key"), r"\."))
    e = log.select(c(scope).alias("scope"), path.alias("path"), root.alias("root"), c(user).alias("user"), "kind", *extra)
    steps = F.split("path", r"\.")
    at = F.explode(F.transform(F.sequence(c("root"), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ".")))
    return e.select("scope", "path", at.alias("at"), "user", "kind", *extra).withColumn("own", c("at") == c("path"))


def _users(name: str, which) -> list:
    """The smallest and the largest user of some rows: whether there is one other than a given one, without a list of them."""
    return [F.min(F.when(which, c("user"))).alias(f"{name}_a"), F.max(F.when(which, c("user"))).alias(f"{name}_z")]


def _other(name: str, user: str = "user"):
    """Whether those summed as name have another user than this row's."""
    return F.coalesce((c(f"{name}_a") != c(user)) | (c(f"{name}_z") != c(user)), F.lit(False))


def parallel_conflicts(log: DataFrame) -> DataFrame:
    """(parallel_id, path, conflict): paths that two branches of one parallel touch, write/write first, else read/write.

    Two paths conflict if one holds the other; the shorter is reported. No accesses are paired: each is told to its path
    and to those above it (as many as the path is deep), and each path keeps the smallest and largest branch that
    reads and writes it, itself and below; two branches differ if and only if these do.
    """
    e = _rolled_up(log, "parallel_id", "branch")
    r, w = c("kind") == "read", c("kind") == "write"
    x = e.groupBy(c("scope").alias("parallel_id"), c("at").alias("path")).agg(*_users("ow", c("own") & w), *_users("or", c("own") & r), *_users("sw", w), *_users("sr", r))
    apart = lambda a, b: F.coalesce((F.least(f"{a}_a", f"{b}_a") != F.greatest(f"{a}_z", f"{b}_z")) & c(f"{a}_a").isNotNull() & c(f"{b}_a").isNotNull(), F.lit(False))
    conflict = F.when(apart("ow", "sw"), "write/write").when(apart("ow", "sr") | apart("or", "sw"), "read/write")
    return x.withColumn("conflict", conflict).where("conflict is not null").select("parallel_id", "path", "conflict")


def shared_access_hazards(log: DataFrame, user: str = "module_path", need_write: bool = True) -> DataFrame:
    """(program, path, users, user, kinds, sites): paths read and written in one program by different users, a row for each user.

    An access takes part in a path if it conflicts with one of another user there: one of the two is at the path itself,
    the other there or below; need_write: one of the two writes. A path is told if of those that take part some read and
    some write. kinds: read, write or both; sites: the distinct sites, sorted (column `site`, missing ones left out). users: how many.

    No accesses are paired: each is told to its path and to those above it, and each path keeps the smallest and
    the largest user of all and of writing accesses, itself and below; that tells whether there is another one.
    E12 is this over modules; E13 over continuous sites (need_write = False) of variables that keep no state.
    """
    e = _rolled_up(log, "program", user, ("site",) if user != "site" else ())
    if user == "site":
        e = e.withColumn("site", c("user"))
    w = c("kind") == "write"
    sums = e.groupBy("scope", "at").agg(*_users("oa", c("own")), *_users("ow", c("own") & w), *_users("sa", F.lit(True)), *_users("sw", w))
    x = e.join(sums, ["scope", "at"])
    if need_write:
        takes = F.when(c("own"), (w & _other("sa")) | _other("sw")).otherwise((w & _other("oa")) | _other("ow"))
    else:
        takes = F.when(c("own"), _other("sa")).otherwise(_other("oa"))
    x = x.where(takes)
    per = x.groupBy("scope", "at", "user").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.array_join(F.sort_array(F.collect_set("site")), ",").alias("sites"))
    per = stored(per, "users")  # read twice
    told = per.groupBy("scope", "at").agg(F.count("*").alias("users"), F.bool_or(F.contains("kinds", F.lit("read"))).alias("r"), F.bool_or(F.contains("kinds", F.lit("write"))).alias("w")).where("r and w and users >= 2")
    return per.join(told, ["scope", "at"]).select(c("scope").alias("program"), c("at").alias("path"), "users", "user", "kinds", "sites")


def unsafe_scan_calls(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """(site, function) of calls in scan code whose signature says that they aren't safe there; calls without a signature aren't findings. signatures: (function, safe)."""
    s = signatures.select(F.lower("function").alias("key"), "safe")
    return calls.withColumn("key", F.lower("function")).join(s, "key").where("not safe").select("site", "function")


def complexity(steps: DataFrame, module_limit: int = 10, step_limit: int = 6) -> DataFrame:
    """(module_path, step, complexity) over the limits: one plus decisions of a module (step null), or of a step. steps: (module_path, step, decisions)."""
    m = steps.groupBy("module_path").agg((F.sum("decisions") + 1).alias("complexity")).where(c("complexity") > module_limit).select("module_path", F.lit(None).cast("string").alias("step"), "complexity")
    s = steps.groupBy("module_path", "step").agg((F.sum("decisions") + 1).alias("complexity")).where(c("complexity") > step_limit)
    return m.unionByName(s.select("module_path", "step", "complexity"))


def unreachable_nodes(nodes: DataFrame) -> DataFrame:
    """(sequence, branch, node) after a break or fork of the same branch. nodes: (sequence, branch, node, type)."""
    stop = nodes.where("type in ('break', 'fork')").groupBy("sequence", "branch").agg(F.min("node").alias("stop"))
    return nodes.join(stop, ["sequence", "branch"]).where("node > stop").select("sequence", "branch", "node")


def duplicate_guards(nodes: DataFrame) -> DataFrame:
    """(sequence, branch, guard, n): the same guard twice among siblings."""
    return nodes.groupBy("sequence", "branch", F.lower(F.regexp_replace("guard", r"\s+", "")).alias("guard")).agg(F.count("*").alias("n")).where("n >= 2")


def constant_guards(guards: DataFrame, known: DataFrame) -> DataFrame:
    """(sequence, branch, node, value): guards that are always true or always false.

    guards: (sequence, branch, node, key, op, value), a guard's comparisons, all of which must hold; op is = or <>; without a
    key the value itself, true or false, is the guard. known: (key, value) of the names with one value for good.
    """
    g = guards.join(known.select("key", c("value").alias("is")), "key", "left")
    holds = F.when(c("key").isNull(), F.lower("value") == "true").when(c("is").isNotNull(), F.when(c("op") == "=", c("is") == c("value")).otherwise(c("is") != c("value")))
    x = g.groupBy("sequence", "branch", "node").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("all"), F.bool_or(F.coalesce(~holds, F.lit(False))).alias("none"))
    return x.where("all or none").select("sequence", "branch", "node", c("all").alias("value"))


def illegal_step_combinations(active: DataFrame, groups: DataFrame) -> DataFrame:
    """(instant, grp): two steps of a mutually exclusive group active together. active: (instant, step); groups: (grp, step)."""
    return active.distinct().join(groups, "step").groupBy("instant", "grp").agg(F.count("*").alias("n")).where("n >= 2").select("instant", "grp")


def step_contracts(contracts: DataFrame, writes: DataFrame) -> DataFrame:
    """(step, var_key, phase, leaked) of contract writes that a step lacks. contracts, writes: (step, var_key, phase).

    Steps are ordered by their number. A missing enter write leaks if an earlier step's enter contract set the
    variable and no exit contract satisfied since then cleared it: one ordered pass over a variable's contracts.
    """
    kept = contracts.distinct().join(writes.select("step", "var_key", "phase").distinct().withColumn("held", F.lit(True)), ["step", "var_key", "phase"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    before = W.partitionBy("var_key").orderBy("step").rangeBetween(W.unboundedPreceding, -1)
    last = lambda phase: F.max(F.when(c("held") & (c("phase") == phase), c("step"))).over(before)
    x = kept.withColumn("set", last("enter")).withColumn("cleared", last("exit")).where("not held")
    leaks = (c("phase") == "enter") & c("set").isNotNull() & (c("cleared").isNull() | (c("cleared") < c("set")))
    return x.select("step", "var_key", "phase", F.coalesce(leaks, F.lit(False)).alias("leaked"))


def reset_contamination(run: DataFrame, reset: DataFrame, referenced: DataFrame | None = None, kept_old: DataFrame | None = None) -> DataFrame:
    """(sequence, var_key) that a run path writes and not every reset path; all of them where there is no reset path. run: (sequence, var_key); reset: (sequence, path_id, var_key).

    referenced: (sequence) of the sequences whose .Reset anything refers to: only these are looked at. kept_old: (sequence,
    var_key) that the reset branch keeps through :OLD: never reported.
    """
    total = reset.groupBy("sequence").agg(F.count_distinct("path_id").alias("total"))
    hit = reset.groupBy("sequence", "var_key").agg(F.count_distinct("path_id").alias("hit"))
    x = run.select("sequence", "var_key").distinct()
    if referenced is not None:
        x = x.join(referenced.select("sequence"), "sequence", "left_semi")
    if kept_old is not None:
        x = x.join(kept_old.select("sequence", "var_key"), ["sequence", "var_key"], "left_anti")
    x = x.join(total, "sequence", "left").join(hit, ["sequence", "var_key"], "left")
    return x.where("total is null or coalesce(hit, 0) < total").select("sequence", "var_key")


def implicit_latch(sets: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(sequence, var_key) set true in a branch where some alternative path doesn't set it false. sets: (sequence, var_key, path_id, value)."""
    total = alternatives.groupBy("sequence").agg(F.count_distinct("path_id").alias("total"))
    x = sets.groupBy("sequence", "var_key").agg(F.bool_or("value").alias("t"), F.count_distinct(F.when(~c("value"), c("path_id"))).alias("cleared"), F.count_distinct(F.when(c("value"), c("path_id"))).alias("setting"))
    return x.join(total, "sequence").where("t and cleared + setting < total").select("sequence", "var_key")


def contradictory_conditions(facts: DataFrame) -> DataFrame:
    """(condition, key): a conjunction that wants two values of one key, or a value that it excludes. facts: (condition, key, op, value) with op = or <>; a plain b is b = true, not b is b <> true."""
    eq = facts.where("op = '='").groupBy("condition", "key").agg(F.count_distinct("value").alias("n"))
    both = facts.where("op = '='").select("condition", "key", "value").join(facts.where("op = '<>'").select("condition", "key", "value"), ["condition", "key", "value"], "left_semi")
    return eq.where("n >= 2").select("condition", "key").unionByName(both.select("condition", "key")).distinct()


def tautologies(facts: DataFrame) -> DataFrame:
    """(condition, key, issue): a disjunction that takes a value and all others (tautology), or a comparison of a name with itself (self_compare). facts as above, value may be a name."""
    per = facts.groupBy("condition", "key", "value").agg(F.bool_or(c("op") == "=").alias("eq"), F.bool_or(c("op") == "<>").alias("ne"))
    always = per.where("eq and ne").select("condition", "key", F.lit("tautology").alias("issue"))
    own = facts.where(F.lower("key") == F.lower("value")).select("condition", "key", F.lit("self_compare").alias("issue"))
    return always.unionByName(own).distinct()
