"""Module trees: structure hashed from the leaves up, variants of modules of one name, where variants differ, and where modules lie.

A tree is a table of dotted paths; a module's parent is its path without the last segment. Names are compared without
regard to case. Trees are walked a level a round, each level written; the rounds are the depth of the deepest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..shared import shuffled, stored

c = F.col


def _bag_digest(*columns: Column) -> Column:
    """Digest of the distinct rows of a group, in any order: an aggregate that combines before the shuffle, however many rows a group has."""
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string")
    return F.md5(F.concat_ws("|", F.count("*").cast("string"), h(0), h(1)))


def _laid_out(modules: DataFrame) -> DataFrame:
    steps = F.split(F.lower("path"), r"\.")
    m = modules.select("program", F.lower("path").alias("path"), F.lower("kind").alias("kind"), steps.alias("steps")).distinct()
    return m.select("program", "path", "kind", F.size("steps").alias("depth"), F.element_at("steps", -1).alias("name"), F.array_join(F.slice("steps", F.lit(1), F.size("steps") - 1), ".").alias("parent"))


def structure_digests(modules: DataFrame) -> DataFrame:
    """(program, path, kind, depth, name, parent, digest): each module with the digest of what lies below it.

    modules: (program, path, kind). A digest is that of the modules directly below, each with its name, its kind and its own
    digest: two modules have the same one if and only if (but for a collision of 128 bits) their sub-modules form the same tree.
    """
    m = stored(_laid_out(modules), "modules")
    deepest = m.agg(F.max("depth")).first()[0] or 0
    leaf = F.md5(F.lit(""))
    out, below = None, None
    for depth in range(deepest, 0, -1):
        level = m.where(c("depth") == depth)
        if below is None:
            level = level.withColumn("digest", leaf)
        else:
            kids = below.groupBy("program", c("parent").alias("path")).agg(_bag_digest(c("name"), c("kind"), c("digest")).alias("digest"))
            level = level.join(kids, ["program", "path"], "left").withColumn("digest", F.coalesce("digest", leaf))
        below = stored(level.select(*m.columns, "digest"), "level")
        out = below if out is None else out.unionByName(below)
    return m.withColumn("digest", leaf) if out is None else out


def module_variants(modules: DataFrame, items: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """(program, name, variant, variants, first, instances, structure, low, high): the variants of each name that has two or more.

    modules: (program, path, kind); items: (program, path, section, item, value), what a module declares itself: parameters,
    variables, mappings, equations; dates and places are not among them. Only modules of kind single are compared.
    Modules of one name are one variant if they declare the same and their sub-modules form the same tree. Variants are
    numbered by their smallest path. low, high: the smallest and the largest path of the variant, as arrays.
    """
    s = structure_digests(modules) if structure is None else structure
    own = items.select("program", F.lower("path").alias("path"), "section", F.lower("item").alias("item"), "value").distinct()
    own = own.groupBy("program", "path").agg(_bag_digest(c("section"), c("item"), c("value")).alias("own"))
    x = s.where("kind = 'single'").join(own, ["program", "path"], "left").withColumn("way", F.split("path", r"\."))
    x = x.groupBy("program", "name", "own", c("digest").alias("structure")).agg(F.count("*").alias("instances"), F.min("path").alias("first"), F.min("way").alias("low"), F.max("way").alias("high"))
    # a row for each variant of a name
    by = W.partitionBy("program", "name")
    x = x.withColumn("variants", F.count("*").over(by)).where("variants >= 2").withColumn("variant", F.row_number().over(by.orderBy("first")))
    return stored(x.select("program", "name", "variant", "variants", "first", "instances", "structure", "low", "high"), "variants")


def version_drift(modules: DataFrame, items: DataFrame) -> DataFrame:
    """(program, name, variants, instances, prefix): names whose modules differ in structure, and the path that all of them share."""
    x = module_variants(modules, items).groupBy("program", "name").agg(F.count("*").alias("variants"), F.sum("instances").alias("instances"), F.min("low").alias("a"), F.max("high").alias("z"))
    same = F.transform(F.sequence(F.lit(0), F.least(F.size("a"), F.size("z"))), lambda n: F.when(F.slice("a", F.lit(1), n) == F.slice("z", F.lit(1), n), n).otherwise(0))
    return x.select("program", "name", "variants", "instances", F.array_join(F.slice("a", F.lit(1), F.array_max(same)), ".").alias("prefix"))


def variant_diff(modules: DataFrame, items: DataFrame) -> DataFrame:
    """(program, name, section, item, change, variant, value): where the variants of a name differ, a row for each variant that has the item.

    change: only, an item that not every variant has; modified, an item of all variants with two values or more. Sections
    are those of items, and submodules: an item is a path below the module, its value the kind found there. Variants are
    compared by their first module. Trees are descended from the top, and below a place only where the digests there differ.
    """
    s = structure_digests(modules)
    v = module_variants(modules, items, s)
    key = ["program", "name", "section", "item"]
    own = items.select("program", F.lower("path").alias("first"), "section", F.lower("item").alias("item"), "value").distinct()
    own = own.join(v.select("program", "name", "variant", "variants", "first"), ["program", "first"])
    n = own.groupBy(*key).agg(F.count_distinct("variant").alias("has"), F.count_distinct(F.struct("value")).alias("values"))
    x = own.join(n, key).withColumn("change", F.when(c("has") < c("variants"), "only").when(c("values") > 1, "modified")).where("change is not null")
    out = x.select(*key, "change", "variant", "value")

    node = s.select("program", c("parent").alias("at"), "path", c("name").alias("step"), "kind", "digest")
    at = stored(v.select("program", "name", "variant", "variants", F.lit("").alias("item"), c("first").alias("at"), c("structure").alias("digest")), "diff")
    place = ["program", "name", "item"]
    while True:
        differ = at.groupBy(*place).agg(F.count_distinct("variant").alias("has"), F.count_distinct("digest").alias("digests"), F.min("variants").alias("of")).where("has < of or digests > 1").select(*place)
        down = at.join(differ, place, "left_semi").drop("digest").join(node, ["program", "at"])
        at = stored(down.select("program", "name", "variant", "variants", F.concat_ws(".", F.when(c("item") != "", c("item")), "step").alias("item"), c("path").alias("at"), "kind", "digest"), "diff")
        if at.isEmpty():
            return out
        n = at.groupBy(*place, "kind").agg(F.count_distinct("variant").alias("has"))
        some = at.join(n, [*place, "kind"]).where("has < variants").select("program", "name", F.lit("submodules").alias("section"), "item", F.lit("only").alias("change"), "variant", c("kind").alias("value"))
        out = out.unionByName(some)
        at = at.drop("kind")


def module_rectangles(p: DataFrame) -> DataFrame:
    """(container, item, layer, x0, y0, x1, y1): where modules lie in their container.

    p: (container, item, layer, x, y, width, height, cx0, cy0, cx1, cy1): the place of the invocation, and the clipping bounds
    of the module in its own coordinates, null without. Bounds are scaled by the invocation's width and height; without
    them the module fills the invocation. Corners may be given in any order; a blank layer is no layer.
    """
    at = lambda origin, bound, size, whole: c(origin) + F.coalesce(bound, F.lit(whole)) * c(size)
    clipped = F.forall(F.array("cx0", "cy0", "cx1", "cy1"), lambda x: x.isNotNull())
    bound = lambda x: F.when(clipped, c(x))
    x, y = [at("x", bound("cx0"), "width", 0.0), at("x", bound("cx1"), "width", 1.0)], [at("y", bound("cy0"), "height", 0.0), at("y", bound("cy1"), "height", 1.0)]
    layer = F.when(F.trim(c("layer").cast("string")) != "", F.trim(c("layer").cast("string")))
    return p.select("container", "item", layer.alias("layer"), F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))


def absolute_frames(p: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(item, ox, oy, sx, sy, depth): each module's own coordinates in those of the outermost container: a point u lies at o + u * s.

    p: (item, container, x, y, width, height), container null or unknown for the outermost ones. A module's invocation is in
    its container's coordinates, so that places and sizes are scaled by all containers around it.
    """
    step = stored(p.select("item", "container", "x", "y", "width", "height"), "places")
    top = step.join(shuffled(step.select(c("item").alias("container"))), "container", "left_anti")
    now = stored(top.select("item", c("x").alias("ox"), c("y").alias("oy"), c("width").alias("sx"), c("height").alias("sy"), F.lit(0).alias("depth")), "frames")
    out = now
    for depth in range(1, max_depth):
        around = now.select(c("item").alias("container"), "ox", "oy", "sx", "sy")
        inner = step.join(shuffled(around), "container").select("item", (c("ox") + c("x") * c("sx")).alias("ox"), (c("oy") + c("y") * c("sy")).alias("oy"), (c("sx") * c("width")).alias("sx"), (c("sy") * c("height")).alias("sy"), F.lit(depth).alias("depth"))
        now = stored(inner, "frames")
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise RuntimeError(f"containers nest deeper than {max_depth}")


#: Names and types of modules that only wrap others; so does l and a number.
WRAPPERS = (
    "display", "equipmodpanel", "epdisp", "form", "l1", "l2", "logic", "mes_statecontrol", "operations", "oprframe", "oprmodule",
    "panel", "report", "rpdisp", "startupanel", "statecontrol", "transfersetups", "trend", "unitcontrol", "updisp",
)
#: How names begin, and what types hold, by kind of parameter module.
PARAMETER_PREFIXES = (("rp", ("rp_", "recpar")), ("ep", ("ep_", "engpar")), ("up", ("up_", "usrpar")))


def _wraps(*values: Column) -> Column:
    def one(v: Column) -> Column:
        v = F.lower(v)
        rest = F.regexp_extract(v, "^[^:]*:(.*)$", 1)
        return F.coalesce(v.isin(*WRAPPERS) | rest.isin(*WRAPPERS) | F.rlike(v, F.lit("^l[0-9]+$")), F.lit(False))

    out = one(values[0])
    for v in values[1:]:
        out = out | one(v)
    return out


def _documented(modules: DataFrame) -> DataFrame:
    m = _laid_out(modules.select("program", "path", F.lit("").alias("kind"))).drop("kind")
    typed = modules.select("program", F.lower("path").alias("path"), F.lower(F.coalesce("moduletype", F.lit(""))).alias("moduletype"), F.lower(F.coalesce("label", "moduletype", F.lit(""))).alias("label"))
    m = m.join(typed, ["program", "path"])
    return stored(m.withColumn("wraps", _wraps(c("name"), c("moduletype"), c("label"))), "documented")


def classify_modules(modules: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(program, path, category): em, ops, rp, ep and up modules, in every category that they are in.

    modules: (program, path, moduletype, label: library:type, both null without a type). Wrappers are in no category by
    their own name. em: the name begins with em_ or the type holds equipmod, and neither holds coordinate. ops: directly in
    an oprframe, the name not beginning with mes_. rp, ep, up: by PARAMETER_PREFIXES.
    rules: (category, match, pattern) with match name (the type holds the pattern), label (the label is the pattern, with or
    without its library), or desc_name and desc_label: the same, but what is told is the nearest module above that is
    no wrapper, from the second segment of the path on, else the module directly above. A marker goes up through its
    wrappers a level a round.
    """
    m = _documented(modules)
    starts = lambda x: F.startswith("name", F.lit(x))
    holds = lambda col, x: F.contains(col, F.lit(x))
    around = F.element_at(F.split("parent", r"\."), -1)
    told = [F.when(~holds("name", "coordinate") & ~holds("moduletype", "coordinate") & (starts("em_") | holds("moduletype", "equipmod")), F.lit("em")), F.when((c("depth") >= 2) & (around == "oprframe") & ~starts("mes_"), F.lit("ops"))]
    for category, words in PARAMETER_PREFIXES:
        fits = F.lit(False)
        for x in words:
            fits = fits | starts(x) | holds("moduletype", x)
        told.append(F.when(fits, F.lit(category)))
    out = m.where("not wraps").select("program", "path", F.explode(F.array_compact(F.array(*told))).alias("category"))
    if rules is None:
        return out.distinct()
    bare = lambda x: F.regexp_replace(F.lower(F.trim(x)), "^[^:]*:", "")
    types = m.where("moduletype <> ''").select("moduletype", "label").distinct()
    label = rules.where("match in ('label', 'desc_label')").select("category", "match", F.explode(F.array_distinct(F.array(F.lower(F.trim("pattern")), bare("pattern")))).alias("key"))
    types = stored(types, "types")
    by_label = types.select("*", F.explode(F.array_distinct(F.array(F.trim("label"), bare(c("label"))))).alias("key")).join(label, "key").select("moduletype", "label", "category", "match")
    # patterns within type names: types are few beside modules, and are cut to all their parts of a pattern's length
    name = rules.where("match in ('name', 'desc_name') and pattern <> ''").select("category", "match", F.lower("pattern").alias("part"))
    lengths = name.select(F.length("part").alias("n")).distinct()
    parts = types.join(lengths, F.length("moduletype") >= c("n")).select("moduletype", "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("moduletype") - c("n") + 1), lambda i: F.substring("moduletype", i, c("n")))).alias("part"))
    by_name = parts.join(name, "part").select("moduletype", "label", "category", "match")
    hits = stored(m.where("moduletype <> ''").join(by_label.unionByName(by_name).distinct(), ["moduletype", "label"]).select("program", "path", "parent", "depth", "category", "match"), "hits")
    out = out.unionByName(hits.where("match in ('name', 'label')").select("program", "path", "category"))
    # markers: (what is told last, where the search is now)
    marks = hits.where("match like 'desc%' and depth > 1").select("program", c("parent").alias("home"), c("parent").alias("path"), "category").distinct()
    at = stored(marks, "marks")
    while True:
        met = at.join(m.select("program", "path", "parent", "depth", "wraps"), ["program", "path"], "left")
        found = met.where("not wraps and depth >= 2").select("program", "path", "category")
        # at the top without one: the module directly above the marker, if it is documented
        top = met.where("size(split(path, '[.]')) < 2 or path = ''").select("program", c("home").alias("path"), "category").join(m.select("program", "path"), ["program", "path"], "left_semi")
        out = out.unionByName(found).unionByName(top)
        up = F.array_join(F.slice(F.split("path", r"\."), F.lit(1), F.size(F.split("path", r"\.")) - 1), ".")
        at = stored(met.where("(wraps is null or wraps) and size(split(path, '[.]')) >= 2").select("program", "home", up.alias("path"), "category").distinct(), "marks")
        if at.isEmpty():
            return out.distinct()


def unit_roots(modules: DataFrame, categories: DataFrame, parameters: DataFrame, max_typed_depth: int = 3) -> DataFrame:
    """(program, path) of modules that look like units: in no category, no wrapper, an em or ops module below them, and a
    parameter called name, medianame, headername or sectionname, or else a type and a path of at most max_typed_depth segments.

    Whole trees are asked from the categorised modules up: each tells every module above it. parameters: (program, path, parameter).
    """
    m = _documented(modules)
    steps = F.split("path", r"\.")
    below = categories.where("category in ('em', 'ops')").select("program", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))).alias("up"), "path").where("up <> path")
    over = below.select("program", c("up").alias("path")).distinct()
    named = parameters.where(F.lower("parameter").isin("name", "medianame", "headername", "sectionname")).select("program", F.lower("path").alias("path")).distinct().withColumn("named", F.lit(True))
    x = m.where("not wraps").join(categories.select("program", "path"), ["program", "path"], "left_anti").join(over, ["program", "path"], "left_semi").join(named, ["program", "path"], "left")
    return x.where(c("named") | ((c("moduletype") != "") & (c("depth") <= max_typed_depth))).select("program", "path")
