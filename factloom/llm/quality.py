"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

Built-in functions only. A vote is 1 (good), 0 (bad) or null (the rule abstains). The model: a text is good
with probability prior; each rule says good, bad or nothing with probabilities of its own for good and for
bad texts (from them follow its accuracies), independently of the other rules. Expectation-maximisation runs over the
counts of vote patterns: at most 3 ** rules rows, whatever the number of texts.

Where labels are given, a bounded sample of labelled texts teaches the insults rule its words (of any language) and holds
the estimate: a labelled text counts for what its label says, whatever its votes. Toxic texts, otherwise like good ones, are a class of
their own then; each rule's weight comes from labels and corpus together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for on was as with be by this are from or at a an "
    "der die das und ist nicht mit von den dem zu ein eine auf für sich des im als auch "
    "le la les de des et est un une du que qui dans en pour sur au par pas avec "
    "el los las y es por para con se del una su al lo como más pero no"
).split()
#: Insults, where no labels tell others.
INSULTS = "idiot idiots stupid moron morons worthless pathetic clown clowns loser losers scum trash disgusting hate dumb filthy".split()
RULES = ("length", "repetition", "lines", "symbols", "word_length", "shouting", "function_words", "closing", "insults")
#: Rules that may also vote good; the others look for one defect and vote bad or abstain.
TWO_SIDED = ("length", "function_words", "closing")
#: Characters that are no part of a word at its ends.
AROUND = ".,!?;:\"'()[]«»“”„¿¡…#*$%&|<>-"
#: Letters that tell a learned word: forms of one word share them; a longer stem tells where a shorter one is common.
STEMS = (6, 8)
#: Without labels: least odds of a bad vote, bad texts to good ones, whatever the corpus says. Insults go with no other defect, so EM
#: alone would find them no sign of bad text; this prior says that they are one, and outweighs what else speaks for a text.
LEAST_ODDS = {"insults": 1e6}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int = 5) -> Column:
    """Number of words that stand in a window of k words which the array holds twice or more."""

    def covered(at: Column) -> Column:
        n = F.size(at)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i == n - 1, F.lit(k)).otherwise(F.least(F.lit(k), F.get(at, i + 1) - F.get(at, i))).cast("long"))

    def positions(windows: Column) -> Column:
        keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
            return _let(F.sort_array(same), covered)

        return _let(keyed, twins)

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        made = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))
        return F.when(n >= k, _let(made, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), positions(h)).otherwise(F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _bare(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(AROUND))


def features(text: Column, stems: list[str] | None = None) -> dict[str, Column]:
    """Measures of a text: name to column. A null text has the measures of the empty one. stems: how insults begin; INSULTS without."""

    def insult(word: Column) -> Column:
        if stems is None:
            return _bare(word).isin(INSULTS)
        return _let(_bare(word), lambda w: F.substring(w, 1, STEMS[0]).isin(short) | F.substring(w, 1, STEMS[1]).isin(long))

    short, long = ([x for x in stems or [] if len(x) <= STEMS[0]], [x for x in stems or [] if len(x) > STEMS[0]])
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, "\t\n\x0b\x0c\r", "")) != "")
    both = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
            F.size(F.filter(w, insult)).cast("long").alias("n_insults"),
        ),
    )
    of_lines = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rlike(y, F.lit(r"[.!?…\"”»)]\s*$")))).cast("long").alias("n_closed_lines"),
        ),
    )
    return {"of_words": both, "of_lines": of_lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "n_shouts": F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]{2,}")).cast("long")}


def votes() -> dict[str, Column]:
    """The rules: each a column of 1, 0 or null over the measures. Rules that look for one defect only vote bad or abstain."""
    c, n = F.col, F.col("n_words")

    def vote(good: Column | None, bad: Column) -> Column:
        out = F.when(bad, F.lit(0))
        return out if good is None else out.when(good, F.lit(1))

    return {
        "length": vote(n >= 40, n < 10),
        "repetition": vote(None, c("n_repeat_words") * 100 > 15 * n),
        "lines": vote(None, (c("n_dup_lines") >= 2) & (c("n_dup_lines") * 100 > 30 * c("n_lines"))),
        "symbols": vote(None, c("n_symbols") * 100 > 20 * n),
        "word_length": vote(None, (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n)),
        "shouting": vote(None, c("n_shouts") * 100 > 30 * n),
        "function_words": vote(c("n_function_words") * 100 >= 8 * n, c("n_function_words") * 100 < 3 * n),
        "closing": vote(c("n_closed_lines") * 2 >= c("n_lines"), (c("n_closed_lines") * 4 < c("n_lines")) & (n >= 15)),
        "insults": vote(None, c("n_insults") * 200 > n),
    }


#: What a rule may say: its vote, or that it abstains.
SAYS = (1, 0, None)


#: What a text may be: good, bad, or good but for its insults, which only labels can tell.
GOOD, BAD, TOXIC = 1, 0, 2


def _start(classes: tuple[int, ...] = (GOOD, BAD)) -> dict:
    """Model before the first round: a rule votes bad on few good texts and on many bad ones; if it votes good, the other way round. Toxic texts are like good ones but for the insults."""
    model: dict = {"prior": 0.8}
    for r in RULES:
        both = r in TWO_SIDED
        odds = LEAST_ODDS.get(r, 1.0) if TOXIC not in classes else 1.0
        good = (0.80, 0.04, 0.16) if both else (0.0, min(0.04, 0.4 / odds), 0.96)
        model[r] = {GOOD: good, BAD: (0.40, 0.40, 0.20) if both else (0.0, 0.40, 0.60)}
        if TOXIC in classes:
            model[r][TOXIC] = (0.0, 0.50, 0.50) if r == "insults" else good
    if TOXIC in classes:
        model["toxic"] = 0.1  # of the texts that aren't good
    return model


def _others(model: dict) -> dict[int, float]:
    """The prior of each class but the good one."""
    rest, toxic = 1 - model["prior"], model.get("toxic", 0.0)
    return {BAD: rest * (1 - toxic)} | ({TOXIC: rest * toxic} if "toxic" in model else {})


def _against(model: dict, other: int) -> Column:
    """Log odds of good against another class, for a text's votes. Its terms stand in one array: literals of an array don't change the generated code."""
    out = [math.log(model["prior"] / _others(model)[other])]
    for r in RULES:
        out += [math.log(g / b) if g > 0 and b > 0 else 0.0 for g, b in zip(model[r][GOOD], model[r][other], strict=True)]
    w = F.array(*map(F.lit, out))
    total = F.get(w, F.lit(0))
    for j, r in enumerate(RULES):
        total = total + F.get(w, F.when(F.col(r) == 1, 3 * j + 1).when(F.col(r) == 0, 3 * j + 2).otherwise(3 * j + 3))
    return total


def posterior(model: dict, of: int = GOOD) -> Column:
    """Probability that a text with these votes is good, or of another class."""
    odds = {k: F.exp(-_against(model, k)) for k in _others(model)}
    return (F.lit(1.0) if of == GOOD else odds[of]) / sum(odds.values(), F.lit(1.0))


def fit(patterns: DataFrame, rounds: int = 30, tolerance: float = 1e-3, strength: float = 20.0) -> dict:
    """Estimate the priors, and what each rule says of the texts of each class, from rows (a column for each rule, n).

    With a column `label` (GOOD, BAD, TOXIC or null) labelled texts count for what they are, toxic texts are a class
    of their own, and no rule has least odds. strength is the weight, in texts, of the start. A bad vote always speaks for bad and a good one for good:
    an estimate that says otherwise is drawn to even, or to the rule's least odds. Without any rows the start
    is returned.
    """
    labelled = "label" in patterns.columns
    classes = (GOOD, BAD, TOXIC) if labelled else (GOOD, BAD)
    first = _start(classes)
    model, odds = first, {} if labelled else LEAST_ODDS
    for _ in range(rounds):
        part = {k: posterior(model, k) for k in classes}
        if labelled:
            part = {k: F.when(F.col("label").isNull(), x).otherwise((F.col("label") == k).cast("double")) for k, x in part.items()}
        p = patterns.select("n", *RULES, *((F.col("n") * x).alias(f"of_{k}") for k, x in part.items()))
        sums = [F.sum("n").alias("all"), *(F.sum(f"of_{k}").alias(f"of_{k}") for k in classes)]
        for r in RULES:
            for v in SAYS:
                said = F.col(r).eqNullSafe(F.lit(v).cast("int"))
                sums += [F.sum(F.when(said, F.col(f"of_{k}"))).alias(f"{r}_{v}_{k}") for k in classes]
        s = {k: v or 0.0 for k, v in p.agg(*sums).first().asDict().items()}
        if not s["all"]:
            return model
        new: dict = {"prior": min(0.98, max(0.3, s[f"of_{GOOD}"] / s["all"]))}
        if labelled:
            new["toxic"] = min(0.99, max(0.01, s[f"of_{TOXIC}"] / max(s["all"] - s[f"of_{GOOD}"], 1e-9)))
        for r in RULES:
            says = {k: [s[f"{r}_{v}_{k}"] + strength * x for v, x in zip(SAYS, first[r][k], strict=True)] for k in classes}
            says = {k: [x / sum(y) for x in y] for k, y in says.items()}
            g, b = says[GOOD], says[BAD]
            if g[1] > b[1]:
                g[1] = b[1] = (g[1] + b[1]) / 2
            if g[0] < b[0]:
                g[0] = b[0] = (g[0] + b[0]) / 2
            g[1] = min(g[1], b[1] / odds.get(r, 1.0))
            new[r] = {k: tuple(x) for k, x in says.items()}
        moved = max(abs(new["prior"] - model["prior"]), *(abs(x - y) for r in RULES for k in classes for x, y in zip(new[r][k], model[r][k], strict=True)))
        model = new
        if moved < tolerance:
            break
    return model


def labelled_sample(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(id, toxic, label) of at most `most` labelled texts, by a hash of their id: label is GOOD, BAD where the quality is, TOXIC for toxic texts of good quality. labels: (doc_id, quality, toxic), of which a row without one of them is none."""
    x = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    x = x.orderBy(F.xxhash64("id"), "id").limit(most)
    return written(x.select("id", F.col("toxic").cast("int").alias("toxic"), F.when(F.col("quality") != 1, BAD).when(F.col("toxic") == 1, TOXIC).otherwise(GOOD).alias("label")), "labelled")


def toxic_stems(docs: DataFrame, sample: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 4, share: float = 0.9, most: int = 1000) -> list[str]:
    """How words of toxic texts begin: STEMS letters that `least` toxic texts of the sample hold, or more, and of all that hold them `share` are toxic. The commonest `most` of them."""
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    bare = F.transform(F.split("text", SPACES), _bare)
    stems = F.array_distinct(F.concat(*(F.transform(bare, lambda w: F.substring(w, 1, n)) for n in STEMS)))
    per = x.select("toxic", F.explode(stems).alias("stem")).where("stem <> ''").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    found = per.where((F.col("toxic") >= least) & (F.col("toxic") >= share * F.col("n"))).orderBy(F.col("toxic").desc(), "stem").limit(most)
    return [r.stem for r in found.select("stem").collect()]


def judged(docs: DataFrame, *, text_col: str = "text", least_words: int = 10, repeat_percent: int = 20, least_probability: float = 0.5, keep: list[str] | None = None, labels: DataFrame | None = None, id_col: str = "doc_id", most_labels: int = 20_000) -> DataFrame:
    """Every row of docs as a struct `row` (of the columns in keep, or all), its measures, votes, p_quality, base_failed and kept.

    Words are runs without space, tab, newline, vertical tab, form feed and carriage return. n_dup_lines
    counts lines with a word that equal an earlier line; n_repeat_words the words in 5-word windows that the
    text holds twice or more. base_failed: fewer than least_words words, or more than repeat_percent of the
    words repeat. kept: not base_failed, and a posterior of least_probability or more.

    labels: (doc_id, quality, toxic) of some of the texts, of which at most most_labels teach the insults rule its words
    and hold the estimate. Without labels, or with none that is whole, INSULTS and LEAST_ODDS stand in.

    Null and empty texts have no words and fail; repeated rows get the same verdict each. An empty table
    gives an empty table. Columns of docs can't clash with the new ones, as they stand in `row`.
    """
    sample, stems = None, None
    if labels is not None and not (found := labelled_sample(labels, most_labels)).isEmpty():
        sample, stems = found, toxic_stems(docs, found, id_col=id_col, text_col=text_col)
    own_id = [F.col(id_col).cast("long").alias("id")] if sample is not None else []
    m = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), *own_id, *(v.alias(k) for k, v in features(docs[text_col], stems).items()))
    m = m.select("row", *(["id"] if own_id else []), "of_words.*", "of_lines.*", "n_symbols", "n_shouts")
    m = m.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    m = written(m.select("*", *(v.cast("int").alias(k) for k, v in votes().items())), "measured")
    if sample is None:
        patterns = m.groupBy(*RULES).agg(F.count("*").alias("n"))
    else:
        patterns = m.select("id", *RULES).join(sample.select("id", "label"), "id", "left").groupBy(*RULES, "label").agg(F.count("*").alias("n"))
    model = fit(written(patterns, "patterns"))
    return m.drop("id").withColumn("p_quality", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= least_probability))
