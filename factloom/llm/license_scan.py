"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

Built-in functions only. A file's segments are its lines, cut at sentence ends; a licence file's whole text
is one more. A notice may be wrapped: a sentence over several lines is a segment too, and so is every run of up
to RUN of its lines, as a notice may be part of a longer sentence. A line without letters and digits ends a
sentence; comment marks aren't tokens, so they need no stripping. A segment's vector has tf * idf for each token; idf counts, over all files, how many hold the
token. Tokens outside the templates weigh as tokens that no file holds. Each segment is compared with every
template, and the best one at or over the threshold is the file's own licence: a title of a licence text before a clause that
tells it from its like, that before a notice, and a reservation of rights only where nothing else is found. A segment's
tokens are sorted, so that equal ones are counted in one pass: work grows with a text, not with its square.

Only segments with a key token of some template are weighed. A template's key tokens are its heaviest ones,
so many that the others alone are shorter than threshold times the template's vector: by Cauchy-Schwarz a
segment without any of them stays under the threshold, so nothing is lost.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Notices by licence: (licence, version that a text must name, text).
NOTICES = (
    ("MIT", "", "Released under the MIT License."),
    ("MIT", "", "Licensed under the MIT License."),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "2.0", "you may not use this file except in compliance with the Apache License, Version 2.0"),
    ("GPL-3.0", "3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "2", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("GPL-1.0", "1", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version"),
    ("LGPL-3.0", "3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Zlib", "", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Zlib", "", "Licensed under the zlib License."),
    ("BSD-3-Clause", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "3", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "2", "Licensed under the BSD 2-Clause License."),
    ("ISC", "", "Licensed under the ISC License."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("CC-BY-4.0", "4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "1.0", "To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain."),
)
#: Fixed values: (..., rank): clauses that tell a licence from its like; one with all clauses of another, and more, ranks higher.
CLAUSES = (
    ("BSD-2-Clause", "", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", 2),
    ("BSD-3-Clause", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 3),
    ("BSD-3-Clause", "", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", 3),
)
#: Titles of licence texts; a title counts more than what the text says elsewhere of other licences.
TITLES = (
    ("GPL-3.0", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-1.0", "1", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("LGPL-3.0", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.0", "2", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.3", "1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL-1.2", "1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("Apache-2.0", "2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("Artistic-1.0", "", "The Artistic License"),
    ("CC0-1.0", "1.0", "CC0 1.0 Universal"),
    ("BSL-1.0", "1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("EPL-2.0", "2.0", "Eclipse Public License - v 2.0"),
)
#: What is only taken where nothing else is found.
LAST = (("Proprietary", "", "All rights reserved."),)
#: (licence, version, text, rank): of templates that a file reaches, one of the highest rank, then the most similar, is its own.
TEMPLATES = (*((*x, 1) for x in NOTICES), *CLAUSES, *((*x, 4) for x in TITLES), *((*x, 0) for x in LAST))
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
SEGMENT_END = r"\n|(?<=[.!?;])\s+"
SENTENCE_END = r"\n[^\p{L}\p{N}\n]*(?=\n)|(?<=[.!?])\s+"
#: Lines of a run: the longest template, wrapped at 30 columns.
RUN = 6
LICENSE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|notice|unlicense|copyright)([-._][^/]*)?$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, _, text, _ in TEMPLATES:
        tokens = re.findall(TOKEN, text.lower())
        v = {t: tokens.count(t) * idf[t] for t in tokens}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def _key_tokens(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    keys = set()
    for v in vectors:
        rest = 1.0
        for t, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if rest < threshold * threshold - 1e-9:
                break
            keys.add(t)
            rest -= x * x
    return sorted(keys)


def _best(segment: Column, idf: dict[str, float], unseen: float, vectors: list[dict[str, float]], threshold: float) -> Column:
    """struct(rank, score, order) of the segment's best template that it reaches, null for none; order: minus its number, so that the first wins a tie.

    A template of a version is only reached by a segment that names it: texts of other versions are alike but for that.
    """
    ranks = F.array(*(F.lit(rank) for *_, rank in TEMPLATES))
    # the version as it may be written; without one, the empty token, which is added to every segment
    versions = F.array(*(F.array(*map(F.lit, {v, f"{v}.0", f"v{v}"} if v else {""})) for _, v, _, _ in TEMPLATES))
    vocabulary = sorted(idf)
    # one constant, not an expression for each number: the plan stays small
    weights = F.from_json(F.lit(json.dumps({t: [idf[t], *(idf[t] * v.get(t, 0.0) for v in vectors)] for t in vocabulary})), "map<string,array<double>>")
    zero = F.array_repeat(F.lit(0.0), len(vectors) + 1)
    none = F.from_json(F.lit(json.dumps([unseen] + [0.0] * len(vectors))), "array<double>")

    def of(tokens: Column) -> Column:
        def counted(sums: Column, t: Column, tf: Column) -> Column:
            w = F.coalesce(F.try_element_at(weights, t), none)
            # first the squared norm, then the products with the templates
            return F.transform(w, lambda x, i: F.get(sums, i) + tf * x * F.when(i == 0, tf * x).otherwise(F.lit(1.0)))

        def add(acc: Column, t: Column) -> Column:
            same = acc["t"] == t
            return F.struct(t.alias("t"), F.when(same, acc["tf"] + 1.0).otherwise(F.lit(1.0)).alias("tf"), F.when(same, acc["sums"]).otherwise(counted(acc["sums"], acc["t"], acc["tf"])).alias("sums"))

        # equal tokens follow each other; what comes after the last one counts it, and what came before the first counted nothing
        start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("tf"), zero.alias("sums"))
        total = F.aggregate(F.array_append(F.sort_array(tokens), F.lit("~")), start, add, lambda acc: acc["sums"])
        named = F.array_append(tokens, F.lit(""))

        def told(s: Column) -> Column:
            norm = F.sqrt(F.greatest(s[0], F.lit(1e-12)))
            scores = F.transform(F.slice(s, 2, len(vectors)), lambda x, i: F.struct(F.get(ranks, i).alias("rank"), F.round(x / norm, 6).alias("score"), (-i).alias("order")))
            return F.array_max(F.filter(scores, lambda x: (x["score"] >= threshold) & F.arrays_overlap(F.get(versions, -x["order"]), named)))

        return F.transform(F.array(total), told)[0]

    return F.transform(F.array(_tokens(segment)), of)[0]


def _runs(sentence: Column) -> Column:
    """A sentence of several lines: the whole of it, and its runs of 2 to RUN lines."""

    def of(lines: Column) -> Column:
        n = F.size(lines)
        run = lambda w: F.transform(F.sequence(F.lit(0), n - w), lambda i: F.array_join(F.slice(lines, i + 1, w), "\n"))
        runs = F.flatten(F.transform(F.sequence(F.lit(2), F.least(n, F.lit(RUN))), run))
        return F.when(n > RUN, F.array_append(runs, sentence)).when(n > 1, runs).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.split(F.trim(sentence), r"\n")), of)[0]


def own_licenses(files: DataFrame, *, path_col: str = "path", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """Each row of files as a struct `row`, with path, own_license and similarity (null where no template reaches the threshold).

    Of equally similar templates of one rank the first counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    vocabulary = sorted({t for _, _, x, _ in TEMPLATES for t in re.findall(TOKEN, x.lower())})
    held = files.select(F.array_intersect(_tokens(text), F.array(*map(F.lit, vocabulary))).alias("t"))
    counts = held.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()  # a row a template token
    seen = {r.t: r.c for r in counts}
    n = seen.pop("", 0)
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1
    vectors = _vectors(idf)
    keys = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in _key_tokens(vectors, threshold)) + r")(?![a-z0-9])"
    segments = F.split(text, SEGMENT_END)
    segments = F.when(F.rlike(F.col(path_col), F.lit(LICENSE_FILE)), F.array_append(segments, text)).otherwise(segments)
    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: F.contains(s, F.lit("\n")) & F.rlike(s, F.lit(keys)))
    segments = F.concat(segments, F.flatten(F.transform(sentences, _runs)))
    kept = F.when(F.rlike(text, F.lit(keys)), F.filter(segments, lambda s: F.rlike(s, F.lit(keys)))).otherwise(F.array().cast("array<string>"))
    best = F.array_max(F.transform(kept, lambda s: _best(s, idf, unseen, vectors, threshold)))
    names = F.array(*(F.lit(name) for name, *_ in TEMPLATES))
    out = files.select(F.struct(*(F.col(f"`{c}`") for c in files.columns if c != text_col)).alias("row"), F.col(path_col).alias("path"), best.alias("best"))
    return out.select("row", "path", F.get(names, -F.col("best.order")).alias("own_license"), F.col("best.score").alias("similarity"))


def _directory(path: Column) -> Column:
    """The path up to its last slash; the root is ''."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licenses(files: DataFrame, *, path_col: str = "path", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """Each row of files as a struct `row` (without its text), with license, how, similarity and source.

    how is own, inherited (from the licence file of the nearest directory above, the file's own included;
    source is that directory) or none. A directory with several licence files takes the most similar one,
    then the first by path. Null and empty texts have no licence of their own; a row without path inherits
    nothing; repeated rows get one result each. Columns of files can't clash, as they stand in `row`.
    """
    own = written(own_licenses(files, path_col=path_col, text_col=text_col, threshold=threshold).withColumn("directory", _directory(F.col("path"))), "own-licenses")
    named = own.where(F.rlike("path", F.lit(LICENSE_FILE)) & F.col("own_license").isNotNull())
    of_directory = named.groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("worst"), "path", "own_license")).alias("x")).select(F.col("directory").alias("above"), F.col("x.own_license").alias("inherited"))
    # directories first: they are fewer than files, and one with a third of all files is one row
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(steps))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))
    directories = own.where("directory is not null").select("directory").distinct().select("directory", F.explode(above).alias("x")).select("directory", "x.depth", "x.above")
    nearest = directories.join(of_directory, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "inherited")).alias("x")).select("directory", F.col("x.above").alias("source"), "x.inherited")
    out = own.join(nearest, "directory", "left")
    has = F.col("own_license").isNotNull()
    return out.select("row", F.coalesce("own_license", "inherited").alias("license"), F.when(has, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("how"), "similarity", F.when(~has, F.col("source")).alias("source"))
