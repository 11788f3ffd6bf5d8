r"""Licence scan: sparse TF-IDF cosine of lines to templates, then inheritance along paths.

1. A line is a bag of words (`[a-z0-9]+`, lowered). Weights are term counts times idf over the templates; a
   word in no template has the idf of a term in none of them and counts in the line's length, so long
   prose with a few licence words stays far from all templates. A line belongs to the nearest
   template, from ``THRESHOLD`` on.
2. Most lines share so little weight with every template that they cannot reach the threshold; one pass
   over the whole texts finds the others, exactly. Each distinct one is compared once, however many
   files have it.
   Headers and licence files are windows of any number of joined sentences and lines: for each template the
   one that is nearest by a cosine whose length counts every token alone. It is the stretch with the
   greatest sum of (products - x * squared weights) for a fitting x, so one pass for each x of a grid finds
   it, however long the text. Windows and the whole text are then compared as lines are.
3. A file has the licence of its best line or window. A directory has that of its best licence file
   (``LICENSE``, ``LICENCE``, ``COPYING``). A file without one inherits from the nearest directory
   above it: distinct directories are joined to directory licences by their ancestors' paths.

Null and empty texts have no licence of their own and still inherit. A null path has no directory.
Very long texts are read whole. Repeated rows each get a result; an empty table gives no rows; columns other than
those named here are carried along, but for the names of the results. Ties: the higher score, then the name of the licence, then the path.
The templates are a small fixed table; the joins with it are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.llm.common import frames, stage, table, type_of, words

THRESHOLD = 0.6

# Wordings of licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
                     "License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, version 3"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
)
#: Lengths of windows (roots of summed squared weights) whose best stretch is looked for.
LENGTHS = (2.0, 3.0, 4.5, 7.0, 10.0, 15.0, 23.0, 35.0, 55.0)


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class Model:
    """Template weights and idf; ``mass`` holds the squared weights, terms by templates."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(tokens(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        self.threshold = threshold
        self.other = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.rows, self.vocabulary = [], sorted(df)
        self.mass = np.zeros((len(df), n))
        for i, ((name, _), c) in enumerate(zip(templates, counts)):
            weight = {w: k * self.idf[w] for w, k in c.items()}
            norm = math.sqrt(sum(v * v for v in weight.values()))
            self.rows += [(i, name, w, v / norm) for w, v in sorted(weight.items())]
            for w, v in weight.items():
                self.mass[self.vocabulary.index(w), i] = (v / norm) ** 2


TERM = table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))


def candidate_lines(files: DataFrame, model: Model) -> DataFrame:
    """(file, line) of every line that can reach the threshold.

    By Cauchy and Schwarz a line's squared cosine to a template is at most the template's squared
    weights at the shared terms, times the share of those terms in the line's squared length; words
    of no template add at least one squared weight each to that length. Other lines stay behind.
    """
    hashes, idf, _, mass = term_table(model)
    enough = model.threshold**2 - 1e-9

    def work(batches):
        for rows, data, offsets in frames(batches, "text"):
            value, _, start, _ = words(data, offsets, TERM)
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            known = hashes[at] == value
            # Lines end at line feeds and at the ends of texts.
            ends = np.union1d(np.flatnonzero(data == 10), offsets[1:])
            owner = np.searchsorted(ends, start, "right")
            pair, tf = np.unique(owner[known] * len(hashes) + at[known], return_counts=True)
            line, place = np.unique(pair // len(hashes), return_inverse=True)
            term = pair % len(hashes)
            foreign, size = np.unique(owner[~known], return_counts=True)
            outside = np.zeros(len(line))
            if len(foreign) and len(line):
                k = np.minimum(np.searchsorted(foreign, line), len(foreign) - 1)
                outside = np.where(foreign[k] == line, size[k], 0) * model.other**2
            bound = np.zeros(len(line))
            for template in mass.T:
                inside = np.bincount(place, (tf * idf[term]) ** 2 * (template[term] > 0), len(line))
                shared = np.bincount(place, template[term], len(line))
                bound = np.maximum(bound, shared * inside / np.maximum(inside + outside, 1e-12))
            line = line[bound >= enough]
            begin = np.where(line > 0, ends[line - 1], 0)
            begin = begin + (data[begin] == 10) * (line > 0) if len(line) else begin
            owner = np.searchsorted(offsets, begin, "right") - 1
            yield pa.record_batch({
                "file": rows.column(0).take(pa.array(owner)),
                "line": pa.array([bytes(data[s:ends[k]]).decode("utf-8", "replace")
                                  for s, k in zip(begin.tolist(), line.tolist())], pa.string())})

    return files.select("file", "text").mapInArrow(
        work, f"file {type_of(files, 'file')}, line string")


UNIT = re.compile(rb"\n|(?<=[.!?])\s+")


def term_table(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the templates' terms, their idf, template weights and squared weights."""
    names = np.frombuffer(" ".join(model.vocabulary).encode(), np.uint8)
    hashes = words(names, np.array([0, len(names)]), TERM)[0]
    order = np.argsort(hashes)
    mass = model.mass[order]
    return hashes[order], np.array([model.idf[w] for w in model.vocabulary])[order], np.sqrt(mass), mass


def best_stretch(dot: np.ndarray, norm: np.ndarray, x: float) -> tuple[int, int]:
    """First and last unit of the stretch with the greatest sum of ``dot - x * norm``."""
    sums = np.concatenate([[0.0], np.cumsum(dot - x * norm)])
    last = int((sums[1:] - np.minimum.accumulate(sums[:-1])).argmax())
    return int(sums[:last + 1].argmin()), last


class Units:
    """Tokens of one text by sentence and line."""

    def __init__(self, body: bytes, value, start, at, known, table_, other: float):
        _, self.idf, self.weights, _ = table_
        cuts = [m.span() for m in UNIT.finditer(body)]
        spans = [(s, e) for s, e in zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(body)]) if s < e]
        self.spans, self.other = spans, other
        self.of = np.searchsorted([s for s, _ in spans], start, "right") - 1
        self.value, self.term, self.known = value, at, known
        n, width = len(spans), self.weights.shape[1]
        self.dot = np.zeros((n, width))
        np.add.at(self.dot, self.of[known], self.idf[at[known], None] * self.weights[at[known]])
        self.norm = np.bincount(self.of, np.where(known, self.idf[at] ** 2, other ** 2), n)

    def cosine(self, first: int, last: int, template: int) -> tuple[float, int]:
        """Cosine of a window to a template, and how many of its terms it has."""
        lo, hi = np.searchsorted(self.of, [first, last + 1])
        known = self.known[lo:hi]
        tf = np.bincount(self.term[lo:hi][known], minlength=len(self.idf)) * self.idf
        foreign = np.unique(self.value[lo:hi][~known], return_counts=True)[1] * self.other
        norm = math.sqrt(float(tf @ tf + foreign @ foreign))
        own = self.weights[:, template]
        return float(tf @ own) / max(norm, 1e-12), int(((tf > 0) & (own > 0)).sum())

    def windows(self, templates: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(first, last) unit of the windows that reach the threshold with one of the templates.

        A window shares three terms or more with its template: the sentences `Mit.` and `Nd! By!` are no licence."""
        found = {(0, len(self.spans) - 1): set(templates.tolist())}
        for k in templates.tolist():
            dot, norm = self.dot[:, k], self.norm
            for length in LENGTHS:
                x = 0.4 / length
                for _ in range(4):
                    first, last = best_stretch(dot, norm, x)
                    total, size = dot[first:last + 1].sum(), norm[first:last + 1].sum()
                    if k in found.setdefault((first, last), set()) or not size:
                        break
                    found[first, last].add(k)
                    # The nearest window of all is the best stretch for this x.
                    x = total / (2 * size)
        out = []
        for (first, last), own in found.items():
            for k in own:
                score, shared = self.cosine(first, last, k)
                if shared > 2 and score >= threshold - 1e-6:
                    out.append((first, last))
                    break
        return out


def candidate_windows(files: DataFrame, model: Model) -> DataFrame:
    """(file, line) of windows of joined sentences and lines that reach the threshold.

    Only texts are looked at whose terms, all together, have enough of a template's squared weights."""
    table_, enough = term_table(model), model.threshold**2 - 1e-9
    hashes, _, _, mass = table_

    def work(batches):
        for rows, data, offsets in frames(batches, "text"):
            value, doc, start, _ = words(data, offsets, TERM)
            n = len(offsets) - 1
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            known = hashes[at] == value
            pair = np.unique(doc[known] * len(hashes) + at[known])
            owner, term = pair // len(hashes), pair % len(hashes)
            reach = np.stack([
                (np.bincount(owner, m[term], n) >= enough) & (np.bincount(owner, m[term] > 0, n) > 2)
                for m in mass.T], 1) if len(pair) else np.zeros((n, 1), bool)
            edge = np.searchsorted(doc, np.arange(n + 1))
            found = []
            for d in np.flatnonzero(reach.any(1)).tolist():
                own = slice(edge[d], edge[d + 1])
                body = data[offsets[d]:offsets[d + 1]].tobytes()
                unit = Units(body, value[own], start[own] - offsets[d], at[own], known[own], table_, model.other)
                found += [(d, body[unit.spans[i][0]:unit.spans[j][1]].decode("utf-8", "replace"))
                          for i, j in unit.windows(np.flatnonzero(reach[d]), model.threshold)]
            found = list(dict.fromkeys(found))
            yield pa.record_batch({
                "file": rows.column(0).take(pa.array([d for d, _ in found], pa.int64())),
                "line": pa.array([x for _, x in found], pa.string())})

    return files.select("file", "text").mapInArrow(
        work, f"file {type_of(files, 'file')}, line string")


def matched_lines(spark: SparkSession, lines: DataFrame, model: Model) -> DataFrame:
    """(key, licence, score) of the distinct lines (key, line) that reach the threshold; terms travel with the key."""
    weights = spark.createDataFrame(model.rows, "template int, licence string, term string, weight double")
    idf = spark.createDataFrame(sorted(model.idf.items()), "term string, idf double")
    terms = lines.select("key", F.explode(F.split(
        F.translate("line", UPPER, UPPER.lower()), "[^a-z0-9]+")).alias("term")).where(
        "term <> ''").groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = terms.join(F.broadcast(idf), "term", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(model.other)))
    # Per line one row for each template it shares a term with, and its length over all terms.
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(weights), "term").groupBy("key", "template", "licence").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    found = dots.join(norms, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = F.max(F.struct(F.col("score"), reverse_key("licence").alias("k"), "licence")).alias("m")
    return found.where(F.col("score") >= model.threshold).groupBy("key").agg(best).select(
        "key", "m.licence", "m.score")


def reverse_key(column: str):
    """A key that orders short names against their alphabet, so that max() takes the first name."""
    return F.translate(F.rpad(column, 32, " "), ALPHABET, ALPHABET[::-1])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABET = "".join(sorted(" -.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def own_licences(files: DataFrame, model: Model) -> DataFrame:
    """``path`` and ``file`` with the licence and score of each file that has one."""
    lines = stage(candidate_lines(files, model).union(candidate_windows(files, model)).withColumn("key", F.md5("line")))
    distinct = stage(lines.select("key", "line").dropDuplicates(["key"]))
    scored = matched_lines(files.sparkSession, distinct, model)
    best = F.max(F.struct("score", reverse_key("licence").alias("k"), "licence")).alias("m")
    return lines.select("file", "key").join(scored, "key").groupBy("file").agg(best).select(
        "file", F.col("m.licence").alias("own_licence"), F.col("m.score").alias("own_score"))


def directory(path):
    """The path without its last part; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherited(files: DataFrame) -> DataFrame:
    """(dir, licence, from_dir) for each directory with a licence in it or above it.

    ``files`` holds path, own_licence and own_score.
    """
    named = files.withColumn("dir", directory(F.col("path")))
    given = named.where(F.col("own_licence").isNotNull() & F.col("path").rlike(
        r"(?i)(?:^|/)(?:licen[cs]e|copying)(?:\.[^/]*)?$")).groupBy(F.col("dir").alias("from_dir")).agg(
        F.max(F.struct("own_score", reverse_key("own_licence").alias("k"), "own_licence")).alias("m")
    ).select("from_dir", F.col("m.own_licence").alias("licence"))
    dirs = named.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    ))).alias("from_dir")).distinct()
    return above.join(given, "from_dir").groupBy("dir").agg(
        F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "licence")).alias("m")
    ).select("dir", F.col("m.licence").alias("dir_licence"), F.col("m.from_dir").alias("from_dir"))


def scan(files: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of ``files`` (file, path, text; ``file`` names a row) with own and effective licence.

    The text is read once, for the lines; only ids and paths take part in the joins.
    """
    own = own_licences(files, model or Model())
    listed = stage(files.drop("text").join(own, "file", "left"))
    return listed.withColumn("dir", directory(F.col("path"))).join(inherited(listed), "dir", "left").select(
        *[c for c in files.columns if c != "text"], "own_licence", "own_score",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("from_dir")).alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as a source tree: three levels of directories below each source; every tenth id is
    the licence file of one of them."""
    i = F.col("doc_id")
    top = F.coalesce("source", F.lit("unknown"))
    second = F.concat(top, F.lit("/d"), F.pmod(F.floor(i / 100), F.lit(10)))
    third = F.concat(second, F.lit("/e"), F.pmod(F.floor(i / 10), F.lit(10)))
    level = F.pmod(F.floor(i / 10), F.lit(3))
    path = F.when(F.pmod(i, F.lit(10)) == 0, F.concat(
        F.when(level == 0, top).when(level == 1, second).otherwise(third), F.lit("/LICENSE"))
    ).otherwise(F.concat(third, F.lit("/"), i, F.lit(".txt")))
    return docs.select(i.alias("file"), path.alias("path"), "text")


def query(docs: DataFrame) -> DataFrame:
    return scan(document_files(docs)).withColumnRenamed("file", "doc_id")
