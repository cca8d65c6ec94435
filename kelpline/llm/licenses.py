"""Licence scans: a trained paragraph classifier over word n-grams, its verdicts confirmed against templates. DataFrame operations only."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import linear
from kelpline.llm.shared import stage

SEED = 11
GRAMS_AT_MOST = 8192  # n-grams with weights, the most frequent of the training rows: the bound of the fit and of what is broadcast
SURE = 0.5  # calibrated probability from which a family is named
OVERLAP = 0.5  # share of a template's n-grams that a paragraph must hold

#: The usual short notices of each family.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License, Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "This software is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "MIT License", "The MIT License (MIT)", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "GNU General Public License, Version 3, 29 June 2007", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it under the terms of the GNU Lesser General Public License.", "GNU Lesser General Public License, Version 3, 29 June 2007", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it under the terms of the GNU Affero General Public License.", "GNU Affero General Public License, Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "BSD 3-Clause License"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public domain": ["This work is released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
    "all rights reserved": ["All rights reserved.", "Copyright 2020 by the author. All rights reserved."],
}
#: Sentences that the classifier is trained on, other than the templates that confirm it.
NOTICES = {
    "Apache": ["This project is distributed under the terms of the Apache 2.0 licence.", "Code in this directory is covered by the Apache License 2.0.", "Apache-2.0 licensed; see the NOTICE file for attributions.", "Apache License, version 1.1.", "Licensed under the Apache License.", "You may use this work under the Apache License, version two point zero.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."],
    "MIT": ["Distributed under the terms of the MIT licence.", "MIT licensed, see LICENSE.", "Permission is granted, free of charge, to any person who obtains a copy of this software and its documentation, to deal in it without restriction.", "The MIT License.", "MIT license.", "License: MIT", "This copyright notice and the permission notice are to be included in all copies and substantial portions of the software.", "Include the above notice in all copies or substantial portions of the Software.", "The code is available under the MIT License, copyright its contributors.", "Use, copy, modify, merge, publish, distribute, sublicense and sell copies of the Software, and permit persons to whom the Software is furnished to do so.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED; a permission notice shall be included in all copies."],
    "GPL": ["This package is distributed under the GNU GPL, version 2 or later.", "Covered by the GNU General Public License; see COPYING.", "GNU General Public License, version 2, June 1991.", "You ought to have received a copy of the GNU General Public License with this package.", "Licensed under the GNU General Public License version 2.", "GPLv3 or any later version of the General Public License applies.", "This program is distributed in the hope that it will be useful; see the GNU General Public License for more details.", "Free software under the terms of the General Public License, at your option any later version."],
    "LGPL": ["This package is distributed under the GNU LGPL, version 2.1 or later.", "Covered by the GNU Lesser General Public License; see COPYING.LESSER.", "GNU Lesser General Public License, version 2.1, February 1999.", "Licensed under the GNU Lesser General Public License version 3.", "LGPLv3 or any later version of the Lesser General Public License applies to the library.", "This library is distributed in the hope that it will be useful; see the GNU Lesser General Public License for more details.", "Link with this library under the terms of the Lesser General Public License."],
    "AGPL": ["This service is distributed under the GNU AGPL, version 3 or later.", "Covered by the GNU Affero General Public License; see COPYING.", "GNU Affero General Public License, version 3, November 2007.", "Licensed under the GNU Affero General Public License version 3.", "AGPLv3 or any later version of the Affero General Public License applies.", "See the GNU Affero General Public License for more details.", "Network use is covered by the Affero General Public License."],
    "BSD": ["This package is under the 3-clause BSD licence.", "BSD licensed, see LICENSE.", "BSD 2-Clause License", "License: BSD.", "Redistribution and use of this work in source or binary form, with or without changes, are permitted if these conditions are met.", "You may redistribute and use it in source and binary forms, modified or not, provided that the conditions below are met.", "The New BSD License (BSD-3-Clause) applies to all files.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."],
    "MPL": ["This file is under the Mozilla Public License 2.0.", "Mozilla Public License, version 1.1.", "The source is subject to the terms of the Mozilla Public License.", "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.", "MPL-2.0 licensed, the Mozilla licence.", "Covered by the terms of the Mozilla Public License, version two."],
    "CC-BY-NC": ["This text is shared under a Creative Commons Attribution-NonCommercial licence.", "The pictures are licensed under the Creative Commons Attribution-NonCommercial 3.0 Unported License.", "CC BY-NC 4.0: non-commercial use with attribution only.", "Licensed under CC BY-NC 3.0.", "This page is under a Creative Commons Attribution-NonCommercial 4.0 licence.", "NonCommercial 4.0 International, with attribution, by Creative Commons.", "Creative Commons BY-NC, not for commercial purposes."],
    "CC-BY-SA": ["This text is shared under a Creative Commons Attribution-ShareAlike licence.", "The pictures are licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC BY-SA 4.0: share alike with attribution.", "Licensed under CC BY-SA 3.0.", "This page is under a Creative Commons Attribution-ShareAlike 4.0 licence.", "ShareAlike 4.0 International, with attribution, by Creative Commons.", "Creative Commons BY-SA, derivatives under the same terms."],
    "CC-BY": ["This text is shared under a Creative Commons Attribution licence.", "The pictures are licensed under the Creative Commons Attribution 3.0 Unported License.", "Creative Commons Attribution 4.0 International applies to this page.", "CC BY 4.0: reuse with attribution.", "Licensed under CC BY 3.0.", "CC BY 4.0 licensed.", "Creative Commons BY, with credit to the author."],
    "public domain": ["The author has placed this text in the public domain.", "These files were released into the public domain by the people who wrote them.", "Released to the public domain, unencumbered.", "Dedicated to the public domain under CC0.", "The author has waived copyright and related rights to the extent that law allows, under CC0 1.0.", "This free and unencumbered work is released into the public domain.", "No rights are reserved; it belongs to the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "all rights reserved": ["Copyright the publisher, all rights reserved worldwide.", "Copyright 2011 Some Company. All rights reserved.", "All rights are reserved by the press.", "All rights reserved by its owner.", "No part of this publication may be reproduced without written permission; all rights reserved.", "(c) the authors. All rights reserved by the owner."],
}
#: Short identifiers of SPDX lines, as patterns: these lines name their families themselves.
SPDX = {"Apache": "apache-.*", "MIT": "mit(-.*)?", "GPL": "gpl-.*", "LGPL": "lgpl-.*", "AGPL": "agpl-.*", "BSD": "(0?bsd|bsd-.*)", "MPL": "mpl-.*", "CC-BY-NC": "cc-by-nc-.*", "CC-BY-SA": "cc-by-sa-.*", "CC-BY": "cc-by-[0-9].*", "public domain": "(cc0-.*|unlicense)"}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
#: Words of legal matters: paragraphs with one are counted, whatever they are judged to be. They decide nothing else: all are judged.
ANCHORS = r"licen[cs]|copyright|reserved|permission|permitted|domain|commons|redistribut|\bcc\b|\bcc0|gnu|mozilla|apache|\bmit\b|\bbsd|spdx"
_NOISE = "the of and to in that is was for on with as by at from this be are or an it which has had not but all were one their there".split()
_LEGAL = "license licensed licence copyright permission permitted public rights version terms under general work released free driver driving fishing granted council office holder fee plate exam holders music reserved seats gnu herd redistribution wealth".split()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def training_rows(each: int = 120) -> list[tuple[list[str], int]]:
    """Labelled paragraphs: of each family its NOTICES, with words dropped, versions changed and prose around them; and as many
    again of the unknown class: prose with legal words in any order, and shuffled parts of notices."""
    rng = random.Random(SEED)
    prose = lambda n: [rng.choice(_NOISE) if rng.random() < 0.6 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    rows = []
    for y, family in enumerate(TEMPLATES):
        for k in range(each):
            w = words_of(NOTICES[family][k] if k < len(NOTICES[family]) else rng.choice(NOTICES[family]))
            if k >= len(NOTICES[family]):
                w = [str(rng.randrange(1, 30)) if x.isdigit() and rng.random() < 0.3 else x for x in w if rng.random() > 0.03]
                w = prose(rng.choice([0, 0, 3, 12])) + w + prose(rng.choice([0, 0, 3, 12]))
            rows.append((w, y))
    for k in range(each * 5):
        if k % 3:
            w = prose(rng.randint(4, 40))
            for x in rng.sample(_LEGAL, rng.randint(1, 4)):
                w.insert(rng.randrange(len(w) + 1), x)
        else:
            w = words_of(rng.choice(NOTICES[rng.choice(list(NOTICES))]))
            w = rng.sample(w, max(1, len(w) // 3)) + prose(6)
            rng.shuffle(w)
        rows.append((w, len(TEMPLATES)))
    return rows


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of each n-gram, biases, and the temperature, which is set on the fifth of the rows that training leaves out."""
    rows = training_rows()
    held = np.arange(len(rows)) % 5 == 4
    counts: dict[str, int] = {}
    for (w, _), out in zip(rows, held):
        if not out:
            for g in grams_of(w):
                counts[g] = counts.get(g, 0) + 1
    names = sorted((g for g, n in counts.items() if n > 1), key=lambda g: (-counts[g], g))[:GRAMS_AT_MOST]
    number = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (w, _) in enumerate(rows):
        x[i, [number[g] for g in grams_of(w) if g in number]] = 1
    y = np.array([c for _, c in rows])
    w, b = linear.fit(x[~held], y[~held], len(FAMILIES), l2=3e-4, turns=300)
    heat = linear.temperature(x[held] @ w + b, y[held])
    return {g: w[i].round(6).tolist() for g, i in number.items()}, b.tolist(), heat


@lru_cache(maxsize=4)
def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(gram, w) and (gram, family, template, size): as long as the vocabulary and the templates."""
    weights = spark.createDataFrame(list(model()[0].items()), "gram string, w array<double>")
    rows, k = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            grams = sorted(grams_of(words_of(text)))
            rows += [(g, family, k, len(grams)) for g in grams]
            k += 1
    return weights, spark.createDataFrame(rows, "gram string, family string, template int, size int")


@lru_cache(maxsize=1)
def _words() -> str:
    """The words of all n-grams with a weight or in a template, as a list in SQL."""
    grams = [*model()[0], *(g for texts in TEMPLATES.values() for t in texts for g in grams_of(words_of(t)))]
    return ", ".join(f"'{w}'" for w in sorted({w for g in grams for w in g.split()}))


def _known(lines: str) -> str:
    """SQL of an array of lines as strings of their known words, two spaces where others are between; lines without words are left out. No
    n-gram with a weight or in a template holds any other word, so these strings tell all that the classifier looks at."""
    words = f"filter(transform({lines}, x -> regexp_extract_all(lower(x), '[a-z0-9]+', 0)), w -> size(w) > 0)"
    return f"transform({words}, w -> array_join(transform(w, x -> if(x in ({_words()}), x, '')), ' '))"


def _piece(known: str) -> str:
    return f"trim(regexp_replace({known}, ' {{3,}}', '  '))"


def _grams(piece: str) -> Column:
    """The distinct n-grams of a string of known words."""
    runs = [f"transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> array_join(slice(w, i, {n}), ' '))" for n in (1, 2, 3)]
    return F.expr(f"array_distinct(flatten(transform(split({piece}, '  '), r -> flatten(transform(array(split(r, ' ')), w -> concat({', '.join(runs)}))))))")


def _judged(pieces: DataFrame) -> DataFrame:
    """pieces (piece: known words, distinct). Adds family, probability and overlap, see classify(). All that is grouped and joined is dealt
    by piece once."""
    weights, templates = _tables(pieces.sparkSession)
    _, bias, heat = model()
    pieces = pieces.repartition("piece")
    grams = pieces.select("piece", F.explode(_grams("piece")).alias("gram"))
    # The weights and the templates are bounded by GRAMS_AT_MOST and TEMPLATES.
    sums = grams.join(F.broadcast(weights), "gram").groupBy("piece").agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))])
    rows = pieces.join(sums.hint("merge"), "piece", "left")
    logits = F.array(*[(F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + bias[k]) / heat for k in range(len(FAMILIES))])
    rows = rows.select("piece", logits.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names = F.array(*map(F.lit, FAMILIES))
    rows = stage(rows.select("piece", F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("family"), (1 / total).alias("probability")), "scores")
    # Only families have templates.
    likely = rows.where(F.col("family") != UNKNOWN).select("piece", "family", F.explode(_grams("piece")).alias("gram"))
    found = likely.join(F.broadcast(templates), ["gram", "family"]).groupBy("piece", "template").agg((F.count("*") / F.first("size")).alias("share"))
    found = found.groupBy("piece").agg(F.max("share").alias("overlap"))
    rows = rows.join(found, "piece", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= SURE) & (F.col("overlap") >= OVERLAP)
    return rows.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))


def classify(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (paragraph, distinct). Adds family, probability (calibrated) and overlap (the largest share of one of the family's
    templates found in the paragraph, in word n-grams). family is `unknown` where that is the likeliest class, where no family reaches
    SURE, or where no template of the family reaches OVERLAP."""
    known = f"array_join({_known('array(paragraph)')}, ' ')"
    rows = paragraphs.select("paragraph", F.expr(_piece(known)).alias("piece"))
    return rows.join(_judged(rows.select("piece").distinct()), "piece").drop("piece")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, n, paragraph): the paragraphs of whole texts, which are runs of lines that hold more than marks; numbered from 0 within
    the text, trimmed. Those without letters and digits are none."""
    text = "regexp_replace(text, '\\\\r\\\\n?', '\n')"
    parts = F.expr(f"filter(transform(split({text}, '\\\\n(?:[^\\\\p{{L}}\\\\p{{N}}\\\\n]*\\\\n)+'), (p, i) -> named_struct('n', i, 'paragraph', trim(BOTH ' \t\n' FROM p))), x -> rlike(x.paragraph, '[\\\\p{{L}}\\\\p{{N}}]'))")
    return docs.select("doc_id", F.inline(parts))


def _read(docs: DataFrame) -> DataFrame:
    """The paragraphs, and of each: anchored (it holds one of ANCHORS), named (families that SPDX lines name) and pieces (known words of
    the whole, in which notices may run over lines, and of each line, which may be a notice by itself; distinct)."""
    rows = paragraphs(docs).withColumn("lines", F.expr(_known("split(paragraph, '\n')")))
    pieces = F.expr(f"array_distinct(transform(concat(array(array_join(lines, ' ')), lines), x -> {_piece('x')}))")
    names = "flatten(transform(regexp_extract_all(lower(paragraph), 'spdx-license-identifier:([^\n]*)', 1), x -> regexp_extract_all(x, '[a-z0-9.+-]+', 0)))"
    family = " ".join(f"when rlike(x, '^{p}$') then '{k}'" for k, p in SPDX.items())
    named = F.expr(f"filter(transform({names}, x -> case {family} end), x -> x is not null)")
    return rows.select("doc_id", "n", "paragraph", F.col("paragraph").rlike(f"(?i){ANCHORS}").alias("anchored"), named.alias("named"), pieces.alias("pieces"))


def _verdicts(found: DataFrame) -> DataFrame:
    """found, as _read() gives it: its columns and family, probability, overlap and families, see scan()."""
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    pieces = found.select("row", F.explode("pieces").alias("piece"))
    judged = stage(_judged(pieces.select("piece").distinct()), "families")
    certain = F.lit(1.0)
    named = found.select("row", F.explode("named").alias("family"), certain.alias("probability"), certain.alias("overlap"))
    # Both grow with the documents, so neither is broadcast, whatever the sizes guessed.
    each = pieces.join(judged.hint("merge"), "piece").select("row", "family", "probability", "overlap").unionByName(named)
    ok = F.col("family") != UNKNOWN
    order = F.struct(ok.cast("int"), "probability", "overlap", "family")
    each = each.groupBy("row").agg(F.max(order).alias("top"), F.array_sort(F.collect_set(F.when(ok, F.col("family")))).alias("families"))
    return found.drop("named", "pieces").join(each.hint("merge"), "row").select(*[c for c in found.columns if c not in ("named", "pieces", "row")], "top.family", "top.probability", "top.overlap", "families")


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, …). Returns (doc_id, n, paragraph, anchored, family, probability, overlap, families): a row for each paragraph.
    anchored: whether it holds one of ANCHORS. families: those confirmed (sorted) in the paragraph as a whole, in its lines, or named by SPDX
    lines; family: the likeliest of these, else `unknown`; probability and overlap belong to it, and of equally likely ones the greatest
    name. All paragraphs and lines are judged, those alike in all known words once. Null and empty texts have none; texts are read whole, and a
    paragraph may be as long as its text; repeated rows give repeated paragraphs; an empty table gives an empty result; other columns
    aren't looked at."""
    return _verdicts(_read(docs))


def by_document(docs: DataFrame) -> DataFrame:
    """A row for each doc_id of docs: doc_id, n_paragraphs (with an anchor or confirmed), n_confirmed, families (sorted, joined by commas; empty
    if none is confirmed), probability (the least of the confirmed; null if none), n_judged (all paragraphs). Rows that share a doc_id count
    together, null doc_ids too; texts without letters and digits have no paragraphs; an empty table gives an empty result."""
    ok = F.col("family") != UNKNOWN
    each = _verdicts(_read(docs).drop("paragraph")).groupBy("doc_id").agg(
        F.count_if(F.col("anchored") | ok).alias("n_paragraphs"),
        F.count_if(ok).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"),
        F.min(F.when(ok, F.col("probability"))).alias("probability"),
        F.count("*").alias("n_judged"),
    )
    ids = docs.select("doc_id").distinct()
    rows = ids.join(each.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_paragraphs", "n_confirmed")], F.coalesce("families", F.lit("")).alias("families"), "probability", F.coalesce("n_judged", F.lit(0)).alias("n_judged"))
