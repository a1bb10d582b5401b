"""License scans: word windows of a text against licence templates by the Dice coefficient of word bigrams.

A window is any run of words of the whole text, across line ends, so a notice is found alone on its line,
within a longer line or paragraph, and wrapped. A window at the threshold t holds at least
m * t / (2 - t) of the m pairs of its template, so each holds one of any m - m * t / (2 - t) + 1 of them:
texts without such a pair are left out by one pattern. Of the rest only windows that begin and end with a
pair of the template are scored, as trimming any other pair raises the coefficient. Templates are the
notices and, beside them, usual headers and beginnings of licence texts.

Units, which `n_matches` counts too, are the lines of a text and the text as a whole. Text is normalised (lower case, everything
but letters and digits is a gap) and a unit's bag of adjacent word pairs is compared with those of
the templates: dice = 2 * common / (pairs of the unit + pairs of the template). A unit of n pairs can
reach a threshold t only with templates of n * t / (2 - t) to n * (2 - t) / t pairs, so units of any
other size are dropped by counting words and the rest meet few templates. Templates are parameters
of bounded number and size, sent to every executor; the work is one pass over the texts.

Edge cases: null, empty and blank texts have no units and no licence; ties go to the template first
by name; repeated lines count each in `n_matches`, as do windows that share no word; rows
of one id are judged each by its text, also those without an id; long texts
are split into lines whole; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.session import local_rows

#: Percent of the Dice coefficient from which a unit counts as a licence.
THRESHOLD = 80
GAP = r"[^\p{L}\p{N}]+"

#: Notices by which texts state their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following two conditions are met",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GNU = ("you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        "Foundation, either version {version} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD2 = _BSD + "THIS SOFTWARE IS PROVIDED BY THE"  # what follows the two conditions, else every third one would fit as well
_BSD3 = _BSD + ("{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                "products derived from this software without specific prior written permission.")
_CC = "Creative Commons {name} {version} International Public License"
#: Usual headers, and passages by which the full texts are known.
TEXTS = (
    ("AGPL-3.0", "This program is free software: " + _GNU.format(name="Affero General Public License", version=3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD2.format("1. ", "2. ")),
    ("BSD-2-Clause", _BSD2.format("", "")),
    ("BSD-3-Clause", _BSD3.format("1. ", "2. ", "3. ")),
    ("BSD-3-Clause", _BSD3.format("", "", "")),
    ("CC-BY-4.0", _CC.format(name="Attribution", version="4.0")),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial", version="4.0")),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike", version="4.0")),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This program is free software; " + _GNU.format(name="General Public License", version=2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: " + _GNU.format(name="General Public License", version=3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: " + _GNU.format(name="Lesser General Public License", version=3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def unit_words(unit: Column) -> Column:
    """Normalised words of a unit."""
    clean = F.trim(F.regexp_replace(F.lower(unit), GAP, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def size_bounds(size: int, threshold: int) -> tuple[int, int]:
    """Sizes of sets that can reach `threshold` percent with one of `size`."""
    return -(-size * threshold // (200 - threshold)), size * (200 - threshold) // threshold


def units_of(text: Column) -> Column:
    """Lines, and the whole text where it has several."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)


def hint(known: list, threshold: int) -> str:
    """A pattern that every text with a window at the threshold matches (in lower case): of each template so many
    pairs, longest first, that a window without them holds too few."""
    needed = {}
    for _, pairs in known:
        spare = len(pairs) - max(1, size_bounds(len(pairs), threshold)[0])
        for pair in sorted({p.rsplit("#", 1)[0] for p in pairs}, key=lambda p: (-len(p), p)):
            first, second = pair.split(" ")
            needed.setdefault(re.escape(first), set()).add(re.escape(second))
            spare -= sum(p.rsplit("#", 1)[0] == pair for p in pairs)
            if spare < 0:
                break
    fits = "|".join(f"{a}{GAP}(?:{'|'.join(sorted(b))})" for a, b in sorted(needed.items()))
    return f"(?<![a-z0-9])(?:{fits})" if needed else r"(?!)"


def template_bigrams(text: str) -> list[str]:
    """Adjacent word pairs, numbered where one recurs."""
    found = re.sub(r"[^\w]|_", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(found, found[1:])]
    return [f"{p}#{pairs[:i].count(p)}" for i, p in enumerate(pairs)]


def unit_bigrams(pairs: Column) -> Column:
    """Numbered pairs of a unit (few, as units are sized before)."""
    return F.transform(pairs, lambda p, i: F.concat_ws("#", p, F.size(F.filter(
        F.slice(pairs, 1, i), lambda q: q == p))))


def candidates(spark: SparkSession, templates: dict, threshold: int) -> DataFrame:
    """`size, license, pairs`: each template under every size of a unit that can reach it."""
    rows = []
    for name, text in templates.items():
        if pairs := template_bigrams(text):
            least, most = size_bounds(len(pairs), threshold)
            rows += [(n, name, pairs) for n in range(max(1, least), most + 1)]
    if sum(len(r[2]) for r in rows) > 1_000_000:
        raise ValueError("the templates are too many to be sent to every executor")
    return local_rows(spark, rows, "size int, license string, pairs array<string>")


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None,
            threshold: int = THRESHOLD) -> DataFrame:
    """`key, unit_no, unit, license, dice` for every unit and template at or above the threshold."""
    known = candidates(docs.sparkSession, TEMPLATES if templates is None else templates, threshold)
    low, high = known.agg(F.min("size"), F.max("size")).first()
    low, high = low or 1, high or 0
    units = docs.filter(F.col(text).isNotNull()).select(F.col(key), F.posexplode(units_of(F.col(text))).alias("unit_no", "unit"))
    # a split with a limit stops early, so a long unit is not normalised
    short = units.filter(F.size(F.split("unit", GAP, high + 4)).between(low + 1, high + 3))
    worded = short.select(key, "unit_no", "unit", unit_words(F.col("unit")).alias("_w"))
    paired = worded.select(key, "unit_no", "unit", (F.size("_w") - 1).alias("size"), F.transform(
        F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda x, i: F.concat_ws(" ", F.get("_w", i), x)).alias("_q"))
    met = paired.join(F.broadcast(known), "size")
    common = F.size(F.array_intersect(unit_bigrams(F.col("_q")), F.col("pairs")))
    total = F.col("size") + F.size("pairs")
    scored = met.select(key, "unit_no", "unit", "license", common.alias("_c"), total.alias("_t"))
    return scored.filter(200 * F.col("_c") >= threshold * F.col("_t")).select(
        key, "unit_no", "unit", "license", ((2 * F.col("_c")).cast("double") / F.col("_t")).alias("dice"))


def _let(value: Column, body) -> Column:
    """`body` (an array) of a value that is computed once."""
    return F.flatten(F.transform(F.array(value), body))


def windows_of(words: Column, known: list, threshold: int) -> Column:
    """Array of (start, end, license, dice): for each template and each of its pairs in the text, the best window from
    there on, if it is at the threshold. Places are those of the first and last pair."""
    rows = []
    for name, pairs in known:
        least, most = size_bounds(len(pairs), threshold)
        rows.append({"license": name, "m": len(pairs), "least": max(1, least), "most": most, "pairs": pairs})
    templates = F.from_json(F.lit(json.dumps(rows)), "array<struct<license:string,m:int,least:int,most:int,pairs:array<string>>>")
    vocabulary = sorted({p.rsplit("#", 1)[0] for _, pairs in known for p in pairs})

    def pairs_of(w: Column) -> Column:
        return F.filter(F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.struct(
            i.alias("at"), F.concat_ws(" ", F.get(w, i), x).alias("p"))), lambda h: h["p"].isin(vocabulary))

    def best(t: Column, own: Column, i: Column) -> Column:
        first = F.get(own, i)["at"]

        def score(near: Column) -> Column:
            counted = F.transform(near, lambda h, j: F.struct(h["at"].alias("at"), F.array_contains(t["pairs"], F.concat_ws(
                "#", h["p"], F.size(F.filter(F.slice(near, 1, j), lambda q: q["p"] == h["p"])))).cast("int").alias("c")))

            def step(acc: Column, h: Column) -> Column:
                c, total = acc["c"] + h["c"], h["at"] - first + 1 + t["m"]
                dice = (2 * c).cast("double") / total
                better = (200 * c >= threshold * total) & (dice > acc["dice"])
                return F.struct(c.alias("c"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
                                F.when(better, h["at"]).otherwise(acc["end"]).alias("end"))

            start = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))
            return F.array(F.aggregate(counted, start, step, lambda acc: F.struct(
                first.alias("start"), acc["end"].alias("end"), t["license"].alias("license"), acc["dice"].alias("dice"))))

        return _let(F.filter(F.slice(own, i + 1, t["most"]), lambda h: h["at"] < first + t["most"]), score)

    def of_template(t: Column, own: Column) -> Column:
        starts = F.when(F.size(own) >= t["least"], F.sequence(F.lit(0), F.size(own) - t["least"])).otherwise(
            F.array().cast("array<int>"))
        dense = F.filter(starts, lambda i: F.get(own, i + t["least"] - 1)["at"] - F.get(own, i)["at"] < t["most"])
        return F.filter(F.flatten(F.transform(dense, lambda i: best(t, own, i))), lambda x: x["end"] >= 0)

    return _let(_let(words, pairs_of), lambda found: F.flatten(F.transform(templates, lambda t: _let(
        F.filter(found, lambda h: F.array_contains(t["pairs"], F.concat(h["p"], F.lit("#0")))),
        lambda own: of_template(t, own)))))


def apart(found: Column) -> Column:
    """How many windows share no word, the better of two that do."""
    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] > acc["end"] + 1
        taken = fresh | (x["dice"] > acc["dice"])
        return F.struct(F.when(taken, x["end"]).otherwise(acc["end"]).alias("end"),
                        F.when(taken, x["dice"]).otherwise(acc["dice"]).alias("dice"),
                        (acc["n"] + fresh.cast("int")).alias("n"))

    start = F.struct(F.lit(-2).alias("end"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(found), start, step, lambda acc: acc["n"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None,
         threshold: int = THRESHOLD) -> DataFrame:
    """`key, license, dice, n_matches`: per document the licence of its best window (null if none), its
    coefficient, and how many windows apart, or units if these are more, match any template."""
    texts = [*TEMPLATES.items(), *TEXTS] if templates is None else list(templates.items())
    known = [(name, pairs) for name, body in texts if (pairs := template_bigrams(body))]
    # a unit at the threshold holds a window at the threshold, so no unit is lost
    own = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))  # rows of one id and text are alike
    texts_ = docs.select(own.alias("_own"), F.col(text).alias("_text"))
    likely = texts_.filter(F.lower("_text").rlike(hint(known, threshold)))
    # no filter on the windows: it would be moved below and score them once more
    windows = likely.select("_own", windows_of(unit_words(F.col("_text")), known, threshold).alias("_f"))
    top = F.array_min(F.transform("_f", lambda x: F.struct((-x["dice"]).alias("order"), x["license"].alias("license"),
                                                          x["dice"].alias("dice"))))
    none = F.lit(None)
    rows = windows.select("_own", top.alias("b"), apart(F.col("_f")).alias("w"), none.cast("int").alias("unit_no"))
    units = matches(likely, "_own", "_text", templates, threshold).select(
        "_own", none.cast("struct<order:double,license:string,dice:double>").alias("b"), none.cast("int").alias("w"), "unit_no")
    best = rows.unionByName(units).groupBy(F.col("_own").alias("_mine")).agg(
        F.min("b").alias("b"), F.greatest(F.max("w"), F.count_distinct("unit_no")).alias("n"))
    return texts_.select("_own").join(best, F.col("_own").eqNullSafe(F.col("_mine")), "left").select(
        F.col("_own.key").alias(key), F.col("b.license").alias("license"), F.col("b.dice").alias("dice"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"))


_UNITS = """
l AS (SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text)
                                 ELSE [text] END) AS unit FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(lower(unit), '[\\p{L}\\p{N}]+') AS w, row_number() OVER () AS u FROM l),
b AS (SELECT doc_id, u, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS pair
      FROM w, unnest(range(1, len(w))) AS r(i) WHERE len(w) BETWEEN 2 AND 200),
c AS (SELECT doc_id, u, n, pair, count(*) AS k FROM b GROUP BY ALL)"""
_KNOWN = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
SQL = f"""WITH {_UNITS.strip()},
t AS (SELECT license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {_KNOWN}) AS v(license, body)),
tb AS (SELECT license, len(w) - 1 AS m, w[i] || ' ' || w[i + 1] AS pair FROM t, unnest(range(1, len(w))) AS r(i)),
tc AS (SELECT license, m, pair, count(*) AS k FROM tb GROUP BY ALL),
s AS (SELECT doc_id, u, license, 2 * sum(least(c.k, tc.k))::DOUBLE / (n + m) AS dice
      FROM c JOIN tc USING (pair) GROUP BY doc_id, u, license, n, m HAVING 200 * sum(least(c.k, tc.k)) >= {THRESHOLD} * (n + m)),
best AS (SELECT doc_id, u, license, dice FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, license) = 1),
d AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n FROM best GROUP BY doc_id)
SELECT documents.doc_id, license, dice, coalesce(n, 0)::BIGINT AS n_matches FROM documents LEFT JOIN d USING (doc_id)"""
