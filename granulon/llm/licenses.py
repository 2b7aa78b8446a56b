"""Licence scan: TF-IDF cosine of notices to templates, then inheritance down directories; DataFrame expressions only.

A text is cut into units: the sentences of each line; the sentences of each paragraph, whose lines are
joined, since headers are wrapped; and each whole paragraph. Paragraphs are parted by lines without a
letter or digit, and comment marks are no words, so a header in comments reads like any other. Units are
compared with the templates (titles, headers and telling clauses of licences) as sparse vectors of words;
a word's weight is its count times its inverse document frequency over all texts of the table. A unit
has the licence of its most similar template, if that is similar enough and no template of another
licence is as good within MARGIN. Such near ones are told apart by the words that only one of them
has: the unit must have all of the better one's and not all of the other's, so "GNU General Public
License" is neither version 2 nor 3. A text has the licence of its best unit. Clauses that licences of a family share count only where the text has no telling one.
An SPDX tag is taken at its word.

Licence files (by their name, or because long notices make up nearly all of their words) give their
licence to their directory, and a text without a licence of its own has the one of the nearest directory
above it that has one.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import cut, join_hot

#: Least cosine of a notice to its template; how much better it must be than to another licence's; share of words in notices that makes a text a licence file.
LEAST, MARGIN, FILE_SHARE = 0.5, 0.02, 0.8
#: Words in different notices that a licence file without a licence file's name has at least: more than a notice of one line.
FILE_WORDS = 25
#: Words of a unit at most in the SQL, which leaves longer ones out; the operator compares units of any length.
LONGEST = 400

# Titles, headers and clauses by which licences are stated, by SPDX id. True: shared with others of the family.
TEMPLATES = (
    ("MIT", "released under the mit license", False),
    ("MIT", "the mit license mit", False),
    ("MIT", "licensed under the mit license see license file in the project root", False),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", False),
    ("Apache-2.0", "licensed under the apache license version 2.0", False),
    ("Apache-2.0", "apache license version 2.0 january 2004", False),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", False),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3", False),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", False),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", False),
    ("GPL-2.0", "this program is licensed under the gnu general public license version 2", False),
    ("GPL-2.0", "gnu general public license version 2 june 1991", False),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", False),
    ("GPL-1.0", "gnu general public license version 1 february 1989", False),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3", False),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", False),
    ("LGPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", False),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1", False),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999", False),
    ("LGPL-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", False),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991", False),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3", False),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", False),
    ("AGPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", False),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license", False),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", False),
    ("BSD-2-Clause", "licensed under the bsd 2 clause simplified license", False),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", True),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", False),
    ("MPL-2.0", "mozilla public license version 2.0", False),
    ("MPL-1.1", "mozilla public license version 1.1", False),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", False),
    ("EPL-2.0", "eclipse public license v 2.0", False),
    ("GFDL-1.3", "gnu free documentation license version 1.3 3 november 2008", False),
    ("Artistic-1.0", "the artistic license preamble", False),
    ("Artistic-2.0", "the artistic license 2.0", False),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4.0 international license cc by 4.0", False),
    ("CC-BY-4.0", "licensed under cc by 4.0", False),
    ("CC-BY-4.0", "creative commons attribution 4.0 international public license", False),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0", False),
    ("CC-BY-SA-4.0", "licensed under a creative commons attribution sharealike 4.0 international license", False),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0", False),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution noncommercial 4.0 international license", False),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal", False),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal", False),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", False),
    ("ISC", "licensed under the isc license", False),
    ("0BSD", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
    ("Unlicense", "this is free and unencumbered software released into the public domain", False),
)
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)[^/]*$"
SPDX = r"SPDX-License-Identifier:[ \t]*([0-9A-Za-z.+-]+(?: (?:OR|AND|WITH) [0-9A-Za-z.+-]+)?)"
# What parts no words, sentences or paragraphs; where paragraphs and sentences end.
_DROPPED, _PARAGRAPH, _SENTENCE = r"[^\p{L}\p{N}.!?;\n]+", r"\n[^\p{L}\p{N}]*\n", r"(?<=[.!?;]) +(?=\p{Lu})"
_NO_WORD = r"[^\p{L}\p{N}.]+|\.(?![\p{N}])|(?<![\p{N}])\."


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case words; a point within a number belongs to it."""
    return F.filter(F.split(F.lower(text), _NO_WORD), lambda w: w != "")


def _template_words(notice: str) -> list[str]:
    return [w for w in re.split(r"[^\w.]+", notice.lower()) if w]


def frequencies(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of texts, and of those with each word of the templates; a row for each word reaches the driver."""
    vocabulary = sorted({w for _, notice, _ in templates for w in _template_words(notice)})
    found = F.array_intersect(words(F.coalesce(F.col(text_col), F.lit(""))), F.array(*map(F.lit, vocabulary)))
    rows = df.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()
    counts = {r[0]: r[1] for r in rows}
    return counts.pop("", 0), counts


def _weights(n: int, counts: dict[str, int], templates) -> tuple[float, str, str]:
    """IDF of an unknown word; as JSON the IDF of the known ones, and the templates as unit vectors."""
    idf = lambda w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1
    vocabulary = {w: idf(w) for _, notice, _ in templates for w in _template_words(notice)}
    out = []
    for name, notice, shared in templates:
        own = _template_words(notice)
        vector = {w: own.count(w) * vocabulary[w] for w in own}
        size = math.sqrt(sum(x * x for x in vector.values()))
        out.append({"id": name, "shared": shared, "own": sorted(set(own)), "w": {w: x / size for w, x in vector.items()}})
    return math.log(1 + n) + 1, json.dumps(vocabulary), json.dumps(out)


def _needed(vectors: list[dict[str, float]], idf: dict[str, float], least: float) -> list[str]:
    """Words of which a unit has at least one if its cosine to any of these unit vectors is `least` or more.

    A cosine is at most the length of the template's part that the unit shares. So a template's most
    frequent words, as long as they are shorter than `least` together, are not enough.
    """
    out = set()
    for vector in vectors:
        common = 0.0
        for w, x in sorted(vector.items(), key=lambda e: (idf[e[0]], e[1], e[0])):
            common += x * x
            if common >= (least - 1e-6) ** 2:
                out.add(w)
    return sorted(out)


def _best(unit: Column, unknown: float, idf: Column, templates: Column, needed: Column, least: float) -> Column:
    """struct(shared, score (negative), id, unit, n_words) of a unit's licence; null without one, or where two are too near."""

    def compare(own: Column) -> Column:
        weight = lambda w: F.coalesce(F.try_element_at(idf, w), F.lit(unknown))

        def vector(ordered: Column) -> Column:
            # Equal words stand together, so a word's count is from its first place to the next word's: no word is compared with all.
            firsts = F.filter(F.transform(ordered, lambda w, i: F.when((i == 0) | (F.get(ordered, i - 1) != w), i)), lambda i: i.isNotNull())
            counted = lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("w"), ((F.coalesce(F.get(at, k + 1), F.size(ordered)) - i) * weight(F.get(ordered, i))).alias("x")))
            return _let(firsts, counted)

        def score(v: Column) -> Column:
            size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + t["x"] * t["x"]))

            def compared(both: Column) -> Column:
                dot = lambda t: F.aggregate(both["known"], F.lit(0.0), lambda s, e: s + e["x"] * F.coalesce(F.try_element_at(t["w"], e["w"]), F.lit(0.0)))
                return F.transform(templates, lambda t: F.struct((-F.round(dot(t) / both["size"], 9)).alias("score"), t["id"].alias("id"), t["shared"].alias("shared"), t["own"].alias("own")))

            # The unit's length once, and only the words that some template has: others add nothing to a product.
            return _let(F.struct(size.alias("size"), F.filter(v, lambda e: F.try_element_at(idf, e["w"]).isNotNull()).alias("known")), compared)

        def choose(each: Column) -> Column:
            def clear(b: Column) -> Column:
                lacks = lambda x, y: F.size(F.array_except(F.array_except(x["own"], y["own"]), own)) > 0
                told = lambda o: (F.coalesce(o["score"], F.lit(0.0)) - b["score"] >= MARGIN) | (~lacks(b, o) & lacks(o, b))
                second = F.array_min(F.filter(each, lambda e: e["id"] != b["id"]))
                return F.when((b["score"] <= -least) & _let(second, told), F.struct(b["shared"].alias("shared"), b["score"].alias("score"), b["id"].alias("id"), unit.alias("unit"), F.size(own).alias("n_words")))

            return _let(F.array_min(each), clear)

        return F.when(F.arrays_overlap(own, needed), _let(_let(_let(F.sort_array(own), vector), score), choose))

    return _let(words(unit), compare)


def _units(text: Column) -> tuple[Column, Column]:
    """The sentences of the paragraphs; and the paragraphs and the sentences of the lines, where these are others."""
    cut_ = lambda part: F.split(part, _SENTENCE)
    paragraphs = F.transform(F.split(text, _PARAGRAPH), lambda p: F.translate(p, "\n", " "))
    sentences = F.flatten(F.transform(paragraphs, cut_))
    return sentences, F.array_except(F.concat(paragraphs, F.flatten(F.transform(F.split(text, "\n"), cut_))), sentences)


def own_licences(df: DataFrame, text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """df with _license, _score, _share (of the words in notices) and _long (words in different notices); no shuffle besides the words' counts."""
    n, counts = frequencies(df, text_col, templates)
    unknown, idf, vectors = _weights(n, counts, templates)
    idf_map = F.from_json(F.lit(idf), "map<string,double>")
    vector_list = F.from_json(F.lit(vectors), "array<struct<id:string,shared:boolean,own:array<string>,w:map<string,double>>>")
    text = F.col(text_col)
    needed = F.array(*map(F.lit, _needed([t["w"] for t in json.loads(vectors)], json.loads(idf), least))).cast("array<string>")
    found = lambda units: F.filter(F.transform(units, lambda s: _best(s, unknown, idf_map, vector_list, needed, least)), lambda b: b.isNotNull())

    def scored(plain: Column) -> Column:
        sentences, others = _units(plain)
        return F.struct(found(sentences).alias("s"), found(others).alias("o"))

    def summary(f: Column) -> Column:
        top = F.array_min(F.concat(f["s"], f["o"]))
        covered = lambda all_: F.aggregate(all_, F.lit(0), lambda s, b: s + b["n_words"])
        share = covered(f["s"]) / F.size(words(text))
        return F.when(top.isNotNull(), F.struct(top["id"].alias("id"), (-top["score"]).alias("score"), share.alias("share"), covered(F.array_distinct(f["s"])).alias("long")))

    out = df.withColumn("_l", F.when(F.arrays_overlap(words(text), needed), _let(_let(F.regexp_replace(text, _DROPPED, " "), scored), summary)))
    out = out.withColumn("_tag", F.when(text.contains("SPDX-License-Identifier:"), F.regexp_extract(text, SPDX, 1)))
    tagged = F.coalesce(F.col("_tag"), F.lit("")) != ""
    return out.withColumns({
        "_license": F.when(tagged, F.col("_tag")).otherwise(F.col("_l.id")), "_score": F.when(tagged, 1.0).otherwise(F.col("_l.score")),
        "_share": F.coalesce(F.col("_l.share"), F.lit(0.0)), "_long": F.coalesce(F.col("_l.long"), F.lit(0)),
    }).drop("_l", "_tag")


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, path, license, score, origin, origin_dir) of each row.

    origin is own or inherited, and origin_dir the directory inherited from; all null without a licence.
    Null texts count as empty; a null path counts as a file in the top directory "", which is above all
    others; of several licence files of a directory the most similar one holds, then the first by licence
    id; repeated rows stay repeated; an empty table gives an empty table; other columns are left out.
    Texts are read twice: for the words' frequencies, and to be compared; what was found is kept aside.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(path, F.lit("")).alias("_path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    whole = (F.col("_share") >= FILE_SHARE) & (F.col("_long") >= FILE_WORDS)
    own = own_licences(rows, "_text", templates).select(
        "_id", "_path", "_license", "_score", F.regexp_replace(F.regexp_replace("_path", "[^/]*$", ""), "/+$", "").alias("_dir"),
        (F.col("_license").isNotNull() & (F.col("_path").rlike(FILE_NAME) | whole)).alias("_gives"),
    )
    own = cut(own)
    given = own.where("_gives").groupBy("_dir").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_license").alias("l"))).alias("g")).select(F.col("_dir").alias("_above"), F.col("g.l").alias("_given"), (-F.col("g.s")).alias("_given_score"))
    # Each directory once: itself and all above it, from which the longest with a licence is the nearest.
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = own.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_above"))
    nearest = join_hot(dirs, given, "_above", "inner").groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("n"), F.col("_above").alias("a"), F.col("_given").alias("l"), F.col("_given_score").alias("s"))).alias("i"))
    joined = join_hot(own, nearest, "_dir", "left")
    has = F.col("_license").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col), F.col("_path").alias("path"), F.coalesce("_license", "i.l").alias("license"), F.coalesce("_score", "i.s").alias("score"),
        F.when(has, "own").when(F.col("i.l").isNotNull(), "inherited").alias("origin"), F.when(~has, F.col("i.a")).alias("origin_dir"),
    )


def oracle_sql(path: str, templates=TEMPLATES) -> str:
    """scan() over the table documents in DuckDB; path: an expression of its columns."""
    different = lambda notice: sorted(set(_template_words(notice)))
    rows = ", ".join(f"({k}, '{name}', {shared}, CAST({different(notice)} AS VARCHAR[]), '{notice}')" for k, (name, notice, shared) in enumerate(templates))
    # A point between digits is held by a mark while other points part words.
    plain = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(\p{{N}})\.(\p{{N}})', concat('\1', chr(57344), '\2'), 'g'), '(\p{{N}})\.(\p{{N}})', concat('\1', chr(57344), '\2'), 'g'), concat('[^\p{{L}}\p{{N}}', chr(57344), ']+'), ' ', 'g'))"
    words = lambda x: f"CASE WHEN {plain.format(x)} = '' THEN [] ELSE string_split(replace({plain.format(x)}, chr(57344), '.'), ' ') END"
    sentences = lambda x: rf"string_split(regexp_replace({x}, '([.!?;]) +(\p{{Lu}})', concat('\1', chr(10), '\2'), 'g'), chr(10))"
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(k, id, shared, words, notice)), tw AS (SELECT k, id, shared, words, w, count(*) AS tf FROM (SELECT k, id, shared, words, unnest(string_split(notice, ' ')) AS w FROM t) GROUP BY ALL),
  d AS (SELECT doc_id, path, regexp_replace(regexp_replace(path, '[^/]*$', ''), '/+$', '') AS dir, text, {words('text')} AS ws FROM (SELECT doc_id, COALESCE({path}, '') AS path, COALESCE(text, '') AS text FROM documents)),
  n AS (SELECT count(*) AS n FROM d),
  f AS (SELECT w, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ws)) AS w FROM d) WHERE w IN (SELECT w FROM tw) GROUP BY 1),
  idf AS (SELECT v.w, ln((1 + n) / (1 + COALESCE(df, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) v CROSS JOIN n LEFT JOIN f ON v.w = f.w),
  tv AS (SELECT k, id, shared, words, w, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM (SELECT k, id, shared, words, tw.w, tf * idf AS x FROM tw JOIN idf ON tw.w = idf.w)),
  p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^\p{{L}}\p{{N}}.!?;\n]+', ' ', 'g'), '\n[^\p{{L}}\p{{N}}]*\n')) AS p FROM d),
  u AS (SELECT doc_id, unnest({sentences("replace(p, chr(10), ' ')")}) AS u, true AS sentence FROM p
    UNION ALL SELECT doc_id, replace(p, chr(10), ' '), false FROM p UNION ALL SELECT doc_id, unnest({sentences('p')}), false FROM p),
  c AS (SELECT doc_id, u, {words('u')} AS ws, count(*) FILTER (sentence) AS often FROM u GROUP BY ALL),
  cw AS (SELECT doc_id, u, often, own, n_words, w, count(*) AS tf FROM (SELECT doc_id, u, often, list_distinct(ws) AS own, len(ws) AS n_words, unnest(ws) AS w FROM c WHERE len(ws) <= {LONGEST}) GROUP BY ALL),
  cv AS (SELECT doc_id, u, often, own, n_words, cw.w, tf * COALESCE(idf, ln(1 + n) + 1) AS x FROM cw CROSS JOIN n LEFT JOIN idf ON cw.w = idf.w),
  dots AS (SELECT doc_id, u, k, id, shared, words, sum(cv.x * tv.x) AS dot FROM cv JOIN tv ON cv.w = tv.w GROUP BY ALL),
  sizes AS (SELECT doc_id, u, often, own, n_words, sqrt(sum(x * x)) AS size FROM cv GROUP BY ALL),
  each AS (SELECT doc_id, u, often, own, n_words, id, min(struct_pack(score := -round(dot / size, 9), shared := shared, words := words)) AS s FROM dots JOIN sizes USING (doc_id, u) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER o AS r, lead(s) OVER o AS other FROM each WINDOW o AS (PARTITION BY doc_id, u ORDER BY s.score, id)),
  best AS (SELECT * FROM ranked WHERE r = 1 AND s.score <= -{LEAST} AND (COALESCE(other.score, 0) - s.score >= {MARGIN} OR (list_has_all(own, list_filter(s.words, lambda x: NOT list_contains(other.words, x))) AND NOT list_has_all(own, list_filter(other.words, lambda x: NOT list_contains(s.words, x)))))),
  own AS (SELECT doc_id, min(struct_pack(shared := s.shared, score := s.score, id := id)) AS b, sum(n_words * often) AS covered, sum(n_words) FILTER (often > 0) AS long FROM best GROUP BY 1),
  tags AS (SELECT doc_id, regexp_extract(text, '{SPDX}', 1) AS tag FROM d),
  j AS (SELECT d.doc_id, dir, path, CASE WHEN tag <> '' THEN tag ELSE b.id END AS license, CASE WHEN tag <> '' THEN 1.0 ELSE -b.score END AS score, COALESCE(covered / len(ws), 0) AS share, COALESCE(long, 0) AS long
    FROM d JOIN tags ON d.doc_id = tags.doc_id LEFT JOIN own ON d.doc_id = own.doc_id),
  given AS (SELECT dir, min(struct_pack(s := -score, l := license)) AS g FROM j WHERE license IS NOT NULL AND (regexp_matches(path, '{FILE_NAME}') OR (share >= {FILE_SHARE} AND long >= {FILE_WORDS})) GROUP BY 1),
  nearest AS (SELECT j.dir, arg_max(struct_pack(a := given.dir, l := g.l, s := -g.s), length(given.dir)) AS i FROM (SELECT DISTINCT dir FROM j) j JOIN given ON given.dir = '' OR j.dir = given.dir OR starts_with(j.dir, concat(given.dir, '/')) GROUP BY 1)
SELECT doc_id, path, COALESCE(license, i.l) AS license, COALESCE(score, i.s) AS score, CASE WHEN license IS NOT NULL THEN 'own' WHEN i.l IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN license IS NULL THEN i.a END AS origin_dir FROM j LEFT JOIN nearest ON j.dir = nearest.dir
"""
