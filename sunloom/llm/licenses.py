"""Licence scans with a positional index of rare words (operator 10, DataFrame functions only).

Each template has postings of its own words of highest inverse document frequency, and a file looks up all words that
have postings, however many licences it holds. Places that agree on the template's relative position are added up. A
template counts if enough of its rare words agree and its mandatory key phrase stands at that position. Base phrases and
key phrases have postings of all their words; a phrase stands where every one of them agrees, so its places are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import keep, table, words

#: Phrase -> label; every place counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, template, mandatory key phrase), all in lower-case words: short notices, then grants of full licence texts.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
]
#: Words of a template that have postings, rarest first, and the share of their rarity that must agree.
LOOKUPS, SHARE = 24, 0.6


def vocabulary() -> list[str]:
    return sorted({w for _, t, k in TEMPLATES for w in f"{t} {k}".split()} | {w for p in BASE for w in p.split()})


def idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every licence word, over all documents; a few hundred words at most."""
    own = docs.select(F.explode_outer(F.concat(F.array_intersect(F.lit(vocabulary()), words(F.col("text"))), F.array(F.lit("")))).alias("w"))  # "" counts the documents
    n = {r["w"]: r["n"] for r in own.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary()}


def _postings(weight: dict[str, float]) -> tuple[list[tuple], list[tuple]]:
    """Rows (word, tid, tpos, idf), and rows (tid, kind, label, key, key_at, least): least is the sum that must agree.

    Kinds are base phrases, key phrases and templates. Each word of a phrase weighs 1, so all must agree.
    """
    keys = sorted({k for _, _, k in TEMPLATES})
    post, about = [], []
    for kind, phrases in (("base", list(BASE)), ("key", keys)):
        for p in phrases:
            parts = p.split()
            post += [(w, len(about), at, 1.0) for at, w in enumerate(parts)]
            about.append((len(about), kind, BASE.get(p) if kind == "base" else p, None, 0, float(len(parts)), float(len(parts))))
    for label, t, k in TEMPLATES:
        parts, key = t.split(), k.split()
        top = sorted(set(parts), key=lambda w: (-weight[w], w))[:LOOKUPS]
        own = [(w, len(about), at, weight[w]) for at, w in enumerate(parts) if w in top]
        at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        post += own
        about.append((len(about), "template", label, k, at, sum(x[3] for x in own), SHARE))
    return post, about


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document row: doc_id, n_words, base array<(at, label)>, found array<(label, start, score)>.

    docs has doc_id and text; other columns are neither read nor returned. base has every place (word index from 0) of
    a base phrase, in order; found the templates that the index finds, each at the place where they agree best. A null
    or empty text has none; repeated rows each give a row; rows without a doc_id are told apart by their texts; an empty
    table gives none. Ties between places go to the smaller one. Only files that hold every word of a phrase are looked
    up; that costs time in proportion to their licence words.
    """
    spark, weight = docs.sparkSession, idf(docs)
    post, about = _postings(weight)
    posted = sorted({p[0] for p in post})
    phrases = sorted({*BASE, *(k for _, _, k in TEMPLATES)})
    # No file has a phrase without the phrase's rarest word.
    needed = sorted({min(p.split(), key=lambda w: (-weight[w], w)) for p in phrases})
    index = F.broadcast(spark.createDataFrame(post, "word string, tid int, tpos int, idf double").join(F.broadcast(spark.createDataFrame(about, "tid int, kind string, label string, key string, key_at int, total double, least double")), "tid"))  # the constants above

    w = docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("words")).withColumn("held", F.array_intersect(F.lit(sorted({x for p in phrases for x in p.split()})), F.col("words")))
    possible = F.lit(False)
    for p in phrases:
        possible = possible | (F.size(F.array_except(F.lit(p.split()), F.col("held"))) == 0)
    at = F.array_compact(F.transform("words", lambda x, i: F.when(x.isin(posted), i)))
    looked = F.transform(at, lambda i: F.struct(i.alias("at"), F.get(F.col("words"), i).alias("word")))
    w = w.select(
        "doc_id", "row", F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("held", F.lit(needed)) & possible, looked).otherwise(F.array().cast("array<struct<at:int,word:string>>")).alias("looked"),
    )
    w = keep(w)
    agree = w.where(F.size("looked") > 0).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.inline("looked")).join(index, "word")
    agree = agree.groupBy("doc_id", "row", "tid", "kind", "label", "key", "key_at", "total", "least", (F.col("at") - F.col("tpos")).alias("start")).agg(F.sum("idf").alias("sum"))
    agree = agree.withColumn("score", F.round(F.col("sum") / F.col("total"), 6)).where(F.when(F.col("kind") == "template", F.col("score") >= F.col("least")).otherwise(F.col("sum") == F.col("least")))
    lists = agree.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "base", F.struct(F.col("start").alias("at"), "label")))).alias("base"),
        F.collect_list(F.when(F.col("kind") == "key", F.struct(F.col("label").alias("key"), F.col("start").alias("at")))).alias("keys"),
        F.collect_list(F.when(F.col("kind") == "template", F.struct("label", (-F.col("score")).alias("neg"), "start", "key", "key_at"))).alias("templates"),
    )
    held = F.array_sort(F.filter("templates", lambda t: F.exists("keys", lambda k: (k["key"] == t["key"]) & (k["at"] == t["start"] + t["key_at"]))))
    # Sorted by label, then by falling score and by place: the first of each label is its best.
    best = F.filter(F.col("held"), lambda t, i: (i == 0) | (t["label"] != F.coalesce(F.get(F.col("held"), i - 1)["label"], F.lit(""))))
    found = lists.withColumn("held", held).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "base", F.transform(best, lambda t: F.struct(t["label"].alias("label"), t["start"].alias("start"), (-t["neg"]).alias("score"))).alias("found"))
    out = w.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")), "left")
    return out.select("doc_id", "n_words", F.coalesce("base", F.array().cast("array<struct<at:int,label:string>>")).alias("base"), F.coalesce("found", F.array().cast("array<struct<label:string,start:int,score:double>>")).alias("found"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    n = F.size("base")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        names(F.col("base.label")).alias("base_labels"), names(F.col("base.label"), F.col("found.label")).alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """The same rule over all words and places of all templates, in DuckDB SQL."""
    quoted = lambda x: "'" + x + "'"
    words_of = lambda p: "[" + ", ".join(map(quoted, p.split())) + "]"
    rows = lambda items: ", ".join("(" + ", ".join(x) + ")" for x in items)
    at = lambda t, k: next(i for i in range(len(t.split())) if t.split()[i : i + len(k.split())] == k.split())
    templates = rows([(str(i), quoted(label), words_of(t), words_of(k), str(at(t, k))) for i, (label, t, k) in enumerate(TEMPLATES)])
    base = rows([(quoted(label), words_of(p)) for p, label in BASE.items()])
    split = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents),
t(tid, label, tw, kw, key_at) AS (VALUES {templates}), b(label, bw) AS (VALUES {base}),
x AS (SELECT doc_id, CAST(i AS INT) AS pos, w[i + 1] AS word FROM d, unnest(range(0, len(w))) AS u(i)),
voc AS (SELECT DISTINCT unnest(tw) AS word FROM t UNION SELECT unnest(bw) FROM b),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM x JOIN voc USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM voc LEFT JOIN df USING (word)),
tp AS (SELECT tid, CAST(i AS INT) AS tpos, tw[i + 1] AS word FROM t, unnest(range(0, len(tw))) AS u(i)),
top AS (SELECT tid, word, idf, row_number() OVER (PARTITION BY tid ORDER BY idf DESC, word) AS k FROM (SELECT DISTINCT tid, word FROM tp) JOIN idf USING (word)),
post AS (SELECT tid, tpos, word, idf FROM tp JOIN top USING (tid, word) WHERE k <= {LOOKUPS}),
total AS (SELECT tid, sum(idf) AS total FROM post GROUP BY tid),
phrases AS (SELECT DISTINCT kw AS p FROM t UNION SELECT bw FROM b),
stand AS (SELECT doc_id, pos, p FROM x JOIN phrases ON word = p[1] JOIN d USING (doc_id) WHERE w[pos + 1:pos + len(p)] = p),
agree AS (SELECT doc_id, tid, pos - tpos AS start, sum(idf) AS s FROM x JOIN post USING (word) WHERE doc_id IN (SELECT doc_id FROM stand) GROUP BY ALL),
found AS (SELECT a.doc_id, t.label, round(s / total, 6) AS score FROM agree a JOIN t USING (tid) JOIN total USING (tid)
          JOIN stand ON stand.doc_id = a.doc_id AND p = kw AND pos = start + key_at WHERE round(s / total, 6) >= {SHARE}),
bs AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM stand JOIN b ON p = bw GROUP BY doc_id),
bl AS (SELECT DISTINCT doc_id, label FROM stand JOIN b ON p = bw), fl AS (SELECT DISTINCT doc_id, label FROM found),
bt AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM bl GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT * FROM bl UNION SELECT * FROM fl) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN bt USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP10_SQL = _sql()
