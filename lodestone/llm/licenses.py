"""License scans by diagonal voting, with DataFrame operations only.

All rolling word 3-grams of the documents are joined by hash (and then word by word) to the places of the licence
templates; votes are counted by diagonal (place in the document less place in the template), neighbouring diagonals are
merged (at most NEAR apart, or a quarter of the template's words, so that words put into a text do not part it), and a merged
span is verified by the part of the template's 3-grams that it holds and by its length.

Null or empty text: no words, no labels, score 0. Repeated rows get the same row each. A null id is scanned like any
other. A very long text is one row as any other. An empty table gives an empty result. Only doc_id
and text are read, so other columns may have any names. The templates are a fixed list, so the broadcast has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.text import NULL_ID

#: Phrase and label of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label and words of each template, as in public licence texts and their usual notices.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("apache-2.0-text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("lgpl-text", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-text", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("cc-by-nc-4.0-notice", "licensed under cc by nc 4 0"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
]

#: A merged span is a match with this part of the template's 3-grams, over at most so many times its words.
MIN_COVERAGE, MAX_STRETCH, NEAR = 0.6, 2, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The words of the text, lower-cased in A-Z, joined by one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def base(docs: DataFrame) -> DataFrame:
    """For each row: n_words, and the places where a phrase of the base stands."""
    pattern = f" ({'|'.join(PHRASES)})(?= )"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64("text").alias("k_th"), F.concat(F.lit(" "), normal(F.col("text")), F.lit(" ")).alias("p"))
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    rows = rows.withColumn("n_base", F.regexp_count("p", F.lit(pattern)).cast("long"))
    some = F.col("n_base") > 0
    first = F.when(some, spaces(F.substring("p", F.lit(1), F.regexp_instr("p", F.lit(pattern)))) - 1)
    last = F.when(some, spaces(F.regexp_extract("p", f"(?s)^(.*){pattern}", 1)))
    names = F.create_map(*(F.lit(x) for kv in PHRASES.items() for x in kv))
    labels = F.when(some, F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("p", F.lit(pattern), F.lit(1)), lambda m: F.element_at(names, m))))).otherwise(F.array().cast("array<string>"))
    n_words = F.when(F.col("p") == "  ", F.lit(0).cast("long")).otherwise(spaces(F.col("p")) - 1)
    return rows.select("doc_id", "k_id", "k_th", n_words.alias("n_words"), "n_base", first.alias("first_word"), last.alias("last_word"), labels.alias("base"))


def templates(spark: SparkSession) -> DataFrame:
    """(number, at, size, t1, t2, t3, hash) of each template's 3-grams, as a local relation; number: its place in TEMPLATES."""
    rows = []
    for number, (_, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [f"({number}, {i}, {len(w)}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for i in range(len(w) - 2)]
    return spark.sql(f"SELECT *, xxhash64(t1, t2, t3) AS hash FROM VALUES {', '.join(rows)} AS t(number, at, size, t1, t2, t3)")


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: k_id, k_th, number of the template, first and last word, coverage."""
    w = words(normal(F.col("text")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k_id"), F.xxhash64("text").alias("k_th"), w.alias("w")).filter(F.size("w") >= 3)
    later = lambda k: F.slice(F.col("w"), F.lit(k), F.size("w"))
    grams = rows.select("k_id", "k_th", F.posexplode(F.arrays_zip(F.col("w").alias("w1"), later(2).alias("w2"), later(3).alias("w3"))).alias("pos", "g"))
    grams = grams.select("k_id", "k_th", "pos", F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3")).withColumn("hash", F.xxhash64("w1", "w2", "w3"))
    votes = grams.join(F.broadcast(templates(docs.sparkSession)), "hash").filter("w1 = t1 AND w2 = t2 AND w3 = t3")
    # plain counts only: a diagonal's distinct template places are rows of a grouping
    cells = votes.groupBy("k_id", "k_th", "number", "size", (F.col("pos") - F.col("at")).alias("diagonal"), "at").agg(F.min("pos").alias("lo"))
    order = Window.partitionBy("k_id", "k_th", "number").orderBy("diagonal", "at")
    near = F.greatest(F.lit(NEAR), F.floor(F.col("size") / 4))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)).cast("int")
    merged = cells.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("k_id", "k_th", "number", "size", "cluster", "at").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    merged = merged.groupBy("k_id", "k_th", "number", "size", "cluster").agg(F.min("lo").alias("first"), (F.max("hi") + 2).alias("last"), F.count("*").alias("n"))
    merged = merged.withColumn("coverage", F.col("n") / (F.col("size") - 2))
    return merged.filter((F.col("coverage") >= MIN_COVERAGE) & (F.col("last") - F.col("first") + 1 <= MAX_STRETCH * F.col("size")))


def scan(docs: DataFrame) -> DataFrame:
    """For each row: n_words, the base's places and labels, all labels and the score: the best coverage of a verified
    span, 1 where a phrase of the base stands."""
    found = spans(docs).groupBy("k_id", "k_th").agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("bits"), F.max("coverage").alias("best"))
    out = base(docs).join(found, ["k_id", "k_th"], "left")
    more = F.filter(F.array(*(F.when(F.expr(f"(bits & shiftleft(1L, {i})) <> 0"), F.lit(label)) for i, (label, _) in enumerate(TEMPLATES))), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(F.concat("base", more)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", every).alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """The same in DuckDB's SQL, word by word without hashes."""
    rows = ", ".join(f"('{label}', {i}, {len(w)}, '{w[i]}', '{w[i + 1]}', '{w[i + 2]}')" for label, w in ((a, b.split()) for a, b in TEMPLATES) for i in range(len(w) - 2))
    places = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS spot FROM wordy WHERE " + " AND ".join(f"list_extract(w, i + {k}) = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
wordy AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
place AS ({places}),
based AS (SELECT r, count(*) AS n, min(spot) AS a, max(spot) AS b, list_sort(list(DISTINCT label)) AS ls FROM place GROUP BY r),
t(label, spot, size, t1, t2, t3) AS (VALUES {rows}),
votes AS (SELECT r, label, size, i - 1 AS pos, spot FROM wordy JOIN t ON list_extract(w, i) = t1 AND list_extract(w, i + 1) = t2 AND list_extract(w, i + 2) = t3),
diag AS (SELECT r, label, size, pos - spot AS d, min(pos) AS lo, max(pos) AS hi, list(DISTINCT spot) AS ats FROM votes GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, label ORDER BY d) <= greatest({NEAR}, size // 4) THEN 0 ELSE 1 END AS apart FROM diag),
clusters AS (SELECT *, sum(apart) OVER (PARTITION BY r, label ORDER BY d) AS c FROM gaps),
merged AS (SELECT r, label, size, c, min(lo) AS a, max(hi) + 2 AS b, len(list_distinct(flatten(list(ats)))) / (size - 2) AS coverage FROM clusters GROUP BY r, label, size, c),
found AS (SELECT r, list(DISTINCT label) AS more, max(coverage) AS best FROM merged WHERE coverage >= {MIN_COVERAGE} AND b - a + 1 <= {MAX_STRETCH} * size GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
    coalesce(array_to_string(ls, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN based USING (r) LEFT JOIN found USING (r)"""
