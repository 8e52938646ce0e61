"""Licence notices in documents: template matching by diagonal voting.

Method: the rolling ``K``-word gram hashes of every text are joined to the template
positions with the same hash (the template table is fixed and small, so the join is a
broadcast one and only hits leave a task). A hit votes for the diagonal "word in the
text minus word in the template"; votes are aggregated by diagonal, diagonals at most
``GAP`` apart are merged (words put in or left out shift a copy by a few words), and a
merged diagonal is verified: its hits must be ``LEAST_HITS`` at least, cover ``COVERAGE``
of the template's words within a span that is not much longer than the template, and hold
the template's mark, the word that tells it from others. Where verified spans of
different labels overlap, the one that covers more words stays.

A text is cut into words once. What a row keeps of it is written: counts, places, and
the few positions whose gram stands in a template; all later steps read that.

Beside the method's labels, places of the plain phrases in ``PHRASES`` are counted.
``score`` is the best coverage of a span that stays, 1 where a plain phrase stands, else 0.

Defined cases: a null text counts as empty; empty texts have no words, places or
labels; very long texts are scanned whole; repeated rows get the same result each; spans
that tie go by coverage, then by the order of the templates, then by place; null ids are
kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import saved

K = 3
GAP = 4
COVERAGE = 0.6
LEAST_HITS = 3
STRETCH = 2  # a verified span is at most this many times its template's length
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels, marks, and wordings of licences and notices as they are published.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "general", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "bsd", "Released under the BSD License"),
    ("bsd", "bsd", "This project is licensed under the terms of the BSD license"),
    ("bsd", "binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "by", "Licensed under CC BY 4.0"),
    ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(words: Column) -> Column:
    """Hashes of all K-word windows, in order."""
    n = F.size(words) - K
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def places(words: Column, phrase: str) -> Column:
    """Start words of all places of a phrase."""
    parts = phrase.split(" ")
    n = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = F.get(words, i + len(parts) - 1) == parts[-1]  # the rarest test first
        for j, part in enumerate(parts[:-1]):
            hit = hit & (F.get(words, i + j) == part)
        return hit
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), here)).otherwise(F.array().cast("array<int>"))


def template_grams(spark) -> DataFrame:
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, label string, mark string, text string")
    df = df.select("template", "label", "mark", words_of(F.col("text")).alias("words"))
    return df.select("template", "label", (F.array_position("words", F.col("mark")) - 1).cast("int").alias("mark_at"), F.size("words").alias("template_words"),
                     F.posexplode(grams(F.col("words"))).alias("template_at", "gram"))


def _read_once(docs: DataFrame, known: list[int], id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_words, places of the phrases (p0, p1, ...) and hits (position, gram) of each text."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", F.translate("text", UPPER, LOWER).contains("license").alias("maybe"), words_of(F.col("text")).alias("words"))
    gram = lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(K)])
    n = F.size("words") - K
    none = F.array().cast("array<int>")
    hits = F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), lambda i: gram(i).isin(known))).otherwise(none)
    at = [F.when(F.col("maybe"), places(F.col("words"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    df = df.select("doc_id", "words", *at, hits.alias("hits"))
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), *[f"p{i}" for i in range(len(PHRASES))],
                     F.transform("hits", lambda i: F.struct(i.alias("at"), gram(i).alias("gram"))).alias("hits"))


def _verified(read: DataFrame, template: DataFrame) -> DataFrame:
    """row, label, template, covered, coverage, lo, hi of each span that hits verify (hi: its last word)."""
    hits = (read.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.gram").join(F.broadcast(template), "gram")
            .withColumn("diagonal", F.col("at") - F.col("template_at")).drop("gram"))
    key = ["row", "template", "label", "template_words", "mark_at"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_list("template_at").alias("hits"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    votes = votes.withColumn("fresh", (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"))
    votes = votes.withColumn("run", F.sum(F.coalesce("fresh", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy(*key, "run").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    merged = merged.withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + (K - 1)))))))
    merged = merged.withColumn("coverage", F.col("covered") / F.col("template_words")).withColumn("hi", F.col("hi") + (K - 1))
    marked = F.exists("hits", lambda t: (t <= F.col("mark_at")) & (F.col("mark_at") < t + K))
    return merged.where((F.size("hits") >= LEAST_HITS) & (F.col("coverage") >= COVERAGE) & marked & (F.col("hi") - F.col("lo") + 1 <= STRETCH * F.col("template_words")))


def _best(spans: DataFrame) -> DataFrame:
    """row, found, coverage: the labels of the spans that stay. Spans are taken best first; one that overlaps a
    taken span of another label goes. Only spans of one stretch of overlaps are looked at together."""
    order = Window.partitionBy("row").orderBy("lo", "hi", "template")
    spans = spans.withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("stretch", F.sum(F.coalesce((F.col("lo") > F.col("before")).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((-F.col("covered")).alias("a"), (-F.col("coverage")).alias("b"), "template", "lo", "hi", "label", "coverage")
    groups = spans.groupBy("row", "stretch").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    clash = lambda x, y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"]) & (x["label"] != y["label"])
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    groups = groups.select("row", F.explode(kept).alias("s"))
    return groups.groupBy("row").agg(F.collect_set("s.label").alias("found"), F.max("s.coverage").alias("coverage"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    template = template_grams(docs.sparkSession)
    known = sorted({r.gram for r in template.select("gram").collect()})  # the fixed templates' grams
    read = saved(_read_once(docs, known, id_col, text_col), "licenses")
    seen = _best(_verified(read, template))
    every = F.concat(*[f"p{i}" for i in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    base = read.select("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                       F.array_max(every).cast("long").alias("last_word"), named.alias("named"))
    both = F.array_sort(F.array_union("named", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(seen, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.when(F.size("named") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same result as DuckDB SQL over ``documents``."""
    words = f"regexp_extract_all(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    rows = ", ".join(f"({i}, {_sql_text(label)}, {_sql_text(mark)}, {_sql_text(text)})" for i, (label, mark, text) in enumerate(TEMPLATES))
    gram = " || ' ' || ".join(f"words[i + {j}]" for j in range(1, K + 1))
    base = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"words[i + {j + 1}] = '{p}'" for j, p in enumerate(phrase.split(" ")))
        base.append(f"SELECT r, i, '{label}' AS label FROM steps WHERE {test}")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words.format('text')} AS words FROM documents),
steps AS (SELECT r, words, unnest(range(len(words))) AS i FROM docs),
tmpl AS (SELECT template, label, mark, {words.format('body')} AS words FROM (VALUES {rows}) AS v(template, label, mark, body)),
tsteps AS (SELECT template, label, list_position(words, mark) - 1 AS mark_at, words, unnest(range(len(words) - {K - 1})) AS i FROM tmpl),
tgrams AS (SELECT template, label, mark_at, len(words) AS template_words, i AS template_at, {gram} AS gram FROM tsteps),
dgrams AS (SELECT r, i AS spot, {gram} AS gram FROM steps WHERE i + {K} <= len(words)),
hits AS (SELECT r, template, label, mark_at, template_words, spot, template_at, spot - template_at AS diagonal FROM dgrams JOIN tgrams USING (gram)),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {GAP} THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY r, template ORDER BY diagonal, spot)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal, spot ROWS UNBOUNDED PRECEDING) AS run FROM marked),
cover AS (SELECT DISTINCT r, template, run, template_at + j AS word FROM runs, range({K}) t(j)),
covered AS (SELECT r, template, run, count(*) AS n FROM cover GROUP BY ALL),
merged AS (SELECT r, template, run, label, template_words, min(spot) AS lo, max(spot) + {K - 1} AS hi, count(DISTINCT template_at) AS n_hits,
  bool_or(template_at <= mark_at AND mark_at < template_at + {K}) AS has_mark FROM runs GROUP BY ALL),
seen AS (SELECT r, template, label, lo, hi, n, n / template_words AS coverage FROM merged JOIN covered USING (r, template, run)
  WHERE n_hits >= {LEAST_HITS} AND has_mark AND n / template_words >= {COVERAGE} AND hi - lo + 1 <= {STRETCH} * template_words),
ordered AS (SELECT r, list(struct_pack(lo := lo, hi := hi, label := label, coverage := coverage) ORDER BY n DESC, coverage DESC, template, lo) AS s FROM seen GROUP BY r),
kept AS (SELECT r, unnest(list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.lo <= x[1].hi AND x[1].lo <= y.hi
  AND y.label <> x[1].label)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM ordered),
own AS (SELECT r, list(DISTINCT k.label) AS found, max(k.coverage) AS coverage FROM kept GROUP BY r),
base AS ({' UNION ALL '.join(base)}),
places AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS named FROM base GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0.0) END AS score
FROM docs LEFT JOIN places USING (r) LEFT JOIN own USING (r)"""
