"""Licence scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of every document are hashed and joined to the pairs of the templates (a fixed, small list, so it
is broadcast).  A hit at word p for a template's place j votes for the diagonal p - j; votes count only if the words
themselves agree.  A base phrase stands where a diagonal has all of its votes.  A longer notice is recognised where
neighbouring diagonals (a word or two added or lost) together have COVERAGE of its pairs, or all of fewer than SHORT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

COVERAGE, NEIGHBOUR, SHORT = 0.8, 2, 8
# Phrases of the base and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Words of well-known public licence notices.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution", "creative-commons"),
    ("all rights reserved", "all-rights-reserved"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: Column) -> Column:
    """Words in the contract's sense but for the case of A-Z, and perhaps a blank at either end."""
    return F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lower(a), F.lower(b))


def _templates(docs: DataFrame) -> DataFrame:
    rows = []
    for t, (phrase, label) in enumerate([*BASE, *NOTICES]):
        w = phrase.split()
        rows += [(t, label, t < len(BASE), len(w) - 1, j, w[j], w[j + 1]) for j in range(len(w) - 1)]
    made = docs.sparkSession.createDataFrame(rows, "t int, label string, base boolean, n_pairs int, j int, w1 string, w2 string")
    return made.withColumn("h", _pair(F.col("w1"), F.col("w2")))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, t, label, base, n_pairs, j, diagonal: verified votes of every document's word pairs."""
    # Outer, since a filter that Spark infers for an inner explosion would split every text once more.
    rolled = docs.select("doc_id", pieces(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode_outer("w").alias("p", "a"))
    b = F.get("w", F.col("p") + 1)
    folded = lambda c: F.translate(c, _UPPER, _LOWER)
    hits = rolled.join(
        F.broadcast(_templates(docs)),
        # Bounds, not equalities, for the words: Spark would make those keys, and fold every word of every text.
        (_pair(F.col("a"), b) == F.col("h")) & folded(F.col("a")).between(F.col("w1"), F.col("w1")) & folded(b).between(F.col("w2"), F.col("w2")),
    ).withColumn("p", F.col("p") - (F.get("w", F.lit(0)) == "").cast("int"))
    return hits.select("doc_id", "t", "label", "base", "n_pairs", "j", (F.col("p") - F.col("j")).cast("long").alias("diagonal"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, label, base, first_word, last_word (start of the last such place), n_places, coverage: verified spans."""
    by_diagonal = votes(docs).groupBy("doc_id", "t", "label", "base", "n_pairs", "diagonal").agg(F.collect_set("j").alias("js"))
    exact = (
        by_diagonal.where("base AND size(js) = n_pairs")
        .groupBy("doc_id", "t", "label", "base")
        .agg(F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.count(F.lit(1)).alias("n_places"), F.lit(1.0).alias("coverage"))
    )
    # A band starts at each diagonal; votes further off belong to another copy, or to words scattered over the text.
    band = Window.partitionBy("doc_id", "t").orderBy("diagonal").rangeBetween(0, NEIGHBOUR)
    merged = (
        by_diagonal.where("NOT base")
        .withColumn("n", F.size(F.array_distinct(F.flatten(F.collect_list("js").over(band)))))
        .withColumn("coverage", F.col("n") / F.col("n_pairs"))
        .where(F.col("coverage") >= F.when(F.col("n_pairs") < SHORT, 1.0).otherwise(COVERAGE))
        .groupBy("doc_id", "t", "label", "base")
        .agg(F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.count(F.lit(1)).alias("n_places"), F.max("coverage").alias("coverage"))
    )
    return exact.unionByName(merged).drop("t")


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Null or empty text has no words, and a document without a licence has n_base 0, null places, empty labels and score
    0.  score is the best coverage of any template.  doc_id names a document: rows that repeat one must repeat its text
    and are counted together.  Other columns are ignored; an empty table gives no rows.
    """
    docs = shared.documents(docs)
    base = F.col("base")
    found = spans(docs).groupBy("doc_id").agg(
        F.sum(F.when(base, F.col("n_places")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("last_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    w = pieces(F.col("text"))
    blanks = (F.get(w, F.lit(0)) == "").cast("long") + ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("long")
    every = docs.select("doc_id", (F.size(w) - blanks).alias("n_words"))
    return every.join(found, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    rows = []
    for t, (phrase, label) in enumerate([*BASE, *NOTICES]):
        w = phrase.split()
        rows += [f"({t}, '{label}', {t < len(BASE)}, {len(w) - 1}, {j}, '{w[j]}', '{w[j + 1]}')" for j in range(len(w) - 1)]
    return ", ".join(rows)


def oracle() -> str:
    """The same in DuckDB's SQL."""
    return rf"""
        WITH tpl(t, label, base, n_pairs, j, w1, w2) AS (VALUES {_values()}),
        d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, i - 1 AS p, w[i] AS w1, w[i + 1] AS w2 FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE len(w) > 1),
        v AS (SELECT doc_id, t, label, base, n_pairs, j, p - j AS diagonal FROM p JOIN tpl USING (w1, w2)),
        g AS (SELECT doc_id, t, label, base, n_pairs, diagonal, count(DISTINCT j) AS n FROM v GROUP BY ALL),
        e AS (SELECT doc_id, label, base, min(diagonal) AS a, max(diagonal) AS z, count(*) AS n_places, 1.0::DOUBLE AS coverage
            FROM g WHERE base AND n = n_pairs GROUP BY doc_id, t, label, base),
        k AS (SELECT doc_id, t, label, base, n_pairs, diagonal, list(DISTINCT j) AS js FROM v WHERE NOT base GROUP BY ALL),
        m AS (SELECT doc_id, t, label, base, n_pairs, len(list_distinct(flatten(list(js) OVER
            (PARTITION BY doc_id, t ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {NEIGHBOUR} FOLLOWING)))) AS n FROM k),
        s AS (SELECT doc_id, label, base, a, z, n_places, coverage FROM e UNION ALL
            SELECT doc_id, label, base, NULL, NULL, 0, n::DOUBLE / n_pairs FROM m WHERE n::DOUBLE / n_pairs >= CASE WHEN n_pairs < {SHORT} THEN 1 ELSE {COVERAGE} END),
        f AS (SELECT doc_id, sum(n_places)::BIGINT AS n_base, min(a) AS first_word, max(z) AS last_word,
            coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
            array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score FROM s GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
            last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN f USING (doc_id)"""
