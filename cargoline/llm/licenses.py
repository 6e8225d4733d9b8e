"""License notices by diagonal voting, in DataFrame operations alone.

Every pair of neighbouring words of a text is hashed and joined with the hashed pairs of all templates. A match of text place and template
place votes for its diagonal, the difference of the two; a vote counts only if both words are really those of the template. The votes of a
diagonal are one bit mask of template places, so they fold in the map tasks. Neighbouring diagonals of one template, as an inserted or
missing word makes them, are merged, and a span is verified by the share of the template's words that its votes cover: all words for
an exact template, ``SHARE`` of them for a notice.

Null, empty and wordless texts have no places; every row of the input is in the result. Rows of equal id and text count as one when votes
are gathered. The templates are a parameter and are broadcast: their size has nothing to do with the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from cargoline.llm.words import keyed
from cargoline.session import materialize

#: Share of a notice's words that must stand in the text.
SHARE = 0.8
#: Words by which two diagonals of one place may lie apart.
SHIFT = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False  # counts as a place of the base phrases

    @property
    def exact(self) -> bool:
        """Short phrases must stand word for word."""
        return self.base or len(self.words.split()) < 8


# The base phrases, then wordings of public licence notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _pairs(spark, templates: tuple[Template, ...]) -> DataFrame:
    """One row per pair of neighbouring template words."""
    rows = []
    for k, t in enumerate(templates):
        w = t.words.split()
        if not 2 <= len(w) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(k, t.label, t.base, t.exact, len(w), at, w[at], w[at + 1]) for at in range(len(w) - 1)]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, exact boolean, size int, place int, first string, second string")
    return made.withColumn("pair", F.xxhash64("first", "second"))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, text_hash, label, base, start, stop, share): verified places of the templates, in words from 0, ``stop`` exclusive."""
    # the outer form of explode: else Spark cuts every text into words once more to filter the empty ones
    rows = keyed(docs, id_col, text).select("id", "text_hash", "words", F.posexplode_outer("words").alias("at", "word"))
    rows = rows.withColumn("next", F.get("words", F.col("at") + 1)).where("next IS NOT NULL").select(
        "id", "text_hash", "at", "word", "next", F.xxhash64("word", "next").alias("pair"))
    votes = rows.join(F.broadcast(_pairs(docs.sparkSession, templates)), "pair").where("word = first AND next = second")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
    diagonals = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(
        "id", "text_hash", "template", "label", "base", "exact", "size", "diagonal").agg(
        F.bit_or(mask).alias("mask"), F.min("at").alias("start"), (F.max("at") + 2).alias("stop"))
    order = W.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT)
    placed = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(order))
    merged = placed.groupBy("id", "text_hash", "template", "label", "base", "exact", "size", "island").agg(
        F.bit_or("mask").alias("mask"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    covered = F.bit_count(F.col("mask").bitwiseOR(F.shiftleft("mask", 1)))
    return merged.withColumn("share", covered / F.col("size")).where(F.col("share") >= F.when(F.col("exact"), 1.0).otherwise(SHARE)).select(
        "id", "text_hash", "label", "base", "start", "stop", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: ``n_words``; of the base phrases ``n_base``, ``first_word``, ``last_word`` (starts, else null) and
    ``base_labels``; of all templates ``labels`` and ``score``, the largest share of a template found (0 where none is)."""
    found = materialize(spans(docs, id_col, text, templates), "license-spans")
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda column: F.concat_ws(",", F.sort_array(F.collect_set(column)))
    sums = found.groupBy("id", "text_hash").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"))
    rows = keyed(docs, id_col, text).select("id", "text_hash", F.size("words").cast("bigint").alias("n_words"))
    both = rows.join(sums, rows.id.eqNullSafe(sums.id) & (rows.text_hash == sums.text_hash), "left")
    return both.select(rows.id.alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
                       F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
                       F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle_sql(words_sql: str, templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``."""
    listed = ", ".join(f"({k}, '{t.label}', {t.base}, {t.exact}, '{t.words}')" for k, t in enumerate(templates))
    return f"""
WITH t AS (SELECT *, string_split(phrase, ' ') AS w FROM (VALUES {listed}) AS v(template, label, base, exact, phrase)),
pairs AS (SELECT template, label, base, exact, len(w) AS size, i - 1 AS place, w[i] AS first, w[i + 1] AS second FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
d AS (SELECT doc_id, {words_sql.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS first, w[i + 1] AS second FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
diag AS (SELECT doc_id, template, label, base, exact, size, pos - place AS diagonal, bit_or(1::BIGINT << place) AS mask, min(pos) AS start
         FROM g JOIN pairs USING (first, second) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER w > {SHIFT}, true) THEN 1 ELSE 0 END AS apart FROM diag
           WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
placed AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked),
merged AS (SELECT doc_id, label, base, exact, size, min(start) AS start, bit_or(mask) AS mask FROM placed GROUP BY doc_id, template, label, base, exact, size, island),
found AS (SELECT *, bit_count(mask | (mask << 1)) / size AS share FROM merged WHERE bit_count(mask | (mask << 1)) / size >= CASE WHEN exact THEN 1.0 ELSE {SHARE} END),
sums AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
         FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN sums USING (doc_id)"""
