"""License scans by diagonal voting.

1. All rolling K-word hashes of every text are joined to the positions of the same hashes in license templates, in one
   scan. Each match is verified there by its words, so a vote is never owed to a collision.
2. A match at text position p and template position t votes for the diagonal p - t. Votes are summed up per diagonal as
   bit masks over the template's positions, in the scan already, so a passage costs a row for each of its diagonals.
3. Diagonals of a template that lie close together (words put in or left out) are merged, and a merged span is accepted
   if its verified votes cover enough of the template. A short phrase needs all its votes on one diagonal, that is every
   word in its place.

Beside the votes each text sends one short row with its number of words; its words never leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, lower_ascii, table

K = 3
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this close belong together; the share of a template's votes a span needs.
NEAR, COVER = 8, 0.6
#: Bits used of each bigint of a mask.
BITS = 60


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # a phrase whose words must all be there, one after the other

    @property
    def words(self) -> list[str]:
        return [x.decode() for x in alnum_words(self.text)]

    @property
    def size(self) -> int:
        """Votes of a whole match."""
        return max(0, len(self.words) - K + 1)


BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Openings of well-known notices; a text that carries most of one gets its label.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "this work is licensed under a creative commons attribution"),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work"),
    Template("proprietary", "all rights reserved"),
)


def templates_table(spark, templates: Sequence[Template]) -> DataFrame:
    """template, tpos, words (K of them, joined), h: one row a K-word sequence."""
    rows = [(k, i, *t.words[i : i + K]) for k, t in enumerate(templates) for i in range(t.size)]
    names = [f"w{i}" for i in range(K)]
    df = spark.createDataFrame(rows, "template int, tpos int, " + ", ".join(f"{n} string" for n in names))
    return df.select("template", "tpos", F.array_join(F.array(*names), " ").alias("words"), F.xxhash64(*names).alias("h"))


def _masks(at: Column, bits: int) -> list[Column]:
    """One bit of a mask of ``bits`` bits, as so many bigints as it takes."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % BITS).cast("int"))
    return [F.when(F.floor(at / BITS) == b, one).otherwise(F.lit(0).cast("long")) for b in range(max(1, -(-bits // BITS)))]


def _plus(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _diagonals(df: DataFrame, templates: Sequence[Template], id_col: str, text_col: str) -> DataFrame:
    """_id, _th (hash of the text), template, diagonal, low and high (its first and last vote), m0.. (votes as masks).
    Each text also has a row with template -1, whose diagonal is its number of words and whose ``rows`` says how many
    rows have this id and text."""
    spark = df.sparkSession
    end = F.xxhash64(F.lit("end of the text"), F.lit(0))
    known = templates_table(spark, templates).unionByName(spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("tpos"), F.lit("").alias("words"), end.alias("h")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(lower_ascii(text), SPLIT), "")
    rolled = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), words.alias("_w")).select(
        "_id", "_th", "_w", F.transform("_w", lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, K)])).alias("_hs")
    )
    each = rolled.select("_id", "_th", "_w", F.posexplode(F.concat("_hs", F.array(end))).alias("pos", "h"))
    # the templates are part of the code: a few hundred rows
    same = (F.col("template") < 0) | (F.array_join(F.slice("_w", F.col("pos") + 1, F.lit(K)), " ") == F.col("words"))
    hits = each.join(F.broadcast(known), "h").where(same).select("_id", "_th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    most = max((t.size for t in templates), default=1)
    return hits.groupBy("_id", "_th", "template", "diagonal").agg(
        F.count("*").alias("rows"), F.min("tpos").alias("low"), F.max("tpos").alias("high"),
        *[F.bit_or(m).alias(f"m{b}") for b, m in enumerate(_masks(F.col("tpos"), most))],
    )


def _spans(diagonals: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """_id, _th, template, rows, first, last, score of each accepted span, and the rows with template -1."""
    masks = [c for c in diagonals.columns if c[0] == "m" and c[1:].isdigit()]
    of = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("template"))
    by = Window.partitionBy("_id", "_th").orderBy("template", "diagonal")
    # an exact phrase stands on one diagonal; others merge with neighbours
    joins = (F.lag("template").over(by) == F.col("template")) & (F.col("diagonal") - F.lag("diagonal").over(by) <= NEAR)
    fresh = (F.col("template") < 0) | of([t.exact for t in templates], "boolean") | ~F.coalesce(joins, F.lit(False))
    merged = (
        diagonals.withColumn("span", F.sum(fresh.cast("int")).over(by))
        .groupBy("_id", "_th", "span", "template")
        .agg(
            F.max("rows").alias("rows"), F.min(F.col("diagonal") + F.col("low")).alias("first"),
            F.max(F.col("diagonal") + F.col("high") + K - 1).alias("last"), *[F.bit_or(m).alias(m) for m in masks],
        )
    )
    votes = _plus([F.bit_count(m) for m in masks])
    share = votes / of([t.size for t in templates], "double")
    merged = merged.withColumn("score", F.when(F.col("template") >= 0, share))
    good = F.when(F.col("template") < 0, True).when(of([t.exact for t in templates], "boolean"), F.col("score") == 1).otherwise(F.col("score") >= COVER)
    return merged.where(good).select("_id", "_th", "template", "rows", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "score")


def scan(df: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each accepted span: id, template (its place in ``templates``), label, exact, first, last (word positions where it
    begins and ends), score (share of the template's votes found).

    Defined results: null and empty texts have none; rows that repeat an id and its text count once, rows that repeat
    an id with other texts are texts of their own; columns other than id and text are not read."""
    spans = _spans(_diagonals(df, templates, id_col, text_col), templates).where("template >= 0")
    of = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("template"))
    return spans.select(F.col("_id").alias(id_col), "template", of([t.label for t in templates]).alias("label"), of([t.exact for t in templates]).alias("exact"), "first", "last", "score")


def report(df: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Defined results: null and empty texts have no words; a null id is a value like others; each row has a row of its
    own, whatever rows repeat its id or its text; columns other than id and text are not read."""
    templates = base + notices
    spans = _spans(_diagonals(df, templates, id_col, text_col), templates)
    labels = sorted({t.label for t in templates})
    label = F.get(F.array(*[F.lit(labels.index(t.label)) for t in templates]), F.col("template"))
    mine, any_ = F.col("template").between(0, len(base) - 1), F.col("template") >= 0
    held = _masks(label, len(labels))
    names = lambda prefix: F.array_join(F.array_compact(F.array(*[F.when(F.getbit(f"{prefix}{k // BITS}", F.lit(k % BITS)) == 1, F.lit(x)) for k, x in enumerate(labels)])), ",")
    rows = spans.groupBy("_id", "_th").agg(
        F.max(F.when(~any_, F.col("rows"))).alias("_rows"),
        F.max(F.when(~any_, F.col("first"))).alias("n_words"),
        F.count_if(mine).alias("n_base"),
        F.min(F.when(mine, F.col("first"))).alias("first_word"),
        F.max(F.when(mine, F.col("first"))).alias("last_word"),
        *[F.coalesce(F.bit_or(F.when(mine, m)), F.lit(0)).alias(f"_base{b}") for b, m in enumerate(held)],
        *[F.coalesce(F.bit_or(F.when(any_, m)), F.lit(0)).alias(f"_any{b}") for b, m in enumerate(held)],
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_one"))
    return each.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", names("_base").alias("base_labels"), names("_any").alias("labels"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle(templates: tuple[Template, ...] = BASE + NOTICES, base: int = len(BASE)) -> str:
    """The same rows by SQL, with the words themselves in place of their hashes."""
    rows = ", ".join(f"({k}, '{t.label}', {t.exact}, '{t.text}')" for k, t in enumerate(templates))
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT template, label, exact, string_split(phrase, ' ') AS p FROM (VALUES {rows}) AS v(template, label, exact, phrase)),
tg AS (SELECT template, label, exact, len(p) - {K} + 1 AS size, i - 1 AS tpos, array_to_string(p[i:i + {K} - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(p) - {K} + 2)) AS i FROM t)),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {K} - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {K} + 2)) AS i FROM d)),
diagonals AS (SELECT doc_id, template, label, exact, size, pos - tpos AS diagonal, list(DISTINCT tpos) AS votes FROM dg JOIN tg USING (g) GROUP BY ALL),
marked AS (SELECT *, exact OR coalesce(diagonal - lag(diagonal) OVER o > {NEAR}, true) AS fresh FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
spanned AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
merged AS (SELECT doc_id, template, label, exact, size, len(list_distinct(flatten(list(votes)))) AS n, min(diagonal + list_min(votes)) AS first
  FROM spanned GROUP BY doc_id, template, label, exact, size, span),
spans AS (SELECT *, n / size AS share FROM merged WHERE n >= CASE WHEN exact THEN size ELSE {COVER} * size END)
SELECT d.doc_id, len(any_value(w)) AS n_words, count(*) FILTER (template < {base}) AS n_base,
  min(first) FILTER (template < {base}) AS first_word, max(first) FILTER (template < {base}) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {base}), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLE = _oracle()
