"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

1. ``term_counts`` counts how often each test word occurs in all training texts.
2. Each test window is keyed by its rarest words.
3. ``build_index`` stores the postings of those words, and only those: document, position, and the words around the
   position, as far as the longest window reaches. They are picked out in the scan of the texts, in the task that
   reads a text, so neither texts nor lists of frequent words are shuffled.
4. ``phrase_matches`` takes the list of a window's rarest word, moves it by the word's offset, intersects it with the
   second rarest word's and then with all the others', which the stored neighbourhood holds. ``proximity_matches``
   asks for a share of the window's words in any order close together instead; for these a window is keyed by as many
   rare words as it takes for every such place to hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, lower_ascii, materialize, small, table

WINDOW = 10
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind the last word of each text (no word has a space).
END = " end"
#: A proximity match holds this share of a window's different words within REACH words.
SHARE = 0.8


def words_of(c: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), SPLIT), "")


def windows(tests: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, win (its words): every window of every test text; a shorter text is one window, an empty one none."""
    w = tests.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    return w.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("win")).distinct()


def term_counts(docs: DataFrame, wins: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: occurrences of each test word in all texts; stored, since the texts are read for it."""
    terms = materialize(wins.select(F.explode("win").alias("word")).distinct().select(F.xxhash64("word").alias("term")).distinct(), "terms")
    each = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).select(F.xxhash64("word").alias("term"))
    if fits(terms):
        counted = each.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:  # the scan's combine comes before the shuffle
        counted = each.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")
    return materialize(counted, "term-counts")


def keyed(wins: DataFrame, counts: DataFrame, share: float = SHARE) -> DataFrame:
    """item_id, win, rank, term, off: the rarest words of each window with their places in it, the rarest at rank 0. A
    text that holds at least ``share`` of the window's different words holds one of these words: there is one more of
    them than may be missing. off2: the place of the window's second rarest word."""
    places = wins.select("item_id", "win", F.posexplode("win").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    ranked = (
        places.join(small(counts), "term", "left")
        .groupBy("item_id", "win")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))).alias("by"))  # as many as a window has words
    )
    off2 = F.coalesce(F.get("by", F.lit(1))["off"], F.col("by")[0]["off"])
    # of equal words, which stand side by side in the order, the first
    firsts = F.filter("by", lambda x, i: (i == 0) | (F.get("by", i - 1)["term"] != x["term"]))
    ranked = ranked.select("item_id", "win", off2.alias("off2"), firsts.alias("by"))
    keys = F.slice("by", F.lit(1), F.size("by") - F.ceil(F.size("by") * share - 1e-9).cast("int") + 1)
    return ranked.select("item_id", "win", "off2", F.posexplode(keys).alias("rank", "x")).select("item_id", "win", "rank", "x.term", "x.off", "off2")


def keys_of(docs: DataFrame, tests: DataFrame, window: int = WINDOW, share: float = 1.0, text_col: str = "text") -> DataFrame:
    """The stored keys of all windows of ``tests`` by the word counts of ``docs``. share 1: for phrases only."""
    wins = windows(tests, window)
    return materialize(keyed(wins, term_counts(docs, wins, text_col), share), "windows")


def build_index(docs: DataFrame, terms: DataFrame, reach: int = WINDOW - 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, term, near (the words from ``reach`` before to ``reach`` behind), at (the word's place in near);
    stored in the shared folder. Each text also has a row with the term of END, whose pos is its number of words."""
    end = F.xxhash64(F.lit(END))
    wanted = terms.select("term").union(terms.sparkSession.range(1).select(end.alias("term"))).distinct()
    texts = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("w"))
    every = F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word")
    if fits(wanted):
        found = texts.select(id_col, "w", every).withColumn("term", F.xxhash64("word")).join(F.broadcast(wanted), "term")
    else:  # only ids, positions and hashes are shuffled; they go back to their texts as one list a document
        places = texts.select(id_col, every).select(id_col, "pos", F.xxhash64("word").alias("term")).join(wanted, "term")
        lists = places.groupBy(id_col).agg(F.collect_set(F.struct("pos", "term")).alias("places"))
        found = texts.join(lists, id_col).select(id_col, "w", F.inline("places")).where(F.col("pos") <= F.size("w"))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.when(F.col("term") == end, F.array().cast("array<string>")).otherwise(F.slice("w", low + 1, F.lit(2 * reach + 1)))
    return materialize(found.select(id_col, "pos", "term", near.alias("near"), (F.col("pos") - low).alias("at")), "postings")


def phrase_matches(index: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, first, last: every place where a window's words stand one after the other."""
    start = F.col("at") - F.col("off")
    second = F.get("near", start + F.col("off2")) == F.get("win", F.col("off2"))
    whole = F.slice("near", start + 1, F.size("win")) == F.col("win")
    return index.join(small(keys.where("rank = 0")), "term").where((start >= 0) & second & whole).select(
        id_col, "item_id", (F.col("pos") - F.col("off")).alias("first"), (F.col("pos") - F.col("off") + F.size("win") - 1).alias("last")
    )


def proximity_matches(index: DataFrame, keys: DataFrame, share: float = SHARE, reach: int = WINDOW + 2, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, win, first: each stretch of at most ``reach`` words that begins at ``first`` and holds at least
    ``share`` of a window's different words, in any order, and begins with one of them. The index must reach that far
    (``build_index(..., reach - 1)``), and ``keys`` must be of the same share, so that every such stretch holds a
    posting: all of them are found, whichever words are missing."""
    need = F.ceil(F.size("words") * share - 1e-9)
    wanted = keys.select("item_id", "win", "term", F.array_distinct("win").alias("words"))
    near = index.join(small(wanted), "term").where(F.size(F.array_intersect("words", "near")) >= need)
    # stretches around the posting that begin with a word of the window
    starts = F.filter(
        F.sequence(F.greatest(F.lit(0), F.col("at") - reach + 1), F.col("at")),
        lambda i: F.array_contains("words", F.get("near", i)) & (F.size(F.array_intersect("words", F.slice("near", i + 1, F.lit(reach)))) >= need),
    )
    return near.select(id_col, "item_id", "win", F.col("pos"), F.col("at"), F.explode(starts).alias("i")).select(id_col, "item_id", "win", (F.col("pos") - F.col("at") + F.col("i")).alias("first")).distinct()


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids of the test texts with
    occurrences) for each document.

    Defined results: null and empty documents have no words and no hits, null and empty tests no windows; an empty
    table of tests hits nothing; ids are keys, so rows that repeat one are taken together as one document; repeated
    tests count once; columns other than id and text aren't read."""
    keys = keys_of(docs, tests, window, 1.0, text_col)
    index = build_index(docs, keys, window - 1, id_col, text_col)
    matches = phrase_matches(index, keys, id_col)
    sizes = index.where(F.col("term") == F.xxhash64(F.lit(END))).select(id_col, F.col("pos").alias("n_words"))
    none = lambda kind: F.lit(None).cast(kind)
    item = tests.schema["item_id"].dataType.simpleString()
    both = matches.select(id_col, none("int").alias("n_words"), "item_id", "first", "last").union(
        sizes.select(id_col, "n_words", none(item).alias("item_id"), none("int").alias("first"), none("int").alias("last"))
    )
    before = Window.partitionBy(id_col).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    return both.withColumn("fresh", F.when(F.col("last").isNotNull(), fresh).otherwise(0)).groupBy(id_col).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("fresh").cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + {WINDOW} - 1], ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p, g.n FROM grams g JOIN wins USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
