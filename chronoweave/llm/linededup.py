"""Line dedup by a segment-partition edit join. DataFrame functions only.

Equal lines are grouped first, with a combine in the scan, so a line in a third of all documents costs one row a task.
The different lines are then joined by edit distance: short lines by characters, lines of LONG words or more by words,
so that what THRESHOLD edits may change grows with the line.

Two lines within ``t`` edits share one of the shorter one's ``t + 1`` segments, moved by few places. So each line is
indexed under its segments, by its length, and looks up, for every shorter length in reach, the substrings where a
shared segment can stand. Candidates that symbol counts can't rule out are verified by banded bit-parallel edit
distance: first each line against the first line of each of its segments, and only lines that this leaves against all
others, so that a large group of near copies isn't taken pair by pair.

Of equal lines the first stays, and a line goes if a line within the threshold comes before it; "before" is by (document
id, line number). The line before needn't stay itself: of a chain of lines, each near the next, the first stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, small, table

#: Edits that make no difference: of characters if one of the lines has fewer than LONG words, else of words.
THRESHOLD, LONG = 2, 20
#: Shorter lines (trimmed, in characters) are left alone: headings, brackets and the like repeat by chance.
MIN_CHARS = 20
LETTERS = "etaniorshdlu"


def edit_distance_within(p: str, t: str, threshold: int = THRESHOLD) -> Column:
    """Whether two arrays of symbols, p at least as long as t, are within ``threshold`` edits: the band of
    2 * threshold + 1 diagonals of the dynamic programme as bit vectors, one step a symbol (Hyyro 2003)."""
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    lit = lambda x: F.lit(x).cast("long")
    flip = lambda c: c.bitwiseXOR(lit(mask))
    n_p, n_t = F.size(p), F.size(t)
    start = F.struct(lit(mask ^ ((1 << threshold) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(threshold).alias("d"))
    # the vectors of one step are needed several times; nested one-element transforms bind them once
    bind = lambda x, f: F.transform(F.array(x), f)[0]

    def step(s: Column, i: Column) -> Column:
        c = F.get(F.col(t), i)
        match = lit(0)
        for k in range(width):
            at = i + (threshold - k)
            match = match.bitwiseOR(F.when((at >= 0) & (F.get(F.col(p), F.greatest(at, F.lit(0))) == c), lit(top >> k)).otherwise(lit(0)))

        def second(x: Column) -> Column:
            vp, vn, d0 = s["vp"], s["vn"], x["d0"]
            hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # on the diagonal until the pattern's end is in the band, then along the last row
            over = i - (n_p - threshold)
            bit = F.call_function("shiftright", lit(top), F.greatest(over + 1, F.lit(0)))
            diagonal = F.when(d0.bitwiseAND(lit(top)) == 0, 1).otherwise(0)
            along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["d"] + F.when(over < 0, diagonal).otherwise(along)).alias("d"),
            )

        def first(m: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(lit(mask))
            return bind(F.struct(d0.alias("d0")), second)

        return bind(match, first)

    return F.aggregate(F.sequence(F.lit(0), n_t - 1), start, step, lambda s: s["d"]) <= threshold


def words_of(c: str) -> Column:
    return F.split(c, " ")


def chars_of(c: str) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with computed columns behind a generator: predicates on them aren't pushed below it, so an expression is
    worked out once a row and not once for each time it is named."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def verified(pairs: DataFrame, a: str, b: str, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs of lines within ``threshold`` edits. What two lines have in common at their beginnings and ends doesn't
    count: the distance is that of what is left, a few symbols as a rule. The longer rest is the pattern."""
    names = pairs.columns
    pairs = fixed(pairs, _wa=words_of(a), _wb=words_of(b))
    long = (F.size("_wa") >= LONG) & (F.size("_wb") >= LONG)
    pairs = fixed(pairs, _sa=F.when(long, F.col("_wa")).otherwise(chars_of(a)), _sb=F.when(long, F.col("_wb")).otherwise(chars_of(b)))
    pairs = pairs.where(F.abs(F.size("_sa") - F.size("_sb")) <= threshold)
    least = F.least(F.size("_sa"), F.size("_sb"))

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda i, j: i.eqNullSafe(j)), False)
        return F.when(first > 0, first - 1).otherwise(least).cast("int")

    pairs = fixed(pairs, _at=common(F.col("_sa"), F.col("_sb")), _end=common(F.reverse("_sa"), F.reverse("_sb")))
    rest = lambda c: F.slice(c, F.col("_at") + 1, F.size(c) - F.col("_at") - F.least(F.col("_end"), least - F.col("_at")))
    pairs = fixed(pairs, _ra=rest("_sa"), _rb=rest("_sb"))
    longer = F.size("_ra") >= F.size("_rb")
    pairs = fixed(pairs, _x=F.when(longer, F.col("_ra")).otherwise(F.col("_rb")), _y=F.when(longer, F.col("_rb")).otherwise(F.col("_ra")))
    # a rest of so many symbols is as far away as it is long, at most
    near = F.when(F.size("_x") <= threshold, True).when(F.size("_y") == 0, False).otherwise(edit_distance_within("_x", "_y", threshold))
    return pairs.where(near).select(names)


def _moves(threshold: int) -> list[tuple[int, int, int]]:
    """(d, k, m): in a line longer by d than the indexed one, its segment k may stand moved by m places. Of all places
    those are left out that leave too many edits for the segments before it or behind it."""
    parts = threshold + 1
    return [(d, k, m) for d in range(parts) for k in range(parts) for m in range(max(-k, d - (parts - 1 - k)), min(k, d + parts - 1 - k) + 1)]


def _keyed(lines: DataFrame, threshold: int) -> DataFrame:
    """lines: _id, _no, _key. Returns a row _id, _no, _own, _k for each key: a hash of a segment, its number, and the length
    and unit of the indexed line. A line is indexed under its own keys (_own) and looks up all of them. A line of about
    LONG words may have a partner that is shorter than that, so it has keys of either unit."""
    words = fixed(lines.select("_id", "_no", "_key"), _words=words_of("_key"))
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    w = F.size("_words")
    units = F.array_compact(F.array(F.when(w < LONG + threshold, F.struct(F.lit(0).alias("u"), hashed(chars_of("_key")).alias("h"))), F.when(w >= LONG, F.struct(F.lit(1).alias("u"), hashed(F.col("_words")).alias("h")))))
    # the places to look at are a constant that is exploded: one expression makes all keys, and its code stays small
    places = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(m).alias("m")) for d, k, m in _moves(threshold)])
    low, parts, k = F.when(F.col("u") == 1, LONG).otherwise(threshold + 1), threshold + 1, F.col("k")
    rows = words.select("_id", "_no", F.inline(units)).select("_id", "_no", "u", "h", F.inline(places))
    rows = rows.withColumn("n", F.size("h") - F.col("d")).where((F.col("d") == 0) | (F.col("n") >= low))
    rows = rows.withColumn("size", F.call_function("div", F.col("n"), F.lit(parts)).cast("int")).withColumn("longer", F.col("n") - F.col("size") * parts)
    # the last segments are one longer
    start = F.col("size") * k + F.greatest(F.col("longer") - (parts - k), F.lit(0)) + F.col("m")
    here = F.col("size") + F.when(F.col("longer") >= parts - k, 1).otherwise(0)
    key = F.xxhash64(F.slice("h", start + 1, here), F.col("n") * parts + k, "u")
    return rows.select("_id", "_no", ((F.col("d") == 0) & (F.col("m") == 0)).alias("_own"), key.alias("_k"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("_id", F.split("_text", "\n", -1).alias("_lines"))


def _sketch(key: str) -> Column:
    """How often each of LETTERS stands in the line, five bits each (counts modulo 32)."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = (F.length(key) - F.length(F.replace(F.col(key), F.lit(c)))).cast("long").bitwiseAND(F.lit(31))
        out = out.bitwiseOR(F.shiftleft(n, 5 * k))
    return out


def _word_sketch(words: Column) -> Column:
    """The same of the words, dealt to as many classes by their hashes."""

    def add(acc: Column, word: Column) -> Column:
        at = (F.pmod(F.xxhash64(word), F.lit(len(LETTERS))) * 5).cast("int")
        one, mask = F.call_function("shiftleft", F.lit(1).cast("long"), at), F.call_function("shiftleft", F.lit(31).cast("long"), at)
        return acc.bitwiseAND(F.bitwise_not(mask)).bitwiseOR((acc.bitwiseAND(mask) + one).bitwiseAND(mask))

    return F.aggregate(words, F.lit(0).cast("long"), add)


def _apart(x: str, y: str) -> Column:
    """At least how many counts two sketches differ by; each edit changes two by one, at most."""
    out = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        of = lambda c, k=k: F.shiftright(F.col(c), 5 * k).bitwiseAND(F.lit(31))
        d = F.abs(of(x) - of(y))
        out = out + F.least(d, 32 - d)
    return out


def _sharing(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed: as _keyed gives it, stored. The look-ups (_id, _no, _k) that meet another line, and the index entries
    (_id2, _no2, _k) that they meet, both stored. Most lines share nothing with any other: two semi-joins find those
    that do, without a row for each pair."""
    stored = keyed.where("_own").select(F.col("_id").alias("_id2"), F.col("_no").alias("_no2"), "_k")
    p, t = keyed.select("_id", "_no", "_k").alias("p"), stored.alias("t")
    other = (F.col("p._id") != F.col("t._id2")) | (F.col("p._no") != F.col("t._no2"))
    asking = materialize(p.join(t.hint("shuffle_hash"), (F.col("p._k") == F.col("t._k")) & other, "left_semi"), "asking")
    return asking, materialize(stored.join(asking.select("_k").distinct().hint("shuffle_hash"), "_k", "left_semi"), "answers")


def _pairs(asks: DataFrame, answers: DataFrame, threshold: int, decided: bool = False) -> DataFrame:
    """Look-ups and index entries of one key, with sketches: the pairs (a_id, a_no, b_id, b_no), b before a, whose symbol
    counts leave so few edits possible. Only these become rows. decided: _g and _g2 say which lines are gone already."""
    later = (F.col("_id") > F.col("_id2")) | ((F.col("_id") == F.col("_id2")) & (F.col("_no") > F.col("_no2")))
    differ = (F.col("_id") != F.col("_id2")) | (F.col("_no") != F.col("_no2"))
    long = (F.col("_w") >= LONG) & (F.col("_w2") >= LONG)
    possible = F.when(long, _apart("_z", "_z2") <= 2 * threshold).otherwise(_apart("_s", "_s2") <= 2 * threshold)
    either = lambda c, x, y: F.when(c, F.col(x)).otherwise(F.col(y))
    if decided:
        possible = possible & ~F.when(later, F.col("_g")).otherwise(F.col("_g2"))
    return asks.join(answers, "_k").where(differ & possible).select(
        either(later, "_id", "_id2").alias("a_id"), either(later, "_no", "_no2").alias("a_no"), either(later, "_id2", "_id").alias("b_id"), either(later, "_no2", "_no").alias("b_no")
    ).distinct()


def _gone(keyed: DataFrame, pick: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """_id, _no of the lines that a line before them is near to. pick: (_id, _no, _key) of the given (_id, _no)."""
    asking, answers = _sharing(keyed)
    lines = materialize(asking.select("_id", "_no").union(answers.select("_id2", "_no2")).distinct(), "lines")
    words = fixed(pick(lines), _words=words_of("_key"))
    w = F.size("_words")
    seen = ["_w", "_s", "_z"]
    lines = materialize(words.select("_id", "_no", "_key", w.alias("_w"), F.when(w < LONG + threshold, _sketch("_key")).alias("_s"), F.when(w >= LONG, _word_sketch(F.col("_words"))).alias("_z")), "sketches")
    second = lines.select(F.col("_id").alias("_id2"), F.col("_no").alias("_no2"), *[F.col(c).alias(f"{c}2") for c in seen])
    asks = materialize(asking.join(lines.select("_id", "_no", *seen), ["_id", "_no"]), "asks")
    answers = materialize(answers.join(second, ["_id2", "_no2"]), "answers")
    discard(asking)

    def near(pairs: DataFrame) -> DataFrame:
        of = lambda x: lines.select(F.col("_id").alias(f"{x}_id"), F.col("_no").alias(f"{x}_no"), F.col("_key").alias(f"{x}_key"))
        with_texts = pairs.join(of("a"), ["a_id", "a_no"]).join(of("b"), ["b_id", "b_no"])
        return verified(with_texts, "a_key", "b_key", threshold).select(F.col("a_id").alias("_id"), F.col("a_no").alias("_no")).distinct()

    # the first line of each key against the others
    place = F.struct("_id2", "_no2", *[f"{c}2" for c in seen])
    heads = answers.groupBy("_k").agg(F.min(place).alias("m")).select("_k", "m.*")
    first = materialize(near(_pairs(asks, heads, threshold)), "gone")
    # lines that are left against all
    flag = lambda rows, i, n, g: rows.join(first.select(F.col("_id").alias(i), F.col("_no").alias(n), F.lit(True).alias(g)).hint("shuffle_hash"), [i, n], "left").withColumn(g, F.coalesce(g, F.lit(False)))
    return first.union(near(_pairs(flag(asks, "_id", "_no", "_g"), flag(answers, "_id2", "_no2", "_g2"), threshold, True)))


def kept_lines(texts: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """texts: _id, _text. Returns _id, _kept: the numbers of the judged lines that stay."""
    with scratch() as s:
        each = _lines(texts).select("_id", F.posexplode("_lines").alias("_no", "_line")).withColumn("_key", F.trim("_line")).where(F.length("_key") >= min_chars)
        # equal lines by 128 bits of hash; the combine in the scan leaves one row a task of a line however often it stands
        firsts = each.groupBy(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(7), "_key").alias("h2")).agg(F.min(F.struct("_id", "_no")).alias("m")).select("m.*")
        numbers = materialize(firsts.groupBy("_id").agg(F.collect_list("_no").alias("_nos")), "first-lines")

        def named(rows: DataFrame) -> DataFrame:
            """_id, _no, _key of the lines whose numbers stand in _nos."""
            rows = rows.select("_id", F.explode(F.transform("_nos", lambda i: F.struct(i.alias("_no"), F.trim(F.get("_lines", i)).alias("_key")))).alias("x"))
            return rows.select("_id", "x._no", "x._key")

        def pick(lines: DataFrame) -> DataFrame:
            """Ids and numbers of a measured size go to the scan of the texts; more meet them by the document's id."""
            asked = materialize(lines.groupBy("_id").agg(F.collect_list("_no").alias("_nos")), "asked")
            return named(_lines(texts).join(small(asked, "shuffle_hash"), "_id"))

        keyed = materialize(_keyed(named(_lines(texts).join(numbers.hint("shuffle_hash"), "_id")), threshold), "keys")
        gone = _gone(keyed, pick, threshold).groupBy("_id").agg(F.collect_set("_no").alias("_gone"))
        left = numbers.join(gone.hint("shuffle_hash"), "_id", "left").select("_id", F.when(F.col("_gone").isNull(), F.col("_nos")).otherwise(F.array_except("_nos", "_gone")).alias("_kept"))
        return s.keep(materialize(left, "kept-lines"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the repeated lines gone from ``text``, plus n_lines and n_dropped.

    Between documents only hashes and line numbers move; texts move to the partition of their own document.

    Defined results: null texts stay null with no lines; an empty text is one empty line and stays; lines under
    ``min_chars`` always stay, even if they repeat; a document may end up empty, it stays as a row. Ids are keys: rows that repeat one are
    judged as one document (each keeps the lines that the id keeps). Other columns pass unchanged, whatever their
    names."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & F.col("_id").isNotNull())
    kept = kept_lines(texts, threshold, min_chars)
    out = _lines(texts).join(kept.hint("shuffle_hash"), "_id", "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    short = F.filter(every, lambda i: F.length(F.trim(F.get("_lines", i))) < min_chars)
    left = F.array_sort(F.array_union(short, F.coalesce("_kept", F.array().cast("array<int>"))))
    out = out.select("_id", "_lines", left.alias("_left")).select("_id", F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n").alias("_text"), F.size("_lines").alias("_all"), F.size("_left").alias("_n"))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    new = [F.col("_all").cast("long").alias("n_lines"), (F.col("_all") - F.col("_n")).cast("long").alias("n_dropped")]
    if not rest:
        same = docs.where(F.col(text_col).isNull() | F.col(id_col).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
        return out.select(*[F.col("_id").alias(c) if c == id_col else F.col("_text").alias(c) for c in docs.columns], *new).unionByName(same)
    own = docs.select(F.col(id_col).alias("_key_id"), F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(rest)])
    joined = own.join(out.dropDuplicates(["_id"]), F.col("_key_id") == F.col("_id"), "left")
    names = {c: f"_c{k}" for k, c in enumerate(rest)}
    columns = [F.col("_key_id").alias(c) if c == id_col else F.when(~F.col("_null"), F.col("_text")).alias(c) if c == text_col else F.col(names[c]).alias(c) for c in docs.columns]
    zero = lambda c: F.when(F.col("_null"), 0).otherwise(c).cast("long")
    return joined.select(*columns, zero(F.coalesce("_all", F.lit(0))).alias("n_lines"), zero(F.coalesce(F.col("_all") - F.col("_n"), F.lit(0))).alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
