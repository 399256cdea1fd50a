"""What misheard number words may mean: a lattice of readings over a text's words, the verse ranges in it, and references
inferred from numbers near keywords.

A word may stand for several numbers, and two words for one, so each place of a text has a set of (value, next place). Ranges
are pairs of readings that follow each other up to a verse word, or stand around "по". All of it is arrays in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import bound
from lectern.operators.lookup import number_values
from lectern.sources.books import NUMBER_HINTS, number_words

VERSE, THROUGH, NOT = "стих", "по", "не"
#: How many words before a verse word a range may begin.
REACH = 5
_PAIRS = "array<struct<first: int, last: int>>"
_READINGS = "array<struct<value: int, next: int>>"


def token_values(tokens: Column) -> Column:
    """Of each token the numbers that it may stand for. A token that shares no first two letters with a number word has none
    and isn't compared with them."""
    beginnings = "|".join(sorted({w[:2] for w in [*NUMBER_HINTS, *number_words()]}))
    none = F.array().cast("array<int>")
    return F.transform(tokens, lambda t: F.when(t.rlike(rf"^(?:\d{{1,6}}$|{beginnings})"), number_values(t)).otherwise(none))


def phrase_readings(values: Column) -> Column:
    """The lattice: of each place the readings that begin there, as (value, next place). ``values``: see ``token_values``.

    One word is each of its values. Two words are also tens (20 to 50) with a unit, or two digits (2 to 5 before any)."""

    def at(values: Column, here: Column, i: Column) -> Column:
        units = F.filter(F.coalesce(F.get(values, i + 1), F.array().cast("array<int>")), lambda u: u.between(1, 9))
        tens = F.filter(here, lambda v: v.isin(20, 30, 40, 50) | v.between(2, 5))
        two = F.flatten(F.transform(tens, lambda v: F.transform(units, lambda u: F.struct(F.when(v < 10, v * 10 + u).otherwise(v + u).cast("int").alias("value"), (i + 2).cast("int").alias("next")))))
        one = F.transform(here, lambda v: F.struct(v.cast("int").alias("value"), (i + 1).cast("int").alias("next")))
        return F.array_sort(F.array_distinct(F.concat(one, two)))

    return bound(values, lambda every: F.transform(every, lambda here, i: at(every, here, i)))


def _readings(lattice: Column, place: Column) -> Column:
    """The readings at a place; none beside the text."""
    return F.when(place >= 0, F.coalesce(F.get(lattice, place), F.array().cast(_READINGS))).otherwise(F.array().cast(_READINGS))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a["value"].alias("first"), b["value"].alias("last"))


def _places(tokens: Column, word: str) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())


def ranges_before_verse(tokens: Column, lattice: Column) -> Column:
    """Pairs of readings that follow each other and end at a verse word, from REACH words before it on: array of (first,
    last), as they are read.

    None begins behind "не", nor where a reading from one word earlier ends at the same place with a greater value (it is
    the tail of that number).
    """

    return bound(F.struct(tokens.alias("w"), lattice.alias("l")), lambda x: _before_verse(x["w"], x["l"]))


def _before_verse(tokens: Column, lattice: Column) -> Column:
    def from_place(i: Column, end: Column) -> Column:
        shadowed = lambda a: F.exists(_readings(lattice, i - 1), lambda p: (p["next"] == a["next"]) & (p["value"] > a["value"]))
        starts = F.filter(_readings(lattice, i), lambda a: (a["next"] < end) & ~shadowed(a))
        starts = F.when((i > 0) & (F.get(tokens, i - 1) == NOT), F.array().cast(_READINGS)).otherwise(starts)
        return F.flatten(F.transform(starts, lambda a: F.transform(F.filter(_readings(lattice, a["next"]), lambda b: b["next"] == end), lambda b: _pair(a, b))))

    def to(end: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.greatest(end - REACH, F.lit(0)), end - 1), lambda i: from_place(i, end)))

    found = F.flatten(F.transform(F.filter(_places(tokens, VERSE), lambda i: i > 0), to))
    return F.array_distinct(found).cast(_PAIRS)


def ranges_around_through(tokens: Column, lattice: Column) -> Column:
    """Pairs of readings before and behind "по", where the text or a verse word follows the second: array of (first, last)."""

    return bound(F.struct(tokens.alias("w"), lattice.alias("l")), lambda x: _around_through(x["w"], x["l"]))


def _around_through(tokens: Column, lattice: Column) -> Column:
    def around(i: Column) -> Column:
        before = F.filter(F.concat(_readings(lattice, i - 2), _readings(lattice, i - 1)), lambda a: a["next"] == i)
        behind = F.filter(_readings(lattice, i + 1), lambda b: F.coalesce(F.get(tokens, b["next"]) == VERSE, F.lit(True)))
        return F.flatten(F.transform(before, lambda a: F.transform(behind, lambda b: _pair(a, b))))

    found = F.flatten(F.transform(F.filter(_places(tokens, THROUGH), lambda i: i > 0), around))
    return F.array_distinct(found).cast(_PAIRS)


def carried(pairs: Column, n: Column) -> Column:
    """The pairs as verse ranges of a chapter of ``n``: a unit behind a number of tens takes these tens over if that is a
    later verse. Pairs that aren't rising or leave the chapter go."""
    tens = lambda p: (F.floor(p["first"] / 10) * 10 + p["last"]).cast("int")
    over = lambda p: (p["last"] < 10) & (p["first"] >= 10) & (tens(p) > p["first"]) & (tens(p) <= n)
    ended = F.transform(pairs, lambda p: F.struct(p["first"].alias("first"), F.when(over(p), tens(p)).otherwise(p["last"]).alias("last")))
    return rising(ended, n)


def rising(pairs: Column, n: Column) -> Column:
    """The pairs that are verse ranges of a chapter of ``n``, each once."""
    return F.array_distinct(F.filter(pairs, lambda p: (p["first"] < p["last"]) & (p["first"] >= 1) & (p["last"] <= n)))


def fuzzy_ranges(norm: Column) -> Column:
    """(before, through) of a normalised text: the pairs of ``ranges_before_verse`` and of ``ranges_around_through``. Texts
    without a chapter word and one of the two words have none, and aren't read."""
    none = F.array().cast(_PAIRS)
    empty = F.struct(none.alias("before"), none.alias("through"))

    def read(tokens: Column) -> Column:
        return bound(bound(token_values(tokens), phrase_readings), lambda lattice: F.struct(ranges_before_verse(tokens, lattice).alias("before"), ranges_around_through(tokens, lattice).alias("through")))

    told = norm.contains("глава") & norm.rlike(rf"(?U)\b(?:{VERSE}|{THROUGH})\b")
    return F.when(told, bound(F.split(norm, " "), read)).otherwise(empty)


#: Patterns of verse numbers near keywords; two numbers are a range if they rise, else each for itself.
NEAR = (r"(\d+) стих", r"стих (\d+)\b(?! глава)", r"с (\d+) по (\d+) стих", r"с (\d+) стих по (\d+) стих", r"(\d+) и (\d+) стих", r"(\d+) (\d+) стих")


def keyword_numbers(norm: Column) -> Column:
    """(chapter, verses) from numbers near keywords: the last number before "глава" that a chapter can have, and the set of
    all verses that any of the patterns gives, ascending. Null and empty where there are none."""
    whole = lambda p, g: F.transform(F.regexp_extract_all(norm, F.lit(p), F.lit(g)), lambda x: x.try_cast("int"))
    chapter = F.try_element_at(F.filter(whole(r"(\d+) глава", 1), lambda c: c.between(1, 150)), F.lit(-1))
    sets = []
    for p in NEAR:
        if p.count("(\\d+)") == 1:
            sets.append(whole(p, 1))
        else:
            both = F.arrays_zip(whole(p, 1).alias("a"), whole(p, 2).alias("b"))
            sets.append(F.flatten(F.transform(both, lambda x: F.when((x["a"] < x["b"]) & (x["b"] - x["a"] <= 1000), F.sequence(x["a"], x["b"])).otherwise(F.array(x["a"], x["b"])))))
    return F.struct(chapter.alias("chapter"), F.array_sort(F.array_distinct(F.array_compact(F.concat(*sets)))).alias("verses"))


def inferred(norm: Column, book: Column, own_numbers: Column, sizes: Column) -> Column:
    """What a text without any reference candidate may still mean in its book: struct (chapter, first, last, kind) or null.

    Keywords go first (kind 1): the least and the greatest verse near them, the greatest only if the chapter has it. Without a
    chapter word, one number alone is a psalm (2), and of the first two or the last two numbers those that are a chapter and
    a verse of it, in this order or the other (3). ``own_numbers``: see ``reference_numbers``; ``sizes``: chapter to last verse.
    """
    size = lambda c: F.try_element_at(sizes, c)
    made = lambda c, v, e, kind: F.struct(c.cast("int").alias("chapter"), v.cast("int").alias("first"), e.cast("int").alias("last"), F.lit(kind).alias("kind"))
    k = F.transform(own_numbers, lambda y: y["value"])
    at = lambda i: F.try_element_at(k, F.lit(i))

    def near(said: Column) -> Column:
        verses = F.filter(said["verses"], lambda v: v > 0)
        first, last = F.array_min(verses), F.array_max(verses)
        held = first.isNotNull() & (first <= size(said["chapter"]))
        by_word = F.when(held, made(said["chapter"], first, F.when(last <= size(said["chapter"]), last).otherwise(first), 1))
        pairs = [F.when(at(b).between(1, size(at(a))), made(at(a), at(b), at(b), 3)) for a, b in ((1, 2), (2, 1), (-2, -1), (-1, -2))]
        psalm = F.when((book == "Псалтирь") & (F.size(k) == 1) & (size(at(1)) >= 1), made(at(1), F.lit(1), F.lit(1), 2))
        bare = F.coalesce(psalm, F.when(F.size(k) >= 2, F.coalesce(*pairs)))
        return F.when(said["chapter"].isNotNull() & (F.size(said["verses"]) > 0), by_word).when(said["chapter"].isNull(), bare)

    return bound(keyword_numbers(norm), near)


def best_of_book(candidates: DataFrame) -> DataFrame:
    """The best reference of each text whose book is known: that of the highest score, of these that with the most verses, of
    these the first. ``candidates``: utt_id, book, ord, score, c, v, e, ... (see ``reference_candidates``); adds n_verses."""
    n = F.when(F.col("d").isNull(), F.col("e") - F.col("v") + 1).otherwise(1)
    best = F.max_by(F.struct("ord", "score", "c", "v", "e", "d", n.alias("n_verses")), F.struct("score", n, -F.col("ord"), -F.col("start")))
    return candidates.groupBy("utt_id", "book").agg(best.alias("x")).select("utt_id", "book", "x.*")
