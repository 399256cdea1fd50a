"""Complete similarity join of quotes: no pair at or over the limit is lost, and nothing is compared that a bound rules out.

A pair is as similar as the likest of its units: the two whole texts, or a run of 4 to 8 query words and as many words at the
window's beginning. The units' matched characters M give the ratio 2M / S, S being the sum of their lengths. Three bounds on
M need no alignment: characters that both have; pairs of neighbouring characters that both have, since the M characters lie in
at most S - 2M + 1 blocks and each block of m has m - 1 such pairs; and the longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.search import SHORT, common_subsequence
from lectern.plans.held import Held
from lectern.ship import shipped

#: Words of the shortest and longest runs.
LEAST_RUN, MOST_RUN = 4, 8
#: Units and characters a block holds at most (but for a block of one unit).
UNITS, CHARACTERS = 1_000, 200_000
#: Lengths in one band differ by less than this factor.
BAND = 1.2
#: Classes that characters and pairs of characters are counted in; sharing a class only raises a bound.
SINGLE, DOUBLE = 32, 256
#: Bits of a text that say how often characters stand in it (a multiple of 64), and most times that they tell.
MARKS, LEVELS = 128, 12
#: Pairs whose counts are compared at a time.
STRIP = 50_000
#: Characters whose places are the bits of one machine word; most words of a text whose pairs are looked at together, and how
#: many pairs are; how many classes their characters have, and after how many characters pairs are looked through.
WORD, WORDS, TOGETHER, CLASSES, STEP = 64, 16, 8192, 128, 12


def _runs(text: Column, starts: bool) -> Column:
    """A text's units: kind (0: the whole, else a run's words) and unit. Of runs either all, or those at its beginning."""
    # Of runs at the beginning, words further on are left in one piece.
    w = F.split(text, " ", MOST_RUN + 1 if starts else -1)
    whole = F.array(F.struct(F.lit(0).alias("kind"), text.alias("unit")))
    sizes = F.when(F.size(w) >= LEAST_RUN, F.sequence(F.lit(LEAST_RUN), F.least(F.lit(MOST_RUN), F.size(w)))).otherwise(F.array().cast("array<int>"))

    def of_size(n: Column) -> Column:
        last = F.lit(1) if starts else F.size(w) - n + 1
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(n.alias("kind"), F.array_join(F.slice(w, i, n), " ").alias("unit")))

    return F.array_distinct(F.concat(whole, F.flatten(F.transform(sizes, of_size))))


def _blocked(units: DataFrame, held: Held) -> tuple[DataFrame, DataFrame]:
    """Distinct units as blocks (kind, band, part, units), and how many parts a band has (kind, band, parts, low, high)."""
    band = F.floor(F.log(BAND, F.length("unit"))).cast("int")
    distinct = held.write(units.select("kind", "unit").distinct().select("kind", "unit", band.alias("band")))
    size = F.length("unit").cast("long")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(UNITS)), F.ceil(F.sum(size) / F.lit(CHARACTERS)))
    bands = held.write(distinct.groupBy("kind", "band").agg(parts.cast("int").alias("parts"), F.min(size).alias("low"), F.max(size).alias("high")))
    # A band's units are dealt by hash. There are some hundred bands at most, whatever the number of units.
    dealt = distinct.join(F.broadcast(bands.select("kind", "band", "parts")), ["kind", "band"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"))
    return dealt.groupBy("kind", "band", "part").agg(F.collect_list("unit").alias("units")), bands


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and for each text how often characters, and pairs of neighbours, of each class stand in it."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    single = np.bincount(owner * SINGLE + codes % SINGLE, minlength=len(texts) * SINGLE).reshape(-1, SINGLE)
    inside = owner[:-1] == owner[1:]
    pairs = ((codes[:-1] * 31 + codes[1:]) % DOUBLE)[inside]
    double = np.bincount(owner[:-1][inside] * DOUBLE + pairs, minlength=len(texts) * DOUBLE).reshape(-1, DOUBLE)
    return lengths, single.astype(np.int32), double.astype(np.int32)


def _marked(*counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each side's texts (a column of counts each): MARKS bits, in rows of machine words, that say whether a class stands
    in a text at least so often; and how many characters have no bit. Of two texts, the bits that both have and the lesser
    rest are at least the characters that both have. Marks are those that tell the last side's texts apart best."""
    levels = np.arange(1, LEVELS + 1)
    held = [(c[:, None, :] >= levels[None, :, None]).reshape(SINGLE * LEVELS, -1) for c in counts]
    share = held[-1].mean(1)
    chosen = np.argsort(-share * (1 - share), kind="stable")[:MARKS]
    out = []
    for c, h in zip(counts, held):
        bits = np.packbits(h[chosen], axis=0, bitorder="little")
        words = np.ascontiguousarray(bits.T).view(np.uint64).T
        out.append((np.ascontiguousarray(words), (c.sum(0, dtype=np.int32) - h[chosen].sum(0, dtype=np.int32)).astype(np.int32)))
    return out


def _still(row: np.ndarray, left_size: np.ndarray, right_rest: np.ndarray) -> np.ndarray:
    """Most characters that the common subsequence of each pair may come to, when so much of its right text is still to come.
    Up to some place of the left text it lies in what was seen, and from there in what is to come; within a piece of places,
    the first part is at most what the piece's end has, the second what both texts have left from its beginning."""
    words, n = row.shape
    piece = WORD if words > 2 else WORD // 4
    ones = np.bitwise_count(row) if words > 2 else np.bitwise_count(row.view(np.uint16)).reshape(words, n, 4).transpose(0, 2, 1).reshape(-1, n)
    most, seen = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    for k, x in enumerate(ones):
        seen += piece - x
        np.maximum(most, seen + np.minimum(np.maximum(left_size - k * piece, 0), right_rest), out=most)
    return most


def _reach(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the longest common subsequence of each pair (i, j) may have ``need`` characters: the bit-parallel recurrence
    for many pairs at once, in as many machine words as the longest left text takes. Characters count by class, which only
    lengthens it. A pair goes as soon as what is left of its texts is too short."""
    n1, n2 = (np.array([len(t) for t in x], dtype=np.int32) for x in (left, right))
    words = -(-int(n1.max()) // WORD)
    classed = lambda x: np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) % CLASSES
    at = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    places = np.zeros((words, len(left) * (CLASSES + 1)), dtype=np.uint64)
    k = at(n1)
    np.bitwise_or.at(places, (k // WORD, np.repeat(np.arange(len(left)) * (CLASSES + 1), n1) + classed(left)), np.uint64(1) << (k % WORD).astype(np.uint64))
    classes = np.full((int(n2.max()), len(right)), CLASSES, dtype=np.int64)
    classes[at(n2), np.repeat(np.arange(len(right)), n2)] = classed(right)
    out = np.zeros(len(i), dtype=bool)
    for first in range(0, len(i), TOGETHER):
        own = np.arange(first, min(first + TOGETHER, len(i)))
        base, other, least, size, rest = i[own] * (CLASSES + 1), j[own], need[own], n1[i[own]], n2[j[own]]
        row = np.full((words, len(own)), 2**WORD - 1, dtype=np.uint64)
        for t, column in enumerate(classes, 1):
            where = base + column.take(other)
            carry = None
            for r, p in zip(row, places):
                met = r & p.take(where)
                total = r + met
                over = total < met if words > 1 else None
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if words > 1 else None
                r -= met
                r |= total
            if t % STEP == 0 or t == len(classes):
                may = _still(row, size, np.maximum(rest - t, 0)) >= least
                if not may.all():
                    own, base, other, least, size, rest, row = own[may], base[may], other[may], least[may], size[may], rest[may], np.ascontiguousarray(row[:, may])
                    if not len(own):
                        break
        out[own] = True
    return out


def alike(left: list[str], right: list[str], least: float) -> list[tuple[int, int, float]]:
    """Pairs of a left and a right text whose ratio times 100 is ``least`` or more, as numbers of the texts, with it."""
    share = least / 100
    (n1, single1, double1), (n2, single2, double2) = _counts(left), _counts(right)
    single1, single2 = (x.T.astype(np.int16 if x.max(initial=0) < 1000 else np.int32) for x in (single1, single2))
    (marks1, rest1), (marks2, rest2) = _marked(single1, single2)
    # Marks and what has none are at most MARKS and a left text's length together.
    small = np.uint8 if MARKS + n1.max() < 255 else np.int32
    rest1, rest2 = (np.minimum(x, n1.max()).astype(small) for x in (rest1, rest2))
    lengths, length = np.unique(n1, return_inverse=True)
    least_of = np.ceil(share * (lengths[:, None] + n2) / 2 - 1e-6)
    least_of = np.minimum(least_of, np.iinfo(small).max).astype(small)
    found: list[tuple[int, int, float]] = []
    matcher, at = SequenceMatcher(None), -1
    open_pairs, together = [], n1.max() <= WORD * WORDS
    size = max(1, STRIP // len(right))
    for first in range(0, len(left), size):
        rows = slice(first, first + size)
        most = np.minimum(rest1[rows, None], rest2[None, :])
        for mine, other in zip(marks1[:, rows], marks2):
            most += np.bitwise_count(mine[:, None] & other[None, :])
        i, j = np.nonzero(most >= least_of[length[rows]])
        i += first
        if n1.max() > WORD:
            # What the marks leave open, by all classes. In short texts hardly a character is without a mark.
            common = np.zeros(len(i), dtype=np.int32)
            for c in range(SINGLE):
                common += np.minimum(single1[c].take(i), single2[c].take(j))
            ok = common >= share * (n1[i] + n2[j]) / 2 - 1e-6
            i, j = i[ok], j[ok]
            if share > 2 / 3 and not together:
                ok = np.minimum(double1[i], double2[j]).sum(1) >= (1.5 * share - 1) * (n1[i] + n2[j]) - 1 - 1e-6
                i, j = i[ok], j[ok]
        open_pairs.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*open_pairs))
    if together and len(i):
        ok = _reach(left, right, i, j, share * (n1[i] + n2[j]) / 2 - 1e-6)
        i, j = i[ok], j[ok]
    order = np.argsort(j, kind="stable")
    places: dict[int, dict[str, int]] = {}
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if not together:
            if a not in places:
                places[a] = {}
                for k, c in enumerate(left[a]):
                    places[a][c] = places[a].get(c, 0) | 1 << k
            if common_subsequence(places[a], len(left[a]), right[b]) < share * (len(left[a]) + len(right[b])) / 2 - 1e-6:
                continue
        if b != at:
            matcher.set_seq2(right[b])
            at = b
        matcher.set_seq1(left[a])
        score = 100 * matcher.ratio()
        if score >= least:
            found.append((a, b, score))
    return found


def similar_all(queries: DataFrame, windows: DataFrame, least: float = 80.0) -> DataFrame:
    """All pairs whose similarity is at least ``least``: query_id, window_id, score, as comparing all with all would give.

    ``queries``: query_id, q, of which those of at least SHORT characters are searched for. ``windows``: window_id, norm.
    Null texts and empty windows are like nothing; rows that repeat an id and a text give one pair. Distinct units go in
    blocks of like length, and two blocks meet if their lengths allow the ratio; each meeting is a row of its own, so no
    length, common text or common beginning makes a large task. What meets grows with the product of both sides' distinct
    units: queries are to be a stated set, or windows a table of verses. Above a limit of 66.7 the bounds leave few pairs to
    be aligned; from there downwards most of like length.
    """
    held = Held(queries.sparkSession)
    # Written first: what texts are made by would else be worked out again for each of their runs.
    queries, windows = held.write(queries.select("query_id", "q")), held.write(windows.select("window_id", "norm"))
    asked = held.write(queries.where(F.length("q") >= SHORT).select("query_id", F.explode(_runs(F.col("q"), False)).alias("u")).select("query_id", "u.*").distinct())
    given = held.write(windows.where("norm <> ''").select("window_id", F.explode(_runs(F.col("norm"), True)).alias("u")).select("window_id", "u.*").distinct())
    (left, bands1), (right, bands2) = _blocked(asked, held), _blocked(given, held)
    a, b = (x.select("kind", *(F.col(c).alias(f"{c}{n}") for c in ("band", "parts", "low", "high"))) for x, n in ((bands1, 1), (bands2, 2)))
    ratio = least / (200 - least)
    meeting = F.broadcast(a.join(b, "kind").where((F.col("high2") >= F.col("low1") * ratio - 1e-6) & (F.col("low2") * ratio <= F.col("high1") + 1e-6)))
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"parts{n}") - 1))
    key = ["kind", "band1", "part1", "band2", "part2"]
    lefts = left.withColumnsRenamed({"band": "band1", "part": "part1", "units": "left"}).join(meeting, ["kind", "band1"]).withColumn("part2", part(2)).select(*key, "left")
    rights = right.withColumnsRenamed({"band": "band2", "part": "part2", "units": "right"}).join(meeting, ["kind", "band2"]).withColumn("part1", part(1)).select(*key, "right")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, one, other in zip(batch["kind"], batch["left"], batch["right"]):
                one, other = list(one), list(other)
                rows = [(kind, one[i], other[j], s) for i, j, s in alike(one, other, least)]
                yield pd.DataFrame(rows, columns=["kind", "asked", "given", "score"])

    met = shipped(lefts.join(rights, key).select("kind", "left", "right")).mapInPandas(compared, "kind int, asked string, given string, score double")
    pairs = met.join(asked.withColumnRenamed("unit", "asked"), ["kind", "asked"]).join(given.withColumnRenamed("unit", "given"), ["kind", "given"])
    return pairs.groupBy("query_id", "window_id").agg(F.max("score").alias("score"))
