"""Filter interaction audit: what each of five filters takes in every order in which they can be applied.

Counts of joint failures decide all of it. For a set S of filters, J(S) is the number of documents that fail every filter of
S: the sum of the products of their flags. From these 32 numbers

* inclusion and exclusion give what filters P leave: the sum over T in P of (-1)^|T| J(T);
* Möbius inversion over supersets gives the documents that fail the filters S and no other: the sum over T around S of
  (-1)^(|T|-|S|) J(T);
* the game "documents removed by P" has the Harsanyi dividends (-1)^(|T|+1) J(T), of which each filter in T gets an equal
  share as its Shapley value. Over all 120 orders the shares are whole numbers.

Texts are read once, for a narrow table of flags; all later steps move ids, hashes and counts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

FILTERS = "ABCDE"
#: White space between words, as a set of characters.
SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SETS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def text_failures(text: Column) -> Column:
    """Which of the filters A to D a text fails, as the sum of their bits (1, 2, 4, 8)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    few = F.size(words) < 50
    repeated = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    flags = (few, repeated, 100 * capitals.cast("long") > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _signed(j: Column, sets: list[tuple[int, int]]) -> Column:
    """The sum of the elements of ``j`` at some sets, each with a whole factor."""
    return _sum([j[t] * F.lit(f) if f != 1 else j[t] for t, f in sets])


def left_by(j: Column) -> Column:
    """For each set of filters, in order, how many documents pass all of them; ``j``: array of the 32 joint failures."""
    return F.array(*(_signed(j, [(t, (-1) ** t.bit_count()) for t in SETS if t & p == t]) for p in SETS))


def failing_exactly(j: Column, s: int) -> Column:
    """How many documents fail the filters of the set ``s`` and no other."""
    return _signed(j, [(t, (-1) ** (t ^ s).bit_count()) for t in SETS if t & s == s])


def shapley(j: Column, i: int) -> Column:
    """A filter's Shapley value times the number of orders, from its shares in the Harsanyi dividends."""
    return _signed(j, [(t, math.factorial(len(FILTERS)) // t.bit_count() * (-1) ** (t.bit_count() + 1)) for t in SETS if t >> i & 1])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents counted by what they fail and how they are labelled: part, mask, good, toxic, n.

    Filter E, a text that a smaller id has too, is found without bringing copies together: the least id of each text by its
    hash (SHA-256) comes out of an aggregation that sums up before it shuffles, and the one row that has both that text and
    that id does not fail.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_failures(text).cast("int").alias("mask"))
    facts = written(facts, "filter-facts")
    known = facts.where("key is not null")
    first = known.groupBy("h").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    judged = known.join(first, ["h", "key"], "left").join(marked, "key", "left")
    # A row without an id has no smaller one and no label.
    judged = judged.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "good", "toxic")
    judged = judged.unionByName(facts.where("key is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    return judged.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


def joint_failures(counted: DataFrame) -> DataFrame:
    """For each part the 32 joint failures of all, good and toxic documents: part, j, j_good, j_toxic (arrays by set)."""
    product = lambda s: F.when(F.col("mask").bitwiseAND(s) == s, F.col("n")).otherwise(F.lit(0))
    sums = {"j": lambda s: F.sum(product(s)), "j_good": lambda s: F.sum(F.when(F.col("good"), product(s)).otherwise(0)), "j_toxic": lambda s: F.sum(F.when(F.col("toxic"), product(s)).otherwise(0))}
    return counted.groupBy("part").agg(*(F.array(*(f(s) for s in SETS)).alias(name) for name, f in sums.items()))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters do to each part of ``docs``, in each order and at each step.

    A text fails A if it has under 50 words, B if under 65 of 100 words are distinct, C if over 5 of 100 characters are
    capitals (A-Z), D if it holds any of ``#$%&*|``, E if a smaller id has the same text anywhere in the table. Rows: part
    (null: empty), filter_order, step (1 to 5), and kept (after the step), removed (by it), redundant (failing its filter,
    but removed before), unique_fails (failing its filter alone), good_lost and toxic_lost (removed by it, so labelled),
    shapley (what its filter removes, summed over all orders); all of them long.

    A null text is the empty one. A row without an id never fails E and has no label; of rows that repeat the least id of a
    text none fails E. A label counts if any of an id's rows has it; other labels and null ones count for nothing. No rows
    give no parts.
    """
    parts = joint_failures(failures(docs, labels, id_col, text_col, part_col))
    bits = {c: 1 << i for i, c in enumerate(FILTERS)}
    steps = [(order, i + 1, sum(bits[c] for c in order[:i]), bits[order[i]]) for order in ORDERS for i in range(len(FILTERS))]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(p).alias("before"), F.lit(b).alias("bit")) for o, i, p, b in steps))
    by_filter = lambda f: F.array(*(f(i) for i in range(len(FILTERS))))
    j = F.col("j")
    x = parts.select(
        "part", "j", left_by(j).alias("left"), left_by(F.col("j_good")).alias("left_good"), left_by(F.col("j_toxic")).alias("left_toxic"),
        by_filter(lambda i: failing_exactly(j, 1 << i)).alias("alone"), by_filter(lambda i: shapley(j, i)).alias("share"),
    )
    x = x.select("*", F.explode(table).alias("s")).select("*", "s.*")
    at = lambda name, s: F.element_at(name, s + 1)
    after, before, bit = (F.col("before") + F.col("bit")), F.col("before"), F.col("bit")
    filter_no = F.log2(bit.cast("double")).cast("int")
    lost = lambda name: at(name, before) - at(name, after)
    return x.select(
        "part", "filter_order", "step", at("left", after).alias("kept"), lost("left").alias("removed"), (at("j", bit) - lost("left")).alias("redundant"),
        at("alone", filter_no).alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"), at("share", filter_no).alias("shapley"),
    )
