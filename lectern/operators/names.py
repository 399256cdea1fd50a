"""Books that a normalised transcript names: exact by an equi-join on word n-grams, misheard ones by similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_reference
from lectern.ship import shipped
from lectern.sources.books import GENERIC, aliases_table

CUTOFF = 0.78
LONGEST = 4


def variants(spark: SparkSession) -> DataFrame:
    """Normalised spoken names and the book of each: variant, book. A few hundred rows, whatever the input."""
    named = aliases_table(spark).select("book", normalize_reference(F.col("alias")).alias("variant"))
    forms = F.array("variant", F.replace("variant", F.lit("послание к "), F.lit("послание ")), F.replace("variant", F.lit("книга "), F.lit("")))
    out = named.select(F.explode(forms).alias("variant"), "book").where((F.col("variant") != "") & ~F.col("variant").isin(*GENERIC))
    return out.groupBy("variant").agg(F.max_by("book", F.struct(F.length("book"), "book")).alias("book"))


_known: dict[str, list[tuple[str, str]]] = {}


def known_names(spark: SparkSession) -> list[tuple[str, str]]:
    """The rows of ``variants``, sorted: a dimension of fixed size, made once in an application."""
    app = spark.sparkContext.applicationId
    if app not in _known:
        _known[app] = sorted((r["variant"], r["book"]) for r in variants(spark).collect())
    return _known[app]


def grams(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Word n-grams with character spans: the key utt_id, gram, start, end (the end is exclusive). ``texts``: utt_id, norm."""
    words = texts.select("utt_id", F.split("norm", " ").alias("w"))
    starts = F.transform("w", lambda _, i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1))
    placed = words.withColumn("s", starts)
    many = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("gram"), F.element_at("s", i).alias("start"))))))
    return placed.select("utt_id", many.alias("g")).select("utt_id", "g.gram", "g.start", (F.col("g.start") + F.length("g.gram")).alias("end"))


def alias_score(gram: Column) -> Column:
    """Score of a name that similarity doesn't look at: longer names count more."""
    return F.least(F.lit(1.0), F.lit(0.72) + F.length(gram) / 45)


def looked_at(gram: Column) -> Column:
    """Whether similarity looks at an n-gram: no general word, no reference keyword, no numbered letter without a name."""
    return ~gram.isin(*GENERIC) & ~gram.rlike(r"(?U)\b(глава|стих|псалом|пророка|паророка|парарока)\b") & ~gram.rlike(r"^([123] )?послание \d+$")


def _letters(words: list[str], alphabet: str) -> np.ndarray:
    """How often each character of the alphabet, or any other, stands in each word."""
    out = np.zeros((len(words), len(alphabet) + 1), np.int16)
    place = {c: i for i, c in enumerate(alphabet)}
    for row, w in zip(out, words):
        for c in w:
            row[place.get(c, -1)] += 1
    return out


def common_length(places: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text and a name of ``size`` characters, whose ``places`` are the bits at
    which it has each character."""
    rows = whole = (1 << size) - 1
    for c in text:
        here = rows & places.get(c, 0)
        rows = (rows + here | rows - here) & whole
    return size - rows.bit_count()


def best_similar(known: list[str]):
    """Arrow UDF: the known name most like a gram and their Ratcliff-Obershelp ratio, if at least CUTOFF.

    Spark has no such similarity. It is counted for pairs alone that two bounds leave open: two texts share no more than the
    lesser count of each character (a matter of arrays), and no more than their longest common subsequence, as matching blocks
    are one. Of equal ratios the last name wins.
    """
    where = [{c: sum(1 << i for i, x in enumerate(k) if x == c) for c in set(k)} for k in known]
    alphabet = "".join(sorted(set("".join(known))))

    @F.pandas_udf("struct<variant: string, ratio: double>")
    def similar(grams: pd.Series) -> pd.DataFrame:
        names, sizes = _letters(known, alphabet)[:, :-1], np.array([len(k) for k in known])
        rows: list[tuple] = []
        for at in range(0, len(grams), 2048):
            some = list(grams[at : at + 2048])
            counts = _letters(some, alphabet)[:, :-1]
            shared = np.zeros((len(some), len(known)), np.int32)
            for c in range(len(alphabet)):
                shared += np.minimum(counts[:, c, None], names[None, :, c])
            open_to = 2 * shared >= CUTOFF * (np.array([len(g) for g in some])[:, None] + sizes[None, :]) - 1e-9
            for g, row in zip(some, open_to):
                best = (0.0, "")
                matcher = SequenceMatcher()
                matcher.set_seq2(g)
                for i in np.flatnonzero(row):
                    if 2 * common_length(where[i], len(known[i]), g) < CUTOFF * (len(g) + len(known[i])) - 1e-9:
                        continue
                    matcher.set_seq1(known[i])
                    ratio = matcher.ratio()
                    if ratio >= CUTOFF:
                        best = max(best, (ratio, known[i]))
                rows.append((best[1], SequenceMatcher(None, g, best[1]).ratio()) if best[1] else (None, None))
        return pd.DataFrame(rows, columns=["variant", "ratio"])

    # Nondeterministic to the optimiser: it would count a filter of the result on every row in front of the aggregation.
    return similar.asNondeterministic()


def exact_candidates(every: DataFrame, table: DataFrame) -> DataFrame:
    """N-grams that are a name: utt_id, book, score, start, end, spoken. ``table``: variant, book, of a bounded number of rows."""
    score = F.when(looked_at(F.col("gram")), 1.0).otherwise(alias_score(F.col("gram")))
    return every.join(F.broadcast(table), F.col("gram") == F.col("variant")).select("utt_id", "book", score.alias("score"), "start", "end", F.col("gram").alias("spoken"))


def book_candidates(texts: DataFrame) -> DataFrame:
    """Candidates of each text: utt_id, book, score, start, end, spoken. ``texts``: utt_id, norm.

    Of a book and span the best score stays. A candidate around the exact name of another book goes.
    """
    spark = texts.sparkSession
    names = known_names(spark)
    table, known = spark.createDataFrame(names, "variant string, book string"), [v for v, _ in names]
    every = grams(texts).where("gram <> ''")
    exact = exact_candidates(every, table)
    longest = max(map(len, known), default=0)
    # Names have no digit but 1 to 5, so all others are alike to similarity, and n-grams with them are looked at once. A
    # native upper bound of the ratio goes first: letters, up to three spaces and one digit are all that a name can share.
    every = every.withColumn("like", F.translate("gram", "6789", "0000"))
    share = F.regexp_count("like", F.lit("[а-яa-z]")) + F.least(F.regexp_count("like", F.lit(" ")), F.lit(3)) + F.least(F.regexp_count("like", F.lit("[1-5]")), F.lit(1))
    # Whether similarity looks at an n-gram doesn't depend on these digits either, so tests come behind the aggregation.
    open_to = every.select("like").distinct().where(looked_at(F.col("like")) & F.col("like").rlike("[а-я]") & F.length("like").between(2, int(longest * (2 - CUTOFF) / CUTOFF) + 1) & (2 * share >= CUTOFF * (F.length("like") + share)))
    fuzzy = shipped(open_to).join(F.broadcast(table.select(F.col("variant").alias("like"))), "like", "left_anti").repartition(texts.sparkSession.sparkContext.defaultParallelism * 4, "like").withColumn("m", best_similar(known)("like")).where("m.variant is not null")
    fuzzy = fuzzy.select("like", "m.ratio", F.col("m.variant").alias("variant")).join(F.broadcast(table), "variant").select("like", "ratio", "book")
    near = every.join(fuzzy, "like").select("utt_id", "book", F.col("ratio").alias("score"), "start", "end", F.col("gram").alias("spoken"))
    best = Window.partitionBy("utt_id", "book", "start", "end").orderBy(F.desc("score"), "spoken")
    found = exact.unionByName(near).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return shadowed_out(found)


def shadowed_out(found: DataFrame) -> DataFrame:
    """Without inexact candidates whose span holds an exact one of another book."""
    sure = F.collect_list(F.when(F.col("score") >= 0.999, F.struct("book", "start", "end"))).over(Window.partitionBy("utt_id"))
    inside = lambda s: (s["book"] != F.col("book")) & (F.col("start") <= s["start"]) & (F.col("end") >= s["end"])
    return found.withColumn("sure", sure).where((F.col("score") >= 0.999) | ~F.exists("sure", inside)).drop("sure")


def family(book: Column) -> Column:
    """A book's name without its number, lower case."""
    return F.lower(F.trim(F.regexp_replace(book, r"^\d+\s+", "")))


def family_kept(found: DataFrame) -> DataFrame:
    """If a text says the number of a book, the others of its family go."""
    said = F.col("book").rlike(r"^[1234]\s") & F.col("spoken").rlike(r"^[1234]\s")
    with_family = found.withColumn("family", family(F.col("book")))
    only = F.max_by("book", F.when(said, F.struct(-F.col("score"), "start", "end"))).over(Window.partitionBy("utt_id", "family"))
    return with_family.withColumn("only", only).where(F.col("only").isNull() | (F.col("only") == F.col("book"))).drop("only")


def with_bonus(found: DataFrame) -> DataFrame:
    """Adds bonus: what makes a candidate specific among those of its family (columns as of ``family_kept``)."""
    group = Window.partitionBy("utt_id", "family")
    peers = F.collect_list(F.struct("book", "start", "end", F.length("spoken").alias("n"))).over(group)
    inside = lambda p: (p["start"] <= F.col("start")) & (p["end"] >= F.col("end")) & (p["n"] > F.length("spoken"))
    around = lambda p: (F.col("start") <= p["start"]) & (F.col("end") >= p["end"]) & (F.length("spoken") > p["n"])
    short = (F.col("family") == F.lower("book")) & (F.length("spoken") <= F.length("family") + 2)
    value = (
        F.when(F.col("spoken").rlike(r"^\d+\s"), 0.75).otherwise(0.0)
        + F.when(F.col("spoken").rlike("послание|евангелие|книга"), 0.3).otherwise(0.0)
        + F.least(F.lit(0.35), F.length("spoken") / 80)
        - 0.7 * F.size(F.filter("peers", inside))
        + 0.25 * F.size(F.filter("peers", around))
        - F.when(short & F.exists("peers", lambda p: p["book"] != F.col("book")), 0.85).otherwise(0.0)
    )
    return found.withColumn("peers", peers).withColumn("bonus", value).drop("peers")
