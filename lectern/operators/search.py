"""Verse search by quotation: exact, contained and similar windows of verses."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.plans.held import Held
from lectern.ship import shipped

SHORT, SHORTEST = 20, 5


def _hashes(words: Column) -> Column:
    """A hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _run_hashes(h: Column, n: int) -> Column:
    """A hash of each run of ``n`` words, of which ``h`` has the hashes: one step for each word and word of the run, without
    making the runs as texts."""
    out = h
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(h, F.lit(k), F.size(h)), lambda a, b: F.xxhash64(a, b))
    return F.slice(out, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))


def _holding(parts: DataFrame, wholes: DataFrame, width: int) -> DataFrame:
    """All pairs of which the one text holds the other, at any character: part_id, part, whole_id, whole.

    ``parts``: part_id, part. ``wholes``: whole_id, whole. A held text may begin and end inside a word of the other, so its
    words but the first and last stand there as they are: texts meet under a run of up to ``width`` of these. A text without
    such words is looked up by its first characters among those of the other. Both sides send hashes and ids; texts are joined
    to the pairs that meet.
    """
    words = parts.where(F.length("part") >= SHORTEST).select("part_id", "part", F.split("part", " ").alias("w"))
    inner = words.withColumn("size", F.greatest(F.least(F.lit(width), F.size("w") - 2), F.lit(0)))
    # What the parts ask for, width + 1 numbers at most: the wholes are looked at for these alone.
    sizes = sorted(r[0] for r in inner.select("size").distinct().collect())
    held = wholes.where(F.length("whole") >= SHORTEST)
    met = []
    if runs := [n for n in sizes if n]:
        first = F.coalesce(*(F.when(F.col("size") == n, F.get(_run_hashes(F.col("h"), n), F.lit(0))) for n in runs))
        keyed = inner.where("size > 0").select("part_id", "size", _hashes(F.slice("w", F.lit(2), F.col("size"))).alias("h")).select("part_id", first.alias("k"))
        places = held.select("whole_id", _hashes(F.split("whole", " ")).alias("h"))
        places = places.select("whole_id", F.explode(F.array_distinct(F.concat(*(_run_hashes(F.col("h"), n) for n in runs)))).alias("k"))
        met.append(keyed.join(places, "k").select("part_id", "whole_id"))
    if 0 in sizes:
        short = inner.where("size = 0").select("part_id", F.substring("part", 1, SHORTEST).alias("k"))
        bits = F.regexp_extract_all("whole", F.lit(f"(?=(.{{{SHORTEST}}}))"), F.lit(1))
        met.append(short.join(held.select("whole_id", F.explode(F.array_distinct(bits)).alias("k")), "k").select("part_id", "whole_id"))
    pairs = reduce(DataFrame.unionByName, met) if met else parts.select("part_id").crossJoin(wholes.select("whole_id")).where(F.lit(False))
    return pairs.distinct().join(parts, "part_id").join(wholes, "whole_id").where(F.col("whole").contains(F.col("part")))


def contained(queries: DataFrame, windows: DataFrame, width: int = 3) -> DataFrame:
    """Windows that hold a query: query_id, window_id, score (110 where they are equal, else 100).

    ``queries``: query_id, q. ``windows``: window_id, norm. Queries of under SHORTEST characters hold nowhere.
    """
    met = _holding(queries.select(F.col("query_id").alias("part_id"), F.col("q").alias("part")), windows.select(F.col("window_id").alias("whole_id"), F.col("norm").alias("whole")), width)
    return met.select(F.col("part_id").alias("query_id"), F.col("whole_id").alias("window_id"), F.when(F.col("part") == F.col("whole"), 110.0).otherwise(100.0).alias("score"))


def embedded(queries: DataFrame, windows: DataFrame, width: int = 3) -> DataFrame:
    """Windows that a query holds: query_id, window_id, q, norm. Windows of under SHORTEST characters are held nowhere."""
    met = _holding(windows.select(F.col("window_id").alias("part_id"), F.col("norm").alias("part")), queries.select(F.col("query_id").alias("whole_id"), F.col("q").alias("whole")), width)
    return met.select(F.col("whole_id").alias("query_id"), F.col("part_id").alias("window_id"), F.col("whole").alias("q"), F.col("part").alias("norm"))


def common_subsequence(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and a text of ``size`` characters that stand at ``places``."""
    full = (1 << size) - 1
    row = full
    for c in other:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


#: Classes that characters are counted in; sharing a class only raises a bound.
CLASSES = 64


def _counted(texts: list[str]) -> np.ndarray:
    """How often characters of each class stand in each text."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for n, t in enumerate(texts):
        out[n] = np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") % CLASSES, minlength=CLASSES)
    return out


@lru_cache(4096)
def _query_runs(q: str, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of ``size`` words of a text, their lengths and counts."""
    words = q.split()
    runs = list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))
    return runs, np.array([len(r) for r in runs]), _counted(runs)


def _similarity(q: str, w: str, least: float = 0.0) -> float:
    """See ``similarity``; any value under ``least`` where it is less than that.

    What matches is a common subsequence and no more than the characters that both have. Runs are taken by this bound, the
    likest first, and what can't be over the best so far isn't aligned.
    """
    words, ahead = q.split(), w.split()
    best = SequenceMatcher(None, q, w).ratio()
    floor = max(best, least / 100 - 1e-9)
    for size in range(4, min(8, len(words), len(ahead)) + 1):
        start = " ".join(ahead[:size])
        runs, lengths, counts = _query_runs(q, size)
        bounds = 2 * np.minimum(counts, _counted([start])).sum(1) / (lengths + len(start))
        likely = np.flatnonzero(bounds > floor)
        if not len(likely):
            continue
        places: dict[str, int] = {}
        for k, c in enumerate(start):
            places[c] = places.get(c, 0) | 1 << k
        matcher = SequenceMatcher(None)
        matcher.set_seq2(start)
        for i in likely[np.argsort(-bounds[likely], kind="stable")].tolist():
            total = len(runs[i]) + len(start)
            if bounds[i] <= floor:
                break
            if 2 * common_subsequence(places, len(start), runs[i]) <= floor * total:
                continue
            matcher.set_seq1(runs[i])
            best = max(best, matcher.ratio())
            floor = max(floor, best)
    return 100 * best


@F.pandas_udf(DoubleType())
def similarity(query: pd.Series, window: pd.Series) -> pd.Series:
    """100 x the Ratcliff-Obershelp ratio, or that of the best run of 4 to 8 query words with the window's beginning."""
    return pd.Series([_similarity(q, w) for q, w in zip(query, window)], dtype=float)


def similar(queries: DataFrame, windows: DataFrame, least: float = 45.0, shingle: int = 3) -> DataFrame:
    """Pairs that share a run of ``shingle`` words, with their similarity of at least ``least``: query_id, window_id, score.

    Sharing a run is an approximation that keeps the comparison from being every query with every window. Hashes and ids
    meet; texts are joined to the pairs, and each pair of texts is compared once, however many rows have them. Pairs are few
    bytes and much work: there are at least as many parts as cores. The result reads tables that end with the application.
    """
    spark = queries.sparkSession
    held = Held(spark)

    def keyed(rows: DataFrame, key: str, text: str) -> DataFrame:
        h = rows.select(key, _hashes(F.split(text, " ")).alias("h"))
        whole = F.array(F.xxhash64("h"))
        return h.select(key, F.explode(F.array_distinct(F.when(F.size("h") >= shingle, _run_hashes(F.col("h"), shingle)).otherwise(whole))).alias("k"))

    long = queries.where(F.length("q") >= SHORT)
    pairs = keyed(long, "query_id", "q").join(keyed(windows, "window_id", "norm"), "k").select("query_id", "window_id").distinct()
    texts = held.write(pairs.join(long.select("query_id", "q"), "query_id").join(windows.select("window_id", "norm"), "window_id"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Told to be nondeterministic, or the limit on it would be asked for in front of the repetition's removal as well.
    score = F.pandas_udf(lambda q, w: pd.Series([_similarity(a, b, least) for a, b in zip(q, w)], dtype=float), DoubleType()).asNondeterministic()
    scored = held.write(shipped(texts.select("q", "norm").distinct().repartition(n, "q", "norm")).withColumn("score", score("q", "norm")).where(F.col("score") >= least))
    return texts.join(scored, ["q", "norm"]).select("query_id", "window_id", "score")


def search_quotes(queries: DataFrame, windows: DataFrame, top: int = 5) -> DataFrame:
    """The best windows of each query: query_id, rank, window_id, score.

    A window that equals the query scores 110, one that holds it 100. Of the others, a query of under SHORT characters finds
    those that it holds and is like by 80 at least, a longer one those that it is like by 45 (see ``similar``).
    """
    held = Held(queries.sparkSession)
    queries, windows = held.write(queries.select("query_id", "q")), held.write(windows.select("window_id", "norm"))
    sure = contained(queries, windows)
    brief = embedded(queries.where(F.length("q").between(SHORTEST, SHORT - 1)), windows)
    brief = shipped(brief).withColumn("score", similarity("q", "norm")).where("score >= 80").select("query_id", "window_id", "score")
    other = brief.unionByName(similar(queries, windows)).join(sure.select("query_id", "window_id"), ["query_id", "window_id"], "left_anti")
    return best_windows(sure.unionByName(other), windows, top)


def best_windows(scored: DataFrame, windows: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` windows of each query: query_id, rank, window_id, score. Shorter windows, then earlier ones, go first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("norm"), "window_id")
    x = scored.join(windows.select("window_id", "norm"), "window_id")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "window_id", "score")
