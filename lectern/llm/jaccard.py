"""N-gram Jaccard join: groups of documents whose word shingles link, by set-relation skipping (see ``setjoin``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, written
from lectern.llm.setjoin import linked_groups

CHUNK = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A number for each byte, and an odd base with its inverse modulo 2**64, for rolling sums of words.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, _BASE, np.uint64)])
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, pow(_BASE, -1, 1 << 64), np.uint64)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: np.ndarray = _LOWER, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, in order, and after how many of them each text ends. Bytes count as ``lower``
    has them, and words are what those for which ``space`` holds separate; a line feed must be one of them."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    hashes, starts = [], []
    held, since = None, 0  # sum and start of the word that the last chunk ended in
    for a in range(0, len(raw), CHUNK):
        part = lower[raw[a : a + CHUNK]]
        gap = space[part]
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
        first, after = edge[::2], edge[1::2]
        sums = np.r_[np.uint64(0), np.cumsum(_BYTES[part] * _UP[: len(part)])]
        found, where = (sums[after] - sums[first]) * _DOWN[first], first + a
        if held is not None:
            if gap[0]:
                found, where = np.r_[held, found], np.r_[since, where]
            else:
                found[:1] = held + found[:1] * np.uint64(pow(_BASE, a - since, 1 << 64))
                where[0] = since
        held = None
        if not gap[-1]:
            held, since = found[-1:], int(where[-1])
            found, where = found[:-1], where[:-1]
        hashes.append(_mix(found))
        starts.append(where)
    ends = np.cumsum([len(t) + 1 for t in texts])
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(where, ends)


def shingle_sets(texts: pa.Array, size: int = 4) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``size`` words, or all words if they are fewer."""
    words, ends = word_hashes([(t.as_py() or "").encode() for t in texts])
    out = []
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            runs = _mix(runs + words[i : i + len(runs)] * np.uint64(2 * i + 3))
    at = 0
    for end in ends:
        n = end - at
        if n >= size:
            out.append(np.unique(runs[at : end - size + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for w in words[at:end]:
                h = _mix(h + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at = end
    return out


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Groups of documents that ``den * |intersection| >= num * |union|`` of their distinct word shingles links.

    One row per input row: ``id_col``, n_shingles (long), component_id (the least non-null id that links reach, the own
    one included) and links (long; how many verified links the document's set has). Words are what white space (ASCII)
    separates, A-Z lower-cased; a text of fewer than ``size`` words has all of them as its one shingle, a null or blank
    one has none and links with nothing. Rows without an id join groups by their text; they get the group's least id, if
    any. Rows that share an id need not share a text; each has its own text's group. Shingles are compared by 64-bit hashes.
    The result reads tables of ``scratch``, which may be cleared once the result is written.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    found = linked_groups(base, lambda x: shingle_sets(x, size), num, den, id_type, scratch=scratch)
    return found.select(F.col("key").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("group").alias("component_id"), F.col("links").cast("long").alias("links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but one of each group (see ``link_documents``).

    The row of the least id stays; one without an id only where no row of the group has one; of rows of that id with
    several texts in the group, one of the same text; of rows that are equal in id and text, any one. Rows are judged by
    their own text: a row stays if another row of its id goes. Rows without words are in no group and stay, all of them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    key, body = F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch(docs.sparkSession)
    found = linked_groups(docs.select(key, body.alias("body"), F.xxhash64(body).alias("tag")), lambda x: shingle_sets(x, size), num, den, id_type, scratch=scratch)
    members = written(found.where("n > 0").groupBy("key", "tag", "root").agg(F.count("*").alias("times")), "near-members")
    scratch.clear()
    best = members.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "tag")).alias("best"))
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("tag") == F.col("best.tag"))
    judged = written(members.join(best, "root").select("key", "tag", stays.alias("stays"), "times").where("not stays or times > 1"), "near-judged")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key, F.xxhash64(body).alias("tag"))
    of = lambda j: j.select(F.col("key").alias("k"), F.col("tag").alias("t"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t"))
    alone = rows.join(of(judged), same, "left_anti").select("row.*")
    repeated = rows.join(of(judged.where("stays")), same).groupBy("key", "tag").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(repeated)
