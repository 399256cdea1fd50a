"""SpotSigs fingerprints: chains of content words behind common-word anchors.

A signature is an anchor with the next ``CHAIN`` content words behind it, or as many as the text still has. Anchors are
common words, and the beginning of the text. A text's fingerprint is its set of signature hashes. Fingerprints are compared by Jaccard; near duplicates are found in partitions by set length, where sets whose
lengths alone rule a match out never meet, by the pruned exact join of ``setjoin``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mapped, written
from lectern.llm.jaccard import _mix, word_hashes
from lectern.llm.setjoin import linked_groups

CHAIN = 2
#: Most ranges that ids are dealt into; the driver holds an id for each.
MAX_PARTS = 1 << 14
#: Ids for each range, on average, that the driver looks at to choose where ranges end.
SAMPLED = 32
#: The common words of English, German, French and Spanish that anchor chains.
COMMON = frozenset(
    (
        "a an the of and to in is it that was for on with as by at from or be are this his her which not have had but "
        "der die das und in zu den mit von ist des im dem nicht ein eine als auch es an auf für sich "
        "le la les de des du et en un une que qui dans par pour est au sur pas plus ne se "
        "el los las y del al lo por con una su para como más o no se"
    ).encode().split()
)
#: All but letters, digits and what is not ASCII becomes a space; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORDS = {"lower": np.frombuffer(_TABLE, np.uint8), "space": np.arange(256) == 32}
_COMMON = np.sort(word_hashes(sorted(COMMON), **_WORDS)[0])
#: What stands for the beginning of a text, and for a word that a chain at its end lacks.
_BEGINNING, _LACKING = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _alone(text: bytes) -> np.uint64:
    """The signature of a text as a whole: of its words, or without any of the text itself."""
    words = text.translate(_TABLE).split()
    return np.frombuffer(hashlib.blake2b(b"= " + b" ".join(words) if words else b"\0" + text, digest_size=8).digest(), np.uint64)[0]


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct signature hashes of each text. A text without a common word has all its words as one signature
    besides; one without content words has these alone, and one without words the text itself."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, ends = word_hashes(raw, **_WORDS)
    common = _COMMON[np.minimum(np.searchsorted(_COMMON, words), len(_COMMON) - 1)] == words
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    content = np.flatnonzero(~common)
    upto = np.r_[0, np.cumsum(~common)]  # content words in front of each word
    first, last = upto[starts], upto[ends]  # each text's own, as numbers of content words
    # A chain begins at a common word, or in front of a text, and has the next content words of that text.
    anchors = np.flatnonzero(common)
    own = np.searchsorted(ends, anchors, side="right")
    at, until, links = np.r_[first, upto[anchors]], np.r_[last, last[own]], np.r_[np.full(len(texts), _BEGINNING), words[anchors]]
    owner = np.r_[np.arange(len(texts)), own]
    chained = at < until
    at, until, links, owner = at[chained], until[chained], links[chained], owner[chained]
    for k in range(CHAIN):
        there = at + k < until
        following = np.full(len(at), _LACKING)
        following[there] = words[content[at[there] + k]]
        links = _mix(links * np.uint64(2 * k + 3) + following)
    order = np.lexsort((links, owner))
    links, owner = links[order], owner[order]
    new = np.r_[True, (links[1:] != links[:-1]) | (owner[1:] != owner[:-1])][: len(links)]
    links, owner = links[new], owner[new]
    out = np.split(links, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []
    for i in np.flatnonzero((last == first) | (last - first == ends - starts)).tolist():
        out[i] = np.union1d(out[i], _alone(raw[i]))
    return out


def signatures(text: str) -> np.ndarray:
    """The signatures of one text."""
    return signature_sets([text])[0]


def printed(marks: np.ndarray) -> str:
    """A fingerprint as a string: 16 hex digits for each signature, in order."""
    return marks.astype(">u8").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 without counting where their lengths rule out ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint of each row's whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([printed(m) for m in signature_sets([t.as_py() or "" for t in part.column(1)])])], names=["key", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")), run, f"key {kind}, fingerprint string").withColumnRenamed("key", id_col)


def length_part(n: int, num: int, den: int) -> int:
    """The partition of a set of ``n`` signatures: part k begins at a length that no set of part k - 2 can match."""
    k, limit = 0, 1
    while limit < n:
        limit = max(limit + 1, limit * den // num)
        k += 1
    return k


def _groups(base: DataFrame, id_type: str, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Groups of the rows of ``base`` (key, tag, body) by their texts' fingerprints, which are made once: key, tag, group, links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m.tobytes() for m in signature_sets(part.column(2).to_pylist())], pa.binary())], names=["key", "tag", "body"])

    def sets(prints: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(p.as_py(), np.uint64) for p in prints]

    prints = scratch.write(mapped(base.select("key", "tag", "body"), run, f"key {id_type}, tag long, body binary"), "fingerprints")
    return linked_groups(prints, sets, num, den, id_type, lambda n: length_part(n, num, den), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """Groups of texts whose fingerprints have a Jaccard of at least num / den: ``id_col``, component_id, links.

    Sets are partitioned by length: a list of the index holds sets of one part and the next alone, as sets of parts
    farther apart can't match. Inside a part the join prunes by prefix, position and known overlaps. Null texts count as
    empty, and equal texts are one group. Ids may be null or repeat.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("key"), F.lit(0).cast("long").alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    found = _groups(base, id_type, num, den, Scratch(docs.sparkSession))
    return found.select(F.col("key").alias(id_col), F.col("group").alias("component_id"), F.col("links").cast("long").alias("links"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 4096, num: int = 80, den: int = 100) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text in the order of ids (after the last: the first).

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of the next one. One
    row per input row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    component_id, the group that ``near_duplicates`` has for the text. Ids may be of any type that has an order. Null texts
    count as empty; rows of equal id stand in an order by a hash of their texts, null ids before all others. An only row is
    its own next; an empty table gives no rows.

    Ids alone are looked at to deal rows into ranges of about ``rows_per_part``; the first row of each range goes to the
    range before as well, so that each task reads a run of rows and one more.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("tag", F.xxhash64("body"))
    scratch = Scratch(spark)
    groups = written(_groups(base, kind, num, den, scratch).select("key", "tag", "group").distinct(), "spotsigs-groups")
    scratch.clear()
    total = groups.count()
    n = min(max(1, total // rows_per_part), MAX_PARTS)
    # Where ranges end: from a bounded sample of ids, as it matters to their sizes alone.
    few = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 32)) < int(min(1.0, SAMPLED * n / max(1, total)) * (1 << 32))
    some = sorted(r["key"] for r in groups.where("key is not null").where(few).select("key").distinct().collect()) if n > 1 else []
    cuts = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []
    part = F.coalesce(_rank(F.col("key"), cuts, kind), F.lit(0)).cast("int").alias("part")
    dealt = base.select("key", "body", "tag", part)
    told = groups.select("key", F.lit(None).cast("string").alias("body"), "tag", part, F.lit(False).alias("peek"), F.lit(0).alias("kind"), "group")
    # Ids of the first row of each range, one small row for each.
    firsts = [(r["part"], r["least"], r["nulls"]) for r in groups.select("key", part).groupBy("part").agg(F.min("key").alias("least"), F.max(F.col("key").isNull()).alias("nulls")).orderBy("part").collect()]
    before = {p: firsts[i - 1][0] for i, (p, _, _) in enumerate(firsts)}
    lead = spark.createDataFrame([(p, None if nulls else least, before[p]) for p, least, nulls in firsts], f"part int, lead {kind}, to int")
    # At most MAX_PARTS rows, which bounds this broadcast.
    heads = dealt.join(F.broadcast(lead), "part").where(F.col("key").eqNullSafe(F.col("lead"))).groupBy("to", "key").agg(F.min(F.struct("tag", "body")).alias("m"))
    heads = heads.select("key", "m.body", "m.tag", F.col("to").alias("part"), F.lit(True).alias("peek"))
    group = F.lit(None).cast(kind).alias("group")
    runs = dealt.select("*", F.lit(False).alias("peek")).unionByName(heads).select("*", F.lit(1).alias("kind"), group).unionByName(told)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        group_of = None
        for whole in batches:
            types = [whole.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), whole.column(0).type]
            for first in range(0, whole.num_rows, 256):
                keys, texts, peeks, told = (c.to_pylist() for c in whole.slice(first, 256).columns)
                marks = iter(signature_sets([t for t in texts if t is not None]))
                pairs = []
                for key, text, ahead, group in zip(keys, texts, peeks, told):
                    if text is None:  # what follows are the rows of this id and text
                        group_of = group
                        continue
                    now = (key, text, next(marks), group_of)
                    if held is not None:
                        pairs.append((held, now))
                    held = None if ahead else now
                halves = [(t, len(t) // 2, ahead) for (_, t, _, _), (_, ahead, _, _) in pairs]
                edited = [t[: len(t) - half] + ahead[:half] for t, half, ahead in halves]
                rows = [
                    (k, len(t), hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest(), printed(m), printed(e), likeness(m, e), likeness(m, ahead), g)
                    for ((k, t, m, g), (_, _, ahead, _)), x, e in zip(pairs, edited, signature_sets(edited))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"])

    out = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id {kind}"
    # Order: by range, the row from the next range last; so a task may have many ranges.
    ordered = runs.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "peek", F.col("key").asc_nulls_first(), "tag", "kind", "body")
    return mapped(ordered.select("key", "body", "peek", "group"), compare, out).withColumnRenamed("key", id_col)


def _rank(key, cuts: list, kind: str):
    """How many of the sorted ``cuts`` are at or below the key, by halving a constant array of them."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*(F.lit(c).cast(kind) for c in cuts))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = key < F.element_at(listed, mid + 1)
        return F.when(at["lo"] >= at["hi"], at).when(below, pair(at["lo"], mid)).otherwise(pair(mid + 1, at["hi"]))

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.when(key.isNotNull(), F.aggregate(steps, pair(F.lit(0), F.lit(len(cuts))), halve, lambda at: at["lo"]))
