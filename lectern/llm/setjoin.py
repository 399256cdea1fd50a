"""Exact set similarity join on Jaccard with set-relation skipping, and the groups it links.

Sets of 64-bit token hashes link when ``den * |intersection| >= num * |union|``. The result is each set's group: the sets
that links connect. Steps, none of which meets a whole group or all pairs of one in a task:

1. Equal sets become one class.
2. Tokens have one global order: by the count of the bucket (of 2^20) that they fall into, rare first. Any fixed order
   makes prefixes complete; this one pushes passages that many documents share out of them.
3. The first ``n - ceil(t n) + 1`` tokens of each class are indexed, with their position. Of each token's list the
   first class is its leader, and the others are compared with leaders alone (a star for a clique).
4. Overlaps of set and leader are counted exactly. Linked stars make first groups.
5. A list whose sets all are in one group is skipped. The others are cut into blocks of entries of like size and position.
   A block is skipped as a whole where too little follows the shared token for any of its entries to link; it isn't even
   opened then. Up to ``LEADERS`` sets of such a list lead the next turn. Entries carry 128 parities of their set's tokens:
   where those of two sets differ, a token is in one of them alone, which bounds the overlap; pairs that this rules out never
   become rows.
6. What is left are pairs across groups, again of block with block. Near copies share many tokens; of these, entries carry
   those that stand before their own one, and a pair that shares one of them has been met there and makes no row here. Where both sets of a pair were counted against a
   common, highly similar leader R, the pair's overlap follows from what each differs from R by, without either set:
   |S and T| = |R| - |(R - S) or (R - T)| + |(S - R) and (T - R)|. For less similar leaders it is bounded,
   |S and T| <= min(|S and R|, |T and R|) + min(|S - R|, |T - R|). Only pairs that this, the sizes, the positions and the
   count of shared prefix tokens leave open are counted from their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mapped

BUCKETS = 1 << 20
#: Turns of comparison with leaders before pairs are compared, and leaders of a list after the first turn.
TURNS, LEADERS = 3, 16
#: Most entries of a block of an index list.
BLOCK = 128
#: How many of its set's earlier tokens an entry carries when pairs are made (twice as many where each has two keys).
EARLIER = 8

#: A set function: texts of an Arrow string array to one sorted array of distinct uint64 per text.
Sets = Callable[[pa.Array], list[np.ndarray]]


def least_overlap(n_x, n_y, num: int, den: int):
    """Smallest intersection of two linked sets, by their sizes: ceil(num (x + y) / (num + den))."""
    return (num * (n_x + n_y) + num + den - 1) // (num + den)


def _batches(x: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    return (x.slice(at, size) for at in range(0, x.num_rows, size))


#: Buckets that one row of packed counts holds.
SEGMENT = 1 << 12


def token_counts(texts: DataFrame, sets: Sets) -> np.ndarray:
    """How many tokens of all sets fall into each bucket. ``texts``: one column.

    A task sends its counts as compressed runs of SEGMENT buckets, which are added up by run.
    """
    import zlib

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for x in batches:
            for part in _batches(x):
                got = [s for s in sets(part.column(0)) if len(s)]
                if got:
                    total += np.bincount((np.concatenate(got) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        runs = [i for i in range(BUCKETS // SEGMENT) if total[i * SEGMENT : (i + 1) * SEGMENT].any()]
        # Eight planes of bytes, as the upper ones are zeros nearly everywhere.
        packed = [zlib.compress(np.ascontiguousarray(total[i * SEGMENT : (i + 1) * SEGMENT].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1) for i in runs]
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(packed, pa.binary())], names=["run", "packed"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT, np.int64)
        for x in batches:
            for v in x.column(1):
                total += np.ascontiguousarray(np.frombuffer(zlib.decompress(v.as_py()), np.uint8).reshape(8, -1).T).view("<i8")[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["run", "total"])

    counted = mapped(texts, count, "run int, packed binary").groupBy("run").applyInArrow(add, "run int, total binary").toArrow()
    out = np.zeros(BUCKETS, np.int64)
    for run, total in zip(counted.column("run").to_pylist(), counted.column("total")):
        out[run * SEGMENT : (run + 1) * SEGMENT] = np.frombuffer(total.as_py(), np.int64)
    return out


def _ordered(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens in the global order."""
    return tokens[np.lexsort((tokens, counts[(tokens % np.uint64(BUCKETS)).astype(np.int64)]))]


def _in_part(tokens: np.ndarray, part: int) -> np.ndarray:
    """Tokens as those of a partition, one to one."""
    x = (tokens ^ np.uint64(part)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29)) ^ np.uint64(part << 40)).view(np.int64)


#: The parities of a set, as two long columns, and which bits of a token say where it counts (not those of its bucket).
BITS, BITS_FROM = ("b1", "b2"), 40


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Of each of 128 places, whether an odd number of a set's tokens falls there; as two whole numbers."""
    odd = np.bincount((tokens >> np.uint64(BITS_FROM) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _apart(x1, x2, y1, y2):
    """At least how many tokens are in one of two sets alone, by their parities."""
    return F.bit_count(x1.bitwiseXOR(y1)) + F.bit_count(x2.bitwiseXOR(y2))


def _mark(tokens: np.ndarray) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def described(docs: DataFrame, sets: Sets, shared: Broadcast, num: int, den: int, columns: dict[str, str]) -> DataFrame:
    """Of each row the set's size n, its class (c1, c2: 128 bits of its hash), its parities and its prefix in the global order.

    ``docs``: ``columns`` (name to type), then body. An empty set has class 0, 0 and no prefix.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in _batches(x):
                got = sets(part.column(len(names)))
                marks = [_mark(s) if len(s) else (0, 0) for s in got]
                odd = np.array([_parities(s) for s in got], np.int64).reshape(-1, 2)
                heads = [_ordered(s, shared.value)[: len(s) - -(-num * len(s) // den) + 1] if len(s) else s for s in got]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array([len(s) for s in got], pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(odd[:, 0]), pa.array(odd[:, 1]), pa.array([h.view(np.int64) for h in heads], pa.list_(pa.int64()))],
                    names=[*names, "n", "c1", "c2", *BITS, "prefix"],
                )

    return mapped(docs, run, ", ".join([*(f"{k} {v}" for k, v in columns.items()), "n int, c1 long, c2 long, b1 long, b2 long, prefix array<long>"]))


def _keys(sizes: np.ndarray, prefixes: pa.Array, part_of: Callable[[int], int] | None) -> pa.Array:
    """What prefixes are indexed under: themselves, or, in partitions by size, their tokens in the set's part and those in the
    next. They are made where they are used, as they take twice the room of the prefixes."""
    if part_of is None:
        return prefixes
    heads = [p.values.to_numpy() for p in prefixes]
    return pa.array([np.concatenate([_in_part(h.view(np.uint64), part_of(n) + i) for i in (0, 1)]) for n, h in zip(sizes.tolist(), heads)], pa.list_(pa.int64()))


def _keyed(classes: DataFrame, part_of: Callable[[int], int] | None) -> DataFrame:
    """The keys of ``classes`` (c1, n, prefix): c, token."""
    if part_of is None:
        return classes.select(F.col("c1").alias("c"), F.explode("prefix").alias("token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in _batches(x, 1024):
                keys = _keys(part.column(1).to_numpy(), part.column(2), part_of)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.value_lengths().to_numpy())), keys.flatten()], names=["c", "token"])

    return mapped(classes.select("c1", "n", "prefix"), run, "c long, token long")


def _full_sets(docs: DataFrame, sets: Sets, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """c1 and the whole set, as packed 64-bit integers, of each of ``reps`` (c1, rep_key, rep_t). ``docs``: key, t, body.

    Sets are built for rows that a bit set of ``reps`` may hold; the join leaves those that it does.
    """
    bits = scratch.broadcast(_bit_set(reps.select(F.xxhash64("rep_key", "rep_t").alias("h"))))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            some = x.filter(pa.array(_in_bits(x.column(2).to_numpy(), bits.value)))
            for part in _batches(some):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in sets(part.column(3))], pa.binary())], names=["key", "t", "packed"])

    built = mapped(docs.select("key", "t", F.xxhash64("key", "t").alias("h"), "body"), run, f"key {kind}, t long, packed binary")
    return built.join(reps, F.col("t").eqNullSafe(F.col("rep_t")) & F.col("key").eqNullSafe(F.col("rep_key"))).select("c1", "packed").dropDuplicates(["c1"])


#: Sets of which the smaller shares at least this part (num / den) with the larger are highly similar: what they differ
#: by is kept with their overlap.
ALIKE = (3, 4)


def overlaps(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Exact intersection sizes: the columns of ``pairs`` (x, y, ...) and shared; and, of highly similar sets, what x has
    beside y (over) and y beside x (under), as packed integers. ``packed``: c1, packed."""
    names = pairs.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _batches(whole, 1024):
                shared, over, under = [], [], []
                for p, q in zip(b.column(len(names)), b.column(len(names) + 1)):
                    x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                    both = np.intersect1d(x, y, assume_unique=True)
                    alike = ALIKE[1] * len(both) >= ALIKE[0] * max(len(x), len(y))
                    shared.append(len(both))
                    over.append(np.setdiff1d(x, both, assume_unique=True).tobytes() if alike else None)
                    under.append(np.setdiff1d(y, both, assume_unique=True).tobytes() if alike else None)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(shared, pa.int32()), pa.array(over, pa.binary()), pa.array(under, pa.binary())], names=[*names, "shared", "over", "under"])

    left = packed.select(F.col("c1").alias("x"), F.col("packed").alias("p"))
    right = packed.select(F.col("c1").alias("y"), F.col("packed").alias("q"))
    return mapped(pairs.join(left, "x").join(right, "y").select(*names, "p", "q"), run, f"{kinds}, shared int, over binary, under binary")


def derived(pairs: DataFrame) -> DataFrame:
    """Exact overlaps of ``pairs`` (x, y, nx, ny) out of those with a leader: x, y, nx, ny, shared.

    Further columns: nr (the leader's size), and of each set what it has beside the leader (ox, oy) and the leader beside
    it (ux, uy).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = lambda name: [np.frombuffer(v.as_py(), np.uint64) for v in b.column(b.schema.get_field_index(name))]  # noqa: E731, B023
            found = [n - len(np.union1d(u, v)) + len(np.intersect1d(o, p, assume_unique=True)) for n, o, p, u, v in zip(b.column(4).to_pylist(), of("ox"), of("oy"), of("ux"), of("uy"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.int32())], names=["x", "y", "nx", "ny", "shared"])

    return mapped(pairs.select("x", "y", "nx", "ny", "nr", "ox", "oy", "ux", "uy"), run, "x long, y long, nx int, ny int, shared int")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (x, y): node and its group's root. Nodes without edges have no row.

    Each round ties a node to the least of its neighbours, by aggregation, and contracts the edges; as ids are hashes, the
    number of nodes falls by a constant factor a round. Each round is written to ``scratch``, and the one before it removed.
    """
    now = scratch.write(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    labels: DataFrame | None = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = scratch.write(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "links-least")
        last, before = now, labels
        if before is None:
            labels = least.select(F.col("x").alias("node"), F.col("m").alias("root"))
        else:
            labels = before.join(least.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root"))
        labels = scratch.write(labels, "links-labels")
        to_x, to_y = least.select("x", F.col("m").alias("mx")), least.select(F.col("x").alias("y"), F.col("m").alias("my"))
        now = now.join(to_x, "x").join(to_y, "y").where("mx <> my").select(F.greatest("mx", "my").alias("x"), F.least("mx", "my").alias("y")).distinct()
        now = scratch.write(now, "links")
        scratch.drop(last, before, least)
        if now.isEmpty():
            scratch.drop(now)
            return labels


def _bit_set(hashes: DataFrame) -> np.ndarray:
    """A bit set that holds every one of ``hashes`` (h, as many bits as eight a hash, 64 MB at most).

    It only saves shuffling rows that a join would drop; where it is too full to, the join drops them.
    """
    size = 1 << 16
    while size < min(8 * hashes.count(), 1 << 29):
        size *= 2
    # Not the lowest bits: those of tokens are their bucket, and prefixes hold the tokens of rare buckets.
    place = F.pmod(F.shiftrightunsigned("h", 20), F.lit(size))
    words = hashes.select(F.expr(f"cast(floor(shiftrightunsigned(h, 20) % {size} / 64) as int)").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _in_bits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes a bit set may hold."""
    place = (hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * len(bits))
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1).astype(bool)


def _maybe_among(rows: DataFrame, hashes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``rows`` whose h may be one of ``hashes``; without h."""
    bits = scratch.broadcast(_bit_set(hashes))
    names = [c for c in rows.columns if c != "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.select(names).filter(pa.array(_in_bits(x.column(x.schema.get_field_index("h")).to_numpy(), bits.value)))

    return mapped(rows.select(*names, "h"), run, rows.select(*names).schema)


def _entries(classes: DataFrame, repeated: DataFrame, part_of: Callable[[int], int] | None, scratch: Scratch) -> DataFrame:
    """The index keys that may occur more than once, with their place: token, c, n, pos, b1, b2. ``classes``: c1, n, the
    parities and the prefix."""
    times = 2 if part_of else 1
    bits = scratch.broadcast(_bit_set(repeated.select(F.col("token").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in _batches(x, 1024):
                lists = _keys(part.column(1).to_numpy(), part.column(4), part_of)
                sizes = lists.value_lengths().to_numpy()
                tokens, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
                row = np.repeat(np.arange(part.num_rows), sizes)
                pos = (np.arange(len(tokens)) - np.repeat(np.r_[0, ends[:-1]], sizes)) % np.maximum(1, np.repeat(sizes // times, sizes))
                hit = np.flatnonzero(_in_bits(tokens, bits.value))
                own = [pa.array(part.column(i).to_numpy()[row[hit]]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[hit]), *own[:2], pa.array(pos[hit], pa.int32()), *own[2:]], names=["token", "c", "n", "pos", *BITS])

    return mapped(classes, run, "token long, c long, n int, pos int, b1 long, b2 long")


def _blocks(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Index lists as blocks of up to BLOCK entries of like size: token, n0, n1 (least and greatest size), p0 (least position)
    and the entries (arrays c, n, pos, g, b1, b2, and maybe earlier). ``entries``: token, c, n, pos, g, b1, b2, and maybe
    earlier (array of tokens).

    g0 and g1 are the least and greatest group. Each task makes blocks of what it has of a list, so a long list may be dealt
    to many tasks.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / np.log(den / num)).cast("int")
    earlier = [c for c in entries.columns if c == "earlier"]
    ordered = entries.select("token", "c", "n", "pos", "g", *BITS, *earlier).withColumn("level", level).sortWithinPartitions("token", "level", "g", "pos", "c").drop("level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            token, c, n, pos, g, b1, b2 = (v.to_numpy() for v in x.columns[:7])
            if not len(token):
                continue
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            inside = np.arange(len(token)) - np.repeat(start, np.diff(np.r_[start, len(token)]))
            at = np.flatnonzero(inside % BLOCK == 0)
            offsets = pa.array(np.r_[at, len(token)], pa.int32())
            each = lambda f, v: pa.array(f.reduceat(v, at))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[at]), each(np.minimum, n), each(np.maximum, n), each(np.minimum, pos), each(np.minimum, g), each(np.maximum, g), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (c, n, pos, g, b1, b2)), *(pa.ListArray.from_arrays(offsets, v) for v in x.columns[7:])],
                names=["token", "n0", "n1", "p0", "g0", "g1", "c", "n", "pos", "g", *BITS, *earlier],
            )

    lists = "c array<long>, n array<int>, pos array<int>, g array<long>, b1 array<long>, b2 array<long>" + ", earlier array<array<long>>" * len(earlier)
    return mapped(ordered, run, f"token long, n0 int, n1 int, p0 int, g0 long, g1 long, {lists}")


def _opened(blocks: DataFrame, names: dict[str, str], *more: str, where: Callable | None = None) -> DataFrame:
    """The entries of blocks, under ``names`` (new ones, of c, n, pos and g); of those for which ``where`` holds, which is asked
    before they become rows."""
    entries = F.arrays_zip(*(F.col(v).alias(k) for k, v in names.items()))
    return blocks.select(*more, F.explode(F.filter(entries, where) if where else entries).alias("e")).select(*more, *(F.col(f"e.{k}").alias(k) for k in names))


def linked_groups(docs: DataFrame, sets: Sets, num: int, den: int, id_type: str, part_of: Callable[[int], int] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Groups of the sets of ``docs`` (key, body, and maybe tag, a long): one row per input row with key, n (set size), group
    (least non-null key of all rows that links reach; the own key for empty sets), links (exact ones that were counted), root
    (the group's own mark, null for empty sets) and tag. ``part_of``: see ``_keys``. The result reads tables of ``scratch``, which the caller may clear once it has written the result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    tag = [c for c in docs.columns if c == "tag"]
    docs = docs.select("key", *tag, "body", F.xxhash64("body").alias("t"))
    counts = token_counts(docs.select("body"), sets)
    rows = scratch.write(described(docs.select("key", "t", *tag, "body"), sets, scratch.broadcast(counts), num, den, {"key": id_type, "t": "long"} | dict.fromkeys(tag, "long")), "sets")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("key").alias("least"), F.min(F.struct("key", "t")).alias("rep"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in BITS), F.first("prefix").alias("prefix"))
    classes = scratch.write(classes, "classes")
    members = scratch.write(rows.select("key", "n", "c1", "c2", *tag), "members")
    scratch.drop(rows)
    lists = _keyed(classes, part_of).groupBy("token").agg(F.min("c").alias("head"), F.count("*").alias("size")).where("size > 1").select("token", "head")
    repeated = scratch.write(lists, "repeated")
    entries = scratch.write(_entries(classes.select("c1", "n", *BITS, "prefix"), repeated, part_of, scratch), "entries")
    heads = entries.select("token", F.col("c").alias("head"), F.col("n").alias("head_n"), F.col("pos").alias("head_pos"), *(F.col(b).alias(f"head_{b}") for b in BITS))
    lists = scratch.write(repeated.join(heads, ["token", "head"]), "lists")
    told = scratch.write(entries.join(lists, "token"), "entries-told")
    scratch.drop(repeated, lists, entries)

    def feasible(n0, n1, p0, m0, m1, q0):
        """Whether sizes from n0 to n1 and from m0 to m1, and first shared tokens from positions p0 and q0 on, allow a link.
        Of a linked pair the first token that both sets share is in both prefixes, so a pair may be judged by any of its
        tokens: one of them is the first."""
        return (den * n1 >= num * m0) & (den * m1 >= num * n0) & ((num + den) * F.least(n1 - p0, m1 - q0) >= num * (n0 + m0))

    def alike(n, m, *bits):
        """Whether parities allow a link of sets of sizes n and m: b1 and b2 of the one, then of the other."""
        return (num + den) * (n + m - _apart(*bits)) >= 2 * num * (n + m)

    link = (num + den) * F.col("shared") >= num * (F.col("nx") + F.col("ny"))

    def as_pairs(met: DataFrame) -> DataFrame:
        """Distinct pairs x > y of sets (c, n) and leaders (y, ny)."""
        first = F.col("c") > F.col("y")
        pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
        return met.select(pick("c", "y").alias("x"), pick("y", "c").alias("y"), pick("n", "ny").alias("nx"), pick("ny", "n").alias("ny")).distinct()

    counted: DataFrame | None = None
    groups: DataFrame | None = None
    packed: list[DataFrame] = []
    for turn in range(TURNS):
        # First one leader for each list, the same in all lists of a group of copies; then, in lists that still hold several
        # groups, up to LEADERS drawn anew each turn, so that a set meets many leaders of a group that one doesn't hold together.
        if groups is None:
            y, ny, py = F.col("head").alias("y"), F.col("head_n").alias("ny"), F.col("head_pos")
            stars = as_pairs(told.where("c <> head").where(feasible(F.col("n"), F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_n"), py)).where(alike(F.col("n"), F.col("head_n"), *(F.col(c) for c in ("b1", "b2", "head_b1", "head_b2")))).select("c", "n", y, ny))
            stars = scratch.write(stars, "stars")
        else:
            blocks = _mixed_blocks(told, groups, num, den, scratch)
            drawn = _opened(blocks, {"y": "c", "ny": "n", "py": "pos", "gy": "g", "y1": "b1", "y2": "b2"}, "token").withColumn("part", F.pmod(F.xxhash64("y", F.lit(turn)), F.lit(LEADERS)))
            drawn = drawn.groupBy("token", "part").agg(F.min(F.struct(F.xxhash64("y", F.lit(turn)).alias("h"), "y", "ny", "py", "gy", "y1", "y2")).alias("m"))
            heads = scratch.write(drawn.select("token", "m.y", "m.ny", "m.py", "m.gy", "m.y1", "m.y2"), "heads")
            near = blocks.withColumnsRenamed({"c": "cs", "n": "ns", "pos": "ps", "g": "gs", "b1": "s1", "b2": "s2"}).join(heads, "token").where("g0 <> gy or g1 <> gy")
            near = near.where(feasible(F.col("n0"), F.col("n1"), F.col("p0"), F.col("ny"), F.col("ny"), F.col("py")))
            may = lambda e: feasible(e["n"], e["n"], e["pos"], F.col("ny"), F.col("ny"), F.col("py")) & alike(e["n"], F.col("ny"), e["b1"], e["b2"], F.col("y1"), F.col("y2"))
            met = _opened(near, {"c": "cs", "n": "ns", "pos": "ps", "g": "gs", "b1": "s1", "b2": "s2"}, "y", "ny", where=lambda e: (e["g"] != F.col("gy")) & may(e))
            stars = scratch.write(as_pairs(met).join(counted.select("x", "y"), ["x", "y"], "left_anti"), "stars")
            scratch.drop(blocks, heads)
        new = _counted(_open_pairs(stars, classes, num, den, scratch), docs, classes, sets, packed, scratch, "star-overlaps")
        scratch.drop(stars)
        found = not new.where(link).isEmpty()
        if counted is None:
            counted = new
        else:
            both = scratch.write(counted.unionByName(new), "overlaps")
            scratch.drop(counted, new)
            counted = both
        if groups is not None and not found:
            break
        scratch.drop(groups)
        groups = components(counted.where(link).select("x", "y"), scratch)
    # Pairs across groups that share a token, block by block; lists of one group are skipped as a whole.
    blocks = _mixed_blocks(told, groups, num, den, scratch, EARLIER * (2 if part_of else 1))
    scratch.drop(told, groups)
    across = _met(blocks, feasible, alike).distinct()
    across = scratch.write(across.join(counted.select("x", "y"), ["x", "y"], "left_anti"), "across")
    scratch.drop(blocks)
    # What is known of both sets' overlap with a common leader, the first one's nearest, gives or bounds their own.
    one_way = lambda x, y, nr, over, under: counted.select(F.col(x).alias("x"), F.col(y).alias("r"), F.col(nr).alias("nr"), F.col("shared").alias("s"), F.col(over).alias("o"), F.col(under).alias("u"))
    known = scratch.write(one_way("x", "y", "ny", "over", "under").unionByName(one_way("y", "x", "nx", "under", "over")), "known")
    nearest = known.groupBy("x").agg(F.max_by(F.struct("r", "nr", F.col("s").alias("sx"), F.col("o").alias("ox"), F.col("u").alias("ux")), F.struct("s", "r")).alias("m")).select("x", "m.*")
    nearest = scratch.write(nearest.join(across.select("x").distinct(), "x", "left_semi"), "nearest")
    told_of = scratch.write(across.join(nearest, "x").join(known.select(F.col("x").alias("y"), "r", F.col("s").alias("sy"), F.col("o").alias("oy"), F.col("u").alias("uy")), ["y", "r"]), "told-of")
    exact = F.col("ox").isNotNull() & F.col("oy").isNotNull()
    bound = F.least("sx", "sy") + F.least(F.col("nx") - F.col("sx"), F.col("ny") - F.col("sy"))
    closed = exact | ((num + den) * bound < num * (F.col("nx") + F.col("ny")))
    followed = scratch.write(derived(told_of.where(exact)), "derived")
    open_pairs = scratch.write(across.join(told_of.where(closed).select("x", "y"), ["x", "y"], "left_anti"), "across-open")
    scratch.drop(across, known, nearest, told_of)
    more = _counted(_open_pairs(open_pairs, classes, num, den, scratch), docs, classes, sets, packed, scratch, "more-overlaps")
    every = counted.select("x", "y", "nx", "ny", "shared").unionByName(more.select("x", "y", "nx", "ny", "shared")).unionByName(followed)
    links = scratch.write(every.where(link).select("x", "y"), "all-links")
    scratch.drop(open_pairs, counted, more, followed, *packed)
    final = components(links, scratch)
    degree = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().groupBy(F.col("x").alias("c1")).agg(F.count("*").alias("links"))
    named = classes.select("c1", "c2", "least").join(final.withColumnRenamed("node", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    rooted = scratch.write(named, "named")
    roots = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("group")), "roots")
    named = scratch.write(rooted.join(roots, "root").join(degree, "c1", "left").select("c1", "c2", "root", "group", F.coalesce("links", F.lit(0)).alias("links")), "groups")
    scratch.drop(classes, links, final, rooted, roots)
    out = members.join(named, ["c1", "c2"], "left")
    return out.select("key", "n", F.coalesce("group", "key").alias("group"), F.coalesce("links", F.lit(0)).alias("links"), "root", *tag)


def _earlier(entries: DataFrame, most: int) -> DataFrame:
    """``entries`` (token, c, pos, ...) with earlier: of the tokens that the set has here, the last ``most`` in front of this
    one. All sets have their tokens in one order (keys that a token has in two parts, by themselves)."""
    before = Window.partitionBy("c").orderBy("pos", "token").rowsBetween(-most, -1)
    return entries.withColumn("earlier", F.collect_list("token").over(before))


def _mixed_blocks(told: DataFrame, groups: DataFrame, num: int, den: int, scratch: Scratch, earlier: int = 0) -> DataFrame:
    """The blocks of the lists that hold several groups. ``earlier``: how many tokens of these lists an entry carries along."""
    grouped = told.select("token", "c", "n", "pos", *BITS).join(groups.withColumnRenamed("node", "c"), "c", "left").select("token", "c", "n", "pos", F.coalesce("root", "c").alias("g"), *BITS)
    grouped = scratch.write(grouped, "grouped")
    mixed = scratch.write(grouped.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("token"), "mixed")
    entries = grouped.join(mixed, "token")
    if earlier:
        # Written, and joined anew: blocks are made where a list's entries are together.
        entries = scratch.write(_earlier(entries, earlier), "entries-earlier").join(mixed, "token")
    blocks = scratch.write(_blocks(entries, num, den), "blocks")
    scratch.drop(grouped, mixed)
    return blocks


def _met(blocks: DataFrame, feasible: Callable, alike: Callable) -> DataFrame:
    """Pairs of sets of different groups that share a token and may link: x > y, nx, ny. An entry carries only some of its
    set's earlier tokens, so a pair may come more than once."""
    a, b = (blocks.select("token", *(F.col(k).alias(k + side) for k in ("n0", "n1", "p0", "g0", "g1", "c", "n", "pos", "g", *BITS, "earlier"))) for side in "ab")
    near = a.join(b, "token").where("not (g0a = g1a and g0b = g1b and g0a = g0b)").where(feasible(F.col("n0a"), F.col("n1a"), F.col("p0a"), F.col("n0b"), F.col("n1b"), F.col("p0b")))
    # An entry of the one block with all of the other that it may link with, and then a row for each of these. A pair that
    # shares an earlier token met in that token's list, at places that more may follow.
    one, other = (F.arrays_zip(*(F.col(k + side).alias(k) for k in ("c", "n", "pos", "g", *BITS, "earlier"))) for side in "ab")
    fits = lambda e, o: (o["g"] != e["g"]) & (e["c"] > o["c"]) & feasible(e["n"], e["n"], e["pos"], o["n"], o["n"], o["pos"]) & alike(e["n"], o["n"], e["b1"], e["b2"], o["b1"], o["b2"]) & ~F.arrays_overlap(e["earlier"], o["earlier"])
    met = F.flatten(F.transform(one, lambda e: F.transform(F.filter(other, lambda o: fits(e, o)), lambda o: F.struct(e["c"].alias("x"), o["c"].alias("y"), e["n"].alias("nx"), o["n"].alias("ny")))))
    return near.select(F.explode(met).alias("e")).select("e.*")


def _open_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``pairs`` (x, y, nx, ny) that their prefixes leave open. Of two prefixes, one ends no later in the global order: its
    set shares with the other what the prefixes share and at most all that it has behind its own."""
    of_pairs = pairs.select(F.col("x").alias("h")).unionByName(pairs.select(F.col("y").alias("h"))).distinct()
    heads = _maybe_among(classes.select("c1", "prefix", F.col("c1").alias("h")), of_pairs, scratch)
    p = pairs.join(heads.select(F.col("c1").alias("x"), F.col("prefix").alias("px")), "x").join(heads.select(F.col("c1").alias("y"), F.col("prefix").alias("py")), "y")
    most = F.size(F.array_intersect("px", "py")) + F.greatest(F.col("nx") - F.size("px"), F.col("ny") - F.size("py"))
    return p.where((num + den) * most >= num * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny")


def _counted(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sets: Sets, packed: list[DataFrame], scratch: Scratch, label: str) -> DataFrame:
    """Pairs with exact overlaps, written. ``packed``: tables of the sets built so far; sets that they haven't yet are built,
    from one row's text each, and added."""
    pairs = scratch.write(pairs, "open-pairs")
    of_pairs = scratch.write(pairs.select(F.col("x").alias("c1")).unionByName(pairs.select(F.col("y").alias("c1"))).distinct(), "of-pairs")
    lacking = of_pairs
    for p in packed:
        lacking = lacking.join(p.select("c1"), "c1", "left_anti")
    reps = scratch.write(classes.select("c1", F.col("rep.key").alias("rep_key"), F.col("rep.t").alias("rep_t")).join(lacking, "c1", "left_semi"), "wanted")
    packed.append(scratch.write(_full_sets(docs, sets, reps, scratch), "packed"))
    held = packed[0]
    for p in packed[1:]:
        held = held.unionByName(p)
    held = held.join(of_pairs, "c1", "left_semi") if len(packed) > 1 else held
    out = scratch.write(overlaps(pairs, held), label)
    scratch.drop(pairs, of_pairs, reps)
    return out
