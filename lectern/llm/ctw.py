"""Language-model scores by context-tree weighting over bytes.

A text is its bytes, A-Z in lower case, and one end mark (0xFF, which UTF-8 never has); five of these marks stand before it
as context. A byte is eight binary decisions, so a context has a binary node for each beginning of the next byte. Each node
estimates its decision by Krichevsky and Trofimov's rule from what followed in training, and mixes that with the nodes of the
contexts that are one byte longer. In batch form the weights follow from block probabilities: a node's own estimate weighs
Pe / (Pe + product of the Pw of its longer contexts), and Pw is half that sum; at the greatest depth Pw is Pe. The context
that training has not seen takes the estimate that its longest seen part comes to, so each decision's two probabilities add
up to 1.

As Spark jobs: texts are dealt into blocks of bounded size; each block gives its distinct (context, byte) codes and words with
their counts in training. Counts are summed by code. The tree of contexts, the nearest byte first, is folded in three tiers
(depths 5 to 3, 3 to 1, 1 to 0) and weights go down again the same way, so that a task holds whole subtrees below three bytes
and below one byte. Each code's log-probability is then joined to the blocks that have it, and a block's texts meet the
values of that block alone. Nothing of the model is held whole anywhere but its nodes of depth 0 and 1 (65,280 at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, crc_bucket, mapped, shipped
from lectern.llm.jaccard import word_hashes

DEPTH = 5
#: Depths at which the tree is cut into tiers.
LOW, MID = 3, 1
MARK = b"\xff"
#: Bytes of text in a block: what one task counts and scores at once.
BLOCK_BYTES = 32 << 20
#: Positions that are looked at together, so that they stay in a core's cache; and codes that are sorted together.
SLICE, SORTED = 1 << 17, 1 << 20
#: Elements of a row of a block's counts, and rows that are sent together. Spark's Parquet reader takes 4,096 rows at once, so
#: what a task holds of them is bounded by the row, not by how large a file's row groups are.
ROW, ROWS = 1 << 9, 1 << 7
#: The end of a text as a token.
END = np.uint64(0x5EED0F7E77)
LOG2, LOG_PI = np.log(2), np.log(np.pi)

U = np.uint64


class Texts:
    """Some texts as one row of bytes, each between marks."""

    def __init__(self, texts: list[bytes]):
        self.texts = [t.lower() for t in texts]
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, code) for every byte and end mark; a code has the nearest context byte on top, and the byte
        itself at the bottom."""
        raw = np.frombuffer(b"".join(MARK * DEPTH + t + MARK for t in self.texts), np.uint8)
        starts = np.r_[0, np.cumsum(self.sizes + DEPTH)]
        for a in range(0, len(raw) - DEPTH, SLICE):
            part = raw[a : a + DEPTH + SLICE].astype(U)
            n = len(part) - DEPTH
            code = part[DEPTH:].copy()
            for k in range(1, DEPTH + 1):
                code |= part[DEPTH - k : DEPTH - k + n] << U(8 * (DEPTH - k + 1))
            # The byte of place i stands at a + DEPTH + i; marks before a text are no bytes of it.
            at = starts[(first := np.searchsorted(starts, a + DEPTH, "right") - 1) : np.searchsorted(starts, a + DEPTH + n, "left")] - a - DEPTH
            number = np.repeat(np.arange(first, first + len(at)), np.diff(np.r_[np.maximum(at, 0), n]))
            marks = (at[:, None] + np.arange(DEPTH)).ravel()
            inside = np.ones(n, bool)
            inside[marks[(marks >= 0) & (marks < n)]] = False
            yield number[inside], code[inside]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, hash) of all tokens, the ends among them."""
        hashes, ends = word_hashes(self.texts)
        number = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        return np.r_[number, np.arange(len(ends))], np.r_[hashes, np.full(len(ends), END)]


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct codes of sorted runs and the sum of each one's counts, in order, as parts of about SORTED codes: a range of
    codes after the other, so that only one range is sorted at a time."""
    longest = max(codes, key=len, default=np.zeros(0, U))
    parts = min(len(longest), -(-sum(map(len, codes)) // SORTED))
    cuts = longest[np.arange(1, parts) * len(longest) // parts] if parts > 1 else longest[:0]
    bounds = [np.r_[0, np.searchsorted(c, cuts), len(c)] for c in codes]
    for i in range(len(cuts) + 1):
        here = [slice(b[i], b[i + 1]) for b in bounds]
        if codes and (some := np.concatenate([c[h] for c, h in zip(codes, here)])).size:
            every, where = np.unique(some, return_inverse=True)
            yield every, np.bincount(where, np.concatenate([n[h] for n, h in zip(counts, here)]), len(every)).astype(np.int32)


class Counts:
    """Distinct codes of a block with their counts in training; those of other texts count 0."""

    def __init__(self) -> None:
        self.raw: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.waiting = 0
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.most = 4 * SORTED

    def add(self, codes: np.ndarray, train: np.ndarray) -> None:
        self.raw[0].append(codes[~train])
        self.raw[1].append(codes[train])
        self.waiting += len(codes)
        if self.waiting >= SORTED:
            self.sort()

    def sort(self) -> None:
        for learnt, raw in enumerate(self.raw):
            if raw:
                some, n = np.unique(np.concatenate(raw), return_counts=True)
                self.codes.append(some)
                self.counts.append((n * learnt).astype(np.int32))
                raw.clear()
        self.waiting = 0
        if sum(map(len, self.codes)) > self.most:
            parts = list(_merged(self.codes, self.counts))
            self.codes, self.counts = [np.concatenate([c for c, _ in parts])], [np.concatenate([n for _, n in parts])]
            # Merged again when as much has come as is there, so that all merging is linear but for a logarithm.
            self.most = max(4 * SORTED, 2 * len(self.codes[0]))

    def whole(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All codes in order with their counts, in parts."""
        self.sort()
        return _merged(self.codes, self.counts)


class Values:
    """Values by code. Most codes are found at one place of a table of hashes, the others by bisection."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift = U(64 - bits)
        self.place = np.zeros(1 << bits, np.int32)
        self.place[self._slot(self.codes)] = np.arange(len(codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return codes * U(0x9E3779B97F4A7C15) >> self.shift

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        at = self.place[self._slot(codes)]
        other = np.flatnonzero(self.codes[at] != codes)
        at[other] = np.searchsorted(self.codes, codes[other])
        return self.values[at]


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed cell."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(cells: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for cell in cells:
        yield from pa.ipc.open_stream(cell.as_buffer())


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts (key, held_out, body) dealt into blocks. Rows of a block: its texts, many in a cell; and rows of its
    codes (kind 0) and words (kind 1) with their counts."""
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("kind", pa.int8()), ("code", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    row = lambda **x: pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | x], schema=schema)
    block, size, counts = TaskContext.get().partitionId() << 24, 0, (Counts(), Counts())

    def counted() -> Iterator[pa.RecordBatch]:
        for kind, of in enumerate(counts):
            for codes, n in of.whole():
                for a in range(0, len(codes), ROW * ROWS):
                    some, k = codes[a : a + ROW * ROWS].view(np.int64), n[a : a + ROW * ROWS].astype(np.int64)
                    ends = np.r_[np.arange(0, len(some), ROW), len(some)].astype(np.int32)
                    size = len(ends) - 1
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (some, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.nulls(size, pa.binary()), pa.array(np.full(size, kind, np.int8)), *lists], schema=schema)

    for batch in batches:
        bodies, train = batch["body"].to_pylist(), ~np.array(batch["held_out"].to_pylist(), bool)
        a = 0
        while a < len(bodies):
            z = a
            while z < len(bodies) and size < block_bytes:
                size += len(bodies[z]) + 1
                z += 1
            texts = Texts(bodies[a:z])
            for number, code in texts.codes():
                counts[0].add(code, train[a:z][number])
            number, code = texts.words()
            counts[1].add(code, train[a:z][number])
            yield row(block=block, texts=packed(batch.slice(a, z - a)))
            a = z
            if size >= block_bytes:
                yield from counted()
                block, size, counts = block + 1, 0, (Counts(), Counts())
    yield from counted()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series eight further on."""
    down = np.ones_like(x)
    for i in range(8):
        down = down * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + np.log(2 * np.pi) / 2 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def block_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of Krichevsky and Trofimov's probability of a row of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - LOG_PI


def fold(key: np.ndarray, a: np.ndarray, b: np.ndarray, lw: np.ndarray, levels: int):
    """The nodes ``levels`` nearer to the root, and the levels on the way: (place of each node's parent, a, b, weight).

    A node's key is its context, nearest byte on top, and one byte for the beginning of the next byte.
    """
    way = []
    for _ in range(levels):
        key, parent = np.unique((key >> U(16)) << U(8) | key & U(255), return_inverse=True)
        kids = np.bincount(parent, lw, len(key))
        a, b = np.bincount(parent, a, len(key)), np.bincount(parent, b, len(key))
        own = block_probability(a, b)
        lw = np.logaddexp(own, kids) - LOG2
        way.append((parent, a, b, 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))))
    return key, a, b, lw, way


class Carry:
    """Of each node, what shorter contexts come to: the mixture so far, the share left, and the estimate if this context was
    not seen; all of a zero."""

    def __init__(self, mixed: np.ndarray, left: np.ndarray, stop: np.ndarray):
        self.mixed, self.left, self.stop = mixed, left, stop

    def past(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray | float) -> Carry:
        """After the nodes themselves."""
        zero = (a + 0.5) / (a + b + 1)
        return Carry(self.mixed + self.left * weight * zero, self.left * (1 - weight), np.where(a + b > 0, self.mixed + self.left * zero, self.stop))

    def at(self, place: np.ndarray) -> Carry:
        return Carry(self.mixed[place], self.left[place], self.stop[place])

    def down(self, way: list) -> Carry:
        """Before the nodes that ``fold`` began with."""
        out = self
        for parent, a, b, weight in reversed(way):
            out = out.past(a, b, weight).at(parent)
        return out


def leaves(codes: np.ndarray, counts: np.ndarray):
    """The nodes of the greatest depth: key, a, b; and the place of each code's eight nodes, and its decisions there."""
    context, byte = codes >> U(8), codes & U(255)
    keys = np.concatenate([context << U(8) | (U(1 << k) | byte >> U(8 - k)) for k in range(8)])
    one = np.concatenate([byte >> U(7 - k) & U(1) for k in range(8)]).astype(bool)
    key, place = np.unique(keys, return_inverse=True)
    n = np.tile(counts.astype(float), 8)
    return key, np.bincount(place, n * ~one, len(key)), np.bincount(place, n * one, len(key)), place, one


def _whole_groups(batches: Iterator[pa.RecordBatch], by: str = "root", least: int = 1 << 18) -> Iterator[pa.Table]:
    """The rows of a sorted partition in parts of at least ``least`` rows that end where a group ends."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        group = t[by].to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _ints(t: pa.Table, c: str) -> np.ndarray:
    return t[c].to_numpy().view(U) if t[c].num_chunks == 1 else t[c].combine_chunks().to_numpy().view(U)


def _reals(t: pa.Table, c: str) -> np.ndarray:
    return t[c].to_numpy().astype(float)


def _out(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c) for c in columns.values()], list(columns))


NODES = "key long, a double, b double, lw double"


def _low_up(batches):
    """Codes to nodes of depth LOW."""
    for t in _whole_groups(batches):
        key, a, b, _, _ = leaves(_ints(t, "code"), _reals(t, "n"))
        key, a, b, lw, _ = fold(key, a, b, block_probability(a, b), DEPTH - LOW)
        yield _out(key=key, a=a, b=b, lw=lw)


def _mid_up(batches):
    """Nodes of depth LOW to nodes of depth MID."""
    for t in _whole_groups(batches):
        key, a, b, lw, _ = fold(_ints(t, "key"), _reals(t, "a"), _reals(t, "b"), _reals(t, "lw"), LOW - MID)
        yield _out(key=key, a=a, b=b, lw=lw)


def _mid_down(top):
    """What nodes of depth LOW carry, from what those of depth MID carry (a broadcast: sorted keys, and three arrays)."""

    def run(batches):
        keys, *carried = top.value
        for t in _whole_groups(batches):
            key = _ints(t, "key")
            mid, _, _, _, way = fold(key, _reals(t, "a"), _reals(t, "b"), _reals(t, "lw"), LOW - MID)
            carry = Carry(*carried).at(np.searchsorted(keys, mid)).down(way)
            yield _out(key=key, mixed=carry.mixed, left=carry.left, stop=carry.stop)

    return run


def _low_down(batches):
    """Codes (n not null) and what their nodes of depth LOW carry, to log10 of each code's probability."""
    for t in _whole_groups(batches):
        real = t["n"].is_valid()
        codes, above = t.filter(real), t.filter(pc.invert(real))
        code = _ints(codes, "code")
        key, a, b, place, one = leaves(code, _reals(codes, "n"))
        low, _, _, _, way = fold(key, a, b, block_probability(a, b), DEPTH - LOW)
        keys = _ints(above, "code")
        order = np.argsort(keys)
        start = order[np.searchsorted(keys[order], low)]
        zero = Carry(*(_reals(above, c) for c in ("mixed", "left", "stop"))).at(start).down(way).past(a, b, 1.0).stop[place]
        value = np.log10(np.where(one, 1 - zero, zero)).reshape(8, -1).sum(0)
        yield _out(code=code, value=value)


def _by_root(df: DataFrame, root) -> DataFrame:
    return df.withColumn("root", root).repartition("root").sortWithinPartitions("root")


def code_values(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """log10 of the probability of each code's byte behind its context: code, value. ``counts``: code, n (0: not in training).

    Subtrees below LOW bytes of context have at most 256 ** (DEPTH - LOW + 1) codes, those below MID bytes 256 ** (LOW - MID)
    contexts; the nodes of depth MID, which go through the driver, are 255 for each of 256 bytes at most.
    """
    rooted = lambda df, column, depth, of: _by_root(df, F.shiftrightunsigned(column, 8 * (of - depth) + 8))
    low = scratch.write(mapped(rooted(counts, "code", LOW, DEPTH), _low_up, NODES), "ctw-low")
    mid = mapped(rooted(low, "key", MID, LOW), _mid_up, NODES).toPandas().sort_values("key")
    key, a, b, lw = mid["key"].to_numpy(np.int64).view(U), *(mid[c].to_numpy(float) for c in ("a", "b", "lw"))
    root, *_, way = fold(key, a, b, lw, MID)
    carry = Carry(np.zeros(len(root)), np.ones(len(root)), np.full(len(root), 0.5)).down(way)
    top = scratch.broadcast((key, carry.mixed, carry.left, carry.stop))
    carried = mapped(rooted(low, "key", MID, LOW), _mid_down(top), "key long, mixed double, left double, stop double")
    none = [F.lit(None).cast("double").alias(c) for c in ("mixed", "left", "stop")]
    # A node of depth LOW goes where the codes below it are: its context is a code's but for the bytes further off.
    rows = counts.select("code", "n", F.shiftrightunsigned("code", 8 * (DEPTH - LOW) + 8).alias("root"), *none)
    above = carried.select(F.col("key").alias("code"), F.lit(None).cast("long").alias("n"), F.shiftrightunsigned("key", 8).alias("root"), "mixed", "left", "stop")
    both = rows.unionByName(above).repartition("root").sortWithinPartitions("root")
    return scratch.write(mapped(both, _low_down, "code long, value double"), "ctw-values")


def _scored(id_type: pa.DataType, train_tokens: int, distinct: int):
    """Cogrouped: a block's texts and the values of its codes and words, to one row a text."""
    names = ["key", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        kinds = []
        for kind in (0, 1):
            some = values.filter(pc.equal(values["kind"], kind))
            kinds.append(Values(_ints(some, "code"), _reals(some, "value")))
        del values
        grams, words = kinds
        out = []
        for batch in unpacked(texts["texts"]):
            some = Texts(batch["body"].to_pylist())
            score = np.zeros(batch.num_rows)
            for number, code in some.codes():
                score += np.bincount(number, grams[code], batch.num_rows)
            number, code = some.words()
            c = words[code]
            n = np.bincount(number, minlength=batch.num_rows)
            base = np.bincount(number, np.log10(c + 1), batch.num_rows) - n * np.log10(train_tokens + distinct + 1)
            known = np.bincount(number, c > 0, batch.num_rows).astype(np.int64)
            arrays = [batch["key"], batch["held_out"], n, known, base, score, -score / np.log10(2) / some.sizes]
            out.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, types)], names))
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types))))

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Log10 probabilities of all texts under a context tree that learns from those whose id's crc32 modulo ``modulus`` is
    not ``held_out``.

    One row per input row: ``id_col``, held_out, n_tokens (words between ASCII white space, A-Z lower-cased, and the end),
    n_known (those that training has), train_tokens, base_score (each token by its count in training plus one), score (the
    tree's, of the lower-cased text and its end), bits_per_byte (the length of that code for each byte, the end counted). A null text is the empty one; null ids
    count as the empty text for the remainder, and rows that repeat count each for itself. Without training rows every byte
    costs eight bits and base_score is 0. Words are told apart by 64-bit hashes. The result reads tables of ``scratch``,
    which may be cleared once the result is written.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type, id_name = to_arrow_type(kind), kind.simpleString()
    base = docs.select(F.col(id_col).alias("key"), (crc_bucket(f"`{id_col}`", modulus) == held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    table = scratch.write(mapped(base, lambda batches: _blocks(batches, block_bytes), "block long, texts binary, kind byte, code array<long>, n array<long>"), "ctw-blocks")
    listed = table.where("kind is not null").select("block", "kind", F.explode(F.arrays_zip("code", "n")).alias("x")).select("block", "kind", "x.code", "x.n")
    counts = scratch.write(listed.groupBy("kind", "code").agg(F.sum("n").alias("n")), "ctw-counts")
    words = counts.where("kind = 1")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    grams = code_values(counts.where("kind = 0").select("code", "n"), scratch)
    values = grams.withColumn("kind", F.lit(0).cast("byte")).unionByName(words.select("code", F.col("n").cast("double").alias("value"), "kind"))
    told = scratch.write(listed.select("block", "kind", "code").join(values, ["kind", "code"]), "ctw-told")
    texts = table.where("kind is null").select("block", "texts")
    found = shipped(texts).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _scored(id_type, total["tokens"], total["distinct"])(a, b), f"key {id_name}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return found.select(F.col("key").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
