"""Byte-level BPE encoding and decoding with tree concatenation of long texts.

A text of up to ``piece_chars`` characters is encoded at once. A longer one is cut into pieces that executors encode
separately; neighbouring pieces are then joined, two and two, until one encoding is left: a task joins up to FAN
pieces of a text, and of a longer text another task joins what comes out of those. A join re-encodes a window around the seam that grows until both sides agree with
it exactly:

* Pre-tokens come from a left-to-right scan without look-behind. So the left side's pre-tokens hold but for the last one
  (and those that a special token across the seam may touch), and the scan of the window is in step with the right side
  from the first boundary that both have. The window grows until such a boundary is found.
* A pre-token that spans the seam has two encoded halves. A token row is the BPE encoding of its bytes exactly when each
  two neighbouring tokens are, as merges act by rank and inside tokens until the first that crosses a boundary. So the
  last k tokens of one half and the first k of the other are encoded anew, k doubling until the outermost tokens on
  both sides are the old ones again.

Pieces are cut anywhere, so that words, runs without white space and special tokens may cross a seam.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mapped, release

PIECE_CHARS = 32_768
#: Neighbouring pieces that one task joins, two and two, before another task joins what came out of all of them.
FAN = 64

#: The pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OUT_FIELDS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


class Encoded(NamedTuple):
    """A text, its ids, and of each pre-token (or special token) the characters and the ids it has."""

    text: str
    ids: np.ndarray
    chars: np.ndarray
    counts: np.ndarray


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def load(vocabulary: str) -> Codec:
    return Codec(vocabulary)


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library, with fast paths for plain text and for decoding."""

    def __init__(self, vocabulary: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.scan = self.library.pre_tokenizer.pre_tokenize_str
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.reach = max(map(len, self.special), default=1)
        # The byte-to-character table of byte-level BPE: printable characters stand for themselves, others follow from 256.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.char_of = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
        byte_of = {c: b for b, c in self.char_of.items()}
        self.token_bytes = {i: bytes(byte_of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        plain = {b: i for i, b in self.token_bytes.items() if not (i in self.special.values())}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.word = functools.lru_cache(maxsize=1 << 16)(self._word)
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})

    def whole(self, text: str) -> list[int]:
        """Ids of a text, special tokens recognised."""
        if not self.special or not any(s in text for s in self.special):
            return self.plain.encode_ordinary(text)
        ids: list[int] = []
        for part in self.split.split(text):
            if part:
                ids += [self.special[part]] if part in self.special else self.plain.encode_ordinary(part)
        return ids

    def encoded(self, text: str) -> Encoded:
        """Encoding with the extent of each pre-token."""
        ids: list[int] = []
        chars: list[int] = []
        counts: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
                chars.append(len(part))
                counts.append(1)
            elif part:
                for _, (a, b) in self.scan(part):
                    got = self.word(part[a:b].encode())
                    ids += got
                    chars.append(b - a)
                    counts.append(len(got))
        return Encoded(text, np.array(ids, np.int32), np.array(chars, np.int64), np.array(counts, np.int64))

    def _word(self, raw: bytes) -> tuple[int, ...]:
        """BPE of bytes as one pre-token, which need not be whole characters."""
        return tuple(t.id for t in self.library.model.tokenize("".join(map(self.char_of.__getitem__, raw))))

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def seam_word(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a pre-token from those of its two halves."""
        k = 2
        while True:
            x, y = left[-k:], right[:k]
            got = self.word(b"".join(self.token_bytes[i] for i in (*x, *y)))
            if (k >= len(left) or got[0] == x[0]) and (k >= len(right) or got[-1] == y[-1]):
                return [*left[: max(0, len(left) - k)], *got, *right[k:]]
            k *= 2

    def joined(self, a: Encoded, b: Encoded) -> Encoded:
        """Encoding of two neighbouring texts' concatenation."""
        if not a.text or not b.text:
            return b if not a.text else a
        ends_a, ends_b = np.cumsum(a.chars), np.cumsum(b.chars)
        ids_a, ids_b = np.cumsum(a.counts), np.cumsum(b.counts)
        # Left of `keep` nothing can change: all but the last pre-token and those within one character of where a special token across the seam may begin.
        keep = min(len(a.chars) - 1, int(np.searchsorted(ends_a, len(a.text) - self.reach - 1, "right")))
        start = int(ends_a[keep - 1]) if keep else 0
        grow = 1
        while True:
            take = min(len(b.chars), grow)
            stop = int(ends_b[take - 1])
            window = a.text[start:] + b.text[:stop]
            cuts = self.boundaries(window)
            seam = len(a.text) - start
            if take == len(b.chars):
                agreed, skip = len(window), take
                break
            # Boundaries before the window's last pre-token, past what a special token across the seam can reach.
            sound = set(cuts[:-2])
            found = [(int(ends_b[j]) + seam, j + 1) for j in range(take - 1) if ends_b[j] >= min(self.reach, len(b.text)) and int(ends_b[j]) + seam in sound]
            if found:
                agreed, skip = found[0]
                break
            grow *= 2
        chars: list[int] = []
        counts: list[int] = []
        ids: list[int] = []
        at = 0
        for cut in cuts:
            if cut > agreed:
                break
            piece = window[at:cut]
            if piece in self.special:
                got = [self.special[piece]]
            elif at < seam < cut and at + start == (int(ends_a[-2]) if len(ends_a) > 1 else 0) and cut == seam + int(ends_b[0]):
                got = self.seam_word(a.ids[len(a.ids) - int(a.counts[-1]) :].tolist(), b.ids[: int(b.counts[0])].tolist())
            else:
                got = self.word(piece.encode())
            ids += got
            chars.append(cut - at)
            counts.append(len(got))
            at = cut
        first, last = (int(ids_a[keep - 1]) if keep else 0), int(ids_b[skip - 1])
        return Encoded(
            a.text + b.text,
            np.concatenate([a.ids[:first], np.array(ids, np.int32), b.ids[last:]]),
            np.concatenate([a.chars[:keep], np.array(chars, np.int64), b.chars[skip:]]),
            np.concatenate([a.counts[:keep], np.array(counts, np.int64), b.counts[skip:]]),
        )

    def boundaries(self, text: str) -> list[int]:
        cuts: list[int] = []
        at = 0
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                cuts.append(at + len(part))
            elif part:
                cuts += [at + e for _, (_, e) in self.scan(part)]
            at += len(part)
        return cuts

    def tree(self, pieces: list[Encoded]) -> Encoded:
        """One encoding out of neighbouring ones, joined two and two."""
        while len(pieces) > 1:
            pieces = [self.joined(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0]


def _row(codec: Codec, ids, columns: list[str]) -> dict:
    got: dict = {"n_tokens": len(ids)}
    if "ids" in columns:
        got["ids"] = ids
    if "ids_sha256" in columns:
        got["ids_sha256"] = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    if "decoded" in columns or "decoded_sha256" in columns:
        text = codec.decode(ids)
        got |= {"decoded": text, "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return got


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids"), piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encode (and decode again) every whole text.

    One row per input row: ``id_col`` and ``columns``, of n_tokens, ids, decoded, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256. A null text counts as empty: no ids, an empty decoded text. Null and
    repeated ids are kept, each row for itself; an empty table gives no rows. Other columns are left out, whatever their names. ``vocabulary`` is the
    path of a vocabulary file, the same on every executor.
    """
    vocabulary, wanted = vocabulary or default_vocabulary(), list(columns)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    out = ", ".join([f"key {id_type}", *(f"{c} {OUT_FIELDS[c][0]}" for c in wanted)])

    def batch(keys: pa.Array, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array([r[c] for r in rows], OUT_FIELDS[c][1]) for c in wanted)], names=["key", *wanted])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                yield batch(part.column(0), [_row(codec, codec.whole(t.as_py()), wanted) for t in part.column(1)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for key, text in zip(x.column(0), x.column(1)):
                t = text.as_py()
                mark = hashlib.blake2b(repr(key.as_py()).encode() + b"\0" + t.encode(), digest_size=16).hexdigest()
                n = -(-len(t) // piece_chars)
                for at in range(0, n, 64):
                    some = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([mark] * len(some)), pa.array([key.as_py()] * len(some), x.column(0).type), pa.array(some, pa.int32()), pa.array([t[i * piece_chars : (i + 1) * piece_chars] for i in some])],
                        names=["mark", "key", "no", "piece"],
                    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for x in batches:
            for at in range(0, x.num_rows, 8):
                part = x.slice(at, 8)
                yield encodings(part.columns[:4], [codec.encoded(t.as_py()) for t in part.column(4)])

    def encodings(head: list[pa.Array], got: list[Encoded]) -> pa.RecordBatch:
        lists = [pa.array([getattr(e, f) for e in got], pa.list_(pa.int32())) for f in ("ids", "chars", "counts")]
        return pa.RecordBatch.from_arrays([*head, pa.array([e.text for e in got]), *lists], names=["mark", "key", "copies", "no", "piece", "ids", "chars", "counts"])

    def joined(x: pa.Table) -> tuple[list, Encoded]:
        """What neighbouring encodings have in common, and one encoding out of them."""
        x = x.take(pa.array(np.argsort(x.column("no").to_numpy(), kind="stable")))
        pieces = [Encoded(t, *(v.values.to_numpy().astype(k) for v, k in zip(lists, (np.int32, np.int64, np.int64)))) for t, *lists in zip(x.column("piece").to_pylist(), x.column("ids"), x.column("chars"), x.column("counts"))]
        return [x.column(i).combine_chunks()[:1] for i in range(3)], load(vocabulary).tree(pieces)

    def inner(x: pa.Table) -> pa.Table:
        head, e = joined(x)
        return pa.Table.from_batches([encodings([*head, pa.array([x.column("no")[0].as_py() // FAN], pa.int32())], [e])])

    def last(x: pa.Table) -> pa.Table:
        head, e = joined(x)
        got = batch(head[1], [_row(load(vocabulary), e.ids, wanted)])
        out = pa.Table.from_batches([got.append_column("copies", head[2])])
        if x.nbytes > 4 << 20:
            release()
        return out

    short = mapped(base.where(F.length("body") <= piece_chars), at_once, out)
    held = f"mark string, key {id_type}, copies long, no int, piece string, ids array<int>, chars array<int>, counts array<int>"

    def long(some: DataFrame, rounds: int) -> DataFrame:
        pieces = mapped(some, cut, f"mark string, key {id_type}, no int, piece string")
        # Rows that are equal in id and text are one, with a count, before anything is gathered by text.
        once = pieces.groupBy("mark", "no").agg(F.first("key").alias("key"), F.first("piece").alias("piece"), F.count("*").alias("copies"))
        encoded = mapped(once.select("mark", "key", "copies", "no", "piece"), each, held)
        if rounds > 1:
            encoded = encoded.groupBy("mark", F.floor(F.col("no") / FAN)).applyInArrow(inner, held)
        done = encoded.groupBy("mark").applyInArrow(last, out + ", copies long")
        return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")

    # One task joins the pieces of a text if they are few, so that they are dealt once.
    size = F.length("body")
    few = long(base.where((size > piece_chars) & (size <= piece_chars * FAN)), 1)
    many = long(base.where(size > piece_chars * FAN), 2)
    return short.unionByName(few).unionByName(many).withColumnRenamed("key", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Texts of id arrays: ``id_col``, decoded. A null array, or null inside one, counts as nothing."""
    vocabulary = vocabulary or default_vocabulary()
    id_type = encoded.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([codec.decode(i for i in v.as_py() or () if i is not None) for v in x.column(1)], pa.string())], names=["key", "decoded"])

    return mapped(encoded.select(F.col(id_col).alias("key"), F.col(ids_col).cast("array<int>").alias("ids")), back, f"key {id_type}, decoded string").withColumnRenamed("key", id_col)
