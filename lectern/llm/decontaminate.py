"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one suffix automaton, whose states stand for runs of words that occur at the
same places of the items. Training texts stream through it: after each word the automaton knows the longest run that
ends there and occurs in an item. Where that run reaches ``window`` words (or a whole item, for shorter items), the words
are hit. Spans of hit words longer than a limit, or documents with too large a share of them, can be removed.

Items are dealt into blocks of a bounded number of words (a longer item into overlapping parts), each with an automaton of
its own. All documents pass through one block after another, and only that block's automaton is in memory; what was hit so
far is written along with the texts between two passes. A benchmark of up to BLOCK_WORDS words takes one pass, and no table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mapped

WINDOW = 10
#: Words of benchmark text in one automaton, about 600 bytes of Python objects each: some 120 MB in a worker.
BLOCK_WORDS = 200_000

#: Upper case to lower case and all that is no word byte to a space: words are digits, a-z and whatever is not ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word runs. ``window``: words that make a hit."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.long: dict[int, set[str]] = {}
        for _, run in items:
            last = 0
            for w in run:
                last = self._extend(last, w)
        for name, run in items:
            if not run:
                continue
            # Where the last `size` words read are a window of this item, the state's runs all end at the same places.
            size = min(window, len(run))
            for state, matched in self.walk(run):
                if matched >= size:
                    state = self._holding(state, size)
                    if size == window:
                        self.long.setdefault(state, set()).add(name)
                    elif matched == len(run):
                        self.short.setdefault(state, (size, set()))[1].add(name)
        #: Of each state, the states on its suffix path (itself first) that end a short item.
        self.ends: dict[int, list[int]] = {}
        if self.short:
            for v in range(len(self.len)):
                got, u = [], v
                while u > 0:
                    if u in self.short:
                        got.append(u)
                    u = self.link[u]
                if got:
                    self.ends[v] = got

    def _extend(self, last: int, w: bytes) -> int:
        to = self.next[last].get(w)
        if to is not None:
            if self.len[to] == self.len[last] + 1:
                return to
            return self._split(last, w, to)
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state of its own for the runs of q of at most len(p) + 1 words."""
        made = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = made
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = made
            p = self.link[p]
        return made

    def _holding(self, state: int, size: int) -> int:
        """The state on the suffix path that stands for the last ``size`` words."""
        while self.len[self.link[state]] >= size:
            state = self.link[state]
        return state

    def walk(self, run: list[bytes]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and the length of the longest run ending there that occurs in an item."""
        state = matched = 0
        for w in run:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            to = self.next[state].get(w)
            if to is None:
                state = matched = 0
            else:
                state, matched = to, matched + 1
            yield state, matched

    def hits(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, word after the last) of windows in a text, in order and merged, and the items they are of."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        size, nxt, link, length, short, ends = self.window, self.next, self.link, self.len, self.short, self.ends
        state = matched = 0
        root = nxt[0]
        here = root
        for i, w in enumerate(run):
            to = here.get(w)
            if to is None:
                while state:
                    state = link[state]
                    here = nxt[state]
                    to = here.get(w)
                    if to is not None:
                        matched = length[state]
                        break
                else:
                    matched, here = 0, root
                    continue
            state, matched = to, matched + 1
            here = nxt[state]
            start = -1
            if matched >= size:
                found |= self.long[self._holding(state, size)]
                start = i + 1 - size
            if ends and state in ends:
                for e in ends[state]:
                    n, names = short[e]
                    if n <= matched:
                        found |= names
                        start = min(start, i + 1 - n) if start >= 0 else i + 1 - n
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most ``block_words`` words, read a part at a time. An item of more is cut into parts that
    overlap by a window less a word, so that each window is in a part."""
    held: list[tuple[str, list[bytes]]] = []
    count = 0
    size = max(block_words, window)
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("i is not null")
    for row in rows.toLocalIterator():
        whole = words(row["t"])
        step = size - window + 1
        for at in range(0, max(1, len(whole) - window + 1), step) if len(whole) > size else (0,):
            run = whole[at : at + size]
            if held and count + len(run) > block_words:
                yield held
                held, count = [], 0
            held.append((row["i"], run))
            count += len(run)
    if held:
        yield held


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood between two removed words goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    at, kept, k = 0, [], 0
    places = [m.span() for m in _WORD.finditer(raw)]
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, min_span_words: int = 5, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, columns: tuple[str, ...] = ("n_words", "n_hit", "items", "spans", "clean_text", "drop"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Match every whole text against all windows of the benchmark items.

    One row per input row, with ``id_col`` and ``columns`` of: n_words, n_hit (words inside any occurrence of a window),
    items (ids of items with occurring windows, as sorted strings), spans (of hit words: first, and one past the last),
    clean_text (without hit spans of at least ``min_span_words`` words; a null text stays null), drop (more than ``max_coverage`` of the words are hit). A window is ``window`` words of an item in a
    row; an item of fewer words is one window, one without words none. Null texts have no words; null item ids are left
    out. Rows with equal ids are matched each for itself; an empty benchmark hits nothing, and empty ``docs`` give no rows. Columns of ``docs`` named in ``keep`` stay (their names and those in ``columns`` must differ); others are left out.
    """
    sc = docs.sparkSession.sparkContext
    wanted = list(columns)
    pair = pa.struct([("first", pa.int32()), ("after", pa.int32())])
    spans_of, span_type = "array<struct<first: int, after: int>>", pa.list_(pair)
    kinds = {"n_words": ("long", pa.int64()), "n_hit": ("long", pa.int64()), "items": ("array<string>", pa.list_(pa.string())), "spans": (spans_of, span_type), "clean_text": ("string", pa.string()), "drop": ("boolean", pa.bool_())}
    kept = [f"kept{i}" for i in range(len(keep))]
    typed = lambda c: docs.schema[c].dataType.simpleString()
    same = ["key " + typed(id_col), "body string", *(f"{k} {typed(c)}" for k, c in zip(kept, keep))]
    names = ["key", "body", *kept]

    def told(text: str | None, run: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> dict:
        hit = sum(b - a for a, b in spans)
        got = {"n_words": len(run), "n_hit": hit, "items": sorted(found), "spans": [{"first": a, "after": b} for a, b in spans], "drop": hit > max_coverage * len(run)}
        if "clean_text" in wanted:
            cut = [x for x in spans if x[1] - x[0] >= min_span_words]
            got["clean_text"] = _without(text, cut) if cut else text
        return got

    def through(automaton, carried: bool, last: bool):
        """A pass through one block: adds its hits to those carried along; the last one makes the result."""

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for at in range(0, x.num_rows, 512):
                    part = x.slice(at, 512)
                    rows = []
                    for i, t in enumerate(part.column(1)):
                        text = t.as_py()
                        run = words(text or "")
                        spans, found = automaton.value.hits(run) if automaton else ([], set())
                        if carried:
                            spans = _merged(spans + [(s["first"], s["after"]) for s in part.column(len(names))[i].as_py()])
                            found |= set(part.column(len(names) + 1)[i].as_py())
                        rows.append(told(text, run, spans, found) if last else (spans, sorted(found)))
                    if last:
                        yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2 : len(names)], *(pa.array([r[c] for r in rows], kinds[c][1]) for c in wanted)], names=["key", *kept, *wanted])
                    else:
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([[{"first": a, "after": b} for a, b in s] for s, _ in rows], span_type), pa.array([f for _, f in rows], pa.list_(pa.string()))], names=[*names, "spans", "found"])

        return match

    scratch = Scratch(docs.sparkSession)
    now = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"), *(F.col(c).alias(k) for k, c in zip(kept, keep)))
    left = blocks(benchmark, item_id_col, item_text_col, block_words, window)
    block, passes = next(left, None), 0
    while True:
        shared = sc.broadcast(Automaton(block, window)) if block else None
        block = next(left, None)
        if block is None:
            out = ", ".join([same[0], *same[2:], *(f"{c} {kinds[c][0]}" for c in wanted)])
            found = mapped(now, through(shared, passes > 0, True), out)
            return found.select(F.col("key").alias(id_col), *(F.col(k).alias(c) for k, c in zip(kept, keep)), *wanted)
        before, now = now, scratch.write(mapped(now, through(shared, passes > 0, False), ", ".join([*same, f"spans {spans_of}", "found array<string>"])), "decontaminate")
        scratch.drop(before)
        shared.unpersist()
        passes += 1
