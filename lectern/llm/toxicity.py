"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of hashed byte n-grams, which see word stems as well as words. Besides the labels it is
fitted to pairs of sentences that differ in an identity term alone, with a penalty on the square of their scores'
difference; so a neutral mention of a group can't move a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_bucket, mapped
from lectern.llm.fitting import Adam, labelled_sample, sigmoid

DIM = 1 << 20
GRAMS = (4, 5, 6)
#: Features that the model may use.
KEPT = 8192
#: Least likelihood gain of a feature, so that a small sample doesn't fit to chance.
LEAST_GAIN = 6.0
SAMPLE_ROWS = 6000

#: Identity terms that stand for each other in counterfactual sentences, by group and language.
IDENTITY = [
    "women men girls boys transgender nonbinary".split(),
    "muslims christians jews hindus buddhists atheists catholics sikhs".split(),
    "muslim christian jewish hindu buddhist atheist catholic sikh".split(),
    "black white asian latino african european arab indigenous".split(),
    "gay lesbian straight bisexual queer heterosexual homosexual".split(),
    "american mexican chinese german french spanish turkish polish russian indian".split(),
    "immigrants refugees foreigners natives locals citizens".split(),
    "disabled blind deaf autistic elderly young".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "ausländer flüchtlinge deutsche türken polen russen".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "immigrés réfugiés étrangers français arabes".split(),
    "mujeres hombres chicas chicos".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "inmigrantes refugiados extranjeros españoles gitanos".split(),
]
_GROUP_OF = {t: g for g in IDENTITY for t in g}
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, _GROUP_OF), key=len, reverse=True)) + r")(?!\w)", re.I)
#: About how many sentences without an identity term get terms in front, besides all swaps in sentences that have one.
FRONT_SENTENCES = 64

_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint64)


#: Bytes that are hashed at once.
CHUNK = 1 << 18


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The texts, a separator before and behind each, in pieces that overlap by what the longest n-gram needs."""
    over = max(GRAMS) - 1
    for k, t in enumerate(texts):
        whole = b"\n%b\n" % t
        for at in range(0, max(1, len(whole) - over), CHUNK):
            yield k, whole[at : at + CHUNK + over]


def gram_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of some texts and the text that each is of, some at a time. A-Z count as a-z, other separators
    as spaces; an n-gram is inside one text and the separators around it, so a text has the same whatever stands beside it."""

    def hashed(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        raw = _TABLE[np.frombuffer(b"".join(p for _, p in group), np.uint8)]
        sizes = [len(p) for _, p in group]
        of, ends = np.repeat([k for k, _ in group], sizes), np.repeat(np.cumsum(sizes), sizes)
        found, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rolling = np.zeros(len(raw), np.uint64)
        for i in range(max(GRAMS)):
            rolling = rolling[: len(raw) - i] * np.uint64(0x100000001B3) + (raw[i:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            if i + 1 in GRAMS and len(rolling):
                inside = np.flatnonzero(np.arange(len(rolling)) + i < ends[: len(rolling)])
                h = (rolling[inside] ^ (rolling[inside] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((h >> np.uint64(64 - 20)).astype(np.int64))
                where.append(of[inside])
        return np.concatenate(found), np.concatenate(where)

    group: list[tuple[int, bytes]] = []
    size = 0
    for k, p in _pieces(texts):
        if group and size + len(p) > 2 * CHUNK:
            yield hashed(group)
            group, size = [], 0
        group.append((k, p))
        size += len(p)
    if group:
        yield hashed(group)


def gram_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All of ``gram_runs`` at once, for short texts."""
    runs = list(gram_runs(texts))
    return tuple(np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, np.int64) for i in (0, 1))


class Model:
    """Weights of the kept buckets and a bias."""

    def __init__(self, kept: np.ndarray):
        self.kept = kept
        self.slot = np.full(DIM, -1, np.int16)
        self.slot[kept] = np.arange(len(kept))
        self.w, self.b = np.zeros(len(kept), np.float32), 0.0

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and feature of each feature present in each text."""
        found = [np.zeros(0, np.int64)]
        for grams, of in gram_runs(texts):
            slot = self.slot[grams]
            hit = np.flatnonzero(slot >= 0)
            found.append(np.unique(of[hit] * len(self.kept) + slot[hit]))
        both = np.unique(np.concatenate(found))
        return both // len(self.kept), both % len(self.kept)

    def logits(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.w[cols], minlength=n) + self.b

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(*self.features(texts), len(texts)))

    def swapped(self, sentence: str) -> Iterator[tuple[bytes, bytes]]:
        """Features of a sentence with an identity term and of what each swap makes of it, packed; both empty if they are alike.

        A swap changes the n-grams around its term alone, so those are counted anew.
        """

        def counts(text: bytes) -> np.ndarray:
            slot = self.slot[gram_hashes([text])[0]]
            return np.bincount(slot[slot >= 0], minlength=len(self.kept))

        found = list(swaps(sentence))
        if not found:
            return
        whole = counts(sentence.encode())
        packed = np.flatnonzero(whole).astype(np.int16).tobytes()
        reach = max(GRAMS)
        for start, end, terms in found:
            before, after = sentence[max(0, start - reach) : start].encode(), sentence[end : end + reach].encode()
            rest = whole - counts(before + sentence[start:end].encode() + after)
            for t in terms:
                other = np.flatnonzero(rest + counts(before + t.encode() + after)).astype(np.int16).tobytes()
                yield (packed, other) if other != packed else (b"", b"")

    def fit(self, rows, cols, y, pairs: tuple, weights: np.ndarray, penalty: float, decay: float = 2e-5, rounds: int = 400) -> Model:
        """Full-batch Adam on log loss + decay |w|^2 + penalty * mean (s(a) - s(b))^2 over counterfactual pairs, by their weights."""
        p = {"w": self.w, "b": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])}
        opt, n = Adam(p, 0.05), len(y)
        (ra, ca), (rb, cb) = pairs
        n_pairs = len(weights)
        for _ in range(rounds):
            self.w, self.b = p["w"], float(p["b"][0])
            g = (sigmoid(self.logits(rows, cols, n)) - y) / n
            gw = np.bincount(cols, g[rows], minlength=len(self.w)) + decay * self.w
            gb = g.sum()
            if n_pairs:
                sa, sb = sigmoid(self.logits(ra, ca, n_pairs)), sigmoid(self.logits(rb, cb, n_pairs))
                d = 2 * penalty * weights * (sa - sb) / weights.sum()
                da, db = d * sa * (1 - sa), -d * sb * (1 - sb)
                gw = gw + np.bincount(ca, da[ra], minlength=len(self.w)) + np.bincount(cb, db[rb], minlength=len(self.w))
                gb += da.sum() + db.sum()
            opt.step({"w": gw.astype(np.float32), "b": np.array([gb])})
        self.w, self.b = p["w"], float(p["b"][0])
        return self


def swaps(sentence: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start and end of each identity term of a sentence, and the other terms of its group."""
    for m in _TERM.finditer(sentence):
        own = m[1].casefold()
        yield m.start(), m.end(), [t for t in _GROUP_OF.get(own, ()) if t != own]


def counterfactuals(sentences: list[str]) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in an identity term: those that have some get each swapped for each of its group;
    others, so that every term meets real contexts, get each term of a group in front in turn."""
    found = []
    for i, s in enumerate(sentences):
        if _TERM.search(s):
            found += [(s, s[:start] + t + s[end:]) for start, end, terms in swaps(s) for t in terms]
        else:
            g = IDENTITY[i % len(IDENTITY)]
            found += [(f"{g[k - 1]} {s}", f"{t} {s}") for k, t in enumerate(g)]
            found.append((f"{g[i % len(g)]} {s}", s))
    return found


def fit(sample: DataFrame, penalty: float, front_sentences: int = FRONT_SENTENCES) -> Model | float:
    """The model of a labelled sample (label, body); see ``quality.fit`` for samples of one label.

    Counterfactual pairs are all swaps in all sentences of the sample, and terms in front of ``front_sentences`` others.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ones, rows = np.zeros(DIM, np.int32), np.zeros(DIM, np.int32), [0, 0]
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1)):
                grams = np.unique(np.concatenate([np.unique(g) for g, _ in gram_runs([text.as_py().encode()])]))
                both[grams] += 1
                rows[label > 0] += 1
                if label > 0:
                    ones[grams] += 1
        some = np.flatnonzero(both > 0)
        for at in range(0, len(some), 1 << 15):
            k = some[at : at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(both[k], pa.int64()), pa.array(ones[k], pa.int64())], names=["gram", "n", "ones"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([sum(rows)], pa.int64()), pa.array([rows[1]], pa.int64())], names=["gram", "n", "ones"])

    counted = mapped(sample, count, "gram int, n long, ones long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n >= 3 or gram < 0").toArrow()
    gram, n, ones = (counted.column(c).to_numpy().astype(np.float64) for c in ("gram", "n", "ones"))
    total, positive = (float(x[gram < 0].sum()) for x in (n, ones))
    if not 0 < positive < total:
        return positive / total if total else 0.5
    keep = gram >= 0
    gram, n, ones = gram[keep].astype(np.int64), n[keep], ones[keep]
    # Signed likelihood ratio of presence against label; features of both signs are kept.
    rest, want = n - ones, positive / total
    gain = ones * np.log((ones + 0.5) / (n * want + 0.5)) + rest * np.log((rest + 0.5) / (n * (1 - want) + 0.5))
    gram, gain = gram[gain >= LEAST_GAIN], gain[gain >= LEAST_GAIN]
    model = Model(np.sort(gram[np.lexsort((gram, -gain))[:KEPT]]))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            packed = [shared.value.features([t.encode()])[1].astype(np.int16).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array([_sentence(t) for t in texts])], names=["label", "x", "sentence"])

    got = mapped(sample, features, "label int, x binary, sentence string").toArrow().to_pylist()
    got.sort(key=lambda r: (r["sentence"], r["label"], r["x"]))
    cols = [np.frombuffer(r["x"], np.int16).astype(np.int64) for r in got]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    y = np.array([r["label"] > 0 for r in got], np.float64)

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1):
                found: dict[tuple[bytes, bytes], int] = {}
                for s in _sentences(text.as_py()):
                    for pair in shared.value.swapped(s):
                        found[pair] = found.get(pair, 0) + 1
                items = list(found.items())
                for at in range(0, len(items), 256):
                    part = items[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p, _ in part], pa.binary()) for i in (0, 1)] + [pa.array([n for _, n in part], pa.int64())], names=["a", "b", "n"])

    # Equal pairs count by weight, and those without a difference in features by weight alone: they add nothing else.
    real = mapped(sample, swapped, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    real.sort(key=lambda r: (r["a"], r["b"]))
    others = [r["sentence"] for r in got if r["sentence"]]
    step = max(1, len(others) // front_sentences) if front_sentences else len(others) + 1
    front = counterfactuals(others[::step] if front_sentences else [])
    encoded = []
    for i, side in enumerate("ab"):
        x, at = model.features([p[i].encode() for p in front])[::-1] if front else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        mine = [np.frombuffer(r[side], np.int16).astype(np.int64) for r in real]
        encoded.append((np.concatenate([at, np.repeat(np.arange(len(mine)) + len(front), [len(c) for c in mine]).astype(np.int64)]), np.concatenate([x, *mine])))
    weights = np.array([1.0] * len(front) + [r["n"] for r in real])
    return model.fit(rows, np.concatenate(cols), y, tuple(encoded), weights, penalty)


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"[.!?\n]+", text) if s.strip()]


def _sentence(text: str) -> str:
    """The middle one of a text's sentences without an identity term."""
    parts = [s for s in _sentences(text) if not _TERM.search(s)]
    return parts[len(parts) // 2] if parts else ""


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, modulus: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS, penalty: float = 1.0, front_sentences: int = FRONT_SENTENCES) -> DataFrame:
    """Score every whole text: ``id_col``, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    The model is fitted to about ``sample_rows`` labelled texts whose id is not held out, ``penalty`` weighing the
    counterfactual term. Its pairs are all swaps of identity terms in the sample, and terms put in front of about
    ``front_sentences`` sentences without one. One row per input row; a null text counts as empty, null ids as the empty text in held_out.
    Without labels of both kinds all scores are the share of label 1 (0.5 without any label). Only the text is an input;
    equal texts have equal scores, whatever stands beside them. An empty table gives no rows.
    """
    model = fit(labelled_sample(docs, labels, label_col, modulus, held_out, sample_rows, id_col, text_col), penalty, front_sentences)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                q = np.full(part.num_rows, shared.value) if isinstance(shared.value, float) else shared.value.score([t.as_py().encode() for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(q.astype(np.float64), 6))], names=["key", "score"])

    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    scored = mapped(base, run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(id_col), (crc_bucket("key", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
