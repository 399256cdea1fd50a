"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_BYTES bytes. Each passage is encoded from its bytes: shares of bytes and of
hashed byte pairs, and how much of its words repeat. A gated attention learns from document labels which passages matter;
the score is a logistic function of the passages' weighted sum. All of a text is in its passages; a long text is scored a
block of passages at a time, as the weighted sum adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_bucket, mapped
from lectern.llm.fitting import Adam, labelled_sample, sigmoid
from lectern.llm.jaccard import word_hashes

PASSAGE_BYTES = 600
PAIRS = 512
WIDTH = 256 + PAIRS + 4
#: Passages that stand in memory at once.
BLOCK = 1024
#: What the model learns from: labelled texts, on average, and most passages of one of them.
SAMPLE_ROWS, SAMPLE_PASSAGES = 5000, 16


def _bags(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-sizes // PASSAGE_BYTES))


def _byte_shares(raw: np.ndarray, where: np.ndarray, total: int, paired: np.ndarray) -> np.ndarray:
    """Feature rows, but for those of words, of ``total`` passages. ``where``: the passage of each byte; ``paired``: whether
    a byte has a next one in its text. ``raw`` may go on beyond ``where``, by the last byte's next."""
    out = np.zeros((total, WIDTH), np.float32)
    n = len(where)
    count = np.maximum(1, np.bincount(where, minlength=total))[:, None]
    out[:, :256] = np.bincount(where * 256 + raw[:n], minlength=total * 256).reshape(total, 256) / count
    first = np.flatnonzero(paired)
    pair = (raw[first].astype(np.int64) * 31 + raw[first + 1] * 17) * 2654435761 >> 7 & (PAIRS - 1)
    out[:, 256 : 256 + PAIRS] = np.bincount(where[first] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS) / count
    np.sqrt(out[:, : 256 + PAIRS], out=out[:, : 256 + PAIRS])
    return out


def _word_shares(words: np.ndarray, bags: int) -> np.ndarray:
    """The four features of words, for each passage of a text. Words go to passages by their share of the text, which is
    close enough for counts of repeats."""
    out = np.zeros((bags, 4), np.float32)
    if len(words):
        cut = np.arange(len(words)) * bags // len(words)
        _, back, often = np.unique(words, return_inverse=True, return_counts=True)
        n = np.maximum(1, np.bincount(cut, minlength=bags))
        out[:, 0] = np.bincount(cut, np.log2(often[back]), minlength=bags) / n
        out[:, 1] = np.bincount(cut, np.r_[False, words[1:] == words[:-1]], minlength=bags) / n
        out[:, 2] = len(often) / len(words)
        out[:, 3] = np.log2(1 + len(words)) / 16
    return out


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of some texts, and how many each text has (at least one). A text's rows are the same
    whatever texts stand beside it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bags = _bags(sizes)
    first = np.r_[0, np.cumsum(bags)[:-1]]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    out = _byte_shares(raw, first[text_of] + (np.arange(len(raw)) - starts[text_of]) // PASSAGE_BYTES, int(bags.sum()), np.r_[text_of[1:] == text_of[:-1], np.zeros(min(1, len(raw)), bool)])
    words, ends = word_hashes(texts)
    at = 0
    for i, end in enumerate(ends):
        out[first[i] : first[i] + bags[i], -4:] = _word_shares(words[at:end], bags[i])
        at = int(end)
    return out, bags


def blocks_of(text: bytes) -> Iterator[np.ndarray]:
    """The rows of ``passages`` of one text, a block at a time."""
    bags = int(_bags(np.array(len(text))))
    raw = np.frombuffer(text, np.uint8)
    told = _word_shares(word_hashes([text])[0], bags)
    for at in range(0, bags, BLOCK):
        some = raw[at * PASSAGE_BYTES : (at + BLOCK) * PASSAGE_BYTES + 1]
        n = min(len(some), BLOCK * PASSAGE_BYTES)
        rows = _byte_shares(some, np.arange(n) // PASSAGE_BYTES, min(BLOCK, bags - at), np.arange(n) + 1 < len(some))
        rows[:, -4:] = told[at : at + BLOCK]
        yield rows


class Model:
    """Gated attention over passages: z = sum softmax(w . (tanh(V h) * sigm(U h))) h, score = sigm(c . z + d)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": g(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, gate), "U": g(hidden, gate), "w": g(gate, 1)[:, 0], "c": g(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def attended(self, x: np.ndarray):
        """Of scaled rows the hidden values, both gates and the logit of their weight."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def forward(self, x: np.ndarray, bags: np.ndarray):
        p = self.p
        x = (x - self.mean) * self.scale
        h, t, s, e = self.attended(x)
        at = np.r_[0, np.cumsum(bags)[:-1]]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        a = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(a[:, None] * h, at)
        return x, h, t, s, a, at, z, sigmoid(z @ p["c"] + p["d"][0])

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 256, decay: float = 1e-3, seed: int = 11) -> Model:
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.02)
        opt, r, p = Adam(self.p, 3e-3), np.random.default_rng(seed), self.p
        at_all = np.r_[0, np.cumsum(bags)]
        for _ in range(rounds):
            order = r.permutation(len(y))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                rows = np.concatenate([np.arange(at_all[i], at_all[i + 1]) for i in some])
                n, yy = bags[some], y[some]
                xs, h, t, s, a, at, z, q = self.forward(x[rows], n)
                dq = ((q - yy) / len(some)).astype(np.float32)
                dz = dq[:, None] * p["c"]
                dzr = np.repeat(dz, n, axis=0)
                da = (dzr * h).sum(1)
                de = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
                dg = de[:, None] * p["w"]
                dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
                dh = (a[:, None] * dzr + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                grads = {"W": xs.T @ dh + decay * p["W"], "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dq + decay * p["c"], "d": np.array([dq.sum()], np.float32)}
                opt.step(grads)
        self.p = {k: v.astype(np.float64) for k, v in p.items()}
        self.mean, self.scale = self.mean.astype(np.float64), self.scale.astype(np.float64)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of texts, each by itself; in double precision and rounded, so that they don't depend on how many there are."""
        sizes = _bags(np.array([len(t) for t in texts], np.int64))
        out = np.zeros(len(texts))
        group: list[int] = []
        for i, n in enumerate(sizes):
            if n > BLOCK:
                out[i] = self._long(texts[i])
                continue
            if group and sizes[group].sum() + n > BLOCK:
                out[group] = self.forward(*passages([texts[k] for k in group]))[-1]
                group = []
            group.append(i)
        if group:
            out[group] = self.forward(*passages([texts[k] for k in group]))[-1]
        return np.round(out, 6)

    def _long(self, text: bytes) -> float:
        """The score of a text of more than a block: attention's sums, each relative to the largest exponent so far."""
        p, most, total, z = self.p, -np.inf, 0.0, 0.0
        for x in blocks_of(text):
            h, _, _, e = self.attended((x - self.mean) * self.scale)
            top = max(most, e.max())
            weight, shrink = np.exp(e - top), np.exp(most - top)
            total, z, most = total * shrink + weight.sum(), z * shrink + weight @ h, top
        return float(sigmoid(z / total @ p["c"] + p["d"][0]))


def fit(sample: DataFrame, most: int = SAMPLE_PASSAGES) -> Model | float:
    """The model of a labelled sample (label, body), or the share of label 1 where there is one label only, 0.5 without any.

    Of a sampled text of more than ``most`` passages it learns from that many, evenly spread from its first to its last.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column(0), b.column(1)):
                raw = text.as_py().encode()
                bags = int(_bags(np.array(len(raw))))
                wanted = np.unique(np.linspace(0, bags - 1, min(most, bags)).round().astype(np.int64))
                got, at = [], 0
                for rows in blocks_of(raw):
                    got.append(rows[wanted[(wanted >= at) & (wanted < at + len(rows))] - at].astype(np.float16))
                    at += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([np.concatenate(got).tobytes()], pa.binary())], names=["label", "x"])

    # Bounded: SAMPLE_ROWS texts of at most SAMPLE_PASSAGES passages of 1.5 kB.
    got = mapped(sample.select("label", "body"), features, "label int, x binary").toArrow()
    y = (got.column("label").to_numpy() > 0).astype(np.float32)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    packed = [v.as_py() for v in got.column("x")]
    order = sorted(range(len(y)), key=lambda i: (hashlib.sha256(packed[i]).digest(), y[i]))  # the same model whatever the order of tasks
    xs = [np.frombuffer(packed[i], np.float16).reshape(-1, WIDTH) for i in order]
    return Model().fit(np.concatenate(xs).astype(np.float32), np.array([len(x) for x in xs]), y[order])


def _scores(model: Model | float, texts: list[bytes]) -> np.ndarray:
    return np.full(len(texts), round(model, 6)) if isinstance(model, float) else model.score(texts)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, modulus: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> DataFrame:
    """Score every whole text: ``id_col``, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    The model is fitted to about ``sample_rows`` labelled texts whose id is not held out, and of each of them to at most
    ``sample_passages`` passages; scores take in all passages. One row per input row; a null text counts as empty, null ids
    as the empty text in held_out; equal texts have equal scores, whatever stands beside them, and an empty table gives no
    rows. Without labels of both kinds all scores are the share of label 1 (0.5 without any label). Only the text is an
    input of the score; other columns are left out.
    """
    model = fit(labelled_sample(docs, labels, label_col, modulus, held_out, sample_rows, id_col, text_col), sample_passages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(shared.value, [t.as_py().encode() for t in part.column(1)]))], names=["key", "score"])

    base = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    scored = mapped(base, run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(id_col), (crc_bucket("key", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, modulus: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``; see ``score_quality``.

    Null and repeated ids are judged by their text like others; a null text is judged as the empty one and stays null.
    """
    model = fit(labelled_sample(docs, labels, label_col, modulus, held_out, sample_rows, id_col, text_col), sample_passages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield part.filter(pa.array(_scores(shared.value, [(t.as_py() or "").encode() for t in part.column(at_text)]) >= threshold))

    return mapped(docs, run, docs.schema)
