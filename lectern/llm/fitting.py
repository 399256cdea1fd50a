"""What the classifiers share: a bounded sample of labelled texts, and an optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_bucket, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About ``rows`` labelled texts (label int, body), of ids whose crc32 modulo ``modulus`` is not ``held_out``.

    The sample is drawn by a hash of the id, so its size is bounded at any size of the corpus: ``rows`` on average, with a
    spread of its square root. Labels that are null are left out; an id with several labels has the largest.
    """
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label is not null")
    known = known.where(crc_bucket("key", modulus) != held_out).groupBy("key").agg(F.max("label").alias("label"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(share * (1 << 32)))
    # At most a few thousand ids and labels by the parameter `rows`: the bound that makes this broadcast safe.
    found = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(F.broadcast(chosen), "key")
    return written(found.select("key", "label", "body").repartition(8, "key"), "labelled").select("label", "body")


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
