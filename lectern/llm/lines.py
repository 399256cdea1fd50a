"""Line deduplication by spread over sites, in DataFrame functions only.

A line that stands on many distinct sites is boilerplate. One HyperLogLog sketch per line hash, merged by aggregation,
estimates on how many sites it stands; lines whose estimate is near the threshold get an exact distinct count. Hot lines
are aggregated before they are shuffled, and joined under salted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

MIN_SITES = 10
#: log2 of a sketch's registers: 4096, a standard error of 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: fifteen standard errors.
NEAR = 0.25
SALTS = 16


def _lines(text):
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))


def _hashed(docs: DataFrame) -> DataFrame:
    """A row for each distinct non-blank line of a document: key, site, and 128 bits of hash."""
    line = F.explode(F.array_distinct(F.filter(_lines(F.col("body")), lambda x: x != ""))).alias("line")
    return docs.select("key", "site", line).select("key", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Hashes of the lines of ``docs`` (key, site, body) that stand on at least ``min_sites`` sites, and the least key
    that has each: h1, h2, keeper."""
    lines = _hashed(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("key").alias("keeper"), F.count("*").alias("n"))
    spread = sketched.where(F.col("n") >= min_sites).select("h1", "h2", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites * (1 - near)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + near)).select("h1", "h2", "keeper")
    unsure = spread.where(F.col("sites") <= min_sites * (1 + near)).select("h1", "h2", "keeper")
    seen = _salted_join(lines, unsure).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.min("keeper").alias("keeper"))
    return sure.unionByName(seen.where(F.col("sites") >= min_sites).select("h1", "h2", "keeper"))


def _salted_join(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """``lines`` joined to the hashes of ``chosen``, each hash's lines dealt over SALTS keys."""
    many = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(many, ["h1", "h2", "salt"])


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Take lines that stand on at least ``min_sites`` distinct sites out of all documents but the one of the least id.

    One row per input row, all its columns with ``text_col`` cleaned, and line_count (lines of the text; a null text has
    none) and removed_count, both long; columns of the input with these two names are replaced. Lines are compared without
    the spaces at their ends; blank lines stay. A line that repeats in its one remaining document stays there each time. Null sites
    count for nothing; rows of equal id count as one document; of rows without an id, which count as one document too, a
    line's last place is there only if no other document has it. Null texts stay null, and an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("line_count", "removed_count")]
    base = docs.select(F.col(id_col).alias("key"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("body"))
    found = written(boilerplate_lines(base, min_sites, lg_k, near), "line-boilerplate")
    gone = _salted_join(_hashed(base), found).where(~F.col("key").eqNullSafe(F.col("keeper"))).groupBy(F.col("key").alias("gone_key")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone_hashes"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).alias("key"))
    joined = packed.join(gone, F.col("key").eqNullSafe(F.col("gone_key")), "left")
    text = F.col("row").getField(text_col)
    raw = F.split(text, "\n", -1)
    keep = F.filter(raw, lambda x: ~F.array_contains(F.col("gone_hashes"), F.struct(F.xxhash64(F.trim(x)).alias("h1"), F.xxhash64(F.lit(1), F.trim(x)).alias("h2"))))
    kept = F.when(F.col("gone_hashes").isNull(), raw).otherwise(keep)
    out = joined.withColumn("kept", kept)
    return out.select(
        *((F.array_join("kept", "\n") if c == text_col else F.col("row").getField(c)).alias(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(raw)).cast("long").alias("line_count"),
        F.when(text.isNull(), 0).otherwise(F.size(raw) - F.size("kept")).cast("long").alias("removed_count"),
    )
