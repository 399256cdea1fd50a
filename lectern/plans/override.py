"""Overrides that an operator types: parsed like speech, and put in the place of the pending candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.sessions import approvals
from lectern.plans.parse import parse_references


def overridden(actions: DataFrame, sizes: DataFrame) -> DataFrame:
    """What becomes of a session's actions where a manual one names its reference by a typed text: session, seq, action, ref,
    outcome, source, asr, detected_text.

    ``actions``: session, seq, action, ref, callback_ok (see ``approvals``), text (what was typed, for manual) and asr (what
    was heard, for submit). A text in which nothing is found leaves the slot alone: reference_not_found. A manual candidate
    takes over what was heard for the one that it replaces.
    """
    typed = actions.where("action = 'manual' and trim(text) <> ''").select(F.trim("text").alias("utt_id"), F.trim("text").alias("text")).distinct()
    found = parse_references(typed, sizes).select(F.col("utt_id").alias("typed"), F.col("ref").alias("typed_ref"))
    manual = F.col("action") == "manual"
    x = actions.withColumn("typed", F.when(manual, F.trim("text"))).join(found, "typed", "left")
    x = x.withColumn("ref", F.when(manual, F.col("typed_ref")).otherwise(F.col("ref"))).withColumn("did", F.when(manual & F.col("ref").isNull(), "not_found").otherwise(F.col("action")))
    outcome = approvals(x.select("session", "seq", F.col("did").alias("action"), "ref", "callback_ok")).select("session", "seq", F.col("ref").alias("slot_ref"), "outcome")
    takes = (F.col("did") == "reset") | F.col("did").isin("approve", "reject") & F.coalesce("callback_ok", F.lit(True))
    heard = F.when(F.col("did") == "submit", F.struct(F.coalesce("asr", F.lit("")).alias("asr"))).when(takes, F.struct(F.lit("").alias("asr")))
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("held", F.coalesce(F.last(heard, ignorenulls=True).over(before)["asr"], F.lit(""))).join(outcome, ["session", "seq"])
    lost = F.col("did") == "not_found"
    put = manual & ~lost
    return x.select(
        "session", "seq", "action", F.when(~lost, F.col("slot_ref")).alias("ref"), F.when(lost, "reference_not_found").otherwise(F.col("outcome")).alias("outcome"),
        F.when(put, "operator:manual").alias("source"), F.when(put, F.col("held")).when(F.col("did") == "submit", F.coalesce("asr", F.lit(""))).alias("asr"), F.when(put, F.col("typed")).alias("detected_text"),
    )
