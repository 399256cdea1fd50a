"""Sessions of recognised references: fragments, context, approvals, share lists, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.books import spoken_names


def fragment_windows(fragments: DataFrame, last: int = 3) -> DataFrame:
    """For each fragment of a session the texts to try: the last 1, 2, ... ``last`` fragments joined, shortest first and
    without repeats: session, seq, candidates. Blank fragments are no fragments. ``fragments``: session, seq, text."""
    clean = fragments.select("session", "seq", F.trim("text").alias("text")).where("text <> ''")
    kept = F.collect_list("text").over(Window.partitionBy("session").orderBy("seq").rowsBetween(1 - max(1, last), 0))
    x = clean.withColumn("kept", kept)
    tails = F.transform(F.sequence(F.lit(1), F.size("kept")), lambda k: F.array_join(F.slice("kept", -k, k), " "))
    return x.select("session", "seq", F.array_distinct(tails).alias("candidates"))


def carried_forward(parsed: DataFrame) -> DataFrame:
    """The last reference known at each fragment: adds last_ref. ``parsed``: session, seq, ref (null where none)."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return parsed.withColumn("last_ref", F.last("ref", ignorenulls=True).over(w))


_AGAIN = r"(?iU)\bтам\s+же\b"


def says_same_place(text: Column) -> Column:
    """Whether a text has "там же" (in the same place)."""
    return text.rlike(_AGAIN)


def same_place(candidates: Column, book: Column, chapter: Column) -> Column:
    """Texts to try, each that says "там же" (in the same place) and more followed by one with the last book and chapter put in."""

    def both(text: Column) -> Column:
        rest = F.trim(F.regexp_replace(text, F.lit(_AGAIN), F.lit("")))
        put = F.concat_ws(" ", book, chapter.cast("string"), F.lit("глава"), rest)
        return F.when(says_same_place(text) & book.isNotNull() & chapter.isNotNull() & (rest != ""), F.array(text, put)).otherwise(F.array(text))

    return F.flatten(F.transform(candidates, both))


def _names_pattern() -> str:
    names = sorted({n.replace("ё", "е") for pair in spoken_names() for n in (pair[0], pair[1].lower())}, key=lambda n: (-len(n), n))
    return "|".join(names)


def _low(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


_KEYWORD = r"(?U)\b(?:глава|стих|псалом)\b"


def likely_explicit(text: Column) -> Column:
    """Whether a text has a keyword of references and the name of a book."""
    low = _low(text)
    return F.coalesce(low.rlike(_KEYWORD) & low.rlike(rf"(?U)\b(?:{_names_pattern()})\b"), F.lit(False))


def likely_book_only(text: Column) -> Column:
    """Whether a text of up to four words is the name of a book and nothing else; a single word may have an "а" too many."""
    low = F.trim(_low(text))
    whole = rf"^(?:{_names_pattern()})$"
    shorter = ~low.contains(" ") & low.endswith("а") & (F.length(low) > 3) & F.substring(low, F.lit(1), F.length(low) - 1).rlike(whole)
    return F.coalesce((low != "") & ~low.rlike(_KEYWORD) & (F.size(F.split(low, r"\s+")) <= 4) & (low.rlike(whole) | shorter), F.lit(False))


def same_place_only(text: Column) -> Column:
    """Whether a text is "там же" and nothing else."""
    return F.coalesce(_low(text).rlike(r"(?U)^\s*там\s+же\s*$"), F.lit(False))


def first_match(attempts: Column) -> Column:
    """The first of the attempts (array of text, ref, and whatever else) that matched, as (hit, blocked).

    Where it isn't the first attempt, which is the newest fragment alone, although that looks like a reference, a book or
    "там же" of its own, what matched is older context, and it is blocked.
    """
    hit = F.try_element_at(F.filter(attempts, lambda a: a["ref"].isNotNull()), F.lit(1))
    own = F.try_element_at(attempts, F.lit(1))
    stale = F.coalesce(hit.isNotNull() & own["ref"].isNull() & (likely_explicit(own["text"]) | likely_book_only(own["text"]) | same_place_only(own["text"])), F.lit(False))
    return F.struct(F.when(~stale, hit).alias("hit"), stale.alias("blocked"))


def jeremiah_as_nehemiah(text: Column) -> Column:
    """A text with Nehemiah for Jeremiah, which sounds alike; null where it has no Jeremiah."""
    put = F.regexp_replace(F.regexp_replace(text, F.lit(r"(?iU)\bиеремии\b"), F.lit("неемии")), F.lit(r"(?iU)\bиеремия\b"), F.lit("неемия"))
    return F.when(put != text, put)


def without_repeats(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows but those that equal the one before in ``columns``, by ``key`` in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w)) & (F.row_number().over(w) > 1)
    return rows.withColumn("_same", same).where("not _same").drop("_same")


def share_list(quotes: DataFrame, distinct: bool = True) -> DataFrame:
    """The numbered list of a session's references: session, n, share_text. ``quotes``: session, seq, ref. With
    ``distinct`` each reference stands once, where it was first."""
    real = quotes.where("trim(ref) <> ''")
    if distinct:
        real = real.groupBy("session", "ref").agg(F.min("seq").alias("seq"))
    lined = F.sort_array(F.collect_list(F.struct("seq", "ref")))
    x = real.groupBy("session").agg(lined.alias("q"))
    return x.select("session", F.size("q").alias("n"), F.array_join(F.transform("q", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["ref"])), "\n").alias("share_text"))


def approvals(actions: DataFrame) -> DataFrame:
    """What becomes of each action on a session's one pending candidate: session, seq, action, ref, outcome.

    ``actions``: session, seq, action (submit, approve, reject, manual, reset), ref, callback_ok. A submit or manual takes the
    slot; an approve or reject uses it up, unless its callback fails, which leaves it; a reset empties it.
    """
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    well = F.coalesce("callback_ok", F.lit(True))
    puts, takes = F.col("action").isin("submit", "manual"), (F.col("action") == "reset") | (F.col("action").isin("approve", "reject") & well)
    change = F.when(puts, F.struct(F.col("ref").alias("ref"))).when(takes, F.struct(F.lit(None).cast("string").alias("ref")))
    x = actions.withColumn("slot", F.last(change, ignorenulls=True).over(w)["ref"])
    outcome = (
        F.when(puts, F.lit("pending"))
        .when(F.col("action") == "reset", "reset")
        .when(~F.col("action").isin("approve", "reject"), "unknown_action")
        .when(F.col("slot").isNull(), "no_pending_candidate")
        .when(~well, "callback_failed")
        .when(F.col("action") == "reject", "rejected")
        .otherwise("approved")
    )
    return x.select("session", "seq", "action", F.when(puts, F.col("ref")).otherwise(F.col("slot")).alias("ref"), outcome.alias("outcome"))


def processing(transitions: DataFrame) -> DataFrame:
    """The state that a session shows after each action: adds stage, progress, manual_required. ``transitions``: see
    ``approvals``. What changes nothing leaves the state; a session begins, and begins anew, idle."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    state = lambda stage, n, manual: F.struct(F.lit(stage).alias("stage"), F.lit(n).alias("progress"), F.lit(manual).alias("manual_required"))
    o = F.col("outcome")
    idle = state("idle", 0, False)
    made = F.when(o == "pending", state("candidate", 100, False)).when(o == "approved", state("approved", 100, False)).when(o == "rejected", state("rejected", 0, True)).when(o == "reset", idle)
    return transitions.withColumn("s", F.coalesce(F.last(made, ignorenulls=True).over(w), idle)).select(*transitions.columns, "s.*")


def route(has_slide: Column, needs_approval: Column, approval_ui: Column, output: Column) -> Column:
    """Where a recognised reference goes: an array of sinks. Without a slide nowhere; if it needs approval to that surface
    alone; else to the outputs that are named (web, slides, or both)."""
    direct = F.array_compact(F.array(F.when(output.isin("slides", "both"), "slides"), F.when(output.isin("web", "both"), "web")))
    waiting = F.array(F.when(approval_ui == "popup", "approval:popup").otherwise("approval:web"))
    none = F.array().cast("array<string>")
    return F.when(~F.coalesce(has_slide, F.lit(False)), none).when(needs_approval, waiting).otherwise(direct)


def picked_ranges(taps: DataFrame) -> DataFrame:
    """The verses that taps leave picked: session, first, last (both null where none are). ``taps``: session, seq, verse.

    The first tap picks a verse, a second one the range between both, or nothing if it is the same verse; a third begins anew.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "verse"))), lambda t: t["verse"])
    none = F.lit(None).cast("int")
    state = lambda a, z, done: F.struct(a.cast("int").alias("first"), z.cast("int").alias("last"), done.alias("done"))

    def tap(s: Column, v: Column) -> Column:
        begin = s["first"].isNull() | s["done"]
        return F.when(begin, state(v, v, F.lit(False))).when(s["first"] == v, state(none, none, F.lit(False))).otherwise(state(F.least(s["first"], v), F.greatest(s["first"], v), F.lit(True)))

    x = taps.groupBy("session").agg(ordered.alias("t")).withColumn("s", F.aggregate("t", state(none, none, F.lit(False)), tap))
    return x.select("session", "s.first", "s.last")


def visible_books(topics: DataFrame, structure: DataFrame) -> DataFrame:
    """The books of each topic (topic, book) that a verse table has (``structure``: book, ...)."""
    return topics.join(structure.select("book").distinct(), "book", "left_semi")


def action_label(approval_action: Column, approval_reason: Column, sent: Column) -> Column:
    """How a published reference is called in a session: what was decided, else waiting, sent or recognised."""
    return F.when(approval_action.isin("approve", "reject"), approval_action).when(approval_reason == "waiting_for_approval", "waiting").when(sent, "sent").otherwise("recognized")


def response_reason(body: Column) -> Column:
    """Reading of a sink's answer as (ok, reason): blank or non-JSON is well, a status or error field says otherwise."""
    get = lambda path: F.get_json_object(body, path)
    error, status = F.coalesce(get("$.error.message"), get("$.error")), get("$.status")
    bad = error.isNotNull() | (F.lower(status).isin("error", "fail", "failed")) | (get("$.map.key_ok") == "false")
    reason = F.coalesce(error, F.when(get("$.map.key_ok") == "false", "invalid_token"), F.concat(F.lit("status:"), status))
    return F.when(body.isNull() | (F.trim(body) == "") | F.try_parse_json(body).isNull() | ~F.coalesce(bad, F.lit(False)), F.struct(F.lit(True).alias("ok"), F.lit("").alias("reason"))).otherwise(F.struct(F.lit(False).alias("ok"), reason.alias("reason")))


def low_confidence(words: Column, word: str = "иереми[яи]", most: float = 0.76) -> Column:
    """Whether a word that fits the pattern was heard with a confidence of at most ``most``. ``words``: array of (word, conf)."""
    return F.coalesce(F.exists(words, lambda w: w["word"].rlike(f"(?iu)^(?:{word})$") & (w["conf"].try_cast("double") <= most)), F.lit(False))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")
