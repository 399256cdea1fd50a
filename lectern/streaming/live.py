"""Live sessions: fragments of speech in, references out, with the state that a session carries.

State of a session: its last fragments, the number of the newest, and the last book and chapter recognised. A micro-batch is
the batch plan over the state's fragments and the new ones, so a stream finds what a batch over the same fragments does. The
state lies in buckets of sessions beside the output: a micro-batch reads and writes those of its own sessions, under its
number, and an index of which micro-batch wrote each bucket last. A batch that is run again after a failure reads the index of
the one before and replaces its own tables; what two batches have superseded is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.sessions import first_match, fragment_windows, jeremiah_as_nehemiah, same_place, says_same_place
from lectern.plans.held import Held
from lectern.plans.parse import parse_references

FRAGMENT = "session string, seq long, text string, low boolean"
STATE = "session string, last_seq long, kept array<string>, book string, chapter int"
INDEX = "bucket int, batch long"
BUCKETS = 256


def live_fragments(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Fragments that a recogniser drops as JSON lines into a folder, as a stream: session, seq, text, low (whether Jeremiah was
    heard without confidence). Partial results and audio events are logged there too; they are no fragments."""
    lines = spark.readStream.schema("event string, " + FRAGMENT).option("maxFilesPerTrigger", files_at_once).json(path)
    return lines.where("coalesce(event, 'final') = 'final'").drop("event")


def live_bodies(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Fragments like ``live_fragments``, with every line that is none: also body (the line) and error, which is null for
    fragments, else not_json, or the field that is missing or of the wrong kind."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path).where("trim(value) <> ''")
    v = lines.select(F.col("value").alias("body"), F.when(F.trim("value").startswith("{"), F.try_parse_json("value")).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    fields = v.select("body", F.col("v").isNull().alias("bad"), F.coalesce(get("event", "string"), F.lit("final")).alias("event"), get("session", "string").alias("session"), get("seq", "long").alias("seq"), get("text", "string").alias("text"), get("low", "boolean").alias("low"))
    missing = F.coalesce(*(F.when(F.col(c).isNull(), c) for c in ("session", "seq", "text")))
    return fields.where("bad or event = 'final'").withColumn("error", F.when(F.col("bad"), "not_json").otherwise(missing)).select("session", "seq", "text", "low", "body", "error")


def _parsed(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct ``texts`` (text) with what was parsed: text, ref, book, chapter."""
    found = parse_references(texts.select(F.col("text").alias("utt_id"), "text"), sizes)
    return texts.join(found.select(F.col("utt_id").alias("text"), "ref", "book", "chapter"), "text", "left")


def _matched(rows: DataFrame, kept: list[str], sizes: DataFrame, known: DataFrame | None, held: Held) -> tuple[DataFrame, DataFrame | None]:
    """The columns ``kept`` of ``rows`` with m (see ``first_match``) and found (whether any text matched), and all that has been
    parsed: ``known`` and more. ``rows``: puts (the texts to try), low, and ``kept``.

    Texts are tried in turn, and only for rows that none matched before. The later ones join several fragments, so nearly each
    is another text, and most rows need none of them.
    """
    parsed = F.struct("text", "ref", "book", "chapter")
    at, over = 0, []
    now = rows.withColumn("attempts", F.array().cast("array<struct<text:string,ref:string,book:string,chapter:int>>"))
    while True:
        over.append(now.where(F.size("puts") <= at))
        now = now.where(F.size("puts") > at).withColumn("own", F.get("puts", F.lit(at))).withColumn("other", jeremiah_as_nehemiah(F.col("own")))
        texts = now.select(F.explode(F.array_compact(F.array("own", "other"))).alias("text")).distinct()
        texts = held.write(texts if known is None else texts.join(known.select("text"), "text", "left_anti"))
        if not texts.isEmpty():
            fresh = held.write(_parsed(texts, sizes))
            known = fresh if known is None else held.write(known.unionByName(fresh))
        if known is None or now.isEmpty():
            break
        both = now.join(known.select(F.col("text").alias("own"), parsed.alias("own_parsed")), "own").join(known.select(F.col("text").alias("other"), parsed.alias("other_parsed")), "other", "left")
        # Nehemiah goes before Jeremiah if it parses, and Jeremiah doesn't or was heard without confidence.
        better = F.coalesce((F.col("other_parsed.book") == "Неемия") & (F.col("own_parsed.ref").isNull() | F.col("low")), F.lit(False))
        tried = F.concat("attempts", F.when(better, F.array("other_parsed", "own_parsed")).otherwise(F.array("own_parsed")))
        now = held.write(both.withColumn("attempts", tried).select(*kept, *(c for c in ("puts", "low") if c not in kept), "attempts", F.exists(tried, lambda a: a["ref"].isNotNull()).alias("found")))
        over.append(now.where("found").drop("found"))
        now, at = now.where("not found").drop("found"), at + 1
    every = over[0].select(*kept, "attempts")
    for x in over[1:]:
        every = every.unionByName(x.select(*kept, "attempts"))
    return every.select(*kept, first_match(F.col("attempts")).alias("m"), F.exists("attempts", lambda a: a["ref"].isNotNull()).alias("found")), known


def session_references(fragments: DataFrame, sizes: DataFrame, state: DataFrame | None = None, last: int = 3, held: Held | None = None) -> DataFrame:
    """What each fragment of sessions refers to: session, seq, text, attempt (what was parsed), ref, book, chapter, blocked.

    ``fragments``: session, seq, text, and maybe low; blank ones are none, of one that was delivered twice one counts, and
    those up to the number in the ``state`` are old. Attempts are the fragment, then it with those before it (``last`` in
    all); "там же" among them stands for the last book and chapter; Jeremiah may stand for Nehemiah.

    The last book depends on what was parsed before, so this goes in rounds: the first leaves out fragments that hang on it,
    each further one parses those of them whose context has changed, which settles at least the next "там же" of each session.
    Rounds end when no context changes. The result reads tables of ``held``, which the caller may clear once it has written
    the result.
    """
    held = held or Held(fragments.sparkSession)
    low = F.coalesce("low", F.lit(False)) if "low" in fragments.columns else F.lit(False)
    new = fragments.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.trim(F.regexp_replace("text", F.lit(r"(?U)\s+"), F.lit(" "))).alias("text"), low.alias("low"), F.lit(True).alias("new")).where("text <> ''").dropDuplicates(["session", "seq"])
    every = new
    if state is not None:
        new = new.join(state.select("session", "last_seq"), "session", "left").where("last_seq is null or seq > last_seq").drop("last_seq")
        old = state.select("session", "last_seq", F.size("kept").alias("n"), F.posexplode("kept").alias("at", "text"))
        old = old.select("session", (F.col("last_seq") - F.col("n") + F.col("at") + 1).alias("seq"), "text", F.lit(False).alias("low"), F.lit(False).alias("new"))
        every = new.unionByName(old)
    tries = fragment_windows(every, last).join(every.select("session", "seq", "text", "low", "new"), ["session", "seq"]).where("new").drop("new")
    if state is not None:
        tries = tries.join(state.select("session", F.col("book").alias("old_book"), F.col("chapter").alias("old_chapter")), "session", "left")
    else:
        tries = tries.withColumn("old_book", F.lit(None).cast("string")).withColumn("old_chapter", F.lit(None).cast("int"))
    # First what no context changes: the texts before the first that says "there as well".
    again = F.array_position(F.transform("candidates", says_same_place), True)
    plain = F.when(again > 0, F.slice("candidates", F.lit(1), again.cast("int") - 1)).otherwise(F.col("candidates"))
    tries = held.write(tries.withColumn("puts", plain).withColumn("open", again > 0).withColumn("b", F.lit(None).cast("string")).withColumn("c", F.lit(None).cast("int")))
    kept = ["session", "seq", "text", "low", "candidates", "old_book", "old_chapter", "open", "b", "c"]
    result, known = _matched(tries, kept, sizes, None, held)
    # From here on open are those that hang on the context, whatever they find; the others are done.
    result = held.write(result.withColumn("open", F.col("open") & ~F.col("found")))
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("m.hit.ref").isNotNull(), F.struct(F.col("m.hit.book").alias("b"), F.col("m.hit.chapter").alias("c")))
    first = True
    while True:
        x = result.withColumn("l", F.last(hit, ignorenulls=True).over(before)).where("open")
        x = x.withColumn("now_b", F.coalesce("l.b", "old_book")).withColumn("now_c", F.when(F.col("l.b").isNull(), F.col("old_chapter")).otherwise(F.col("l.c")))
        changed = held.write((x if first else x.where("not (b <=> now_b and c <=> now_c)")).select(*(c for c in kept if c not in ("b", "c")), F.col("now_b").alias("b"), F.col("now_c").alias("c")))
        if changed.isEmpty():
            return result.select("session", "seq", "text", F.col("m.hit.text").alias("attempt"), F.col("m.hit.ref").alias("ref"), F.col("m.hit.book").alias("book"), F.col("m.hit.chapter").alias("chapter"), F.col("m.blocked").alias("blocked"))
        fresh, known = _matched(changed.withColumn("puts", same_place(F.col("candidates"), F.col("b"), F.col("c"))), kept, sizes, known, held)
        result = held.write(result.join(changed.select("session", "seq"), ["session", "seq"], "left_anti").unionByName(fresh))
        first = False


def next_state(state: DataFrame | None, references: DataFrame, last: int = 3) -> DataFrame:
    """The state after the fragments of ``references`` (see ``session_references``)."""
    rows = references.select("session", "seq", "text", "book", "chapter")
    own = rows.groupBy("session").agg(F.max("seq").alias("last_seq"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("texts"), F.max_by(F.struct("book", "chapter"), F.when(F.col("book").isNotNull(), F.col("seq"))).alias("p"))
    if state is None:
        return own.select("session", "last_seq", F.slice("texts", -F.least(F.lit(last), F.size("texts")), F.lit(last)).alias("kept"), F.col("p.book").alias("book"), F.col("p.chapter").alias("chapter"))
    old = state.withColumnsRenamed({"last_seq": "old_seq", "book": "old_book", "chapter": "old_chapter"})
    both = old.join(own, "session", "full_outer")
    texts = F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.coalesce("texts", F.array().cast("array<string>")))
    chapter = F.when(F.col("p.book").isNull(), F.col("old_chapter")).otherwise(F.col("p.chapter"))
    kept = F.slice(F.col("t"), -F.least(F.lit(last), F.size("t")), F.lit(last))
    return both.withColumn("t", texts).select("session", F.coalesce("last_seq", "old_seq").alias("last_seq"), kept.alias("kept"), F.coalesce("p.book", "old_book").alias("book"), chapter.alias("chapter"))


def _bucket(session: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(session).cast("string")), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, path: str, number: int, buckets: list[int] | None = None) -> DataFrame:
    """The sessions' state after a micro-batch, of some buckets or of all."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index/batch={number}").collect()
    places = [f"{path}/state/batch={r.batch}/bucket={r.bucket}" for r in index if buckets is None or r.bucket in buckets]
    return spark.read.schema(STATE).parquet(*places) if places else spark.createDataFrame([], STATE)


def publish(fragments: DataFrame, sizes: DataFrame, path: str, checkpoint: str, last: int = 3, buckets: int = BUCKETS):
    """Start the stream that writes what live fragments refer to under ``path``/references, each micro-batch under its number,
    and the sessions' state (see ``read_state``). Lines with an error (see ``live_bodies``) go to ``path``/rejected.

    ``buckets``, of which the driver knows the numbers, must stay what it was when the stream began.
    """
    spark = fragments.sparkSession

    def index(number: int) -> dict[int, int]:
        return {r.bucket: r.batch for r in spark.read.schema(INDEX).parquet(f"{path}/index/batch={number}").collect()} if number >= 0 else {}

    def at(place: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{place}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def remove(place: str) -> None:
        store, where = at(place)
        store.delete(where, True)

    def write(batch: DataFrame, number: int) -> None:
        held = Held(spark)
        batch = held.write(batch)
        if "error" in batch.columns:
            batch.where("error is not null").select("body", "error").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
            batch = batch.where("error is null").drop("body", "error")
        before = index(number - 1)
        touched = {r.bucket for r in batch.select(_bucket("session", buckets).alias("bucket")).distinct().collect()}
        state = read_state(spark, path, number - 1, sorted(touched)) if touched & before.keys() else None
        found = session_references(batch, sizes, state, last, held)
        found.write.mode("overwrite").parquet(f"{path}/references/batch={number}")
        done = spark.read.schema(found.schema).parquet(f"{path}/references/batch={number}")
        after = next_state(state, done, last).select("session", "last_seq", "kept", "book", "chapter").withColumn("bucket", _bucket("session", buckets))
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/batch={number}")
        # Sessions of blank fragments alone leave no state.
        kept = {r.bucket for r in spark.read.schema(STATE + ", bucket int").parquet(f"{path}/state/batch={number}").select("bucket").distinct().collect()}
        now = before | {b: number for b in kept}
        spark.createDataFrame(list(now.items()), INDEX).coalesce(1).write.mode("overwrite").parquet(f"{path}/index/batch={number}")
        # The batch before is settled once this one runs: what it superseded is read by nobody.
        # Its index goes last; where that is gone, a batch that is run again has nothing left to remove.
        store, where = at(f"index/batch={number - 2}")
        if number >= 2 and store.exists(where):
            for b, written in index(number - 2).items():
                if before[b] != written:
                    remove(f"state/batch={written}/bucket={b}")
            remove(f"index/batch={number - 2}")
        held.clear()

    return fragments.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
