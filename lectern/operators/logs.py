"""Event logs of recognition sessions: JSON lines, damaged ones kept and counted, summed up in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: what a log line may hold.
EVENT = "ts STRING, event STRING, text STRING, partial STRING, vosk_text STRING, payload STRUCT<text: STRING, ref: STRING, book: STRING, chapter: INT, start_verse: INT, end_verse: INT, source: STRING, attempts: ARRAY<STRUCT<text: STRING, ref: STRING, source: STRING, matched: BOOLEAN>>>"


def find_logs(spark: SparkSession, path: str) -> list[str]:
    """The log files that a path means: the file itself; the events.jsonl in a folder; or that of each of its folders."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = hadoop.Path(path.rstrip("/") + "/events.jsonl")
    if store.exists(where) and not store.getFileStatus(where).isDirectory():
        return [path]
    if store.exists(own):
        return [own.toString()]
    return sorted(x.getPath().toString() for x in store.globStatus(hadoop.Path(path.rstrip("/") + "/*/events.jsonl")) or [])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with their place: path, line_no, line. ``line_no`` grows with the place of the line in its file.

    Files are read in splits, without a shuffle: a line's number is made of where its split begins, of the row's number in
    its task, and, as editors end lines by other characters too, of its number among the parts of what the reader took for a
    line. A task reads fewer rows than a split has bytes, so numbers grow from split to split of a file.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + row).alias("at"), "value")
    parts = F.split("value", "[\r\u001c-\u001e\u0085\u2028\u2029\u000b\u000c]")
    lines = read.select("path", "at", F.posexplode(parts).alias("part", "line"))
    return lines.select("path", (F.col("at") * 1024 + F.least("part", F.lit(1023))).alias("line_no"), "line").where(F.trim("line") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines as events: the columns of ``lines``, e (struct), and event. A line that is no JSON object is an event
    invalid_json; it stays."""
    good = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    e = F.when(good, F.from_json("line", EVENT))
    return lines.withColumn("e", e).withColumn("event", F.when(good, F.col("e.event")).otherwise(F.lit("invalid_json")))


def counted_values(events: DataFrame) -> DataFrame:
    """What a summary counts, one row each: kind, value, path, line_no. Kinds: final_text, ref, book, range_ref,
    unmatched_text, unmatched_attempt; blank values don't count."""
    seen = F.col("event").isin("parsed", "text_probe")
    p = F.col("e.payload")
    has = F.trim(F.coalesce(p["ref"], F.lit(""))) != ""
    one = lambda kind, when, value: F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), F.trim(value).alias("value")))).otherwise(F.array().cast("array<struct<kind: string, value: string>>"))
    attempts = F.transform(F.filter(p["attempts"], lambda a: ~F.coalesce(a["matched"], F.lit(False))), lambda a: F.struct(F.lit("unmatched_attempt").alias("kind"), F.trim(a["text"]).alias("value")))
    every = F.concat(
        one("final_text", F.col("event") == "final_raw", F.col("e.text")), one("ref", seen, p["ref"]), one("book", seen, p["book"]), one("range_ref", seen & p["ref"].contains("-"), p["ref"]),
        one("unmatched_text", seen & ~has, F.coalesce(p["text"], F.col("e.text"))), F.when(seen & attempts.isNotNull(), attempts).otherwise(F.array().cast("array<struct<kind: string, value: string>>")),
    )
    return events.select("path", "line_no", F.explode(every).alias("x")).select("x.kind", "x.value", "path", "line_no").where("value <> ''")


def most_common(values: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` values of each kind: kind, value, n, rank. Of equal counts the one met first goes first."""
    counted = values.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "first", "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).drop("first")


def has_json(text: Column) -> Column:
    """Whether a text is valid JSON."""
    return F.try_parse_json(text).isNotNull()


def summary(lines: DataFrame, top: int = 30) -> DataFrame:
    """The report over some logs: what, value, n, rank. Rows "logs" and "events" count files and lines; the others are the
    ``top`` values of each kind of ``counted_values``."""
    counts = lines.groupBy().agg(F.countDistinct("path").alias("logs"), F.count("*").alias("events"))
    totals = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("logs", "events")))).alias("x")).select("x.what", F.lit("").alias("value"), "x.n", F.lit(1).alias("rank"))
    return totals.unionByName(most_common(counted_values(parse_lines(lines)), top).select(F.col("kind").alias("what"), "value", "n", "rank"))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as lines of a log: one column, value. ``events``: ts, event and whatever else; nulls are left out."""
    first = [c for c in ("ts", "event") if c in events.columns]
    return events.select(F.to_json(F.struct(*first, *(c for c in events.columns if c not in first))).alias("value"))


def append_log(events: DataFrame, path: str) -> None:
    """Append events to a folder of JSON lines that ``read_lines`` reads."""
    event_lines(events).write.mode("append").text(path)


#: Fixed value: the fields of EVENT by name.
FIELDS = ("ts", "event", "text", "partial", "vosk_text", "payload")


def log_bodies(lines: DataFrame) -> DataFrame:
    """Lines with whatever they say: adds body (VARIANT; null where a line is no JSON object) and event (invalid_json there)."""
    found = lines.withColumn("body", F.when(F.trim("line").startswith("{"), F.try_parse_json("line")))
    return found.withColumn("event", F.when(F.col("body").isNull(), F.lit("invalid_json")).otherwise(F.try_variant_get("body", "$.event", "string")))


def other_fields(bodies: DataFrame) -> DataFrame:
    """The fields of events that EVENT has no name for, one row each: path, line_no, event, field, type, value (VARIANT)."""
    fields = F.map_filter(F.col("body").try_cast("map<string, variant>"), lambda k, _: ~k.isin(*FIELDS))
    x = bodies.select("path", "line_no", "event", F.explode(fields).alias("field", "value"))
    return x.select("path", "line_no", "event", "field", F.schema_of_variant("value").alias("type"), "value")


def restated(bodies: DataFrame, **changes: Column) -> DataFrame:
    """Bodies as lines of a log (one column, value), with some top-level fields set; all others, known or not, stay as they
    were, and so does a line that is no JSON object."""
    kept = F.map_filter(F.col("body").try_cast("map<string, variant>"), lambda k, _: ~k.isin(*changes) if changes else F.lit(True))
    new = [x for name, value in changes.items() for x in (F.lit(name), value.cast("variant"))]
    return bodies.select(F.coalesce(F.to_json(F.map_concat(kept, F.create_map(*new)) if new else kept), F.col("line")).alias("value"))


def heavy_hitters(values: DataFrame, top: int = 30, tracked: int = 8192) -> DataFrame:
    """What ``most_common`` gives, without shuffling every value: kind, value, n, rank.

    A mergeable sketch of each kind's frequent values (by their hashes, so that long texts cost no more) names at most
    ``tracked`` candidates; only rows of these are counted, exactly. A value that a sketch doesn't name occurs in at most a
    share of 7 / ``tracked`` of its kind's rows (twice the sketch's error), so a kind is settled if its last value on the
    list occurs more often than that, or if its candidates are all its rows. The other kinds are counted in full. ``kind``
    should have few values: ``tracked`` hashes of each are broadcast.
    """
    keyed = values.withColumn("h", F.xxhash64("value"))
    sketch = keyed.groupBy("kind").agg(F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("s"), F.count("*").alias("total"))
    named = sketch.select("kind", F.explode("s.item").alias("h"))
    counted = keyed.join(F.broadcast(named), ["kind", "h"], "left_semi").groupBy("kind", "value").agg(F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("first"))
    by_kind = Window.partitionBy("kind")
    ranked = counted.withColumn("rank", F.row_number().over(by_kind.orderBy(F.desc("n"), "first", "value"))).withColumn("covered", F.sum("n").over(by_kind)).where(F.col("rank") <= top)
    judged = ranked.groupBy("kind").agg(F.max("covered").alias("covered"), F.min(F.when(F.col("rank") == top, F.col("n"))).alias("least"))
    settled = sketch.join(judged, "kind").where((F.col("covered") == F.col("total")) | (F.col("least") * tracked > F.col("total") * 7)).select("kind")
    sure = ranked.join(F.broadcast(settled), "kind", "left_semi").select("kind", "value", "n", "rank")
    return sure.unionByName(most_common(values.join(F.broadcast(settled), "kind", "left_anti"), top))


def session_files(lines: DataFrame) -> DataFrame:
    """What each log says of its session, one row each: path, began, ended (first and last ts), events, invalid, settings.

    ``settings`` is the JSON object that the log's last event "session" gives beside ts and event, or an empty one.
    """
    x = log_bodies(lines).withColumn("ts", F.try_variant_get("body", "$.ts", "string"))
    rest = F.map_filter(F.col("body").try_cast("map<string, variant>"), lambda k, _: ~k.isin("ts", "event"))
    last = F.max_by(F.to_json(rest), F.when(F.col("event") == "session", F.col("line_no")))
    return x.groupBy("path").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.count_if(F.col("event") == "invalid_json").alias("invalid"), F.coalesce(last, F.lit("{}")).alias("settings"))
