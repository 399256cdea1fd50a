"""Sessions, logs, search, streams; and all catalogued queries against their SQL on the smallest tables."""

import glob
import json
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import likeness, logs, lookup, search, sessions
from lectern.plans import catalogue
from lectern.sources.canon import chapter_sizes, formula_verses
from lectern.streaming import journal
from lectern.streaming.live import live_bodies, live_fragments, publish, read_state, session_references

SF = "/root/testdata/sf0.001"


def test_sessions(spark):
    f = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("a", 3, "y"), ("a", 4, "z"), ("a", 5, "w")], "session string, seq long, text string")
    got = {r.seq: r.candidates for r in sessions.fragment_windows(f, 3).collect()}
    assert got == {1: ["x"], 3: ["y", "x y"], 4: ["z", "y z", "x y z"], 5: ["w", "z w", "y z w"]}
    a = spark.createDataFrame([("s", 1, "approve", None, None), ("s", 2, "submit", "A", None), ("s", 3, "approve", None, False), ("s", 4, "approve", None, True), ("s", 5, "reject", None, None), ("s", 6, "jump", None, None)], "session string, seq long, action string, ref string, callback_ok boolean")
    assert [r.outcome for r in sessions.approvals(a).orderBy("seq").collect()] == ["no_pending_candidate", "pending", "callback_failed", "approved", "no_pending_candidate", "unknown_action"]
    q = spark.createDataFrame([("s", 1, "B"), ("s", 2, "A"), ("s", 3, "B"), ("s", 4, " ")], "session string, seq long, ref string")
    assert sessions.share_list(q).first().share_text == "1. B\n2. A" and sessions.share_list(q, False).first().n == 3


def test_logs(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text('{"event": "parsed", "payload": {"ref": "A 1:2-3", "book": "A"}}\n\n[1]\n{"event": "final_raw", "text": "x"}\nbroken {\n{"event": "parsed", "text": "t", "payload": {"attempts": [{"text": "u", "matched": false}, {"text": "v", "matched": true}]}}\n')
    events = logs.parse_lines(logs.read_lines(spark, str(tmp_path)))
    assert {r.event: r["count"] for r in events.groupBy("event").count().collect()} == {"parsed": 2, "invalid_json": 2, "final_raw": 1}
    assert {(r.kind, r.value) for r in logs.most_common(logs.counted_values(events)).collect()} == {("ref", "A 1:2-3"), ("range_ref", "A 1:2-3"), ("book", "A"), ("final_text", "x"), ("unmatched_text", "t"), ("unmatched_attempt", "u")}


def test_search(spark):
    q = spark.createDataFrame([(1, "one two three four five six"), (2, "zz"), (3, "alpha beta gamma delta")], "query_id long, q string")
    w = spark.createDataFrame([(10, "zero one two three four five six seven"), (11, "one two three four five six"), (12, "alpha beta gamma delto epsilon")], "window_id long, norm string")
    assert {(r.query_id, r.window_id, r.score) for r in search.contained(q, w).collect()} == {(1, 10, 100.0), (1, 11, 110.0)}
    best = search.best_windows(search.similar(q, w), w, 1).where("query_id = 3").first()
    assert best.window_id == 12 and best.score > 80


def test_lookup(spark):
    phrases = {r.phrase for r in lookup.recogniser_phrases(spark).collect()}
    assert "[unk]" in phrases and "матфей" in phrases and not any(any(c.isdigit() for c in p) for p in phrases)


def test_logs_found_and_appended(spark, tmp_path):
    events = spark.createDataFrame([("t1", "final_raw", "раз"), ("t2", "parsed", None)], "ts string, event string, text string")
    for name in ("b", "a"):
        logs.append_log(events.coalesce(1), str(tmp_path / name / "events.jsonl"))
    found = logs.find_logs(spark, str(tmp_path))
    assert [f.rsplit("/", 2)[1] for f in found] == ["a", "b"]
    assert logs.find_logs(spark, str(tmp_path / "a"))[0].endswith("a/events.jsonl") and logs.find_logs(spark, str(tmp_path / "none")) == []
    lines = logs.read_lines(spark, found)
    assert logs.parse_lines(lines).groupBy("event").count().orderBy("event").collect() == [("final_raw", 2), ("parsed", 2)]
    report = {(r.what, r.value): r.n for r in logs.summary(lines).collect()}
    assert report["events", ""] == 4 and report["final_text", "раз"] == 2


def test_line_numbers_grow(spark, tmp_path):
    """Lines of a file that is read in splits are numbered in the order in which they stand there."""
    path = tmp_path / "events.jsonl"
    path.write_text("".join(f"{i}{chr(0x2028) if i % 3 == 0 else chr(10)}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [int(r.line) for r in logs.read_lines(spark, str(path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(3000))


def test_search_equals_brute_force(spark):
    """Containment at any character, for texts of one word or many, is what comparing all with all finds."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 6)))
    windows = {i: " ".join(word() for _ in range(r.randrange(1, 12))) for i in range(60)} | {900: "gamma delta epsilon", 901: ""}
    parts = [w[a : a + r.randrange(4, 20)].strip() for w in windows.values() if len(w) > 4 for a in (0, 1, len(w) // 2)]
    queries = dict(enumerate([*parts, "amma del", "amma delta eps", "gamma", "mm", "gamma delta epsilon", "zz", ""]))
    q = spark.createDataFrame(list(queries.items()), "query_id long, q string")
    w = spark.createDataFrame(list(windows.items()), "window_id long, norm string")
    want = {(i, j, 110.0 if a == b else 100.0) for i, a in queries.items() for j, b in windows.items() if len(a) >= 5 and a in b}
    assert {(x.query_id, x.window_id, x.score) for x in search.contained(q, w).collect()} == want and len(want) > 100
    held = {(i, j) for i, a in queries.items() for j, b in windows.items() if len(b) >= 5 and b in a}
    assert {(x.query_id, x.window_id) for x in search.embedded(q, w).collect()} == held


def test_similar_recall(spark):
    """Of the pairs that comparing all with all finds, those that share no run of words are lost: the share is known."""
    r = random.Random(6)
    verses = {i: " ".join(f"{r.choice('abcdefgh')}{r.randrange(60)}" for _ in range(r.randrange(6, 14))) for i in range(80)}
    heard = {i: " ".join(w if r.random() > 0.15 else "z" + w for w in verses[i].split()) for i in range(0, 80, 2)}
    q = spark.createDataFrame(list(heard.items()), "query_id long, q string")
    w = spark.createDataFrame(list(verses.items()), "window_id long, norm string")
    both = q.crossJoin(w).withColumn("score", search.similarity("q", "norm")).where("score >= 80")
    want = {(x.query_id, x.window_id) for x in both.collect()}
    got = {(x.query_id, x.window_id) for x in search.similar(q, w, 80.0).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 20
    best = {x.query_id: (x.window_id, x.score) for x in search.search_quotes(q.unionByName(spark.createDataFrame([(500, verses[1]), (501, verses[3][:-2])], "query_id long, q string")), w, 1).collect()}
    assert best[500] == (1, 110.0) and best[501] == (3, 100.0)


@pytest.mark.parametrize("least", [45.0, 80.0])
def test_similar_all_equals_brute_force(spark, least, monkeypatch):
    """All pairs at or over the limit, and their scores, are what comparing all with all finds: with misheard, moved, long,
    repeated and short texts, over many blocks."""
    monkeypatch.setattr(likeness, "UNITS", 40)
    r = random.Random(9)
    words = ["".join(r.choice("абвгдеиклмнорст") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    verses = {i: " ".join(r.choice(words) for _ in range(r.choice((1, 3, 4, 7, 9, 14, 60)))) for i in range(60)}
    verses |= {70: verses[0], 71: "", 72: None, 73: "ааааааааааааааааааааааааа", 74: " ".join(["да"] * 30), 75: "😀" * 24}
    heard = {i: " ".join(w if r.random() > 0.15 else "".join(r.sample(w, len(w))) for w in (verses[i] or "").split()) for i in range(0, 60, 2)}
    heard |= {80: "начало " + (verses[5] or "") + " конец", 81: None, 82: "", 83: "а" * 30, 84: " ".join(["да"] * 28), 85: "😀" * 20, 86: verses[4]}
    q = spark.createDataFrame(list(heard.items()), "query_id long, q string")
    w = spark.createDataFrame(list(verses.items()) + [(3, verses[3])], "window_id long, norm string")
    score = search.similarity.func
    want = {(i, j): s for i, a in heard.items() for j, b in verses.items() if a and len(a) >= 20 and b for s in [score(pd.Series([a]), pd.Series([b]))[0]] if s >= least}
    got = [(x.query_id, x.window_id, x.score) for x in likeness.similar_all(q, w, least).collect()]
    assert {(i, j): s for i, j, s in got} == want and len(got) == len(want) >= 20
    assert likeness.similar_all(q.limit(0), w, least).count() == 0 and likeness.similar_all(q, w.limit(0), least).count() == 0


SAID = [
    ("a", 1, "Матфей 5 глава 3 стих", 1, "Матфей 5:3"), ("a", 2, "и там же 7 стих", 1, "Матфей 5:7"), ("a", 3, "", 1, None), ("b", 1, "просто слова", 1, None),
    ("a", 4, "и еще там же 9 стих", 2, "Матфей 5:9"), ("b", 2, "там же", 2, None), ("a", 4, "и еще там же 9 стих", 2, "Матфей 5:9"),
    ("b", 3, "Марк", 3, None), ("b", 4, "3 глава 16 стих", 3, "Марк 3:16"), ("a", 5, "Неемия 2 глава", 3, "Матфей 5:9"), ("a", 6, "и там же 4 стих", 3, "Матфей 5:4"), ("b", 5, "Лука 2 глава и там же 4 стих", 3, "Лука 2:4"), ("b", 6, "там же 5 стих", 3, "Лука 2:5"),
]


def test_live_sessions(spark, tmp_path):
    """A stream over any micro-batches finds what the batch does: context is carried, stale context is blocked, and blank and
    repeated fragments count for nothing."""
    sizes = chapter_sizes(formula_verses(spark))
    rows = [(s, i, t, None) for s, i, t, _, _ in SAID]
    schema = "session string, seq long, text string, low boolean"
    whole = session_references(spark.createDataFrame(rows, schema), sizes)
    got = {(r.session, r.seq): (r.ref, r.blocked) for r in whole.collect()}
    assert ("a", 3) not in got and got["a", 1][0] == "Матфей 5:3" and got["a", 2][0] == "Матфей 5:7" and got["a", 4][0] == "Матфей 5:9" and got["b", 4][0] == "Марк 3:16"
    assert got["b", 2] == (None, False) and got["b", 5][0] == "Лука 2:4" and got["b", 6][0] == "Лука 2:5"
    for k in (1, 2, 3):
        lines = [json.dumps({"event": "final", "session": s, "seq": i, "text": t}) for s, i, t, at, _ in SAID if at == k] + [json.dumps({"event": "partial", "session": "a", "seq": 99, "text": "Лука 1 глава 1 стих"})]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    run = publish(live_fragments(spark, str(tmp_path / "in"), 1), sizes, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    run.processAllAvailable()
    run.stop()
    streamed = spark.read.parquet(str(tmp_path / "out" / "references"))
    assert {(r.session, r.seq): (r.ref, r.blocked) for r in streamed.collect()} == got and streamed.select("batch").distinct().count() == 3


def test_live_state_restart(spark, tmp_path):
    """After a failure a batch is run again with the same result; the state of sessions that a batch lacks isn't written; lines
    that are no fragments are kept apart."""
    sizes = chapter_sizes(formula_verses(spark))
    out, buckets = str(tmp_path / "out"), 4
    said = lambda s, i, t: json.dumps({"session": s, "seq": i, "text": t}, ensure_ascii=False)
    files = [[said("a", 1, "Матфей 5 глава 3 стих"), said("b", 1, "Марк 2 глава 1 стих"), "broken {", '{"session": "a", "seq": "x", "text": "t"}', '{"event": "partial"}'], [said("a", 2, "и там же 7 стих")], [said("b", 2, "и там же 4 стих"), "[1]"], [said("a", 3, "и там же 8 стих")]]

    def deliver(k):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(files[k]))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))

    def run():
        stream = publish(live_bodies(spark, str(tmp_path / "in"), 1), sizes, out, str(tmp_path / "checkpoint"), buckets=buckets)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    for k in range(3):
        deliver(k)
    run()
    state = lambda n: {(r.session, r.last_seq, tuple(r.kept), r.book, r.chapter) for r in read_state(spark, out, n).collect()}
    third = state(2)
    assert {r[:2] for r in third} == {("a", 2), ("b", 2)}
    # The third batch's end is lost: a stream that begins anew runs it again.
    os.remove(tmp_path / "checkpoint" / "commits" / "2")
    for p in glob.glob(str(tmp_path / "checkpoint" / "commits" / ".2.crc")):
        os.remove(p)
    deliver(3)
    run()
    assert state(2) == third and {r[:2] for r in state(3)} == {("a", 3), ("b", 2)}
    refs = {(r.session, r.seq): r.ref for r in spark.read.parquet(out + "/references").collect()}
    assert refs == {("a", 1): "Матфей 5:3", ("b", 1): "Марк 2:1", ("a", 2): "Матфей 5:7", ("b", 2): "Марк 2:4", ("a", 3): "Матфей 5:8"}
    assert sorted((r.batch, r.error) for r in spark.read.parquet(out + "/rejected").collect()) == [(0, "not_json"), (0, "seq"), (2, "not_json")]
    written = {n: {os.path.basename(p) for p in glob.glob(f"{out}/state/batch={n}/bucket=*")} for n in range(4)}
    assert len(written[3]) == 1 and written[3] == written[1] | written[3] and not (written[0] & written[3]) and len(os.listdir(out + "/index")) == 2


def test_journal(spark, tmp_path, monkeypatch):
    """A batch stands in the log once, whatever fails between its lines and its entry, and whoever comes second."""
    path = str(tmp_path / "log")
    events = lambda *xs: spark.createDataFrame([(f"t{x}", "final_raw", f"x{x}") for x in xs], "ts string, event string, text string")
    lines = lambda: sorted((r.batch, json.loads(r.line)["text"]) for r in journal.read_journal(spark, path).collect())
    assert lines() == [] and journal.append_batch(events(1, 2), path, 0) and lines() == [(0, "x1"), (0, "x2")]

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(journal, "_enter", fails)
        with pytest.raises(RuntimeError):
            journal.append_batch(events(3, 4), path, 1)
    assert lines() == [(0, "x1"), (0, "x2")]
    assert journal.append_batch(events(3, 4), path, 1) and not journal.append_batch(events(3, 4), path, 1)
    assert journal.append_batch(events(3).limit(0), path, 2)
    assert lines() == [(0, "x1"), (0, "x2"), (1, "x3"), (1, "x4")]
    assert not journal._enter(spark, path, 1, "lines/batch=1/other") and len(lines()) == 4
    journal.append_batch(spark.createDataFrame([("t0", "session", "m1", 16000)], "ts string, event string, model string, samplerate int"), path, 3)
    journal.write_session(spark, path)
    row = spark.read.json(path + "/session").first()
    assert (row.began, row.ended, row.events, row.invalid, json.loads(row.settings)) == ("t0", "t4", 5, 0, {"model": "m1", "samplerate": 16000})


def test_journal_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"ts": f"t{k}", "event": "parsed"}))
    source = spark.readStream.schema("ts string, event string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):
        run = journal.journal(source, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
        run.processAllAvailable()
        run.stop()
    got = journal.read_journal(spark, str(tmp_path / "log"))
    assert got.select("batch").distinct().count() == 3 and got.count() == 3


def test_log_bodies(spark):
    """Fields that the schema lacks survive reading and writing; damaged lines stay as they are."""
    rows = [("l", 1, '{"ts": "a", "event": "parsed", "chunk": 7, "nested": {"x": [1, "z"]}}'), ("l", 2, "broken {"), ("l", 3, "[1]"), ("l", 4, '{"event": null, "odd key": null}'), ("l", 5, None)]
    bodies = logs.log_bodies(spark.createDataFrame(rows, "path string, line_no long, line string"))
    assert [r.event for r in bodies.orderBy("line_no").collect()] == ["parsed", "invalid_json", "invalid_json", None, "invalid_json"]
    assert {(r.line_no, r.field, r.type) for r in logs.other_fields(bodies).collect()} == {(1, "chunk", "BIGINT"), (1, "nested", "OBJECT<x: ARRAY<VARIANT>>"), (4, "odd key", "VOID")}
    got = [r.value for r in logs.restated(bodies.orderBy("line_no"), ts=F.lit("b")).collect()]
    assert json.loads(got[0]) == {"ts": "b", "event": "parsed", "chunk": 7, "nested": {"x": [1, "z"]}} and got[1:3] == ["broken {", "[1]"] and json.loads(got[3])["ts"] == "b" and got[4] is None
    assert json.loads(logs.restated(bodies.where("line_no = 1")).first().value) == json.loads(rows[0][2])


@pytest.mark.parametrize("tracked", [16, 64, 8192])
def test_heavy_hitters(spark, tracked):
    """The list equals the full count: of values of all frequencies, of equal ones, and of more values than the sketch tracks."""
    r = random.Random(4)
    steep = [("steep", f"v{int(r.paretovariate(0.9))}") for _ in range(4000)]
    rows = steep + [("even", f"w{i % 700}") for i in range(2100)] + [("few", x) for x in "aab"] + [("hot", "x")] * 3000 + [("hot", f"y{i}") for i in range(300)]
    r.shuffle(rows)
    values = spark.createDataFrame([(k, v, "p", i) for i, (k, v) in enumerate(rows)], "kind string, value string, path string, line_no long").repartition(6)
    text = lambda d: sorted(map(tuple, d.select("kind", "value", "n", "rank").collect()))
    for top in (1, 5):
        assert text(logs.heavy_hitters(values, top, tracked)) == text(logs.most_common(values, top))
    assert logs.heavy_hitters(values.limit(0)).count() == 0


def test_nehemiah(spark):
    """Jeremiah is Nehemiah where only that parses, or where it was heard without confidence."""
    sizes = chapter_sizes(formula_verses(spark).where("not (book = 'Иеремия' and chapter > 10) and not (book = 'Неемия' and chapter > 20)"))
    rows = [("a", 1, "Иеремия 12 глава 13 стих", False), ("b", 1, "Иеремия 2 глава 3 стих", False), ("c", 1, "Иеремия 2 глава 3 стих", True), ("d", 1, "Иеремия 30 глава 33 стих", True)]
    got = session_references(spark.createDataFrame(rows, "session string, seq long, text string, low boolean"), sizes)
    assert {r.session: r.ref for r in got.collect()} == {"a": "Неемия 12:13", "b": "Иеремия 2:3", "c": "Неемия 2:3", "d": None}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda d: sorted(tuple("" if pd.isna(x) else str(round(float(x), 6)) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_functions_reach_workers(tmp_path):
    """Plans with functions of this package run where only the driver can import it."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lectern.operators.search import search_quotes
from lectern.plans.parse import parse_references
from lectern.sources.canon import chapter_sizes, formula_verses
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
said = spark.createDataFrame([(1, "матвей 5 глава 3 стих")], "utt_id long, text string")
print("FOUND", parse_references(said, chapter_sizes(formula_verses(spark))).first().ref)
q = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "query_id long, q string")
w = spark.createDataFrame([(2, "alpha beta gamma delto epsilon")], "window_id long, norm string")
print("FOUND", search_quotes(q, w).first().window_id)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x for x in out.stdout.splitlines() if x.startswith("FOUND")] == ["FOUND Матфей 5:3", "FOUND 2"], out.stderr[-2000:]


def test_common_subsequences_together():
    """Pairs that may reach what they need are those whose longest common subsequence does, for texts of one and of many words."""
    r = random.Random(4)
    for most in (30, 64, 65, 200):
        left = ["".join(r.choice("абвгде ") for _ in range(r.randrange(1, most + 1))) for _ in range(12)] + ["а" * most]
        right = ["".join(c for c in r.choice(left) if r.random() < 0.8) or "ж" for _ in range(15)]
        pairs = [(i, j) for i in range(len(left)) for j in range(len(right))]

        def common(a, b):
            row = [0] * (len(b) + 1)
            for x in a:
                row = [0, *(max(p + 1 if x == y else 0, q) for p, q, y in zip(row, row[1:], b))]
                for k in range(1, len(row)):
                    row[k] = max(row[k], row[k - 1])
            return row[-1]

        want = [common(left[i], right[j]) for i, j in pairs]
        i, j = (np.array(x) for x in zip(*pairs))
        for off in (0, 1):
            got = likeness._reach(left, right, i, j, np.array(want) + off - 1e-6)
            assert got.all() if not off else not got.any()
