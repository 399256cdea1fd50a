from pyspark.sql import functions as F

from lectern.plans.held import Held
from lectern.plans.parse import once_per, parse_references
from lectern.sources.canon import chapter_sizes, formula_verses


def test_texts_are_read_once(spark):
    said = {0: "Марк 3 глава 4 стих", 1: "Псалом 20 2 стих", 2: "просто слова", 3: None}
    rows = spark.createDataFrame([(i, said[i % 4]) for i in range(400)], "utt_id long, text string")
    found = parse_references(rows, chapter_sizes(formula_verses(spark)))
    # What is left to do is one join: the reading is behind it, however often a text is said.
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.utt_id: r.ref for r in found.collect()}
    assert got == {i: ("Марк 3:4", "Псалтирь 20:2")[i % 4] for i in range(400) if i % 4 < 2}


def test_once_per_distinct_values(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(60)], "id long, a string, b long")

    def f(x):
        x.foreach(lambda _: seen.add(1))
        return x.where("b < 2").select("utt_id", F.explode(F.array("a", F.lit("z"))).alias("y"))

    got = sorted(map(tuple, once_per(rows, ["a", "b"], f, Held(spark)).select("id", "y").collect()))
    assert got == sorted((i, y) for i in range(60) if i % 3 < 2 for y in ("ab"[i % 2], "z"))
    assert seen.value == 6


def test_verse_texts_are_made_once(spark):
    from lectern.plans.parse import verse_texts

    verses = formula_verses(spark)
    same = [(i, "Марк", 1, 2, 3, None) for i in range(50)] + [(i, "Марк", 1, 39, 2, 2) for i in range(50, 100)] + [(100, None, 1, 1, 1, None), (101, "Марк", 3, 1, 1, 2)]
    refs = spark.createDataFrame(same, "ref_id long, book string, chapter int, start_verse int, end_verse int, end_chapter int")
    out = verse_texts(refs, verses)
    assert out.columns == [*refs.columns, "verse_text"]
    over = "1:39. 41-1-39 1:40. 41-1-40 2:1. 41-2-1 2:2. 41-2-2"
    number = {r.book: r.book_no for r in verses.where("book = 'Марк'").select("book", "book_no").distinct().collect()}["Марк"]
    made = {r.ref_id: r.verse_text for r in out.collect()}
    assert made == {i: f"2. {number}-1-2 3. {number}-1-3" if i < 50 else over.replace("41-", f"{number}-") if i < 100 else None for i in range(102)}
    # 4 verses of the one reference and 2 of the other are gathered, not 50 times as many.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ref_id" not in plan.split("collect_list", 1)[1].split("LocalRelation", 1)[0].split("LogicalRDD", 1)[0]


def test_windows_are_normalised_where_asked_for(spark):
    from lectern.sources.canon import verse_windows

    verses = spark.createDataFrame([("b", 1, 1, "Ёж, и"), ("b", 1, 2, "..."), ("b", 1, 3, None), ("b", 1, 4, "—"), ("b", 1, 5, "Z")], "book string, chapter int, verse int, text string")
    out = verse_windows(verses, 2)
    assert sorted((r.first, r.last, r.norm) for r in out.select("first", "last", "norm").collect()) == [(1, 1, "еж и"), (1, 2, "еж и"), (4, 5, "z"), (5, 5, "z")]
    assert "regexp_replace" not in out.drop("norm")._jdf.queryExecution().optimizedPlan().toString()


def test_quote_runs_and_similarity(spark):
    import random
    from difflib import SequenceMatcher

    from lectern.operators import search

    draw = random.Random(7)
    text = lambda n: " ".join(draw.choice(["бог", "любит", "мир", "и", "свет", "во", "тьме", "слово", "a", "vita"]) for _ in range(n))

    def plainly(q, w):
        words, ahead = q.split(), w.split()
        best = SequenceMatcher(None, q, w).ratio()
        for size in range(4, min(8, len(words), len(ahead)) + 1):
            start = " ".join(ahead[:size])
            best = max([best, *(SequenceMatcher(None, " ".join(words[i : i + size]), start).ratio() for i in range(len(words) - size + 1))])
        return 100 * best

    pairs = [(text(draw.randint(0, 40)), text(draw.randint(0, 60))) for _ in range(150)]
    want = [plainly(q, w) for q, w in pairs]
    assert [search._similarity(q, w) for q, w in pairs] == want
    got = [search._similarity(q, w, 60.0) for q, w in pairs]
    assert [x if x >= 60 else None for x in got] == [x if x >= 60 else None for x in want]
    # Windows that are copies have one score.
    q = spark.createDataFrame([(1, "свет во тьме светит и тьма")], "query_id long, q string")
    w = spark.createDataFrame([(i, "свет во тьме светит и") for i in range(40)] + [(99, "свет")], "window_id long, norm string")
    found = search.similar(q, w)
    assert sorted(r.window_id for r in found.collect()) == list(range(40)) and len({r.score for r in found.collect()}) == 1
    assert search.similar(q, w)._jdf.queryExecution().optimizedPlan().toString().count("lambda") == 0
    # Of wholes only the lengths of run are looked at that parts have; the way of short parts is not gone without these.
    plan = search.contained(q, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_join" not in plan


def test_later_attempts_are_read_for_open_fragments_alone(spark, monkeypatch):
    from lectern.streaming import live

    read = []
    parsed = live._parsed
    monkeypatch.setattr(live, "_parsed", lambda texts, sizes: read.extend(r.text for r in texts.collect()) or parsed(texts, sizes))
    said = ["Марк 3 глава 4 стих", "там же 5 стих", "слово", "там же 6 стих", "там же 7 стих"]
    rows = [(f"s{n}", i, t) for n in range(3) for i, t in enumerate(said)]
    got = {(r.session, r.seq): r.ref for r in live.session_references(spark.createDataFrame(rows, "session string, seq long, text string"), chapter_sizes(formula_verses(spark))).collect()}
    assert {k: got[k] for k in got if k[1] in (0, 1, 3, 4)} == {(f"s{n}", i): f"Марк 3:{v}" for n in range(3) for i, v in ((0, 4), (1, 5), (3, 6), (4, 7))}
    # Each text once, and none of several fragments for those that the first attempt settles.
    assert len(read) == len(set(read)) and "Марк 3 глава 4 стих там же 5 стих" not in read
