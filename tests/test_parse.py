"""Transcripts to references: golden sentences, properties, and what must not be found."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import fold_numbers, normalize_quote, normalize_reference, verse_count, verse_id
from lectern.operators.lookup import number_values
from lectern.operators.names import best_similar
from lectern.operators.references import compact_range, places
from lectern.plans.parse import best_with_margin, parse_references, resolve_candidates, verse_texts
from lectern.sources.books import books, number_words, spoken_names
from lectern.sources.canon import chapter_sizes, formula_verses, golden_sizes, read_verses, structure, verse_windows
from tests.golden import PARSED, RESOLVED

GOLDEN = [
    ("Иеремия 32:40-43", "Иеремия 32:40-43"),
    ("Второзаконие. Двадцатую главу с 10 по 15 стих.", "Второзаконие 20:10-15"),
    ("Матфей 5:48-6:4", "Матфей 5:48-6:4"),
    ("третье послание Иоанна 9 10 стих", "3 Иоанна 1:9-10"),
    ("Псалом сто тридцать два.", "Псалтирь 132:1-3"),
    ("Первый псалом, первый стих и до конца главы.", "Псалтирь 1:1-6"),
    ("Иисуса Навин, первая глава 90 стиха", "Иисус Навин 1:9"),
    ("деяние 4 глава 3 2 стих", "Деяния 4:32"),
    ("от Матфея 16 из третей главы", "Матфей 3:16"),
    ("Лука 6 глава 43-44-х нет доброго дерева", "Лука 6:43-44"),
    ("Римлянам 3 глава. И там же прочитаем 22-23.", "Римлянам 3:22-23"),
    ("1 книга царств 10 глава", None),
    ("Книга Иов, тридцать вторая глава, тридцать третьей, тридцать четвёртая стих.", None),
    ("просто слова", None),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame(list(golden_sizes().items()), "book string, sizes map<int,int>")


def test_golden(spark, sizes):
    said = spark.createDataFrame(list(enumerate(t for t, _ in GOLDEN)), "utt_id long, text string")
    found = {r.utt_id: r.ref for r in parse_references(said, sizes).collect()}
    assert [found.get(i) for i in range(len(GOLDEN))] == [want for _, want in GOLDEN]


def test_all_golden_sentences(spark, sizes):
    """Every golden sentence gives the reference expected of it."""
    said = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "utt_id long, text string")
    found = {r.utt_id: r.ref for r in parse_references(said, sizes).collect()}
    assert [(t, found.get(i)) for i, (t, want) in enumerate(PARSED) if found.get(i) != want] == []


def test_golden_resolver(spark, sizes):
    said = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(RESOLVED)], "utt_id long, text string")
    ranked = resolve_candidates(said, sizes).persist()
    first, best = {r.utt_id: r.ref for r in ranked.where("rank = 1").collect()}, {r.utt_id: r.ref for r in best_with_margin(ranked).collect()}
    wrong = [t for i, (t, top, one) in enumerate(RESOLVED) if (first.get(i), best.get(i)) != (top, one)]
    assert wrong == []


def test_similar_names_equal_library():
    """The bound by letters loses no name that the standard library finds."""
    import difflib
    import random

    r = random.Random(4)
    known = sorted({n for n, _ in spoken_names()})
    said = ["".join(c for c in r.choice(known) if r.random() > 0.12) + r.choice(["", "а", " 1"]) for _ in range(400)]
    got = best_similar.__wrapped__(known) if hasattr(best_similar, "__wrapped__") else best_similar(known).func
    for g, row in zip(said, got(pd.Series(said)).itertuples()):
        near = difflib.get_close_matches(g, known, 1, 0.78)
        assert (row.variant or None) == (near[0] if near else None)


def test_resolver_margin(spark, sizes):
    said = spark.createDataFrame([(1, "Иона 3 глава 16 стих"), (2, "Иона 3 глава 5 стих"), (3, "от яна 316 так возлюбил Бог мир")], "utt_id long, text string")
    ranked = resolve_candidates(said, sizes).persist()
    assert {r.utt_id: r.ref for r in ranked.where("rank = 1").collect()} == {1: "Иоанн 3:16", 2: "Иона 3:5", 3: "Иоанн 3:16"}
    assert {r.utt_id for r in best_with_margin(ranked).collect()} == {1, 3}


def test_numbers(spark):
    said = {"сто двадцать три": "123", "двадцать первый": "21", "сто пять": "105", "пять двадцать": "5 20", "двадцать 3": "20 3", "седьмой восьмой": "7 8", "сто сто": "100 100", "глава": "глава"}
    rows = spark.createDataFrame(list(said.items()), "said string, want string").select("want", F.array_join(fold_numbers(F.split("said", " ")), " ").alias("got")).collect()
    assert all(r.want == r.got for r in rows), rows
    assert number_words()["третьей"] == 3 and number_words()["пятидесятый"] == 50
    assert spark.range(1).select(number_values(F.lit("сор"))).first()[0] == [40]


def test_text_functions(spark):
    r = spark.range(1).select(normalize_quote(F.lit(" Ёж, и  ЛИС!\n7 ")).alias("q"), normalize_quote(F.lit(None).cast("string")).alias("none"), normalize_reference(F.lit("Матфей 5:3-9")).alias("n"), verse_id(F.lit(40), F.lit(5), F.lit(48)).alias("id"), verse_id(F.lit(None), F.lit(5), F.lit(48)).alias("no_id"), verse_count(F.lit(3), F.lit(9), F.lit(None)).alias("k"), compact_range(F.lit("1519"), F.lit(40)).alias("c"), places(F.lit("a1 b22"), F.lit(r"\d+")).alias("p")).first()
    assert (r.q, r.none, r.n, r.id, r.no_id, r.k) == ("еж и лис 7", None, "матфей 5 глава 3 9 стих", "40005048", None, 7)
    assert tuple(r.c) == (15, 19) and [tuple(x) for x in r.p] == [("1", 1), ("22", 4)]


def test_canon(spark, tmp_path):
    assert len(books()) == 66 and len(dict(spoken_names())) > 180
    verses = formula_verses(spark, 3, 4)
    assert structure(verses).count() == 62 * 3 + 4
    assert chapter_sizes(verses).where("book = 'Иуда'").first().sizes == {1: 4}
    one = verses.where("book = 'Марк' and chapter = 1")
    assert verse_windows(one, 2).count() == 7
    refs = spark.createDataFrame([(1, "Марк", 1, 3, 2, 2), (2, "Марк", 1, 2, 2, None)], "ref_id int, book string, chapter int, start_verse int, end_verse int, end_chapter int")
    told = {r.ref_id: r.verse_text for r in verse_texts(refs, verses).collect()}
    assert told == {1: "1:3. 41-1-3 1:4. 41-1-4 2:1. 41-2-1 2:2. 41-2-2", 2: "41-1-2"}
    path = tmp_path / "canon.json"
    path.write_text('{"Books": [{"BookId": 9, "BookName": "x", "Chapters": [{"ChapterId": 1, "Verses": [{"VerseId": 1, "Text": "t"}, {"VerseId": 2, "Text": null}]}]}]}')
    assert [(r.book, r.verse, r.text) for r in read_verses(spark, str(path)).orderBy("verse").collect()] == [("Бытие", 1, "t"), ("Бытие", 2, "")]
