"""Column functions over transcripts: normalisation, number words, reference formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.sources.books import number_words, roman

#: The words that references are read by, with the endings that their stems take in speech.
KEYWORDS = {
    "глава": ("глав", "а у ы е ой"),
    "стих": ("стих", "а и е ов ии ие ами ах"),
    "псалом": ("псал", "ом ма ме"),
    "послание": ("послани", "е и я ю ем"),
}
#: Single words as the recogniser mishears them, and what was said; a word and its meaning each line.
MISHEARD = """
агея аггея
агла глава
атмосфея матфея
атеана иоанна
главоз глава
главус глава
гуана иоанна
илана иоанна
ивреем евреям
изход исход
иоанну иоанна
иоф иов
истих стих
исаи исаия
каримфинам коринфянам
каринфена коринфянам
коринфян коринфянам
малахи малахия
матвея матфея
мотфей матфей
ниемии неемии
ниэмии неемии
переми иеремия
перемию иеремия
перемия иеремия
ремью иеремия
первоглава 1 глава
первостих 1 стих
послаником послание
посланника послание
посланником послание
постанет послание
притчет притчи
римляном римлянам
сих стих
стив стих
тестих стих
солма псалом
стивы стих
тихо стих
филиппитс филиппийцам
филиппица филиппийцам
"""
#: Beginnings of words that are misheard in many forms, and what was said.
BEGINNINGS = """
еклисиаст екклесиаст
еклисяст екклесиаст
икресяст екклесиаст
иклисиаст екклесиаст
клесяст екклесиаст
парлипомин паралипоменон
паралипомин паралипоменон
фесалоник фессалоникийцам
феселоник фессалоникийцам
фесолоник фессалоникийцам
фессалоник фессалоникийцам
"""
#: Phrases as they are misheard, once words are spelt out and number words are digits; N is a number, and a
#: word may have any ending where it ends in *. What was said stands behind the bar: N there is the phrase's first number,
#: N3 its third.
PHRASES = """
таразакон* 1 глава 22 стих | второзаконие 11 глава 22 стих
таразакон* | второзаконие
второзакон* стае глава | второзаконие 6 глава
второзакон* стая глава | второзаконие 6 глава
2 законе | второзаконие
N мега царств | N книга царств
и лова | иова
и екклесиаст | екклесиаст
книга ио | книга иова
книги ио | книги иова
тремя я | иеремия
и иеремия | иеремия
паророка и языки | пророка иезекииля
про рокас афоний | пророка софонии
про рокас афония | пророка софонии
про рокас афонии | пророка софонии
пророк астафония | пророка софонии
пророк астафонии | пророка софонии
астафония | пророка софонии
астафонии | пророка софонии
иван гелятматфея | евангелие от матфея
иван гелятматфеа | евангелие от матфея
иван гелиатриан* | евангелие от иоанна
от фея | матфея
евангелие под иоанна | евангелие от иоанна
под иуанна | от иоанна
идея боссов | деяния апостолов
диаметр опослов | деяния апостолов
1 темофея | 1 тимофею
1 темофею | 1 тимофею
2 темофея | 2 тимофею
2 темофею | 2 тимофею
и вся на | ефесянам
вся на | ефесянам
антрите огова | 3 глава
достая глава | 6 глава
вашей сестой стих | 6 стих
вашей стой стих | 6 стих
открыть при N глава | открыть притчи N глава
откройте при N глава | откройте притчи N глава
открываем при N глава | открываем притчи N глава
откроем при N глава | откроем притчи N глава
с 29 подлит с 3 стих | с 27 по 33 стих
с N года 20 месяц | с N по 21 стих
и у ванна | иоанна
и у ванов | иоанна
и уванна | иоанна
и уванов | иоанна
и уанна | иоанна
и с а и | исаия
от от | от
от яна | от иоанна
деяние апостола | деяния апостолов
деяния апостола | деяния апостолов
иисуса навина | иисус навин
иисуса навин | иисус навин
из стих | стих
из тих | стих
N из их | N стих
первом послание | 1 послание
втором послание | 2 послание
третьем послание | 3 послание
N тестих | N стих
N голова | N глава
N лас | N глава
N рюмке | N глава
N из них | N стих
под N | по N
иоанн в N послание | N послание иоанна
иоанн во N послание | N послание иоанна
петр в N послание | N послание петра
петр во N послание | N послание петра
петер в N послание | N послание петра
петер во N послание | N послание петра
фессалоникийцам фессалоникийцам | фессалоникийцам
N послание апостола павла фессалоникийцам | N фессалоникийцам
N послание апостола павлы фессалоникийцам | N фессалоникийцам
N послание апостол и иоанна | N послание иоанна
N книга паралипоменон | N паралипоменон
N книгу паралипоменон | N паралипоменон
N глава N N стих N давайте | N глава N4 N3 стих давайте
N глава N N стих N прочитаем | N глава N4 N3 стих прочитаем
"""


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), F.lit(1))


def _words() -> dict[str, str]:
    """Single words and what they stand for: forms of the keywords, and misheard words."""
    forms = {stem + e: word for word, (stem, endings) in KEYWORDS.items() for e in endings.split()}
    return forms | dict(line.split(None, 1) for line in MISHEARD.strip().splitlines())


_APART, _ENDS = "(?<![0-9а-яa-z])", "(?![0-9а-яa-z])"


def _phrases() -> list[tuple[str, str]]:
    """Phrases as patterns, with their replacements."""
    pairs = (line.split(" | ") for line in PHRASES.strip().splitlines())
    return [(heard.replace("*", "[а-я]*").replace("N", "([0-9]+)"), re.sub("N([0-9]?)", lambda m: "$" + (m[1] or "1"), said)) for heard, said in pairs]


def _as_said(text: Column) -> Column:
    """A text with misheard phrases as what was said, one phrase after the other. One pattern of all of them tells whether a
    text has any; most have none."""

    def replaced(t: Column) -> Column:
        out = t
        for heard, said in _phrases():
            out = F.regexp_replace(out, f"{_APART}(?:{heard}){_ENDS}", said)
        return F.when(t.rlike(f"{_APART}(?:{'|'.join(h for h, _ in _phrases())}){_ENDS}"), out).otherwise(t)

    return bound(text, replaced)


def _spelt(words: Column) -> Column:
    """A token array with each word as what it stands for."""
    table = F.create_map(*(F.lit(x) for pair in sorted(_words().items()) for x in pair))

    def one(w: Column) -> Column:
        begins = w
        for line in BEGINNINGS.strip().splitlines():
            heard, said = line.split()
            begins = F.when(w.startswith(heard), said).otherwise(begins)
        return F.coalesce(F.try_element_at(table, w), begins)

    return F.split(F.array_join(F.transform(words, one), " "), " ")


def normalize_quote(text: Column) -> Column:
    """Lower case, ё as е, everything but letters (а-я, a-z) and digits a single space; and "страх господи" in the form of
    the verse tables. Null stays null."""
    low = F.translate(F.lower(text), "ё", "е")
    # All but а-я, a-z and 0-9, said as ranges: the same class negated took 3 to 30 times as long where eight tasks matched at once.
    plain = F.regexp_replace(low, r"[\x00-/:-`{-\x{42f}\x{450}-\x{10ffff}]+", " ")
    # Few texts have these words, and looking for them is much less work than matching what stands around them.
    named = F.regexp_replace(plain, "(?<![0-9а-яa-z])страх господи(?![0-9а-яa-z])", "страх господень")
    return F.trim(F.when(plain.contains("страх господи"), named).otherwise(plain))


def fold_numbers(words: Column) -> Column:
    """Number words of a token array as digits: hundreds, tens and units in a row are one number.

    Digits that stand there already never merge. One left fold: the state is what is out and the number being built.
    """
    lexicon = F.create_map(*(F.lit(x) for pair in sorted(number_words().items()) for x in pair))
    valued = F.transform(words, lambda w: F.struct(w.alias("word"), F.try_element_at(lexicon, w).alias("value")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("int").alias("held"), F.lit(0).alias("floor"))
    done = lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"].cast("string"))))
    state = lambda out, held, floor: F.struct(out.alias("out"), held.cast("int").alias("held"), floor.cast("int").alias("floor"))

    def step(s: Column, w: Column) -> Column:
        value = w["value"]
        # `floor`: numbers below it may still be added to the one held.
        joins = s["held"].isNotNull() & (value < s["floor"])
        room = F.when(value >= 100, 100).when(value >= 20, 10).otherwise(0)
        return (
            F.when(value.isNull(), state(F.concat(done(s), F.array(w["word"])), F.lit(None), F.lit(0)))
            .when(joins, state(s["out"], s["held"] + value, F.when(value >= 20, 10).otherwise(0)))
            .otherwise(state(done(s), value, room))
        )

    return F.aggregate(valued, start, step, done)


def _roman_chapters(text: Column) -> Column:
    """Roman numerals up to 20 before a word for chapter as digits."""
    out = text
    for n in range(20, 0, -1):
        out = F.regexp_replace(out, F.lit(rf"(?<![0-9а-яa-z]){roman(n)}\s*,?\s+глав[аеуы](?![0-9а-яa-z])"), F.lit(f"{n} глава"))
    return F.when(text.rlike("[ivx]"), out).otherwise(text)


def _coordinates(text: Column) -> Column:
    """Written forms in words: 5:3-9, 5:48-6:4, 43-44-х, 8-й."""
    n, gap = r"(\d+)", r"\s*"
    forms = (
        (rf"{n}{gap}:{gap}{n}{gap}-{gap}{n}{gap}:{gap}{n}", "$1 глава $2 стих по $3 глава $4 стих"),
        (rf"{n}{gap}:{gap}{n}{gap}-{gap}{n}", "$1 глава $2 $3 стих"),
        (rf"{n}{gap}:{gap}{n}", "$1 глава $2 стих"),
        (rf"{n}{gap}-{gap}{n}{gap}-?{gap}х(?![0-9а-яa-z])", "$1 $2 стих"),
        (rf"{n}-?(?:й|я|ю|е|го|му|м)(?![0-9а-яa-z])", "$1"),
    )
    out = text
    for pattern, words in forms:
        out = F.regexp_replace(out, pattern, words)
    return F.when(text.rlike(r"\d"), out).otherwise(text)


def normalize_reference(text: Column) -> Column:
    """A transcript in the form that reference rules read: lower case, keywords and misheard words spelt out, digits for
    number words, "глава" and "стих" for colons, single spaces, nothing but letters and digits. Null stays null."""
    t = bound(bound(F.translate(F.lower(text), "ё–", "е-"), _roman_chapters), _coordinates)
    t = F.trim(F.regexp_replace(t, "[^0-9а-яa-z]+", " "))
    t = F.array_join(fold_numbers(_spelt(F.split(t, " "))), " ")
    t = _as_said(t)
    # A gospel is "from" its author, and the three digits after John's name are chapter and verse.
    t = F.regexp_replace(t, "(?<![0-9а-яa-z])(?:ивангел|евангел)[а-я]* (?:от )?", "евангелие от ")
    return F.regexp_replace(t, r"(?<![0-9а-яa-z])иоанна (\d)(\d{2})(?!\d)", "иоанна $1 $2")


def reference_text(book: Column, chapter: Column, first: Column, last: Column, end_chapter: Column) -> Column:
    """"Book 5:48", "Book 5:3-9" or "Book 5:48-6:4"."""
    head = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), first.cast("string"))
    return F.when(end_chapter.isNotNull(), F.concat(head, F.lit("-"), end_chapter.cast("string"), F.lit(":"), last.cast("string"))).when(first == last, head).otherwise(F.concat(head, F.lit("-"), last.cast("string")))


def verse_id(book_no: Column, chapter: Column, verse: Column) -> Column:
    """BBCCCVVV; null unless all three are positive."""
    good = (book_no > 0) & (chapter > 0) & (verse > 0)
    return F.when(good, F.concat(F.lpad(book_no.cast("string"), 2, "0"), F.lpad(chapter.cast("string"), 3, "0"), F.lpad(verse.cast("string"), 3, "0")))


def verse_id_problem(book: Column, book_no: Column, chapter: Column, verse: Column) -> Column:
    """Why ``verse_id`` gives none, or an empty text: a book that has no number, then numbers that are missing or below 1."""
    named = F.trim(F.coalesce(book, F.lit("")))
    unknown = F.concat(F.lit("unknown_book:"), F.when(named == "", "empty").otherwise(named))
    good = F.coalesce((chapter > 0) & (verse > 0), F.lit(False))
    return F.when(book_no.isNull(), unknown).when(~good, "invalid_chapter_or_verse").otherwise("")


def verse_count(first: Column, last: Column, end_chapter: Column) -> Column:
    """Verses to show: one for a reference over chapters or one that is no range."""
    return F.when(end_chapter.isNotNull() | first.isNull() | last.isNull() | (last < first), 1).otherwise(last - first + 1)


def value_range(values: Column) -> Column:
    """Least and greatest of the positive ones among some numbers, as (first, last); null if there are none."""
    some = F.filter(values, lambda v: v > 0)
    return F.when(F.size(some) > 0, F.struct(F.array_min(some).alias("first"), F.array_max(some).alias("last")))
