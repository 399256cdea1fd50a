"""The canon's books, their spoken names, and number words: small dimension tables, built by rule from a few stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 66 books in canon order, each with further spoken names ("|"): forms a rule below doesn't give.
BOOKS = """
Бытие: быт|бытья|бытия|бытиев
Исход:
Левит:
Числа:
Второзаконие:
Иисус Навин: навин
Судьи: книга судей
Руфь: русь|книга русь|руф|книга руф
1 Царств:
2 Царств:
3 Царств:
4 Царств:
1 Паралипоменон: 1 хроник|1 парал|первая книга хроник|1 параллель помином
2 Паралипоменон: 2 хроник|2 парал|вторая книга хроник|2 параллель помином
Ездра: книга ездры
Неемия: книга неемии|ниемии|книга ниемии|немии|немия|книга немии|ни эмии
Есфирь: книга есфири
Иов: книга иова
Псалтирь: псалмы|псалом|пс
Притчи: притчи соломона|притча
Екклесиаст: кохелет
Песня Песней: песнь песней
Исаия: книга исаии|иссаии|иссайи|пророка иссаии|пророка иссайи
Иеремия: книга иеремии
Плач Иеремии: плач
Иезекииль: книга иезекииля
Даниил:
Осия: книга осии
Иоиль: книга иоиля
Амос: книга амоса
Авдий: книга авдия
Иона: книга ионы
Михей: книга михея
Наум: книга наума
Аввакум: книга аввакума
Софония: книга софонии
Аггей: книга аггея
Захария: книга захарии
Малахия: книга малахии
Матфей: евангелие от матфея|от матфея|матфея
Марк: евангелие от марка|от марка|марка
Лука: евангелие от луки|от луки|луки
Иоанн: евангелие от иоанна|от иоанна|иоанна|ианна|от иана|иана|иранно
Деяния: деяния апостолов|книга дияни|дияни|деяние|диане|диания|диане апостолов|диана апостолов
Римлянам: рим|послание римлиным
1 Коринфянам: 1 коринф
2 Коринфянам: 2 коринф
Галатам: гал
Ефесянам: еф
Филиппийцам: фил
Колоссянам: кол|кол осии|кол осии яна|калася нам|каласянам
1 Фессалоникийцам: первое фесс|первое фес|1 фесс
2 Фессалоникийцам: второе фесс|второе фес|2 фесс
1 Тимофею:
2 Тимофею:
Титу:
Филимону:
Евреям: евр
Иаков: послание иакова|иак|яков|апостол яков
1 Петра:
2 Петра:
1 Иоанна: первая яна|1 яна|послание яна
2 Иоанна: вторая яна|2 яна
3 Иоанна: третья яна|3 яна
Иуда: послание иуды|иуд|апостол иуда
Откровение: апокалипсис|откровение иоанна|откровение иоанна богослова
""".strip()
#: The books of one chapter whose references may leave it out, and names that are too general to be a book's.
ONE_CHAPTER = ("Филимону", "2 Иоанна", "3 Иоанна", "Иуда")
GENERIC = ("итак", "книга", "книги", "книга пророка", "пророка", "послание", "евангелие")

ORDINAL_BOOK = {1: ("первая", "первое", "первого"), 2: ("вторая", "второе", "второго"), 3: ("третья", "третье", "третьего"), 4: ("четвертая", "четвертое", "четвертого"), 5: ("пятая", "пятое", "пятого")}


def books() -> list[tuple[int, str]]:
    return [(i, line.partition(":")[0]) for i, line in enumerate(BOOKS.splitlines(), 1)]


def spoken_names() -> list[tuple[str, str]]:
    """(alias, book) pairs, lower-cased: listed names and those that the book's kind gives."""
    found: dict[str, str] = {}
    for number, line in enumerate(BOOKS.splitlines(), 1):
        book, _, listed = line.partition(":")
        low = book.lower()
        names = [low, *(x for x in listed.strip().split("|") if x)]
        digit, _, family = low.partition(" ") if low[0].isdigit() else ("", "", low)
        feminine, neuter, genitive = ORDINAL_BOOK[int(digit)] if digit else ("", "", "")
        if number <= 5:
            feminine = ORDINAL_BOOK[number][0]
            names += [f"книга {low}", f"{number} моисеева", f"{feminine} книга моисея"]
        elif family in ("царств", "паралипоменон"):
            names += [f"{feminine} {family}"] + [f"{feminine} книга {family}"] * (family == "царств")
        elif low in ("руфь", "даниил"):
            names.append(f"книга {low}")
        elif 45 <= number <= 58 or 60 <= number <= 64:
            if digit:
                to = "" if family in ("петра", "иоанна") else "к "
                names += [f"{neuter} послание {family}", f"{genitive} послания {family}", f"{digit} послания {family}", f"{digit} послание {to}{family}", f"{neuter} послание {to}{family}", f"{digit} послание {family}"]
            else:
                names += [f"послание к {low}", f"послание {low}"]
        for name in names:
            found[name] = book
    return sorted(found.items())


#: Number words: stems with the endings of ordinals, and cardinals; tens and hundreds carry on.
_HARD = "ый ая ое ого ой ому ую ым ых ые"
_UNITS = {1: ("перв", _HARD, "один одна"), 2: ("втор", "ой ая ое ого ому ую ым ых ые", "два две"), 3: ("трет", "ий ья ье ьего ьей ей ьему ью ьим ьих ьи", "три"), 4: ("четверт", _HARD, "четыре"), 5: ("пят", _HARD, "пять"), 6: ("шест", "ой ая ое ого ому ую ым ых ые", "шесть"), 7: ("седьм", "ой ая ое ого ому ую ым ых ые", "семь"), 8: ("восьм", "ой ая ое ого ому ую ым ых ые", "восемь"), 9: ("девят", _HARD, "девять")}
_TEENS = "десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат".split()
_TENS = {20: ("двадцат", "двадцать"), 30: ("тридцат", "тридцать"), 40: ("сороков", "сорок"), 50: ("пятидесят", "пятьдесят"), 60: ("шестидесят", "шестьдесят"), 70: ("семидесят", "семьдесят"), 80: ("восьмидесят", "восемьдесят"), 90: ("девяност", "девяносто"), 100: ("сот", "сто")}


def number_words() -> dict[str, int]:
    """Ordinals in their case forms, and cardinals, with ё as е."""
    found = {}
    for value, (stem, endings, cardinals) in _UNITS.items():
        found |= {stem + e: value for e in endings.split()} | dict.fromkeys(cardinals.split(), value)
    for i, stem in enumerate(_TEENS, 10):
        found |= {stem + e: i for e in _HARD.split()} | {stem + "ь": i}
    for value, (stem, cardinal) in _TENS.items():
        found |= {stem + e: value for e in _HARD.split()} | {cardinal: value}
    return found


def roman(n: int) -> str:
    """Lower-case roman numeral of 1 to 39."""
    return "x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]


#: Beginnings of misheard number words and what they may stand for.
NUMBER_HINTS = {"пер": [1], "вто": [2], "тре": [3], "трей": [3], "три": [3], "чет": [4, 14, 40], "четы": [4, 14, 40], "детый": [9], "детри": [29], "девя": [9, 19], "двад": [20], "трид": [30], "тридцат": [30], "тть": [30], "сор": [40], "пят": [5, 15, 50]}


def books_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(books(), "book_no int, book string")


def aliases_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(spoken_names(), "alias string, book string")


def numbers_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(number_words().items()), "word string, value int")


def overlaid(spark: SparkSession, more: DataFrame) -> DataFrame:
    """The spoken names with those of a shared dictionary (alias, book) on top: names of books that the canon lacks are left out,
    and a name that is there already goes to the book that the dictionary says."""
    own, known = aliases_table(spark), [b for _, b in books()]
    told = more.select(F.lower(F.trim("alias")).alias("alias"), "book").where((F.col("alias") != "") & F.col("book").isin(*known)).dropDuplicates(["alias"])
    return own.join(F.broadcast(told.select("alias")), "alias", "left_anti").unionByName(told)
