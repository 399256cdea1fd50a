"""Verse tables: the nested JSON that editions come in, flat verses, and the sizes of chapters that validation needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.books import books, books_table

#: Fixed value: the layout of verse-table files.
VERSE_FILE = "Books ARRAY<STRUCT<BookId INT, BookName STRING, Chapters ARRAY<STRUCT<ChapterId INT, Verses ARRAY<STRUCT<VerseId INT, Text STRING>>>>>>"
ONE_CHAPTER_NUMBERS = (57, 63, 64, 65)


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """Flat verses of a verse-table file: book_no (place in the file), book_id, book, chapter, verse, text.

    Books are named by their place; those past the 66th are left out. A null text is empty.
    """
    raw = spark.read.schema(VERSE_FILE).json(path, multiLine=True)
    flat = raw.select(F.posexplode("Books").alias("at", "b")).select((F.col("at") + 1).alias("book_no"), F.col("b.BookId").alias("book_id"), F.col("b.BookName").alias("file_name"), F.explode("b.Chapters").alias("c"))
    flat = flat.select("book_no", "book_id", "file_name", F.col("c.ChapterId").alias("chapter"), F.explode("c.Verses").alias("v"))
    named = flat.join(F.broadcast(books_table(spark)), "book_no")
    return named.select("book_no", "book_id", "file_name", "book", "chapter", F.col("v.VerseId").alias("verse"), F.coalesce("v.Text", F.lit("")).alias("text"))


def named_by_id(verses: DataFrame) -> DataFrame:
    """The verses with the names that search uses: by BookId, else the file's own, else the id as text."""
    by_id = books_table(verses.sparkSession).select(F.col("book_no").alias("book_id"), F.col("book").alias("id_name"))
    return verses.join(F.broadcast(by_id), "book_id", "left").withColumn("book", F.coalesce("id_name", "file_name", F.col("book_id").cast("string"))).drop("id_name")


def formula_verses(spark: SparkSession, chapters: int = 50, verses: int = 40) -> DataFrame:
    """A regular canon for tests: every book has ``chapters`` chapters of ``verses`` verses, one-chapter books one."""
    n = F.when(F.col("book_no").isin(*ONE_CHAPTER_NUMBERS), 1).otherwise(chapters)
    grid = books_table(spark).select("book_no", "book", F.explode(F.sequence(F.lit(1), n)).alias("chapter")).select("*", F.explode(F.sequence(F.lit(1), F.lit(verses))).alias("verse"))
    return grid.withColumn("text", F.concat_ws("-", "book_no", "chapter", "verse"))


def chapter_sizes(verses: DataFrame) -> DataFrame:
    """Per book the number of verses of each chapter, as a map: book, sizes (chapter to last verse). One row a book.

    Verses of a chapter are numbered from 1 without gaps, as the canon's are.
    """
    per = verses.where("verse > 0").groupBy("book", "chapter").agg(F.max("verse").cast("int").alias("n"))
    return per.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.col("chapter").cast("int"), "n"))).alias("sizes"))


def structure(verses: DataFrame) -> DataFrame:
    """Chapters of each book with their verse numbers in order: book, chapter, verse_ids, first, last, n."""
    return verses.groupBy("book", "chapter").agg(F.sort_array(F.collect_set("verse")).alias("verse_ids"), F.min("verse").alias("first"), F.max("verse").alias("last"), F.countDistinct("verse").alias("n"))


def verse_windows(verses: DataFrame, width: int) -> DataFrame:
    """Runs of up to ``width`` verses of a chapter from each verse on: book, chapter, first, last, text, norm, seq.

    seq orders windows as the table does; those without a letter or digit are left out. A window has one if one of its verses
    does, so that each verse is looked at once for that, and a window is normalised only where its normal form is asked for.
    """
    from lectern.functions.text import normalize_quote

    said = F.translate(F.lower("text"), "ё", "е").rlike("[а-яa-z0-9]")
    span = Window.partitionBy("book", "chapter").orderBy("verse").rowsBetween(0, width - 1)
    ahead = verses.withColumn("said", said).withColumn("run", F.collect_list(F.struct("verse", "text", "said")).over(span))
    sized = ahead.select("book", "chapter", F.col("verse").alias("first"), "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("k"))
    part = F.slice("run", 1, F.col("k"))
    kept = sized.where(F.exists(part, lambda v: v["said"]))
    out = kept.select("book", "chapter", "first", F.element_at(part, -1)["verse"].alias("last"), F.array_join(F.transform(part, lambda v: v["text"]), " ").alias("text"))
    return out.withColumn("norm", normalize_quote(F.col("text")))


def golden_sizes() -> dict[str, dict[int, int]]:
    """Chapter sizes of the formula canon, changed where known cases need them."""
    sizes = {b: {c: 40 for c in range(1, (1 if n in ONE_CHAPTER_NUMBERS else 50) + 1)} for n, b in books()}
    sizes["Псалтирь"] |= {c: 40 for c in range(51, 151)} | {1: 6, 132: 3, 124: 5}
    sizes["Исаия"] |= {c: 40 for c in range(51, 67)}
    changes = {("Деяния", 4): 37, ("1 Иоанна", 2): 29, ("Матфей", 5): 48, ("Матфей", 22): 46, ("1 Коринфянам", 15): 58, ("Иеремия", 32): 44, ("Иоанн", 6): 71, ("Лука", 6): 49, ("Иов", 32): 22, ("Иов", 34): 37, ("Иона", 3): 10, ("Лука", 20): 47}
    for (book, chapter), n in changes.items():
        sizes[book][chapter] = n
    return sizes


def golden_verses(spark: SparkSession) -> DataFrame:
    numbers = {b: n for n, b in books()}
    rows = [(numbers[b], b, c, n) for b, chapters in golden_sizes().items() for c, n in chapters.items()]
    grid = spark.createDataFrame(rows, "book_no int, book string, chapter int, n int").select("book_no", "book", "chapter", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("verse"))
    return grid.withColumn("text", F.concat_ws("-", "book_no", "chapter", "verse"))
