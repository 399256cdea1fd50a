"""Small lookups: number beginnings, vocabulary of the recogniser, book suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.books import NUMBER_HINTS, aliases_table, books_table, number_words

#: Words about references that the recogniser must know, and names that its dictionary lacks.
KEYWORDS = "глава главу главы главе стих стиха стихи стихов псалом псалма евангелие послание книга пророка по до с и от из читаем прочитаем откроем откройте там же конца первое второе третье".split()
UNKNOWN_TO_RECOGNISER = "паралипоменон фессалоникийцам екклесиаст кохелет аввакума аггея иезекииля ниемии немии иссаии иссайи".split()


def number_values(token: Column) -> Column:
    """Numbers up to 150 that a misheard token may stand for, ascending: a known beginning either way, or a number word."""
    hints = F.create_map(*(x for k, v in NUMBER_HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.create_map(*(F.lit(x) for kv in sorted(number_words().items()) for x in kv))
    meets = lambda k: token.startswith(k) | k.startswith(token)
    by_hint = F.when(F.length(token) >= 2, F.flatten(F.map_values(F.map_filter(hints, lambda k, _: meets(k)))))
    by_word = F.when(F.length(token) >= 3, F.map_values(F.map_filter(words, lambda k, _: meets(k))))
    direct = F.array_compact(F.array(F.try_element_at(words, token)))
    none = F.array().cast("array<int>")
    every = F.concat(direct, F.coalesce(by_hint, none), F.coalesce(by_word, none))
    return F.when(token.rlike(r"^\d{1,6}$"), F.array(token.try_cast("int"))).otherwise(F.array_sort(F.array_distinct(F.filter(every, lambda v: v.between(1, 150)))))


def recogniser_phrases(spark: SparkSession) -> DataFrame:
    """Distinct phrases the recogniser is given: phrase. Names, keywords and number words; none with a digit or a word
    that its dictionary lacks; and [unk] for all else."""
    names = aliases_table(spark).select(F.lower("alias").alias("phrase"))
    more = spark.createDataFrame([(w,) for w in [*KEYWORDS, *number_words()]], "phrase string")
    known = F.array(*map(F.lit, UNKNOWN_TO_RECOGNISER))
    usable = names.unionByName(more).where((F.col("phrase") != "") & ~F.col("phrase").rlike(r"\d") & ~F.arrays_overlap(F.split("phrase", " "), known))
    return usable.unionByName(spark.createDataFrame([("[unk]",)], "phrase string")).distinct()


def suggestions(queries: DataFrame, top: int = 6) -> DataFrame:
    """Books whose name begins with what was typed, in canon order: query_id, book_no, book; none once a number is typed.
    ``queries``: query_id, typed."""
    from pyspark.sql import Window

    typed = queries.withColumn("p", F.lower(F.ltrim("typed"))).where((F.col("p") != "") & ~F.col("p").rlike(r"\D\s*\d"))
    met = typed.join(F.broadcast(books_table(queries.sparkSession)), F.lower("book").startswith(F.col("p")))
    return met.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("book_no"))).where(F.col("r") <= top).select("query_id", "book_no", "book")


def vocabulary_report(phrases: DataFrame, words: list[str]) -> DataFrame:
    """One row on the recogniser's phrases: size, missing_words (how many words its dictionary lacks), and for each of
    ``words`` whether it is one of them, as columns has_0, has_1, ..."""
    has = [F.coalesce(F.bool_or(F.col("phrase") == w), F.lit(False)).alias(f"has_{i}") for i, w in enumerate(words)]
    return phrases.agg(F.countDistinct("phrase").alias("size"), *has).withColumn("missing_words", F.lit(len(UNKNOWN_TO_RECOGNISER)).cast("long"))
