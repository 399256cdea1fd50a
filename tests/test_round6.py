import re
import time

from pyspark.sql import functions as F

from lectern.functions.text import normalize_quote


def test_quotes_keep_letters_and_digits_alone(spark):
    """Every character but а-я, a-z and 0-9 parts words: those next to these ranges, of other scripts and planes, and none at all."""
    odd = [chr(c) for c in (0, 9, 10, 47, 48, 57, 58, 64, 96, 97, 122, 123, 127, 160, 0x3B1, 0x42F, 0x430, 0x44F, 0x450, 0x451, 0x456, 0x2028, 0x4E00, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    texts = [f"б{c}{d}9" for c in odd for d in odd] + ["", " ", " а  b ", "Ёж и ЯК", "".join(odd)]
    got = {x.text: x.n for x in spark.createDataFrame([(t,) for t in texts], "text string").select("text", normalize_quote(F.col("text")).alias("n")).collect()}
    assert got == {t: re.sub("[^а-яa-z0-9]+", " ", t.lower().replace("ё", "е")).strip(" ") for t in texts}


def test_quotes_are_normalised_fast(spark):
    """Tasks of one JVM do not hold each other up in matching."""
    texts = spark.range(0, 32000, 1, 8).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" Слово, и дело plain words ")), 70).alias("text"))
    began = time.time()
    texts.select(normalize_quote(F.col("text")).alias("n")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 8
