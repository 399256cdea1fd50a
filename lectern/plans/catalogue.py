"""The engine's queries over the driver's tables, each with the DuckDB SQL it is held against.

Transcripts are made from ``events`` by arithmetic, so that SQL knows what a parser must find: book 1 + event_id % 66,
chapter 1 + user_id % 50 (1 for books of one chapter), verse 1 + event_id % 20, last verse up to four more.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import payloads
from lectern.functions.text import fold_numbers, normalize_quote, normalize_reference, reference_text, value_range, verse_count, verse_id, verse_id_problem
from lectern.operators import likeness, logs, lookup, names, readings, search, sessions
from lectern.operators.references import compact_range, reference_numbers
from lectern.plans import parse
from lectern.plans.override import overridden
from lectern.plans.held import Held
from lectern.plans.parse import best_in_book, best_with_margin, once_per, parse_references, resolve_candidates, verse_texts
from lectern.ship import shipped
from lectern.sources import canon
from lectern.sources.books import ONE_CHAPTER, books, number_words, overlaid, roman, spoken_names
from lectern.streaming.live import session_references

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _drawn(spark: SparkSession, sf_dir: str, values: list[tuple], schema: str) -> DataFrame:
    """Events, each with one of some values by its number: event_id and the columns of ``schema``."""
    dimension = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i long, {schema}")
    return _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(values)).alias("i")).join(F.broadcast(dimension), "i").drop("i")


def _drawn_sql(values: list[tuple], columns: str, select: str | None = None, where: str = "") -> str:
    """What ``_drawn`` gives, as SQL with some columns."""
    return f"SELECT event_id, {select or columns} FROM events JOIN ({_values((i, *v) for i, v in enumerate(values))}) AS t(i, {columns}) ON event_id % {len(values)} = i {where}"


def _values(rows) -> str:
    """Rows of texts as SQL VALUES."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_ONE = ", ".join(str(n) for n, b in books() if b in ONE_CHAPTER)
_BOOKS_SQL = "books(book_no, book) AS (VALUES " + ", ".join(f"({n}, '{b}')" for n, b in books()) + ")"
_SPOKEN_SQL = f"""WITH {_BOOKS_SQL}, u AS (
  SELECT event_id AS utt_id, book, CASE WHEN b.book_no IN ({_ONE}) THEN 1 ELSE 1 + user_id % 50 END AS c, 1 + event_id % 20 AS v, 1 + event_id % 20 + user_id % 5 AS e
  FROM events JOIN books b ON b.book_no = 1 + event_id % 66
)"""


def _spoken(spark: SparkSession, sf_dir: str, text: Callable[..., Column]) -> DataFrame:
    """Transcripts of events: utt_id and text(book, chapter, verse, last verse)."""
    names = F.array(*(F.lit(b) for _, b in books()))
    no = (F.col("event_id") % 66 + 1).cast("int")
    c = F.when(no.isin(*(n for n, b in books() if b in ONE_CHAPTER)), 1).otherwise(F.col("user_id") % 50 + 1).cast("string")
    v, e = F.col("event_id") % 20 + 1, F.col("event_id") % 20 + 1 + F.col("user_id") % 5
    # The table is one file: dealt, so that all cores have a share of the texts.
    dealt = _t(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    return dealt.select(F.col("event_id").alias("utt_id"), text(F.element_at(names, no), c, v.cast("string"), e.cast("string")).alias("text"))


def _sizes(spark: SparkSession) -> DataFrame:
    return canon.chapter_sizes(canon.formula_verses(spark))


def _parsed(spark: SparkSession, sf_dir: str, text: Callable[..., Column]) -> DataFrame:
    return parse_references(_spoken(spark, sf_dir, text), _sizes(spark)).select("utt_id", "ref", "book", F.col("chapter").cast("long").alias("chapter"), F.col("start_verse").cast("long").alias("start_verse"), F.col("end_verse").cast("long").alias("end_verse"))


_FOUND = "SELECT utt_id, book || ' ' || c || ':' || v || CASE WHEN e > v THEN '-' || e ELSE '' END AS ref, book, CAST(c AS BIGINT) AS chapter, CAST(v AS BIGINT) AS start_verse, CAST(e AS BIGINT) AS end_verse FROM u"
_LONE = _FOUND.replace("CASE WHEN e > v THEN '-' || e ELSE '' END", "''").replace("CAST(e AS BIGINT)", "CAST(v AS BIGINT)")


def _say(*parts):
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


_QUOTED = "CASE WHEN doc_id % 7 = 0 THEN 'Начало премудрости СТРАХ  Господи, ' || text ELSE text END"


def _norm_sql(text: str) -> str:
    plain = f"' ' || regexp_replace(translate(lower({text}), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g') || ' '"
    return f"trim(regexp_replace({plain}, ' страх господи ', ' страх господень ', 'g'))"


@query("q01_normalize_quote", f"SELECT doc_id, {_norm_sql(_QUOTED)} AS norm FROM documents")
def q01(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", normalize_quote(F.expr(_QUOTED)).alias("norm"))


_NORMAL = [(1, "Матфей 5:48-6:4", "матфей 5 глава 48 стих по 6 глава 4 стих"), (2, "Второзаконие. Двадцатую главу с 10 по 15 стих.", "второзаконие 20 глава с 10 по 15 стих"), (3, "Псалом сто тридцать два.", "псалом 132"), (4, "Лука 6 глава 43-44-х", "лука 6 глава 43 44 стих"), (5, "Первое послание Иоанна, вторая глава, с 8 по 9 стих", "1 послание иоанна 2 глава с 8 по 9 стих"), (6, "Книга Иов, тридцать четвёртая глава", "книга иов 34 глава"), (7, "", "")]


@query("q02_normalize_reference", _drawn_sql([(w,) for _, _, w in _NORMAL], "norm"))
def q02(spark, sf_dir):
    return _drawn(spark, sf_dir, [(t,) for _, t, _ in _NORMAL], "text string").select("event_id", normalize_reference(F.col("text")).alias("norm"))


def _number_phrase(n: int) -> str:
    words = {v: k for k, v in number_words().items() if k[-1] in "ьаио" or k[-1] not in "йяеюмх"}
    parts = [100] * (n >= 100) + [n % 100 // 10 * 10] * (n % 100 >= 20) + [n % 100 if n % 100 < 20 else n % 10]
    return " ".join(words[p] for p in parts if p)


@query("q03_number_words_fold", "SELECT event_id, 'глава ' || (1 + event_id % 199) || ' стих' AS folded FROM events")
def q03(spark, sf_dir):
    said = _drawn(spark, sf_dir, [(f"глава {_number_phrase(n)} стих",) for n in range(1, 200)], "said string")
    return said.select("event_id", F.array_join(fold_numbers(F.split("said", " ")), " ").alias("folded"))


@query("q04_roman_numerals", "SELECT event_id, 'иоанна ' || (1 + event_id % 20) || ' глава' AS norm FROM events")
def q04(spark, sf_dir):
    said = _drawn(spark, sf_dir, [(f"Иоанна {roman(n).upper()}, глава",) for n in range(1, 21)], "text string")
    return said.select("event_id", normalize_reference(F.col("text")).alias("norm"))


@query("q05_parse_explicit", f"{_SPOKEN_SQL} {_LONE}")
def q05(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda b, c, v, e: _say(b, c, "глава", v, "стих"))


@query("q06_parse_range", f"{_SPOKEN_SQL} {_FOUND}")
def q06(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda b, c, v, e: _say(b, c, "глава с", v, "по", e, "стих"))


@query("q07_parse_cross_chapter", f"{_SPOKEN_SQL} SELECT utt_id, book || ' ' || c || ':' || v || '-' || (c + 1) || ':' || e AS ref, book, CAST(c AS BIGINT) AS chapter, CAST(v AS BIGINT) AS start_verse, CAST(e AS BIGINT) AS end_verse FROM u WHERE c < 50 AND book NOT IN ({', '.join(repr(b) for b in ONE_CHAPTER)})")
def q07(spark, sf_dir):
    said = _spoken(spark, sf_dir, lambda b, c, v, e: F.when((c.cast("int") < 50) & ~b.isin(*ONE_CHAPTER), _say(b, F.concat(c, F.lit(":"), v, F.lit("-"), (c.cast("int") + 1).cast("string"), F.lit(":"), e))))
    return parse_references(said.where("text is not null"), _sizes(spark)).select("utt_id", "ref", "book", F.col("chapter").cast("long").alias("chapter"), F.col("start_verse").cast("long").alias("start_verse"), F.col("end_verse").cast("long").alias("end_verse"))


@query("q08_parse_colon_form", f"{_SPOKEN_SQL} {_FOUND}")
def q08(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda b, c, v, e: _say(b, F.concat(c, F.lit(":"), v, F.when(v != e, F.concat(F.lit("-"), e)).otherwise(""))))


@query("q09_parse_reversed", f"{_SPOKEN_SQL} {_LONE}")
def q09(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda b, c, v, e: _say(v, "стих", c, "глава", b))


@query("q12_invalid_rejected", f"{_SPOKEN_SQL} SELECT count(*) AS n_said, CAST(0 AS BIGINT) AS n_found FROM u")
def q12(spark, sf_dir):
    said = _spoken(spark, sf_dir, lambda b, c, v, e: _say(b, c, "глава", (v.cast("int") % 9 + 41).cast("string"), "стих"))
    found = parse_references(said, _sizes(spark)).groupBy().agg(F.count("*").alias("n_found"))
    return said.groupBy().agg(F.count("*").alias("n_said")).join(F.broadcast(found))


@query("q14_compact_range", """WITH t AS (SELECT event_id, CAST(100 + event_id % 9900 AS VARCHAR) AS token FROM events),
s AS (SELECT event_id, CAST(token[1:k] AS BIGINT) AS a, CAST(token[k + 1:] AS BIGINT) AS z FROM (SELECT event_id, token, unnest(range(1, len(token))) AS k FROM t))
SELECT event_id, a AS first, z AS last FROM s WHERE a > 0 AND z > a AND z <= 40 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY z - a DESC, a DESC) = 1""")
def q14(spark, sf_dir):
    token = (F.col("event_id") % 9900 + 100).cast("string")
    x = _t(spark, sf_dir, "events").select("event_id", compact_range(token, F.lit(40)).alias("w")).where("w is not null")
    return x.select("event_id", F.col("w.first").cast("long").alias("first"), F.col("w.last").cast("long").alias("last"))


@query("q20_resolver_margin", """WITH c AS (SELECT p_partkey % 100 AS utt_id, p_partkey, p_brand AS book, p_size % 3 AS chapter, p_partkey % 7 AS s, p_partkey % 7 + p_size % 4 AS e, round(p_retailprice, 2) + p_partkey * 37 % 101 AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, p_partkey) AS rank FROM c),
b AS (SELECT * FROM r WHERE rank = 1),
g AS (SELECT b.utt_id, arg_min(b.score - r.score, r.rank) AS gap FROM r JOIN b USING (utt_id) WHERE r.rank BETWEEN 2 AND 5 AND NOT (r.book = b.book AND r.chapter = b.chapter AND b.s <= r.s AND b.e >= r.e AND (b.s <> r.s OR b.e <> r.e)) GROUP BY b.utt_id)
SELECT b.utt_id, p_partkey AS ref FROM b LEFT JOIN g USING (utt_id) WHERE gap IS NULL OR gap >= 1.0""")
def q20(spark, sf_dir):
    c = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("utt_id"), F.col("p_partkey").alias("ref"), F.col("p_brand").alias("book"), (F.col("p_size") % 3).alias("chapter"), (F.col("p_partkey") % 7).alias("start_verse"), (F.col("p_partkey") % 7 + F.col("p_size") % 4).alias("end_verse"), (F.round("p_retailprice", 2) + F.col("p_partkey") * 37 % 101).alias("score"))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("utt_id").orderBy(F.desc("score"), "ref"))).where("rank <= 5")
    return best_with_margin(ranked, 1.0).select("utt_id", "ref")


@query("q21_verse_id_encode", """SELECT l_orderkey, l_linenumber, lpad(CAST(1 + l_orderkey % 66 AS VARCHAR), 2, '0') || lpad(CAST(1 + l_partkey % 150 AS VARCHAR), 3, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS verse_id,
CAST(CASE WHEN l_linenumber > 5 THEN 1 ELSE 6 - l_linenumber END AS BIGINT) AS n_verses FROM lineitem""")
def q21(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", verse_id(F.col("l_orderkey") % 66 + 1, F.col("l_partkey") % 150 + 1, F.col("l_linenumber")).alias("verse_id"), verse_count(F.col("l_linenumber"), F.lit(5), F.lit(None)).cast("long").alias("n_verses"))


def _line_verses(spark, sf_dir):
    """Documents as chapters, their lines as verses."""
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("book", "chapter", (F.col("i") + 1).alias("verse"), "text")


_LINES = "lines AS (SELECT source AS book, doc_id AS chapter, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS verse, unnest(string_split(text, chr(10))) AS text FROM documents)"


@query("q22_canon_structure", f"WITH {_LINES} SELECT book, chapter, string_agg(CAST(verse AS VARCHAR), ',' ORDER BY verse) AS verse_ids, CAST(max(verse) AS BIGINT) AS last, count(DISTINCT verse) AS n FROM lines GROUP BY book, chapter")
def q22(spark, sf_dir):
    return canon.structure(_line_verses(spark, sf_dir)).select("book", "chapter", F.array_join(F.transform("verse_ids", lambda v: v.cast("string")), ",").alias("verse_ids"), F.col("last").cast("long").alias("last"), "n")


@query("q23_verse_windows", f"""WITH {_LINES}, w AS (SELECT a.chapter, a.verse AS first, k, string_agg(b.text, ' ' ORDER BY b.verse) AS text, count(*) AS n FROM lines a CROSS JOIN (VALUES (1), (2), (3)) AS t(k) JOIN lines b ON a.chapter = b.chapter AND b.verse BETWEEN a.verse AND a.verse + k - 1 GROUP BY ALL)
SELECT chapter, CAST(first AS BIGINT) AS first, CAST(first + k - 1 AS BIGINT) AS last, md5(text) AS text_md5 FROM w WHERE n = k AND regexp_matches(lower(text), '[а-яёa-z0-9]')""")
def q23(spark, sf_dir):
    return canon.verse_windows(_line_verses(spark, sf_dir), 3).select("chapter", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_NORM = _norm_sql("text")


@query("q24_quote_containment", f"""WITH q AS (SELECT item_id, {_NORM} AS q FROM benchmark), d AS (SELECT doc_id, {_NORM} AS norm FROM documents)
SELECT item_id AS query_id, doc_id AS window_id, CASE WHEN q = norm THEN 110.0 ELSE 100.0 END::DOUBLE AS score FROM q JOIN d ON contains(norm, q) AND length(q) >= 5""")
def q24(spark, sf_dir):
    q = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), normalize_quote(F.col("text")).alias("q"))
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("window_id"), normalize_quote(F.col("text")).alias("norm"))
    return search.contained(q, Held(spark).write(d))


@query("q25_quote_similarity_topk")
def q25(spark, sf_dir):
    q = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), normalize_quote(F.col("text")).alias("q"))
    lines = _line_verses(spark, sf_dir).select((F.col("chapter") * 100000 + F.col("verse")).alias("window_id"), normalize_quote(F.col("text")).alias("norm"))
    lines = Held(spark).write(lines).where("norm <> ''")
    return search.best_windows(search.similar(q, lines), lines, 5)


@query("q26_fragment_buffer", """WITH t AS (SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE trim(text) <> ''), w AS (SELECT conv_id, turn, text AS a, lag(text) OVER s AS b, lag(text, 2) OVER s AS c FROM t WINDOW s AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(concat_ws('|', a, CASE WHEN b IS NOT NULL THEN b || ' ' || a END, CASE WHEN c IS NOT NULL THEN c || ' ' || b || ' ' || a END)) AS tried FROM w""")
def q26(spark, sf_dir):
    f = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    return sessions.fragment_windows(f, 3).select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"), F.md5(F.array_join("candidates", "|").cast("binary")).alias("tried"))


@query("q27_context_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'r' || length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_ref FROM conversations")
def q27(spark, sf_dir):
    p = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", F.concat(F.lit("r"), F.length("text").cast("string"))).alias("ref"))
    return sessions.carried_forward(p).select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"), "last_ref")


_PLACED = [("там же 5 стих", "Наум", 1, "там же 5 стих|Наум 1 глава 5 стих"), ("привет", "Наум", 1, "привет"), ("и там же стих 7", "Наум", 1, "и там же стих 7|Наум 1 глава и стих 7"), ("там же 5 стих", None, None, "там же 5 стих")]


@query("q28_same_place_expand", _drawn_sql([(t,) for *_, t in _PLACED], "tried"))
def q28(spark, sf_dir):
    x = _drawn(spark, sf_dir, [v[:3] for v in _PLACED], "text string, book string, chapter int")
    tried = sessions.same_place(F.array("text"), F.col("book"), F.col("chapter"))
    return x.select("event_id", F.regexp_replace(F.array_join(tried, "|"), " +", " ").alias("tried"))


_GUARDED = [
    (1, [("новый", None), ("старый новый", "A 1:1")], "A 1:1", False),
    (2, [("5 глава", None), ("старый 5 глава", "A 1:1")], "A 1:1", False),
    (3, [("Матфей 5 глава", None), ("старый Матфей 5 глава", "A 1:1")], None, True),
    (4, [("5 глава", "A 1:1"), ("старый 5 глава", "B 2:2")], "A 1:1", False),
    (5, [("x", None)], None, False),
    (6, [("Там  же", None), ("Марк 1 глава там же", "A 1:1")], None, True),
    (7, [("марка", None), ("5 глава марка", "A 1:1")], None, True),
    (8, [("Левита", None), ("5 глава левита", "A 1:1")], None, True),
    (9, [("а потом он пошел", None), ("Марк а потом он пошел", "A 1:1")], "A 1:1", False),
]


@query("q29_stale_context_guard", _drawn_sql([(r, b) for _, _, r, b in _GUARDED], "ref, blocked"))
def q29(spark, sf_dir):
    x = _drawn(spark, sf_dir, [(a,) for _, a, _, _ in _GUARDED], "attempts array<struct<text: string, ref: string>>")
    return x.select("event_id", sessions.first_match(F.col("attempts")).alias("m")).select("event_id", "m.hit.ref", "m.blocked")


@query("q30_consecutive_dedupe", "SELECT event_id, user_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def q30(spark, sf_dir):
    return sessions.without_repeats(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("q31_session_ref_list", """WITH q AS (SELECT user_id, event_type || ' ' || (event_id % 9) AS ref, min(event_id) AS seq FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq, ref) AS i FROM q)
SELECT user_id, count(*) AS n, string_agg(i || '. ' || ref, chr(10) ORDER BY i) AS share_text FROM n GROUP BY user_id""")
def q31(spark, sf_dir):
    q = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", (F.col("event_id") % 9).cast("string")).alias("ref"))
    return sessions.share_list(q).select(F.col("session").alias("user_id"), F.col("n").cast("long").alias("n"), "share_text")


def _as_log(spark, sf_dir):
    """Events as log lines: every eleventh damaged, types as parsed references or raw finals."""
    ref = F.concat(F.col("event_type"), F.lit(" 1:"), (F.col("user_id") % 40).cast("string"), F.when(F.col("user_id") % 3 == 0, F.lit("-40")).otherwise(""))
    kind = F.when(F.col("event_id") % 2 == 0, "parsed").otherwise("final_raw")
    payload = F.struct(F.when(F.col("event_id") % 4 != 0, ref).alias("ref"), F.col("event_type").alias("book"), F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("text"))
    line = F.to_json(F.struct(kind.alias("event"), F.concat(F.lit("f"), (F.col("user_id") % 60).cast("string")).alias("text"), payload.alias("payload")))
    return _t(spark, sf_dir, "events").select(F.lit("log").alias("path"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))


@query("q32_log_summary_top30", """WITH e AS (SELECT event_id, event_id % 2 = 0 AS parsed, CASE WHEN event_id % 4 <> 0 THEN event_type || ' 1:' || (user_id % 40) || CASE WHEN user_id % 3 = 0 THEN '-40' ELSE '' END END AS ref, event_type AS book, 't' || (user_id % 50) AS ptext, 'f' || (user_id % 60) AS ftext FROM events WHERE event_id % 11 <> 0),
v AS (SELECT 'final_text' AS kind, ftext AS value, event_id FROM e WHERE NOT parsed UNION ALL SELECT 'ref', ref, event_id FROM e WHERE parsed AND ref IS NOT NULL UNION ALL SELECT 'book', book, event_id FROM e WHERE parsed
UNION ALL SELECT 'range_ref', ref, event_id FROM e WHERE parsed AND contains(ref, '-') UNION ALL SELECT 'unmatched_text', ptext, event_id FROM e WHERE parsed AND ref IS NULL)
SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min(event_id), value) AS rank FROM v GROUP BY kind, value QUALIFY rank <= 30""")
def q32(spark, sf_dir):
    return logs.most_common(logs.counted_values(logs.parse_lines(_as_log(spark, sf_dir)))).select("kind", "value", "n", F.col("rank").cast("long").alias("rank"))


@query("q35_invalid_json_count", "SELECT CASE WHEN event_id % 11 = 0 THEN 'invalid_json' WHEN event_id % 2 = 0 THEN 'parsed' ELSE 'final_raw' END AS event, count(*) AS n FROM events GROUP BY 1")
def q35(spark, sf_dir):
    return logs.parse_lines(_as_log(spark, sf_dir)).groupBy("event").agg(F.count("*").alias("n"))


@query("q33_unmatched_attempts", "SELECT text AS value, count(*) AS n FROM (SELECT trim(text) AS text FROM conversations WHERE role <> 'assistant' AND trim(text) <> '') GROUP BY 1")
def q33(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    e = c.groupBy("conv_id").agg(F.collect_list(F.struct("text", F.lit(None).cast("string").alias("ref"), F.lit("").alias("source"), (F.col("role") == "assistant").alias("matched"))).alias("attempts"))
    none = F.lit(None).cast("string")
    log = e.select(F.lit("c").alias("path"), F.col("conv_id").alias("line_no"), F.lit("parsed").alias("event"), F.struct(none.alias("text"), F.struct(none.alias("text"), none.alias("ref"), none.alias("book"), "attempts").alias("payload")).alias("e"))
    return logs.counted_values(log).where("kind = 'unmatched_attempt'").groupBy("value").agg(F.count("*").alias("n"))


_ACTIONS = "CASE event_id % 5 WHEN 0 THEN 'submit' WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'submit' ELSE 'approve' END"


@query("q36_approval_transitions", f"""WITH a AS (SELECT user_id, event_id, {_ACTIONS} AS action, 'r' || event_id AS ref, event_id % 7 <> 0 AS ok FROM events),
m AS (SELECT *, CASE WHEN action = 'submit' THEN ref WHEN ok THEN '' END AS change FROM a),
s AS (SELECT *, nullif(last_value(change IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS slot FROM m)
SELECT user_id, event_id, action, CASE WHEN action = 'submit' THEN ref ELSE slot END AS ref, CASE WHEN action = 'submit' THEN 'pending' WHEN slot IS NULL THEN 'no_pending_candidate' WHEN NOT ok THEN 'callback_failed' WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END AS outcome FROM s""")
def q36(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr(_ACTIONS).alias("action"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("ref"), (F.col("event_id") % 7 != 0).alias("callback_ok"))
    return sessions.approvals(a).select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), "action", "ref", "outcome")


@query("q37_approval_action_label", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'approve' WHEN event_id % 5 = 1 THEN 'reject' WHEN user_id % 3 = 0 THEN 'waiting' WHEN event_id % 2 = 0 THEN 'sent' ELSE 'recognized' END AS label FROM events")
def q37(spark, sf_dir):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", sessions.action_label(F.when(e % 5 == 0, "approve").when(e % 5 == 1, "reject"), F.when(F.col("user_id") % 3 == 0, "waiting_for_approval"), e % 2 == 0).alias("label"))


_BODIES = ["", "ok, no JSON", '{"status":"ok"}', '{"status":"error"}', '{"error":{"message":"no token"}}', '{"map":{"key_ok":false}}', '{"map":{"key_ok":true}}']


@query("q38_response_classifier", "SELECT n_nationkey, b.ok, b.reason FROM nation JOIN (VALUES (0, true, ''), (1, true, ''), (2, true, ''), (3, false, 'status:error'), (4, false, 'no token'), (5, false, 'invalid_token'), (6, true, '')) AS b(i, ok, reason) ON n_nationkey % 7 = b.i")
def q38(spark, sf_dir):
    body = F.element_at(F.array(*map(F.lit, _BODIES)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", sessions.response_reason(body).alias("r")).select("n_nationkey", "r.ok", "r.reason")


@query("q39_low_confidence_words", "SELECT event_id, (event_id % 3 = 0 AND user_id % 100 <= 76) AS low FROM events")
def q39(spark, sf_dir):
    words = F.array(F.struct(F.when(F.col("event_id") % 3 == 0, "Иеремия").otherwise("глава").alias("word"), (F.col("user_id") % 100 / 100).cast("string").alias("conf")), F.struct(F.lit("иеремии").alias("word"), F.lit("none").alias("conf")))
    return _t(spark, sf_dir, "events").select("event_id", sessions.low_confidence(words).alias("low"))


_PHRASES_SQL = f"""names(phrase) AS ({_values((n,) for n, _ in spoken_names())}), more(phrase) AS ({_values((w,) for w in [*lookup.KEYWORDS, *number_words()])}), missing(word) AS ({_values((w,) for w in lookup.UNKNOWN_TO_RECOGNISER)}),
said AS (SELECT lower(phrase) AS phrase FROM names UNION SELECT phrase FROM more),
phrases AS (SELECT phrase FROM said WHERE phrase <> '' AND NOT regexp_matches(phrase, '[0-9]') AND NOT EXISTS (SELECT 1 FROM missing WHERE list_contains(string_split(phrase, ' '), word)) UNION SELECT '[unk]')"""


@query("q40_grammar_vocab", f"WITH {_PHRASES_SQL} SELECT phrase FROM phrases")
def q40(spark, sf_dir):
    return lookup.recogniser_phrases(spark)


_TYPED = [(1, "и"), (2, "1 "), (3, "Ма"), (4, "иоанн 3"), (5, ""), (6, "пс")]


@query("q41_prefix_suggestions", f"WITH {_BOOKS_SQL}, q(i, p) AS (VALUES (0, 'и'), (1, '1 '), (2, 'ма'), (5, 'пс')) SELECT event_id, CAST(book_no AS BIGINT) AS book_no, book FROM events JOIN q ON event_id % 6 = i JOIN books ON starts_with(lower(book), p) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY book_no) <= 6")
def q41(spark, sf_dir):
    x = lookup.suggestions(_drawn(spark, sf_dir, [(t,) for _, t in _TYPED], "typed string").withColumnRenamed("event_id", "query_id"))
    return x.select(F.col("query_id").alias("event_id"), F.col("book_no").cast("long").alias("book_no"), "book")


@query("q42_latest_slide", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q42(spark, sf_dir):
    return sessions.latest(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("q43_verse_text_range_join", f"{_SPOKEN_SQL}, t AS (SELECT utt_id, b.book_no, c, unnest(range(v, e + 1)) AS w, v, e FROM u JOIN books b ON b.book = u.book) SELECT utt_id, string_agg(CASE WHEN e > v THEN w || '. ' ELSE '' END || book_no || '-' || c || '-' || w, ' ' ORDER BY w) AS verse_text FROM t GROUP BY utt_id")
def q43(spark, sf_dir):
    names = F.array(*(F.lit(b) for _, b in books()))
    no = (F.col("event_id") % 66 + 1).cast("int")
    book = F.element_at(names, no)
    c = F.when(book.isin(*ONE_CHAPTER), 1).otherwise(F.col("user_id") % 50 + 1).cast("int")
    v = (F.col("event_id") % 20 + 1).cast("int")
    refs = _t(spark, sf_dir, "events").select(F.col("event_id").alias("ref_id"), book.alias("book"), c.alias("chapter"), v.alias("start_verse"), (v + F.col("user_id") % 5).cast("int").alias("end_verse"), F.lit(None).cast("int").alias("end_chapter"))
    return verse_texts(refs, canon.formula_verses(spark)).select(F.col("ref_id").alias("utt_id"), "verse_text")


_HEARD = [("детри", "29"), ("двад", "2,20"), ("17", "17"), ("сор", "40"), ("xx", "")]


@query("q44_number_prefix_lookup", _drawn_sql(_HEARD, "token, numbers"))
def q44(spark, sf_dir):
    x = _drawn(spark, sf_dir, [(t,) for t, _ in _HEARD], "token string")
    return x.select("event_id", "token", F.array_join(F.transform(lookup.number_values(F.col("token")), lambda v: v.cast("string")), ",").alias("numbers"))


@query("q48_reference_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'Марк ' || l_linenumber || ':2-' || (l_linenumber + 1) || ':4' WHEN l_partkey % 2 = 0 THEN 'Марк ' || l_linenumber || ':2' ELSE 'Марк ' || l_linenumber || ':2-4' END AS ref FROM lineitem")
def q48(spark, sf_dir):
    far = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber") + 1)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reference_text(F.lit("Марк"), F.col("l_linenumber"), F.lit(2), F.when(far.isNull() & (F.col("l_partkey") % 2 == 0), 2).otherwise(4), far).alias("ref"))


@query("q10_one_chapter_books", f"""WITH o(i, book) AS ({_values((i, b) for i, b in enumerate(ONE_CHAPTER))}), u AS (SELECT event_id AS utt_id, book, 1 AS c, 1 + event_id % 20 AS v, 1 + event_id % 20 + user_id % 5 AS e FROM events JOIN o ON i = event_id % 4) {_FOUND}""")
def q10(spark, sf_dir):
    book = F.element_at(F.array(*map(F.lit, ONE_CHAPTER)), (F.col("event_id") % 4 + 1).cast("int"))
    v, e = F.col("event_id") % 20 + 1, F.col("event_id") % 20 + 1 + F.col("user_id") % 5
    verses = F.when(v == e, F.concat_ws(" ", v.cast("string"), F.lit("стих"))).otherwise(F.concat_ws(" ", F.lit("с"), v.cast("string"), F.lit("по"), e.cast("string"), F.lit("стих")))
    said = _t(spark, sf_dir, "events").select(F.col("event_id").alias("utt_id"), F.concat_ws(" ", book, verses).alias("text"))
    return parse_references(said, _sizes(spark)).select("utt_id", "ref", "book", *(F.col(c).cast("long").alias(c) for c in ("chapter", "start_verse", "end_verse")))


@query("q11_trailing_zero_repair", f"{_SPOKEN_SQL} SELECT utt_id, book || ' ' || c || ':' || w AS ref, book, CAST(c AS BIGINT) AS chapter, CAST(w AS BIGINT) AS start_verse, CAST(w AS BIGINT) AS end_verse FROM (SELECT *, 5 + utt_id % 5 AS w FROM u)")
def q11(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda b, c, v, e: _say(b, c, "глава", ((F.col("event_id") % 5 + 5) * 10).cast("string"), "стих"))


_SHORT = [(1, "Псалом сто тридцать два.", "Псалтирь 132:1-3"), (2, "Псалом 124", "Псалтирь 124:1-5"), (3, "Псалом 124 3 стих", "Псалтирь 124:3"), (4, "Псалом 23", "Псалтирь 23:1"), (5, "Псалом 200", None), (6, "Наум 2 5", "Наум 2:5")]


@query("q13_short_chapter_expand", _drawn_sql([(r,) for _, _, r in _SHORT], "ref", where="WHERE ref IS NOT NULL"))
def q13(spark, sf_dir):
    sizes = spark.createDataFrame(list(canon.golden_sizes().items()), "book string, sizes map<int, int>")
    said = _drawn(spark, sf_dir, [(t,) for _, t, _ in _SHORT], "text string")
    return parse_references(said.withColumnRenamed("event_id", "utt_id"), sizes).select(F.col("utt_id").alias("event_id"), "ref")


@query("q15_book_exact_candidates", """WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation WHERE n_name IS NOT NULL), t AS (SELECT event_id, a.name AS first, b.name AS second FROM events JOIN n a ON a.k = event_id % 25 JOIN n b ON b.k = user_id % 25),
p AS (SELECT event_id, first AS name, 0 AS start FROM t UNION ALL SELECT event_id, second, length(first) + 9 FROM t)
SELECT event_id, upper(name) AS book, CAST(start AS BIGINT) AS start, CAST(start + length(name) AS BIGINT) AS "end", CAST(1.0 AS DOUBLE) AS score, round(least(1.0, 0.72 + length(name) / 45.0), 6)::DOUBLE AS alone FROM p""")
def q15(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("variant"), F.col("n_name").alias("book"))
    two = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 25).alias("k1"), (F.col("user_id") % 25).alias("k2"))
    named = two.join(F.broadcast(n.select(F.col("k").alias("k1"), F.col("variant").alias("v1"))), "k1").join(F.broadcast(n.select(F.col("k").alias("k2"), F.col("variant").alias("v2"))), "k2")
    texts = named.select(F.col("event_id").alias("utt_id"), F.concat_ws(" ", "v1", F.lit("глава и"), "v2").alias("norm"))
    found = names.exact_candidates(names.grams(texts), n.select("variant", "book"))
    return found.select(F.col("utt_id").alias("event_id"), "book", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score", F.round(names.alias_score(F.col("spoken")), 6).alias("alone"))


def _misheard() -> list[tuple[str, str | None, float | None]]:
    """Names of books with a letter out, or two in the other's place, and what is most like them, by the standard library."""
    known = sorted({b.lower() for _, b in books()})
    said = sorted({w for b in known if len(b) > 4 for w in (b[:2] + b[3:], b[:3] + b[4:5] + b[3:4] + b[5:], b[::-1])} - set(known))
    near = {w: get_close_matches(w, known, 1, names.CUTOFF) for w in said}
    return [(w, *((near[w][0], round(SequenceMatcher(None, w, near[w][0]).ratio(), 6)) if near[w] else (None, None))) for w in said]


@query("q16_book_fuzzy_candidates", _drawn_sql(_misheard(), "said, book, ratio", "said, book, CAST(ratio AS DOUBLE) AS ratio", "WHERE book IS NOT NULL"))
def q16(spark, sf_dir):
    x = _drawn(spark, sf_dir, [(w,) for w, _, _ in _misheard()], "said string")
    near = shipped(x.select("said").distinct()).withColumn("m", names.best_similar(sorted({b.lower() for _, b in books()}))("said")).where("m.variant is not null")
    return x.join(near, "said").select("event_id", "said", F.col("m.variant").alias("book"), F.round("m.ratio", 6).alias("ratio"))


_SPANS = "p_partkey % 50 AS utt_id, p_brand AS book, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.9 END AS score, p_partkey % 17 AS start, p_partkey % 17 + p_size % 9 + 1 AS e"


def _spans(spark, sf_dir, *more):
    x = _t(spark, sf_dir, "part")
    start = (F.col("p_partkey") % 17).cast("int")
    return x.select("p_partkey", (F.col("p_partkey") % 50).alias("utt_id"), F.col("p_brand").alias("book"), F.when(F.col("p_size") % 3 == 0, 1.0).otherwise(0.9).alias("score"), start.alias("start"), (start + F.col("p_size") % 9 + 1).cast("int").alias("end"), *more)


@query("q17_shadow_filter", f"WITH c AS (SELECT p_partkey, {_SPANS} FROM part) SELECT p_partkey FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.utt_id = c.utt_id AND s.score >= 0.999 AND c.score < 0.999 AND s.book <> c.book AND c.start <= s.start AND c.e >= s.e)")
def q17(spark, sf_dir):
    return names.shadowed_out(_spans(spark, sf_dir)).select("p_partkey")


@query("q18_family_filter", """WITH c AS (SELECT p_partkey, p_partkey % 50 AS utt_id, lower(p_type) AS family, CASE WHEN p_size % 5 = 0 THEN p_type ELSE (p_size % 5) || ' ' || p_type END AS book, p_partkey % 3 = 0 AS said, p_partkey % 101 + p_partkey / 1e6 AS score FROM part),
o AS (SELECT utt_id, family, book AS only_book FROM c WHERE said AND regexp_matches(book, '^[1-4] ') QUALIFY row_number() OVER (PARTITION BY utt_id, family ORDER BY score) = 1)
SELECT p_partkey FROM c LEFT JOIN o USING (utt_id, family) WHERE only_book IS NULL OR only_book = book""")
def q18(spark, sf_dir):
    size = (F.col("p_size") % 5).cast("string")
    book = F.when(size == "0", F.col("p_type")).otherwise(F.concat_ws(" ", size, "p_type"))
    x = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("utt_id"), book.alias("book"), F.when(F.col("p_partkey") % 3 == 0, book).otherwise(F.col("p_type")).alias("spoken"), (F.col("p_partkey") % 101 + F.col("p_partkey") / 1e6).alias("score"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    return names.family_kept(x).select("p_partkey")


@query("q19_resolver_topk", f"{_SPOKEN_SQL} SELECT utt_id, book, book || ' ' || c || ':' || v AS ref, true AS reasoned FROM u")
def q19(spark, sf_dir):
    ranked = resolve_candidates(_spoken(spark, sf_dir, lambda b, c, v, e: _say(b, c, "глава", v, "стих")), _sizes(spark))
    return ranked.where("rank = 1").select("utt_id", "book", "ref", F.array_contains("reasons", "valid_chapter_verses").alias("reasoned"))


@query("q34_range_refs", "SELECT ref AS value, count(*) AS n FROM (SELECT event_type || ' 1:' || (user_id % 40) || '-40' AS ref FROM events WHERE event_id % 11 <> 0 AND event_id % 2 = 0 AND event_id % 4 <> 0 AND user_id % 3 = 0) GROUP BY 1")
def q34(spark, sf_dir):
    return logs.counted_values(logs.parse_lines(_as_log(spark, sf_dir))).where("kind = 'range_ref'").groupBy("value").agg(F.count("*").alias("n"))


@query("q45_book_number_exclusion", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE (l_suppkey % 3 + 1) || ',' END || l_linenumber || ',' || (l_partkey % 150 + 1) AS numbers FROM lineitem")
def q45(spark, sf_dir):
    digit = (F.col("l_suppkey") % 3 + 1).cast("string")
    norm = F.concat_ws(" ", digit, F.when(F.col("l_partkey") % 2 == 0, "иоанна").otherwise("стих"), F.col("l_linenumber").cast("string"), F.lit("глава"), (F.col("l_partkey") % 150 + 1).cast("string"))
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", norm.alias("norm"), F.concat_ws(" ", digit, F.lit("Иоанна")).alias("book"))
    return x.select("l_orderkey", "l_linenumber", F.array_join(F.transform(reference_numbers(F.col("norm"), F.col("book")), lambda y: y["value"].cast("string")), ",").alias("numbers"))


_CHOICE = ["Иона", "Иоанн", "1 Иоанна", "Римлянам", "Лука"]


@query("q46_iona_adjust", f"""WITH b(i, book) AS ({_values(enumerate(_CHOICE))}), c AS (SELECT p_partkey, p_partkey // 5 AS utt_id, CASE WHEN i = 0 AND (p_partkey // 5) % 2 = 0 THEN 'Лука' ELSE book END AS book, p_size::DOUBLE AS score FROM part JOIN b ON i = p_partkey % 5),
x AS (SELECT *, utt_id % 3 <> 0 AND NOT bool_or(book = 'Иона') OVER (PARTITION BY utt_id) AS told FROM c)
SELECT p_partkey, book, CASE WHEN told AND book = 'Иоанн' THEN score + 30 WHEN told AND book = '1 Иоанна' THEN score + 6 WHEN told AND book = 'Римлянам' THEN score - 14 ELSE score END AS score,
CASE WHEN told AND book = 'Иоанн' THEN 'r,iona_invalid_john_hint' WHEN told AND book = '1 Иоанна' THEN 'r,iona_invalid_john_epistle_hint' WHEN told AND book = 'Римлянам' THEN 'r,iona_invalid_confusable_penalty' ELSE 'r' END AS reasons FROM x""")
def q46(spark, sf_dir):
    x = _t(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 5).alias("utt_id"), F.element_at(F.array(*map(F.lit, _CHOICE)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("book"), F.col("p_size").cast("double").alias("score"))
    x = x.withColumn("book", F.when((F.col("book") == "Иона") & (F.col("utt_id") % 2 == 0), "Лука").otherwise(F.col("book"))).withColumn("norm", F.when(F.col("utt_id") % 3 != 0, "иона 3 глава").otherwise("3 глава")).withColumn("reasons", F.array(F.lit("r")))
    return parse.iona_adjusted(x).select("p_partkey", "book", "score", F.array_join("reasons", ",").alias("reasons"))


_SAID = ["послание 3 глава", "евангелие от марка", "пророка исаии", "от яна 316", "просто слова", "послание от луки яна"]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("q47_context_hints", f"""WITH {_BOOKS_SQL}, s(i, norm, letter, gospel, prophet, yana) AS (VALUES (0, '', true, false, false, false), (1, '', false, true, false, false), (2, '', false, false, true, false), (3, '', false, false, false, true), (4, '', false, false, false, false), (5, '', true, true, false, true)),
x AS (SELECT event_id, book, letter, gospel, prophet, yana FROM events JOIN books ON book_no = 1 + event_id % 66 JOIN s ON i = user_id % 6),
r AS (SELECT event_id, unnest([
  CASE WHEN letter AND book IN {_in(parse.LETTERS)} THEN {{'r': 'epistle_hint', 'p': 35}} END, CASE WHEN letter AND book IN {_in(parse.GOSPELS)} THEN {{'r': 'epistle_hint_penalty', 'p': -30}} END,
  CASE WHEN gospel AND book IN {_in(parse.GOSPELS)} THEN {{'r': 'gospel_hint', 'p': 35}} END, CASE WHEN gospel AND book IN {_in(parse.LETTERS)} THEN {{'r': 'gospel_hint_penalty', 'p': -30}} END,
  CASE WHEN prophet AND book IN {_in(parse.PROPHETS)} THEN {{'r': 'prophet_hint', 'p': 25}} END, CASE WHEN prophet AND book NOT IN {_in(parse.PROPHETS)} THEN {{'r': 'prophet_hint_penalty', 'p': -10}} END,
  CASE WHEN yana AND book IN {_in(parse.JOHN_LETTERS)} THEN {{'r': 'yana_epistle_hint', 'p': 24}} END, CASE WHEN yana AND book = 'Иоанн' THEN {{'r': 'yana_gospel_hint', 'p': 10}} END, CASE WHEN yana AND book IN {_in(parse.MISHEARD_YANA)} THEN {{'r': 'yana_confusable_penalty', 'p': -12}} END
]) AS h FROM x)
SELECT x.event_id, coalesce(string_agg(h.r, ',' ORDER BY h.r), '') AS reasons, CAST(coalesce(sum(h.p), 0) AS DOUBLE) AS points FROM x LEFT JOIN r ON x.event_id = r.event_id AND h IS NOT NULL GROUP BY x.event_id""")
def q47(spark, sf_dir):
    book = F.element_at(F.array(*(F.lit(b) for _, b in books())), (F.col("event_id") % 66 + 1).cast("int"))
    norm = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("user_id") % 6 + 1).cast("int"))
    x = _t(spark, sf_dir, "events").select("event_id", parse.context_reasons(book, norm).alias("h"))
    return x.select("event_id", F.array_join(F.array_sort(F.transform("h", lambda h: h["reason"])), ",").alias("reasons"), F.aggregate("h", F.lit(0.0), lambda a, h: a + h["points"]).alias("points"))


@query("q49_cross_chapter_text", f"{_SPOKEN_SQL}, t AS (SELECT utt_id, b.book_no, c, v, e, unnest(range(0, 3)) AS k FROM u JOIN books b ON b.book = u.book WHERE c < 49 AND b.book_no NOT IN ({_ONE})), w AS (SELECT *, unnest(range(CASE WHEN k = 0 THEN v ELSE 1 END, CASE WHEN k = 2 THEN e ELSE 40 END + 1)) AS n FROM t) SELECT utt_id, md5(string_agg((c + k) || ':' || n || '. ' || book_no || '-' || (c + k) || '-' || n, ' ' ORDER BY k, n)) AS text_md5 FROM w GROUP BY utt_id")
def q49(spark, sf_dir):
    no = (F.col("event_id") % 66 + 1).cast("int")
    c, v = (F.col("user_id") % 50 + 1).cast("int"), (F.col("event_id") % 20 + 1).cast("int")
    refs = _t(spark, sf_dir, "events").select(F.col("event_id").alias("ref_id"), F.element_at(F.array(*(F.lit(b) for _, b in books())), no).alias("book"), c.alias("chapter"), v.alias("start_verse"), (v + F.col("user_id") % 5).cast("int").alias("end_verse"), (c + 2).alias("end_chapter")).where((F.col("chapter") < 49) & ~F.col("book").isin(*ONE_CHAPTER))
    return verse_texts(refs, canon.formula_verses(spark)).select(F.col("ref_id").alias("utt_id"), F.md5(F.col("verse_text").cast("binary")).alias("text_md5"))


def _parsed_events(spark, sf_dir):
    """Events as parsed references with gaps: parsed (struct), heard, and the slide made of them."""
    e, u = F.col("event_id"), F.col("user_id")
    parsed = F.struct(F.when(e % 5 != 0, F.concat(F.lit(" A "), e.cast("string"))).alias("ref"), F.when(e % 3 != 0, F.concat(F.lit("v"), u.cast("string"))).alias("verse_text"), F.lit("A").alias("book"), (u % 9).cast("int").alias("chapter"), (e % 4).cast("int").alias("start_verse"), (e % 4 + 1).cast("int").alias("end_verse"), F.lit(None).cast("int").alias("end_chapter"))
    x = _t(spark, sf_dir, "events").select("event_id", "user_id", parsed.alias("parsed"), F.when(e % 2 == 0, F.concat(F.lit("h "), u.cast("string"))).alias("heard"))
    return x.withColumn("slide", payloads.slide_payload(F.col("parsed"), F.lit("parser"), F.col("heard")))


_SLIDES = "s AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN 'A ' || event_id END AS ref, CASE WHEN event_id % 3 <> 0 THEN 'v' || user_id END AS verse, CASE WHEN event_id % 2 = 0 THEN 'h ' || user_id END AS heard FROM events)"


@query("q50_slide_payload", f"WITH {_SLIDES} SELECT event_id, ' ' || ref AS ref, verse, 'vosk:parser' AS source, heard AS asr, CASE WHEN verse IS NULL THEN ref ELSE ref || chr(10) || chr(10) || verse END AS text FROM s WHERE ref IS NOT NULL")
def q50(spark, sf_dir):
    x = _parsed_events(spark, sf_dir).where("slide is not null")
    return x.select("event_id", "slide.ref", "slide.verse", "slide.source", "slide.asr", payloads.slide_text(F.col("slide.ref"), F.col("slide.verse")).alias("text"))


@query("q51_slide_body", f"WITH {_SLIDES} SELECT event_id, json_extract_string(body, '$.slides[0].text') AS text, json_extract_string(body, '$.slides[0].theme.name') AS theme FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN json_object('slides', [json_object('text', coalesce(ref, ''), 'theme', json_object('name', 'dark'))]) ELSE json_object('slides', [json_object('text', coalesce(ref, ''))]) END AS body FROM s)")
def q51(spark, sf_dir):
    x = _parsed_events(spark, sf_dir).select("event_id", payloads.slide_body(F.col("slide.ref"), F.lit(None).cast("string"), F.when(F.col("event_id") % 4 == 0, "dark")).alias("body"))
    return x.select("event_id", F.get_json_object("body", "$.slides[0].text").alias("text"), F.get_json_object("body", "$.slides[0].theme.name").alias("theme"))


@query("q52_shown_slide", f"WITH {_SLIDES} SELECT event_id, coalesce(ref, heard, '{payloads.NO_REFERENCE}') AS ref, coalesce(verse, heard, '{payloads.NO_VERSE}') AS verse, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'live' END AS source FROM s")
def q52(spark, sf_dir):
    x = _parsed_events(spark, sf_dir)
    slide = F.struct(F.col("parsed.ref").alias("ref"), F.col("parsed.verse_text").alias("verse"), F.when(F.col("event_id") % 2 == 0, "web").alias("source"), F.col("heard").alias("asr"), F.col("heard").alias("detected_text"))
    return x.select("event_id", payloads.shown_slide(slide).alias("s")).select("event_id", "s.ref", "s.verse", "s.source")


@query("q53_payload_summary", f"WITH {_SLIDES} SELECT event_id, heard AS text, CASE WHEN ref IS NULL THEN NULL ELSE ' ' || ref END AS ref, CAST(user_id % 9 AS BIGINT) AS chapter, ref IS NOT NULL AS has_slide, CAST(event_id % 3 AS BIGINT) AS n_attempts FROM s")
def q53(spark, sf_dir):
    attempts = F.when(F.col("event_id") % 3 > 0, F.array_repeat(F.struct(F.lit("a").alias("text"), F.lit(False).alias("matched")), (F.col("event_id") % 3).cast("int")))
    payload = F.struct(F.col("heard").alias("text"), F.lit("parser").alias("source"), "parsed", "slide", F.coalesce(attempts, F.array().cast("array<struct<text: string, matched: boolean>>")).alias("attempts"))
    x = _parsed_events(spark, sf_dir).select("event_id", payloads.payload_summary(payload).alias("s"))
    return x.select("event_id", "s.text", "s.ref", F.col("s.chapter").cast("long").alias("chapter"), "s.has_slide", F.size("s.attempts").cast("long").alias("n_attempts"))


@query("q54_candidate_fields", "SELECT event_id, event_type AS ref, '' AS verse, CAST(user_id % 9 AS BIGINT) AS chapter, '' AS label FROM events")
def q54(spark, sf_dir):
    text = lambda c: F.lit(None).cast("string").alias(c)
    raw = F.struct(F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("ref"), *(((F.col("user_id") % 9).cast("int").alias(c) if c in payloads.NUMBERS else text(c)) for c in payloads.CANDIDATE[1:]))
    return _t(spark, sf_dir, "events").select("event_id", payloads.clean_candidate(raw).alias("c")).select("event_id", "c.ref", "c.verse", F.col("c.chapter").cast("long").alias("chapter"), "c.label")


@query("q55_size_class", "SELECT doc_id, CASE WHEN n > 520 THEN 'very-long' WHEN n > 230 THEN 'long' ELSE '' END AS slide, CASE WHEN n > 900 THEN 'extra-long' WHEN n > 520 THEN 'very-long' WHEN n > 260 THEN 'long' ELSE '' END AS operator, CAST(greatest(0, least(100, n - 50)) AS BIGINT) AS progress FROM (SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS n FROM documents)")
def q55(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", payloads.size_class(t).alias("slide"), payloads.size_class(t, payloads.OPERATOR_SIZES).alias("operator"), payloads.progress(F.length(payloads.filled(t)) - 50).cast("long").alias("progress"))


_TARGETS = [("auto", "auto"), ("", "auto"), (" localhost ", "http://localhost:8091"), ("box:9000/", "http://box:9000"), ("https://box/x/", "https://box/x"), ("AUTO", "AUTO")]


@query("q56_target_url", _drawn_sql(_TARGETS, "said, url"))
def q56(spark, sf_dir):
    return _drawn(spark, sf_dir, [(a,) for a, _ in _TARGETS], "said string").select("event_id", "said", payloads.target_url(F.col("said")).alias("url"))


@query("q57_target_failover", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' END AS url, event_id % 3 < 2 AS ok,
CASE WHEN event_id % 3 = 0 THEN 'id:1' WHEN event_id % 3 = 1 THEN 'id:2' WHEN user_id % 2 = 0 THEN 'a=down;b=holyrics_error:x' ELSE 'holyrics_error:x' END AS reason FROM events""")
def q57(spark, sf_dir):
    e = F.col("event_id") % 3
    tried = F.array(F.struct(F.lit("a").alias("url"), (e == 0).alias("ok"), F.when(e == 0, "id:1").otherwise("down").alias("reason")), F.struct(F.lit("b").alias("url"), (e == 1).alias("ok"), F.when(e == 1, "id:2").otherwise("holyrics_error:x").alias("reason")))
    return _t(spark, sf_dir, "events").select("event_id", payloads.sent_to(tried, F.col("user_id") % 2 == 0).alias("s")).select("event_id", "s.url", "s.ok", "s.reason")


@query("q58_share_link", f"""WITH q AS (SELECT user_id, list(event_type || ' ' || event_id ORDER BY event_id) AS refs FROM events WHERE event_id % 4 <> 0 GROUP BY user_id), t AS (SELECT user_id, '{payloads.SHARE_HEADING}' || chr(10) || list_aggregate(list_transform(refs, lambda r, i: i || '. ' || r), 'string_agg', chr(10)) AS text FROM q)
SELECT user_id, text, 'https://wa.me/?text=' || replace(url_encode(text), '%2F', '/') AS link FROM t""")
def q58(spark, sf_dir):
    refs = F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 4 != 0, F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).otherwise(" ").alias("ref")))), lambda r: r["ref"])
    x = _t(spark, sf_dir, "events").groupBy("user_id").agg(refs.alias("refs")).select("user_id", payloads.share_text(F.col("refs")).alias("text")).where("text <> ''")
    return x.withColumn("link", payloads.share_link(F.col("text")))


_REQUESTS = [("{\"a\": 1}", 200), ("[1]", 400), ("", 400), ("{broken", 400), ("  {} ", 200), ("7", 400)]


@query("q59_json_body", f"SELECT n_nationkey, CAST(status AS BIGINT) AS status FROM nation JOIN ({_values((i, c) for i, (_, c) in enumerate(_REQUESTS))}) AS t(i, status) ON n_nationkey % 6 = i")
def q59(spark, sf_dir):
    body = F.element_at(F.array(*(F.lit(b) for b, _ in _REQUESTS)), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", payloads.json_object(body)["status"].cast("long").alias("status"))


_SETTINGS = [("A=1", "A", "1"), ("  export B = \"two words\"", "B", "two words"), ("# C=3", None, None), ("", None, None), ("D='x=y'", "D", "x=y"), ("no equals", None, None), ("=v", None, None), ("E=", "E", "")]


@query("q60_settings", _drawn_sql([(n, v) for _, n, v in _SETTINGS], "name, setting", "name, setting AS value", "WHERE name IS NOT NULL"))
def q60(spark, sf_dir):
    x = _drawn(spark, sf_dir, [(t,) for t, _, _ in _SETTINGS], "line string").select("event_id", payloads.setting_line(F.col("line")).alias("s"))
    return x.where("s is not null").select("event_id", "s.name", "s.value")


@query("q61_value_range", "SELECT user_id, min(v) AS first, max(v) AS last FROM (SELECT user_id, event_id % 40 - 20 AS v FROM events) WHERE v > 0 GROUP BY user_id")
def q61(spark, sf_dir):
    x = _t(spark, sf_dir, "events").groupBy("user_id").agg(value_range(F.collect_list(F.col("event_id") % 40 - 20)).alias("w")).where("w is not null")
    return x.select("user_id", "w.first", "w.last")


@query("q62_verse_id_reasons", f"""WITH {_BOOKS_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Tobit' WHEN event_id % 9 = 1 THEN '' ELSE book END AS name, user_id % 5 AS c, event_id % 4 AS v FROM events JOIN books ON book_no = 1 + event_id % 66)
SELECT event_id, CASE WHEN b.book_no IS NOT NULL AND c > 0 AND v > 0 THEN lpad(CAST(b.book_no AS VARCHAR), 2, '0') || lpad(CAST(c AS VARCHAR), 3, '0') || lpad(CAST(v AS VARCHAR), 3, '0') END AS verse_id,
CASE WHEN b.book_no IS NULL THEN 'unknown_book:' || CASE WHEN name = '' THEN 'empty' ELSE name END WHEN c <= 0 OR v <= 0 THEN 'invalid_chapter_or_verse' ELSE '' END AS reason FROM x LEFT JOIN books b ON b.book = x.name""")
def q62(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 9 == 0, "Tobit").when(e % 9 == 1, "").otherwise(F.element_at(F.array(*(F.lit(b) for _, b in books())), (e % 66 + 1).cast("int")))
    x = _t(spark, sf_dir, "events").select("event_id", name.alias("book"), (F.col("user_id") % 5).cast("int").alias("c"), (e % 4).cast("int").alias("v"))
    x = x.join(F.broadcast(canon.books_table(spark)), "book", "left")
    return x.select("event_id", verse_id(F.col("book_no"), F.col("c"), F.col("v")).alias("verse_id"), verse_id_problem(F.col("book"), F.col("book_no"), F.col("c"), F.col("v")).alias("reason"))


_FRAGMENTS = [("Матфей 5 глава", True, False, False), ("5 глава", False, False, False), ("от Марка", False, True, False), ("Левита", False, True, False), ("книга Бытие и еще много слов", False, False, False), (" Там  же ", False, False, True), ("там же 5 стих", False, False, False), ("", False, False, False), ("Псалом 5", True, False, False)]


@query("q63_context_guards", _drawn_sql([f[1:] for f in _FRAGMENTS], "explicit, book_only, same_place"))
def q63(spark, sf_dir):
    t = F.col("text")
    return _drawn(spark, sf_dir, [f[:1] for f in _FRAGMENTS], "text string").select("event_id", sessions.likely_explicit(t).alias("explicit"), sessions.likely_book_only(t).alias("book_only"), sessions.same_place_only(t).alias("same_place"))


@query("q64_status_dedupe", "SELECT event_id FROM (SELECT event_id, event_type || user_id % 2 AS status, lag(event_type || user_id % 2) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE status IS DISTINCT FROM before")
def q64(spark, sf_dir):
    x = _t(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", (F.col("user_id") % 2).cast("string")).alias("status"))
    return sessions.without_repeats(x, "user_id", ["event_id"], ["status"]).select("event_id")


_ASKED = ["ефесянам", "бытие", "псалом", "двадцать", "четыре", "седьмой", "аввакума"]


@query("q65_grammar_diagnostics", f"WITH {_PHRASES_SQL} SELECT count(*) AS size, {', '.join(f"bool_or(phrase = '{w}') AS has_{i}" for i, w in enumerate(_ASKED))}, CAST({len(lookup.UNKNOWN_TO_RECOGNISER)} AS BIGINT) AS missing_words FROM phrases")
def q65(spark, sf_dir):
    return lookup.vocabulary_report(lookup.recogniser_phrases(spark), _ASKED)


_TOPICS = [("law", "Бытие"), ("law", "Исход"), ("gospels", "Марк"), ("gospels", "Tobit")]


@query("q66_visible_books", f"SELECT topic, book FROM ({_values(_TOPICS)}) AS t(topic, book) WHERE book <> 'Tobit'")
def q66(spark, sf_dir):
    return sessions.visible_books(spark.createDataFrame(_TOPICS, "topic string, book string"), canon.structure(canon.formula_verses(spark)))


@query("q67_log_report", """WITH e AS (SELECT event_id, user_id % 3 AS f, event_id % 2 = 0 AS parsed, event_type AS book FROM events WHERE event_id % 11 <> 0), v AS (SELECT book AS value, count(*) AS n, min({'f': f, 'e': event_id}) AS met FROM e WHERE parsed GROUP BY 1)
SELECT 'logs' AS what, '' AS value, count(DISTINCT user_id % 3) AS n, CAST(1 AS BIGINT) AS rank FROM events UNION ALL SELECT 'events', '', count(*), 1 FROM events UNION ALL SELECT 'book', value, n, row_number() OVER (ORDER BY n DESC, met, value) FROM v""")
def q67(spark, sf_dir):
    lines = _as_log(spark, sf_dir).join(_t(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file")), "line_no").select(F.col("file").alias("path"), "line_no", "line")
    return logs.summary(lines).where("what in ('logs', 'events', 'book')").select("what", "value", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"))


@query("q68_processing_status", f"""WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 13 = 0 THEN 'reset' ELSE {_ACTIONS} END AS action, 'r' || event_id AS ref, event_id % 7 <> 0 AS ok FROM events),
m AS (SELECT *, CASE WHEN action = 'submit' THEN ref WHEN ok OR action = 'reset' THEN '' END AS change FROM a),
s AS (SELECT *, nullif(last_value(change IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS slot FROM m),
o AS (SELECT *, CASE WHEN action = 'submit' THEN 'candidate' WHEN action = 'reset' THEN 'idle' WHEN slot IS NULL OR NOT ok THEN NULL WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END AS new_stage FROM s),
l AS (SELECT user_id, event_id, coalesce(last_value(new_stage IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS stage FROM o)
SELECT user_id, event_id, stage, CAST(CASE WHEN stage IN ('candidate', 'approved') THEN 100 ELSE 0 END AS BIGINT) AS progress, stage = 'rejected' AS manual_required FROM l""")
def q68(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, "reset").otherwise(F.expr(_ACTIONS)).alias("action"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("ref"), (F.col("event_id") % 7 != 0).alias("callback_ok"))
    x = sessions.processing(sessions.approvals(a))
    return x.select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), "stage", F.col("progress").cast("long").alias("progress"), "manual_required")


@query("q69_range_pick", """WITH RECURSIVE t AS (SELECT user_id, event_id % 5 + 1 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT user_id, i, v AS a, v AS z, false AS done FROM t WHERE i = 1 UNION ALL
SELECT t.user_id, t.i, CASE WHEN p.a IS NULL OR p.done THEN t.v WHEN p.a = t.v THEN NULL ELSE least(p.a, t.v) END, CASE WHEN p.a IS NULL OR p.done THEN t.v WHEN p.a = t.v THEN NULL ELSE greatest(p.a, t.v) END, NOT (p.a IS NULL OR p.done) AND p.a <> t.v FROM p JOIN t ON t.user_id = p.user_id AND t.i = p.i + 1)
SELECT user_id, CAST(a AS BIGINT) AS first, CAST(z AS BIGINT) AS last FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def q69(spark, sf_dir):
    x = sessions.picked_ranges(_t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 + 1).cast("int").alias("verse")))
    return x.select(F.col("session").alias("user_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("q70_publish_route", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'approval:popup' ELSE 'approval:web' END WHEN user_id % 5 = 0 THEN 'slides' WHEN user_id % 5 = 1 THEN 'web' WHEN user_id % 5 = 2 THEN 'slides,web' ELSE '' END AS sinks FROM events")
def q70(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    output = F.when(u % 5 == 0, "slides").when(u % 5 == 1, "web").when(u % 5 == 2, "both").otherwise("none")
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(sessions.route(e % 4 != 0, e % 3 == 0, F.when(u % 2 == 0, "popup").otherwise("web"), output), ",").alias("sinks"))


@query("q71_book_id_names", f"WITH {_BOOKS_SQL} SELECT p_partkey, CASE WHEN b.book IS NOT NULL THEN b.book WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_partkey % 90 AS VARCHAR) END AS book FROM part LEFT JOIN books b ON b.book_no = p_partkey % 90")
def q71(spark, sf_dir):
    x = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 90).cast("int").alias("book_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("file_name"), F.lit("").alias("book"))
    return canon.named_by_id(x).select("p_partkey", "book")


@query("q72_live_context", f"""WITH {_BOOKS_SQL}, e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 1 + event_id % 20 AS v, CASE WHEN book_no IN ({_ONE}) THEN 1 ELSE 1 + event_id % 50 END AS c, book FROM events JOIN books ON book_no = 1 + user_id % 66),
x AS (SELECT *, CASE WHEN i % 3 = 1 THEN book END AS said, CASE WHEN i % 3 = 1 THEN c END AS said_c FROM e),
l AS (SELECT *, last_value(said IGNORE NULLS) OVER w AS b, last_value(said_c IGNORE NULLS) OVER w AS lc FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, b || ' ' || lc || ':' || v AS ref, false AS blocked FROM l""")
def q72(spark, sf_dir):
    e = F.col("event_id")
    no = (F.col("user_id") % 66 + 1).cast("int")
    book = F.element_at(F.array(*(F.lit(b) for _, b in books())), no)
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    c = F.when(book.isin(*ONE_CHAPTER), 1).otherwise(e % 50 + 1).cast("string")
    v = (e % 20 + 1).cast("string")
    text = F.when(F.col("i") % 3 == 1, _say(book, c, "глава", v, "стих")).otherwise(_say("и там же", v, "стих"))
    fragments = _t(spark, sf_dir, "events").withColumn("i", i).select(F.col("user_id").cast("string").alias("session"), e.alias("seq"), text.alias("text"))
    return session_references(fragments, _sizes(spark)).select("session", "seq", "ref", "blocked")


@query("q73_alias_overlay", f"SELECT alias, book FROM ({_values(spoken_names())}) AS t(alias, book) UNION ALL SELECT 'марочка', 'Марк' UNION ALL SELECT 'лукич', 'Лука'")
def q73(spark, sf_dir):
    more = spark.createDataFrame([("Марочка", "Марк"), ("лукич", "Лука"), ("марк", "Марк"), ("x", "Tobit")], "alias string, book string")
    return overlaid(spark, more)


#: Words as they may be heard: number words cut short or run together, digits, and others.
_GARBLED = ["двад", "трид", "сор", "пят", "чет", "перв", "детри", "7", "3", "двадца", "не", "восьм", "слово"]
_NUMBERS_SQL = f"""number_word(word, value) AS ({_values(sorted(number_words().items()))}), hint(word, value) AS ({_values((w, v) for w, vs in readings.NUMBER_HINTS.items() for v in vs)}),
heard(k, token) AS ({_values(enumerate(_GARBLED))}),
meant AS (SELECT k, value FROM heard JOIN number_word ON length(token) >= 3 AND (starts_with(word, token) OR starts_with(token, word)) UNION SELECT k, value FROM heard JOIN hint ON length(token) >= 2 AND (starts_with(word, token) OR starts_with(token, word)) UNION SELECT k, value FROM heard JOIN number_word ON word = token UNION SELECT k, CAST(token AS INT) FROM heard WHERE regexp_matches(token, '^[0-9]+$'))"""


def _heard_sql(places: str) -> str:
    """The lattice over words of events, as SQL: r(event_id, place, value, next). ``places``: SELECT event_id, place, k."""
    return f"""WITH {_NUMBERS_SQL}, w AS ({places}),
v AS (SELECT event_id, place, value FROM w JOIN meant USING (k) WHERE value BETWEEN 1 AND 150),
r AS (SELECT event_id, place, value, place + 1 AS next FROM v UNION SELECT a.event_id, a.place, CASE WHEN a.value < 10 THEN 10 * a.value ELSE a.value END + b.value, a.place + 2
      FROM v a JOIN v b ON a.event_id = b.event_id AND b.place = a.place + 1 WHERE b.value BETWEEN 1 AND 9 AND (a.value IN (20, 30, 40, 50) OR a.value BETWEEN 2 AND 5))"""


_DEALT = [f"event_id // {13**i} % 13" for i in range(3)] + ["user_id % 13"]


def _garbled(k: int) -> Column:
    """A heard word of an event."""
    return F.element_at(F.array(*map(F.lit, _GARBLED)), (F.expr(_DEALT[k].replace("//", "div")) + 1).cast("int"))


def _listed(pairs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["first"].cast("string"), F.lit("-"), p["last"].cast("string")))), ",")


@query("q74_fuzzy_readings", _heard_sql(" UNION ALL ".join(f"SELECT event_id, {i} AS place, {_DEALT[i]} AS k FROM events" for i in range(2))) + " SELECT event_id, coalesce(string_agg(value || '@' || next, ',' ORDER BY next, value), '') AS readings FROM (SELECT DISTINCT event_id FROM events) LEFT JOIN (SELECT * FROM r WHERE place = 0) USING (event_id) GROUP BY event_id")
def q74(spark, sf_dir):
    lattice = readings.phrase_readings(readings.token_values(F.array(_garbled(0), _garbled(1))))
    order = F.array_sort(F.transform(F.get(lattice, 0), lambda r: F.struct(r["next"].alias("n"), r["value"].alias("v"))))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(order, lambda r: F.concat(r["v"].cast("string"), F.lit("@"), r["n"].cast("string"))), ",").alias("readings"))


@query("q75_fuzzy_range", _heard_sql(" UNION ALL ".join(f"SELECT event_id, {i} AS place, {_DEALT[i]} AS k FROM events" for i in range(4))) + """,
p AS (SELECT DISTINCT a.event_id, a.value AS first, b.value AS last FROM r a JOIN r b ON b.event_id = a.event_id AND b.place = a.next AND b.next = 4 LEFT JOIN w ON w.event_id = a.event_id AND w.place = a.place - 1
      WHERE a.next < 4 AND (w.k IS NULL OR w.k <> 10) AND NOT EXISTS (SELECT 1 FROM r o WHERE o.event_id = a.event_id AND o.place = a.place - 1 AND o.next = a.next AND o.value > a.value)),
c AS (SELECT DISTINCT event_id, first, CASE WHEN last < 10 AND first >= 10 AND first // 10 * 10 + last BETWEEN first + 1 AND 40 THEN first // 10 * 10 + last ELSE last END AS last FROM p)
SELECT event_id, string_agg(first || '-' || last, ',' ORDER BY first || '-' || last) AS ranges FROM c WHERE first < last AND last <= 40 GROUP BY event_id""")
def q75(spark, sf_dir):
    tokens = F.array(*(_garbled(i) for i in range(4)), F.lit("стих"))
    x = _t(spark, sf_dir, "events").select("event_id", tokens.alias("w")).withColumn("lattice", readings.phrase_readings(readings.token_values(F.col("w"))))
    x = x.select("event_id", _listed(readings.carried(readings.ranges_before_verse(F.col("w"), F.col("lattice")), F.lit(40))).alias("ranges"))
    return x.where("ranges <> ''")


@query("q76_through_range", _heard_sql("SELECT event_id, 0 AS place, " + _DEALT[0] + " AS k FROM events UNION ALL SELECT event_id, 1, " + _DEALT[1] + " FROM events UNION ALL SELECT event_id, 3, " + _DEALT[2] + " FROM events UNION ALL SELECT event_id, 4, " + _DEALT[3] + " FROM events") + """,
p AS (SELECT DISTINCT a.event_id, a.value AS first, b.value AS last FROM r a JOIN r b ON b.event_id = a.event_id AND b.place = 3 JOIN events e ON e.event_id = a.event_id WHERE a.next = 2 AND b.next = 5 OR a.next = 2 AND b.next = 5 - e.user_id % 2 AND e.user_id % 2 = 0)
SELECT event_id, string_agg(first || '-' || last, ',' ORDER BY first || '-' || last) AS ranges FROM p WHERE first < last AND last <= 40 GROUP BY event_id""")
def q76(spark, sf_dir):
    end = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("стих"))).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(F.array(_garbled(0), _garbled(1), F.lit("по"), _garbled(2), _garbled(3)), end)
    ranges = lambda x: x.withColumn("lattice", readings.phrase_readings(readings.token_values(F.col("w")))).select("utt_id", _listed(readings.rising(readings.ranges_around_through(F.col("w"), F.col("lattice")), F.lit(40))).alias("ranges")).where("ranges <> ''")
    return once_per(_t(spark, sf_dir, "events").select("event_id", tokens.alias("w")), ["w"], ranges, Held(spark))


_NEAR_SQL = "1 + event_id % 50 AS c, 1 + user_id % 35 AS v, 1 + user_id % 35 + event_id % 6 AS e, event_id % 7 AS kind"


@query("q77_keyword_inference", f"""WITH x AS (SELECT event_id, {_NEAR_SQL} FROM events)
SELECT event_id, CAST(CASE kind WHEN 2 THEN v WHEN 5 THEN e ELSE c END AS BIGINT) AS chapter, CAST(CASE kind WHEN 2 THEN 1 ELSE v END AS BIGINT) AS first,
CAST(CASE kind WHEN 0 THEN e WHEN 1 THEN CASE WHEN e + 10 <= 40 THEN e + 10 ELSE v END WHEN 2 THEN 1 WHEN 6 THEN e ELSE v END AS BIGINT) AS last,
CASE WHEN kind = 2 THEN 2 WHEN kind IN (3, 5) THEN 3 ELSE 1 END AS kind FROM x WHERE kind <> 4""")
def q77(spark, sf_dir):
    x = _t(spark, sf_dir, "events").select("event_id", *(F.expr(p) for p in _NEAR_SQL.split(", ")))
    c, v, e, far = F.col("c").cast("string"), F.col("v").cast("string"), F.col("e").cast("string"), (F.col("e") + 10).cast("string")
    said = F.element_at(F.array(
        _say("с", v, "по", e, "стих слово", c, "глава"), _say(c, "глава слово", v, "и", far, "стих"), _say("стих", v, "слово"), _say(c, "по", v), _say("стих 0 и еще 0 стих", c, "глава"),
        _say(e, "и", v, "слово 200 глава"), _say("стих", e, "и", v, "стих слово", c, "глава"),
    ), (F.col("kind") + 1).cast("int"))
    sizes = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.struct(i, F.lit(40))))
    guessed = lambda x: x.withColumn("sizes", sizes).select("utt_id", readings.inferred(F.col("norm"), F.lit("Псалтирь"), reference_numbers(F.col("norm"), F.lit("Псалтирь")), F.col("sizes")).alias("y")).where("y is not null")
    found = once_per(x.select("event_id", said.alias("norm")), ["norm"], guessed, Held(spark))
    return found.select("event_id", *(F.col(f"y.{n}").cast("long").alias(n) for n in ("chapter", "first", "last")), "y.kind")


@query("q78_best_of_book", f"""{_SPOKEN_SQL} SELECT utt_id, CAST(c AS BIGINT) AS chapter, CAST(v AS BIGINT) AS start_verse, CAST(CASE WHEN utt_id % 3 = 0 THEN v ELSE e END AS BIGINT) AS end_verse,
CAST(CASE WHEN utt_id % 3 = 0 THEN 1 ELSE e - v + 1 END AS BIGINT) AS n_verses FROM u WHERE utt_id % 3 < 2 OR e > v""")
def q78(spark, sf_dir):
    kind = F.col("event_id") % 3
    said = _spoken(spark, sf_dir, lambda b, c, v, e: F.when(kind == 0, _say(c, "глава", v, "стих и", c, "глава", v, "по", e, "стих")).when(kind == 1, _say(c, "глава слово с", v, "по", e, "стих")).when(v != e, _say(c, "глава", v, "по", v, "стих и", c, "глава", v, "по", e, "стих")))
    book = F.element_at(F.array(*(F.lit(b) for _, b in books())), (F.col("utt_id") % 66 + 1).cast("int"))
    found = best_in_book(said.where("text is not null").select("utt_id", F.col("text").alias("norm"), book.alias("book")), _sizes(spark))
    return found.select("utt_id", F.col("c").cast("long").alias("chapter"), F.col("v").cast("long").alias("start_verse"), F.col("e").cast("long").alias("end_verse"), F.col("n_verses").cast("long").alias("n_verses"))


@query("q79_heavy_hitters", """WITH w AS (SELECT lang AS kind, unnest(string_split(text, ' ')) AS value, doc_id FROM documents)
SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min(doc_id), value) AS rank FROM w WHERE value <> '' GROUP BY kind, value QUALIFY rank <= 30""")
def q79(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.explode(F.split("text", " ")).alias("value"), F.lit("").alias("path"), F.col("doc_id").alias("line_no")).where("value <> ''")
    return logs.heavy_hitters(words).select("kind", "value", "n", F.col("rank").cast("long").alias("rank"))


def _wide_log(spark, sf_dir):
    """A log a user of events, with fields of its own: a model in session events, and chunk or conf in others."""
    e = F.col("event_id")
    kind = F.when(e % 7 == 0, "session").otherwise("final_raw")
    line = F.to_json(F.struct(F.concat(F.lit("t"), (e + 10_000_000).cast("string")).alias("ts"), kind.alias("event"), F.when(e % 7 == 0, F.concat(F.lit("m"), (e % 5).cast("string"))).alias("model"), F.when(e % 3 == 1, e).alias("chunk"), F.when(e % 3 == 2, F.array(F.lit(True), F.lit(False))).alias("conf")))
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), e.alias("line_no"), F.when(e % 11 == 0, F.substring(line, 1, 15)).otherwise(line).alias("line"))


@query("q80_log_other_fields", """WITH e AS (SELECT event_id AS e, event_id % 7 = 0 AS s FROM events WHERE event_id % 11 <> 0), f AS (SELECT s, 'model' AS field, 'STRING' AS type FROM e WHERE s UNION ALL SELECT s, 'chunk', 'BIGINT' FROM e WHERE e % 3 = 1 UNION ALL SELECT s, 'conf', 'ARRAY<BOOLEAN>' FROM e WHERE e % 3 = 2)
SELECT CASE WHEN s THEN 'session' ELSE 'final_raw' END AS event, field, type, count(*) AS n FROM f GROUP BY ALL""")
def q80(spark, sf_dir):
    return logs.other_fields(logs.log_bodies(_wide_log(spark, sf_dir))).groupBy("event", "field", "type").agg(F.count("*").alias("n"))


@query("q81_session_files", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS e, event_id % 11 = 0 AS bad, event_id % 7 = 0 AND event_id % 11 <> 0 AS s FROM events)
SELECT path, 't' || min(e + 10000000) FILTER (NOT bad) AS began, 't' || max(e + 10000000) FILTER (NOT bad) AS ended, count(*) AS events, count(*) FILTER (bad) AS invalid,
coalesce(arg_max('{' || CASE e % 3 WHEN 1 THEN '"chunk":' || e || ',' WHEN 2 THEN '"conf":[true,false],' ELSE '' END || '"model":"m' || (e % 5) || '"}', e) FILTER (s), '{}') AS settings FROM e GROUP BY path""")
def q81(spark, sf_dir):
    return logs.session_files(_wide_log(spark, sf_dir))


@query("q82_manual_override", f"""WITH {_BOOKS_SQL}, a AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'submit' WHEN 1 THEN 'manual' WHEN 2 THEN 'approve' ELSE 'manual' END AS action, CASE WHEN event_id % 8 = 3 THEN NULL WHEN event_id % 4 = 0 THEN 'r' || event_id ELSE book || ' 1:' || (1 + event_id % 20) END AS ref, event_id % 7 <> 0 AS ok,
CASE event_id % 4 WHEN 0 THEN 'heard ' || event_id END AS heard, CASE WHEN event_id % 8 = 3 THEN 'просто слова' ELSE book || ' 1 глава ' || (1 + event_id % 20) || ' стих' END AS said FROM events JOIN books ON book_no = 1 + event_id % 66),
m AS (SELECT *, CASE WHEN action = 'submit' OR action = 'manual' THEN ref WHEN ok THEN '' END AS change, CASE WHEN action = 'submit' THEN heard WHEN action = 'approve' AND ok THEN '' END AS hears FROM a),
s AS (SELECT *, nullif(last_value(change IGNORE NULLS) OVER w, '') AS slot, coalesce(last_value(hears IGNORE NULLS) OVER w, '') AS held FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, action, CASE WHEN action = 'approve' THEN slot ELSE ref END AS ref, CASE WHEN action = 'approve' THEN CASE WHEN slot IS NULL THEN 'no_pending_candidate' WHEN NOT ok THEN 'callback_failed' ELSE 'approved' END WHEN ref IS NULL THEN 'reference_not_found' ELSE 'pending' END AS outcome,
CASE WHEN action = 'manual' AND ref IS NOT NULL THEN 'operator:manual' END AS source, CASE WHEN action = 'submit' THEN heard WHEN action = 'manual' AND ref IS NOT NULL THEN held END AS asr, CASE WHEN action = 'manual' AND ref IS NOT NULL THEN said END AS detected_text FROM s""")
def q82(spark, sf_dir):
    e = F.col("event_id")
    book = F.element_at(F.array(*(F.lit(b) for _, b in books())), (e % 66 + 1).cast("int"))
    said = F.when(e % 8 == 3, "просто слова").otherwise(_say(book, "1 глава", (e % 20 + 1).cast("string"), "стих"))
    action = F.when(e % 4 == 0, "submit").when(e % 4 == 2, "approve").otherwise("manual")
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), e.alias("seq"), action.alias("action"), F.when(e % 4 == 0, F.concat(F.lit("r"), e.cast("string"))).alias("ref"), (e % 7 != 0).alias("callback_ok"), F.when(action == "manual", said).alias("text"), F.when(e % 4 == 0, F.concat(F.lit("heard "), e.cast("string"))).alias("asr"))
    return overridden(a, _sizes(spark)).withColumnsRenamed({"session": "user_id", "seq": "event_id"})


@query("q83_similar_complete")
def q83(spark, sf_dir):
    q = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), normalize_quote(F.col("text")).alias("q"))
    lines = _line_verses(spark, sf_dir).select((F.col("chapter") * 100000 + F.col("verse")).alias("window_id"), normalize_quote(F.col("text")).alias("norm"))
    return likeness.similar_all(q, lines, 80.0)
