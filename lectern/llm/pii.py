"""Surrogates for personal data, in DataFrame functions only.

Detected entities get replacements of the same type and format: letters become letters of the same case and script,
digits digits, card numbers keep their issuer digit and their Luhn validity, given names stay given names of the same
gender. A replacement follows from a secret key, the entity's type and its canonical form, so that all mentions of an
entity agree wherever they stand, without shuffling texts. Where a text names a person, the words of that name are replaced
wherever else they stand in it.

Names are found behind forms of address, by given names of a list, and by their shape (two capitalised words that differ)
beside words that introduce or follow a person. The distinct entities alone are aggregated to check that no two share a
surrogate and that no surrogate is another entity; those that clash get another attempt, until none do. Where a form has too
few values for that, later attempts lengthen the surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

#: Given names by gender and script, for detection and as replacements.
GIVEN_NAMES = {
    ("female", "latin"): "Alice Amelia Andrea Anna Barbara Camille Carmen Caroline Charlotte Claire Clara Diana Elena Elizabeth Emily Emma Eva Francesca Greta Hannah Helen Ingrid Isabel Jane Jennifer Julia Karen Katharina Laura Linda Lucia Margaret Maria Marie Marta Mary Monika Nancy Nicole Olivia Patricia Paula Petra Rachel Rosa Ruth Sarah Silvia Sofia Susan Teresa Ursula Victoria".split(),
    ("male", "latin"): "Adam Albert Alexander Andreas Antonio Bernard Carlos Charles Christian Daniel David Diego Edward Felix Fernando Francois Frank Friedrich George Hans Henry Hugo Jack Jacques James Javier Jean John Jorge Jose Joseph Juan Karl Klaus Louis Luis Manuel Mark Martin Matthew Michael Miguel Nicolas Oliver Pablo Patrick Paul Pedro Peter Pierre Richard Robert Stefan Thomas Walter William Wolfgang".split(),
    ("female", "cyrillic"): "Анна Вера Галина Дарья Екатерина Елена Ирина Ксения Лариса Людмила Марина Мария Наталья Нина Ольга Полина Светлана Софья Татьяна Юлия".split(),
    ("male", "cyrillic"): "Александр Алексей Андрей Антон Борис Василий Виктор Владимир Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Сергей".split(),
}
#: Forms of address before a name, by gender.
TITLES = {"female": "Mrs Ms Miss Frau Señora Señorita Sra Srta Madame Mademoiselle Mme Mlle госпожа".split(), "male": "Mr Herr Señor Sr Monsieur господин".split(), "any": "Dr Prof".split()}
#: Syllables that surnames are made of.
SYLLABLES = {"latin": "ba bel bor da del dor fa fen gar gol hal hen ka kel kor la len lor ma mel mor na nel nor pa per ra ren ros sa sel sor ta tel tor va ven vor wal wen".split(), "cyrillic": "ба бел бор ва вер вол га гор да дон жа зар ка ким кор ла лев лис ма мир мор на нев ра род рос са сев сол та тих тор ча чер ша шум".split()}

#: Words before and behind a name that show that it is one, where it is known by its shape alone.
BEFORE = "by from to with dear contact regards, sincerely, signed von Liebe Lieber Hallo Cher Chère Querido Querida Estimado Estimada".split()
BEHIND = "wrote writes said says told asked replied answered called lives works schrieb sagte wohnt écrit dit habite escribió dijo vive".split()
#: Words that often begin a sentence before a name.
STARTS = "The Then Later When While After Before But And So Yet Now Today Yesterday Tomorrow Here There Once If As Since Because Although However Meanwhile Still Only Even Also That This Dann Später Als Aber Und Heute Gestern Doch Puis Alors Mais Quand Hier Luego Entonces Pero Cuando Ayer Hoy Le La Les Der Die Das El Los Las".split()
#: Words that begin, and words that end, names of places, bodies and offices that have the shape of a person's.
PLACES = "New San Santa Red United Prime North South East West Northern Southern Eastern Western Great Central National International Royal White Black Foreign Supreme European American British French German Spanish Russian World Grand Upper Lower Old Big".split()
BODIES = "York Angeles City Cross Nations States Kingdom Union Minister President Secretary Council Court House Bank University College School Institute Company Corporation Party Times Post Street River Lake Valley Island Islands Republic Ocean Sea Airport Station Hospital Church Museum Department Ministry Agency Association League Club".split()
#: What streets are called, behind and before their names.
STREETS = "Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Court Way".split()
ROADS = "rue avenue boulevard Calle Avenida Plaza Rue Avenue Boulevard".split()

_ALL_GIVEN = "|".join(n for names in GIVEN_NAMES.values() for n in names)
_ALL_TITLES = "|".join(t for titles in TITLES.values() for t in titles)
_NAME = r"\p{Lu}[\p{L}'-]+"
_SHAPE = lambda n: rf"(?!(?:{'|'.join(STARTS + PLACES)})(?!\p{{L}}))(?<w{n}>\p{{Lu}}\p{{Ll}}+) (?!(?:\k<w{n}>|{'|'.join(BODIES)})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
_LABEL = r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
#: What tokens of known services begin with, and a user's name and password in a URL.
_TOKEN = r"(?:sk-(?:[a-z]{2,8}-)?|gh[pousr]_|xox[abprs]-)"
_LOGIN = r"://[^\s/:@?#]{1,64}:[^\s/:@?#]{1,128}@"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
_KEY_EDGE = lambda word: rf"-----{word} (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY-----"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "KEY": _KEY_EDGE("BEGIN") + r"[^-]++" + _KEY_EDGE("END"),
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "SECRET": rf"\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b|(?<![0-9A-Za-z]){_TOKEN}[0-9A-Za-z]{{20,}}(?![0-9A-Za-z])|{_LOGIN}|(?i:{_LABEL})[\"']?[^\s\"']{{6,}}[\"']?|(?<![0-9A-Za-z])[0-9a-f]{{40}}(?![0-9A-Za-z])",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b(?=\W|$)(?<=\d[ 0-9A-Z]{0,8})",
    "IPV6": rf"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?=[0-9A-Fa-f:]*\d)(?=[0-9:]*[A-Fa-f]|(?:[0-9A-Fa-f]*:){{3}}|\d{{4}}:){_GROUPS}::(?:{_GROUPS})?|::(?=[0-9A-Fa-f:]*\d){_GROUPS})(?![0-9A-Za-z:])",
    "IP": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?![\d-])",
    "PHONE": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ADDRESS": rf"(?<![\p{{L}}\d])(?:\d{{1,5}}[A-Za-z]? (?:{_NAME} ){{1,3}}(?:{'|'.join(STREETS)})\b|\d{{1,5}},? (?:{'|'.join(ROADS)}) (?:(?:de|du|des|la|del|l'|los|las) ?){{0,2}}{_NAME}|(?:{'|'.join(ROADS)}) (?:(?:de|du|des|la|del|los|las) ){{0,2}}{_NAME},? \d{{1,5}}|\p{{Lu}}[\p{{L}}-]*(?:straße|strasse|gasse|allee|platz|weg) \d{{1,5}}[a-z]?)(?![\p{{L}}\d])",
    "NAME": rf"(?<!\p{{L}})(?=\p{{Lu}}|гос)(?:(?:{_ALL_TITLES})\.? (?:{_NAME})(?: {_NAME}){{0,2}}|(?:{_ALL_GIVEN}) {_NAME}|(?<=(?<!\p{{L}})(?:{'|'.join(w + '|' + w.capitalize() for w in BEFORE)}) ){_SHAPE(1)}|{_SHAPE(2)}(?= (?:{'|'.join(BEHIND)})(?!\p{{L}})))(?!\p{{L}})",
}
#: What of an address stays: what kind of street it is.
_STREET = rf"(?<!\p{{L}})(?:{'|'.join(ROADS)}) (?:(?:de|du|des|la|del|los|las) ){{0,2}}|(?:straße|strasse|gasse|allee|platz|weg)(?= \d)|(?<= )(?:{'|'.join(STREETS)})(?!\p{{L}})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Attempts at the entity's own length; each later one adds a character (a syllable to names) where the format allows.
SAME_LENGTH_ATTEMPTS = 6
#: The same for given names, as the list that they come from is short.
LISTED_ATTEMPTS = 2
#: Kinds of entities that may get longer by a character; the others but names have 10^9 forms at least, and are drawn again
#: at their length.
GROWING = ("EMAIL", "SECRET", "KEY", "ADDRESS", "PHONE")


def _may_match(body: Column) -> Column:
    """A quick test that every text with a match of ANY passes: each pattern needs a digit, one of these words or a name."""
    low = F.lower(body)
    words = [low.contains(w) for w in ("@", "passw", "pwd", "secret", "token", "key", "akia", "asia", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")]
    hexed = r"(?<![0-9A-Za-z])(?=[0-9a-f])[0-9a-f]{40}|::"
    found = body.rlike("[0-9]") | body.rlike(hexed) | body.rlike(PATTERNS["NAME"])
    for w in words:
        found = w | found
    return found


def _type_of(match: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("NAME"))


def _parts(match: Column) -> Column:
    """Array of (kind, text) that the match falls into: names by word with their gender, else an entity with what is left as it
    is around it (kind ""). A number like a card's without a Luhn sum is none."""
    found = _type_of(match)
    kind = F.when((found == "CARD") & (_luhn_sum(F.regexp_replace(match, r"\D", "")) % 10 != 0), "").otherwise(found)
    gender = F.when(match.rlike(rf"^(?:{'|'.join(TITLES['female'])})\b"), "female").when(match.rlike(rf"^(?:{'|'.join(TITLES['male'])})\b"), "male")
    for (sex, _), names in GIVEN_NAMES.items():
        gender = F.coalesce(gender, F.when(F.arrays_overlap(F.split(match, " "), F.split(F.lit(" ".join(names)), " ")), sex))

    def word(x: Column, i: Column) -> Column:
        own = F.lit(None).cast("string")
        for (sex, script), names in GIVEN_NAMES.items():
            own = F.when(x.isin(names), F.lit(f"GIVEN-{sex}-{script}")).otherwise(own)
        script = F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        title = x.rlike(rf"^(?:{_ALL_TITLES})\.?$") & (i == 0)
        # The first of two words without a form of address is a given name, though not one of the list.
        unlisted = F.when((i == 0) & match.contains(" "), F.concat(F.lit("GIVEN-any-"), script))
        return F.struct(F.when(title, F.lit("")).otherwise(F.coalesce(own, unlisted, F.concat(F.lit("SURNAME-"), F.coalesce(gender, F.lit("any")), F.lit("-"), script))).alias("kind"), x.alias("text"))

    gap = F.struct(F.lit("").alias("kind"), F.lit(" ").alias("text"))
    named = F.slice(F.flatten(F.transform(F.transform(F.split(match, " "), word), lambda x: F.array(gap, x))), F.lit(2), F.length(match))
    lead = F.when(kind == "KEY", F.regexp_extract(match, "^" + _KEY_EDGE("BEGIN"), 0)).when(kind == "SECRET", F.regexp_extract(match, rf"^((?i:{_LABEL})|AKIA|ASIA|{_TOKEN}|://)", 1)).otherwise("")
    tail = F.when(kind == "KEY", F.regexp_extract(match, _KEY_EDGE("END") + "$", 0)).otherwise("")
    rest = F.substring(match, F.length(lead) + 1, F.length(match) - F.length(lead) - F.length(tail))
    plain = lambda x: F.struct(F.lit("").alias("kind"), x.alias("text"))
    single = F.filter(F.array(plain(lead), F.struct(kind.alias("kind"), rest.alias("text")), plain(tail)), lambda p: p["text"] != "")
    return F.when(kind == "NAME", named).otherwise(single)


def _with_names(gap: Column, names: Column) -> Column:
    """Array of (kind, text) that text beside matches falls into: words of the ``names`` (kind, text) found in the text are
    mentions, if capitalised."""
    known = F.transform(names, lambda p: F.lower(p["text"]))
    tokens = F.regexp_extract_all(gap, F.lit(r"\p{L}+(?:[-']\p{L}{2,})*|[^\p{L}]+"), F.lit(0))

    def token(x: Column) -> Column:
        at = F.array_position(known, F.lower(x))
        kind = F.when((at > 0) & x.rlike(r"^\p{Lu}"), F.try_element_at(names, at.cast("int"))["kind"])
        return F.struct(F.coalesce(kind, F.lit("")).alias("kind"), x.alias("text"))

    return F.transform(tokens, token)


def canonical(kind: Column, text: Column) -> Column:
    """What all mentions of an entity have in common: case of addresses and names, spacing of numbers."""
    return (
        F.when(kind.isin("EMAIL", "IPV6"), F.lower(text))
        .when(kind.isin("PHONE", "CARD", "SSN"), F.regexp_replace(text, r"\D", ""))
        .when(kind == "IBAN", F.regexp_replace(text, " ", ""))
        .when(kind.startswith("SURNAME") | kind.startswith("GIVEN"), F.lower(text))
        .otherwise(text)
    )


def _space(kind: Column) -> Column:
    """Kinds between which surrogates must not clash; names by script, as gender is only how one is mentioned."""
    by_script = lambda name: F.concat(F.lit(name + "-"), F.element_at(F.split(kind, "-"), -1))
    return F.when(kind.startswith("SURNAME"), by_script("SURNAME")).when(kind.startswith("GIVEN"), by_script("GIVEN")).otherwise(kind)


BLOCKS = 4


def _style(text: Column) -> Column:
    """How a text is scrambled: as hex digits, as symbols where it has neither letters nor digits, or else by class."""
    hexed = text.rlike("^[\"']?(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}[\"']?$")
    return F.when(hexed, "hex").when(~text.rlike(r"[\p{L}\p{N}]"), "symbols").otherwise("")


def _scrambled(text: Column, numbers: Column, style: Column, spaced: Column) -> Column:
    """Text with each letter and digit replaced by one of its class. Where the text is ``spaced``, numbers are used up by
    letters and digits alone, so that spacing doesn't matter."""
    sets = F.array(*map(F.lit, ("0123456789abcdef", "0123456789", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "_%+-.")))

    def one(c: Column, i: Column) -> Column:
        which = F.when((style == "hex") & c.rlike("[0-9a-f]"), 1).when(c.rlike(r"\p{N}"), 2).when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), 3).otherwise(4)).when(c.rlike(r"\p{Lu}"), 5).when(c.rlike(r"\p{L}"), 6).when((style == "symbols") & ~c.isin("'", '"'), 7)
        return F.struct(c.alias("c"), F.element_at(sets, which).alias("set"))

    def drawn(x: Column, i: Column) -> Column:
        n = F.when(spaced, F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", ""))).otherwise(i)
        return F.coalesce(F.substring(x["set"], F.element_at(numbers, n % (32 * BLOCKS) + 1) % F.length(x["set"]) + 1, F.lit(1)), x["c"])

    return F.array_join(F.transform(F.transform(_chars(text), one), drawn), "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit in the place of the check digit."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c > "4", 9).otherwise(0))
    return F.aggregate(F.transform(_chars(F.reverse(digits)), doubled), F.lit(0), lambda a, x: a + x)


def _respaced(digits: Column, like: Column) -> Column:
    """The digits in the places of those of ``like``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(_chars(like), lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _numbers(seed: Column) -> Column:
    """The 16-bit numbers that follow from a seed: four hex digits each of BLOCKS SHA-512 digests."""
    digest = F.concat(*(F.sha2(F.concat_ws("|", seed, F.lit(str(i))), 512) for i in range(BLOCKS)))
    return F.transform(F.regexp_extract_all(digest, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def surrogates(parts: Column, key: str) -> Column:
    """Replacements, in order, of an array of (kind, text, attempt); those of kind "" stay.

    The steps are arrays of structs that hold what the next one needs, as functions of arrays compute a repeated
    expression again.
    """

    def seeded(p: Column) -> Column:
        kind, text = p["kind"], p["text"]
        canon = canonical(kind, text)
        lead = F.when(kind == "PHONE", F.regexp_extract(text, r"^(\+\d{1,3})(?=[ .(-])", 1)).when(kind == "IBAN", F.substring(text, 1, 2)).otherwise("")
        body = F.when(kind == "IPV6", F.lower(text)).when(kind == "EMAIL", F.lower(F.substring_index(text, "@", 1))).when(kind == "CARD", F.regexp_replace(text, r"\D", "")).otherwise(F.substring(text, F.length(lead) + 1, F.length(text)))
        host = F.when(kind == "EMAIL", F.sha2(F.concat_ws("|", F.lit(key), F.lit("HOST"), F.substring_index(canon, "@", -1)), 256))
        more = F.greatest(p["attempt"] - F.when(kind.startswith("GIVEN"), LISTED_ATTEMPTS - 1).otherwise(SAME_LENGTH_ATTEMPTS - 1), F.lit(0))
        quote = F.regexp_extract(body, "[\"']$", 0)
        longer = F.concat(F.substring(body, F.lit(1), F.length(body) - F.length(quote)), F.repeat(F.when(kind == "PHONE", "0").otherwise("a"), more), quote)
        grown = F.when(kind.isin(*GROWING) & (more > 0), longer).otherwise(body)
        return F.struct(kind.alias("kind"), text.alias("text"), lead.alias("lead"), grown.alias("body"), F.when(kind == "IPV6", "hex").otherwise(_style(body)).alias("style"), more.alias("more"), _numbers(F.concat_ws("|", F.lit(key), _space(kind), canon, p["attempt"].cast("string"))).alias("n"), host.alias("host"))

    def shaped(p: Column) -> Column:
        return F.struct(*(p[x].alias(x) for x in ("kind", "text", "lead", "body", "more", "n", "host")), _scrambled(p["body"], p["n"], p["style"], ~p["kind"].isin("EMAIL", "SECRET")).alias("new"))

    def carded(p: Column) -> Column:
        drawn = F.concat(F.substring(p["body"], 1, 1), F.substring(p["new"], F.lit(2), F.length(p["body"]) - 2))
        return F.struct(*(p[x].alias(x) for x in ("kind", "text", "lead", "body", "more", "n", "host", "new")), F.when(p["kind"] == "CARD", drawn).alias("drawn"))

    def final(p: Column) -> Column:
        kind, n = p["kind"], p["n"]
        at = lambda i: F.element_at(n, i)
        host = F.concat(F.translate(F.substring(p["host"], 1, 16), "0123456789", "ghijklmnop"), F.lit(".example.com"))
        octets = F.concat_ws(".", *((at(i) % 254 + 1).cast("string") for i in (1, 2, 3, 4)))
        check = (10 - _luhn_sum(F.concat(p["drawn"], F.lit("0"))) % 10) % 10
        last = F.when(_luhn_sum(p["body"]) % 10 == 0, check).otherwise((check + 1 + at(40) % 9) % 10)
        out = F.when(kind == "", p["text"]).when(kind == "EMAIL", F.concat(p["new"], F.lit("@"), host)).when(kind == "IP", octets).when(kind == "CARD", _respaced(F.concat(p["drawn"], last.cast("string")), p["text"]))
        nth_of = lambda made_of: lambda i: F.element_at(F.split(F.lit(" ".join(made_of)), " "), at(i % (32 * BLOCKS - 4) + 5) % len(made_of) + 1)
        cased = lambda made: F.when(p["text"].rlike(r"^\P{Ll}+$"), F.upper(made)).otherwise(F.initcap(made))
        lists = GIVEN_NAMES | {("any", script): sum((v for (_, x), v in GIVEN_NAMES.items() if x == script), []) for script in SYLLABLES}
        for (sex, script), names in lists.items():
            ending = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(p["more"], F.lit(1))), nth_of(SYLLABLES[script])), "")
            listed = F.element_at(F.split(F.lit(" ".join(names)), " "), at(1) % len(names) + 1)
            out = out.when(kind == f"GIVEN-{sex}-{script}", cased(F.concat(listed, F.when(p["more"] > 0, ending).otherwise(""))))
        for script, made_of in SYLLABLES.items():
            syllable = lambda i, made_of=made_of: F.element_at(F.split(F.lit(" ".join(made_of)), " "), at(i) % len(made_of) + 1)
            made = F.concat(*map(syllable, (1, 2, 3, 4)), F.when(p["more"] > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(p["more"], F.lit(1))), lambda i: syllable(i % (32 * BLOCKS - 4) + 5)), "")).otherwise(""))
            if script == "cyrillic":
                made = F.concat(made, F.when(kind == "SURNAME-female-cyrillic", "ова").otherwise("ов"))
            out = out.when(kind.startswith("SURNAME") & kind.endswith(script), cased(made))
        street = F.regexp_extract(p["body"], _STREET, 0)
        out = out.when((kind == "ADDRESS") & (street != ""), F.overlay(p["new"], street, F.regexp_instr(p["body"], F.lit(_STREET))))
        return out.otherwise(F.concat(p["lead"], p["new"]))

    for step in (seeded, shaped, carded, final):
        parts = F.transform(parts, step)
    return parts


def clashes(entities: DataFrame, key: str) -> DataFrame:
    """The attempt that each entity needs, of those that can't keep their first: space, canon, attempt.

    ``entities``: space, canon, kind, text. All entities stay distinct, and distinct from all that was detected.
    """
    spark = entities.sparkSession
    known = written(entities.groupBy("space", "canon").agg(F.min(F.struct("kind", "text")).alias("m")).select("space", "canon", "m.kind", "m.text"), "pii-entities")
    originals = known.select("space", F.col("canon").alias("form"))
    state = known.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    while True:
        tried = state.withColumn("form", canonical(F.col("kind"), surrogates(F.array(F.struct("kind", "text", "attempt")), key)[0]))
        taken = originals if settled is None else originals.unionByName(settled.select("space", "form"))
        first = tried.groupBy("space", "form").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        free = first.join(taken, ["space", "form"], "left_anti")
        tried = written(tried, "pii-tried")
        won = tried.join(free.select("space", "form", F.col("owner").alias("canon")), ["space", "form", "canon"], "left_semi")
        lost = written(tried.join(won.select("space", "canon"), ["space", "canon"], "left_anti"), "pii-lost")
        settled = written(won if settled is None else settled.unionByName(won.select(settled.columns)), "pii-settled")
        if lost.isEmpty():
            return settled.where("attempt > 0").select("space", "canon", "attempt")
        state = lost.drop("form").withColumn("attempt", F.col("attempt") + 1)


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "lectern") -> DataFrame:
    """Replace personal data in every whole text by surrogates.

    One row per input row: ``id_col``, ``text_col`` with replacements, and entity_count (mentions replaced, long). Null
    texts stay null with no mentions; null and repeated ids keep a row each; equal texts get equal results. An empty
    table gives no rows. Other columns are left out. ``key`` is the secret on which surrogates depend.
    """
    none = F.array().cast("array<string>")
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    base = base.withColumn("matches", F.when(_may_match(F.col("body")), F.regexp_extract_all("body", F.lit(ANY), F.lit(0))).otherwise(none))
    some = F.size("matches") > 0
    plain: DataFrame | None = None
    mentions = base.where(some).select(F.explode("matches").alias("match")).groupBy("match").agg(F.count("*").alias("n"))
    flat = mentions.select(F.explode(_parts(F.col("match"))).alias("p")).where("p.kind <> ''")
    entities = flat.select(_space(F.col("p.kind")).alias("space"), canonical(F.col("p.kind"), F.col("p.text")).alias("canon"), F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))
    again = clashes(entities, key)
    name = lambda p: F.concat_ws("|", _space(p["kind"]), canonical(p["kind"], p["text"]))
    if again.isEmpty():
        source, attempt = base, lambda p: F.lit(0)
    else:
        # The texts that mention one of the few entities that clash get a map of their attempts.
        hit = base.where(some).select("body", F.explode(F.flatten(F.transform("matches", _parts))).alias("p")).where("p.kind <> ''")
        hit = hit.select(F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"), _space(F.col("p.kind")).alias("space"), canonical(F.col("p.kind"), F.col("p.text")).alias("canon")).join(again, ["space", "canon"])
        maps = hit.distinct().groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "space", "canon"), "attempt"))).alias("attempts"))
        # Null texts, and those that the quick test rules out, stand in no map: they go by the join.
        may = F.coalesce(_may_match(F.col("body")), F.lit(False))
        plain = base.where(~may).select(F.col("key").alias(id_col), F.col("body").alias(text_col), F.lit(0).cast("long").alias("entity_count"))
        source = base.where(may).withColumn("t1", F.xxhash64("body")).withColumn("t2", F.xxhash64(F.lit(1), "body")).join(maps, ["t1", "t2"], "left")
        attempt = lambda p: F.coalesce(F.try_element_at(F.col("attempts"), name(p)), F.lit(0))

    def replaced(parts: Column) -> Column:
        tried = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), attempt(p).alias("attempt")))
        return F.array_join(surrogates(tried, key), "")

    whole = lambda x: F.array(F.struct(F.lit("").alias("kind"), x.alias("text")))
    split = source.withColumn("parts", F.when(some, F.transform("matches", _parts)))
    split = split.withColumn("names", F.when(some, F.filter(F.flatten("parts"), lambda p: p["kind"].startswith("GIVEN") | p["kind"].startswith("SURNAME"))))
    gaps = F.split("body", ANY, -1)
    split = split.withColumn("gaps", F.when(F.size("names") > 0, F.transform(gaps, lambda g: _with_names(g, F.col("names")))).when(some, F.transform(gaps, whole)))
    # Gaps and matches by turns: the first gap, a match, a gap, ...
    new = F.concat(F.transform("parts", replaced), F.array(F.lit("")))
    between = F.transform("gaps", lambda g: F.when(F.exists(g, lambda p: p["kind"] != ""), replaced(g)).otherwise(F.array_join(F.transform(g, lambda p: p["text"]), "")))
    woven = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, b))), "")
    count = F.size(F.filter("parts", lambda m: F.exists(m, lambda p: p["kind"] != ""))) + F.size(F.filter(F.flatten("gaps"), lambda p: p["kind"] != ""))
    out = split.select(F.col("key").alias(id_col), F.when(some, woven).otherwise(F.col("body")).alias(text_col), F.when(some, count).otherwise(0).cast("long").alias("entity_count"))
    return out if plain is None else out.unionByName(plain)
