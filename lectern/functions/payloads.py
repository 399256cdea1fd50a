"""Column functions over candidates and slides: what is shown, sent and logged of a reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a slide shows where the reference or the verse is missing, and the heading of a share text.
NO_REFERENCE, NO_VERSE = "Найдена ссылка", "Текст цитаты пока не найден."
SHARE_HEADING = "Цитаты из проповеди:"
#: The fields of a slide's payload, and of a candidate, which are trimmed text where they are text.
PAYLOAD = ("ref", "verse", "book", "chapter", "start_verse", "end_verse", "end_chapter", "source", "asr", "detected_text")
CANDIDATE = (*PAYLOAD, "chunk", "label")
NUMBERS = ("chapter", "start_verse", "end_verse", "end_chapter", "chunk")
#: Lengths beyond which a verse is shown smaller, on the slide and to the operator, and how that is called.
SLIDE_SIZES = ((520, "very-long"), (230, "long"))
OPERATOR_SIZES = ((900, "extra-long"), (520, "very-long"), (260, "long"))


def filled(text: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.trim(F.coalesce(text, F.lit("")))


def slide_payload(parsed: Column, source: Column, heard: Column) -> Column:
    """The ten fields of a slide for a parsed reference (struct: ref, verse_text, book, chapter, start_verse, end_verse,
    end_chapter) that ``source`` (parser, resolver) found in ``heard``; null where nothing was parsed."""
    made = {"verse": parsed["verse_text"], "source": F.concat(F.lit("vosk:"), source), "asr": heard, "detected_text": heard}
    return F.when(parsed["ref"].isNotNull(), F.struct(*(made.get(c, parsed[c] if c not in made else None).alias(c) for c in PAYLOAD)))


def slide_text(ref: Column, verse: Column) -> Column:
    """The reference, an empty line and the verse; or the one that there is."""
    r, v = filled(ref), filled(verse)
    return F.when((r != "") & (v != ""), F.concat(r, F.lit("\n\n"), v)).otherwise(F.concat(v, F.when(v == "", r).otherwise("")))


def slide_body(ref: Column, verse: Column, theme: Column) -> Column:
    """The JSON body that shows one slide, with a theme if it has a name."""
    text = slide_text(ref, verse)
    plain = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("slides")))
    themed = F.to_json(F.struct(F.array(F.struct(text.alias("text"), F.struct(theme.alias("name")).alias("theme"))).alias("slides")))
    return F.when(F.coalesce(theme, F.lit("")) == "", plain).otherwise(themed)


def shown_slide(slide: Column) -> Column:
    """What a screen shows of a slide (ref, verse, source, asr, detected_text): a missing reference is what was detected, a
    missing verse what was heard, and each has a last resort."""
    f = {c: filled(slide[c]) for c in ("ref", "verse", "asr", "detected_text")}
    first = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))
    source = F.coalesce(F.nullif(slide["source"], F.lit("")), F.lit("live"))
    return F.struct(first(f["ref"], f["detected_text"], F.lit(NO_REFERENCE)).alias("ref"), first(f["verse"], f["asr"], f["detected_text"], F.lit(NO_VERSE)).alias("verse"), source.alias("source"), f["asr"].alias("asr"), f["detected_text"].alias("detected_text"))


def clean_candidate(candidate: Column) -> Column:
    """A submitted candidate with its text fields trimmed, missing ones empty."""
    return F.struct(*((candidate[c] if c in NUMBERS else filled(candidate[c])).alias(c) for c in CANDIDATE))


def payload_summary(payload: Column) -> Column:
    """What a log keeps of a payload (text, source, parsed, slide, attempts)."""
    p = payload["parsed"]
    fields = [payload["text"].alias("text"), *(p[c].alias(c) for c in ("ref", "book", "chapter", "start_verse", "end_verse")), payload["source"].alias("source")]
    return F.struct(*fields, payload["slide"].isNotNull().alias("has_slide"), F.coalesce(payload["attempts"], F.filter(payload["attempts"], lambda a: F.lit(False))).alias("attempts"))


def size_class(text: Column, sizes: tuple = SLIDE_SIZES) -> Column:
    """How long a text is, by ``sizes`` (greatest first); empty for a short one."""
    n = F.length(filled(text))
    out = F.lit("")
    for least, name in reversed(sizes):
        out = F.when(n > least, name).otherwise(out)
    return out


def progress(value: Column) -> Column:
    """A percentage: whole, from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int")))


def target_url(value: Column, port: int = 8091) -> Column:
    """A sink's address with scheme and port, without slashes at the end; "auto" and an empty one are "auto"."""
    v = F.rtrim(F.regexp_replace(filled(value), "/+$", ""))
    host, rest = F.substring_index(v, ":", 1), F.regexp_extract(v, "^[^:]*:(.*)$", 1)
    made = F.when(v.contains("://"), v).when(v.contains(":"), F.concat(F.lit("http://"), host, F.lit(":"), rest)).otherwise(F.concat(F.lit("http://"), v, F.lit(f":{port}")))
    return F.when((v == "") | (F.lower(v) == "auto"), F.when(v == "", "auto").otherwise(v)).otherwise(made)


def sent_to(outcomes: Column, auto: Column) -> Column:
    """Where a request ended that tries targets in turn: struct (url, ok, reason) of ``outcomes`` (array of url, ok, reason).

    The first that answers well is it. A target that was named, not found, ends the attempts with a reason about tokens or
    of its own; else the reason lists all.
    """
    good = F.try_element_at(F.filter(outcomes, lambda o: o["ok"]), F.lit(1))
    own = F.try_element_at(F.filter(outcomes, lambda o: ~o["ok"] & (o["reason"].startswith("holyrics_token_") | o["reason"].startswith("holyrics_error:"))), F.lit(1))
    every = F.array_join(F.transform(outcomes, lambda o: F.concat(o["url"], F.lit("="), o["reason"])), ";")
    failed = F.when(~auto & own.isNotNull(), own["reason"]).when(every == "", "holyrics_unavailable").otherwise(every)
    return F.when(good.isNotNull(), F.struct(good["url"].alias("url"), F.lit(True).alias("ok"), good["reason"].alias("reason"))).otherwise(F.struct(F.lit(None).cast("string").alias("url"), F.lit(False).alias("ok"), failed.alias("reason")))


def share_text(refs: Column) -> Column:
    """The numbered references under their heading; empty if there are none."""
    real = F.filter(F.transform(refs, filled), lambda r: r != "")
    lines = F.transform(real, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    return F.when(F.size(real) > 0, F.concat(F.lit(SHARE_HEADING + "\n"), F.array_join(lines, "\n"))).otherwise("")


def share_link(text: Column) -> Column:
    """The link that shares a text; empty for an empty one. Spaces are %20, and slashes stay."""
    coded = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("https://wa.me/?text="), F.replace(coded, F.lit("*"), F.lit("%2A"))))


def json_object(body: Column) -> Column:
    """A request's body as (body, status): a JSON object is 200, anything else 400 without a body."""
    good = F.coalesce(F.trim(body).startswith("{") & F.try_parse_json(body).isNotNull(), F.lit(False))
    return F.struct(F.when(good, body).alias("body"), F.when(good, 200).otherwise(400).alias("status"))


def setting_line(line: Column) -> Column:
    """A line of a settings file as (name, value), or null: blank lines and comments say nothing; "export" in front and quotes
    around the value go."""
    t = F.regexp_replace(F.trim(line), r"^export\s+", "")
    name, raw = F.trim(F.substring_index(t, "=", 1)), F.trim(F.regexp_extract(t, r"^[^=]*=(.*)$", 1))
    value = F.regexp_replace(raw, r"^(?:\"(.*)\"|'(.*)')$", "$1$2")
    return F.when((t != "") & ~t.startswith("#") & t.contains("=") & (name != ""), F.struct(name.alias("name"), value.alias("value")))
