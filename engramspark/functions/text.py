"""Column functions on text: rendering, cleaning, tokens, fallbacks, token estimates, lenient JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import STOP_WORDS

#: Words that call for a rewritten query; matched anywhere in it, even inside words.
PRONOUNS = ("这", "那", "刚才", "之前", "它", "他", "她", "这个", "那个", "this", "that", "it", "he", "she", "they", "them", "these", "those")
CELL_TYPES = ("fact", "constraint", "preference", "task", "fragmented")
ROLES = ("system", "user", "assistant", "tool")

Estimator = Callable[[Column], Column]


def chars(c: Column) -> Column:
    """One token a code point: the estimate without a tokenizer."""
    return F.length(c).cast("long")


def chars_div_4(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Split on runs of white space, no empty words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def render(role: Column, content: Column) -> Column:
    """``[role]: content`` as cells keep turns."""
    return F.concat(F.lit("["), role, F.lit("]: "), content)


def capitalize(c: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def render_prompt(role: Column, content: Column) -> Column:
    """``[Role]: content`` as full-history prompts show turns."""
    return render(capitalize(role), content)


#: Times as ISO 8601 writes them: date, and time to the hour or finer, with or without separators and a zone.
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}|\d{8})(?:[^0-9](\d{2}(?::\d{2}(?::\d{2})?)?|\d{4}|\d{6})(?:[.,](\d+))?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
MOMENT = "struct<micros:bigint,zoned:boolean>"


def moment(raw: Column) -> Column:
    """MOMENT of a text by ISO_TIME (null for anything else): microseconds, as if UTC where no zone is given."""
    part = [F.regexp_extract(raw, ISO_TIME, k) for k in range(5)]
    digits = F.rpad(F.regexp_replace(part[2], ":", ""), 6, "0")
    zone = F.regexp_replace(F.regexp_replace(part[4], ":", ""), "^Z$", "+0000")
    zone = F.when(zone == "", "+0000").otherwise(F.rpad(zone, 5, "0"))
    at = F.try_to_timestamp(F.concat(F.regexp_replace(part[1], "-", ""), digits, zone), F.lit("yyyyMMddHHmmssxx"))
    micros = F.unix_micros(at) + F.rpad(F.left(part[3], F.lit(6)), 6, "0").cast("long")
    return F.when(raw.rlike(ISO_TIME) & micros.isNotNull(), F.struct(micros.alias("micros"), (part[4] != "").alias("zoned"))).cast(MOMENT)


def clean(token: Column) -> Column:
    """Lower case, without anything but letters, digits, ``_`` and white space."""
    return F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}_\s]", ""))


def query_terms(query: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The distinct cleaned words of a query that are not stop words."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(F.filter(F.transform(words(query), clean), lambda t: (t != "") & ~F.array_contains(stops, t)))


def doc_tokens(keywords: Column, text: Column) -> Column:
    """Each keyword cleaned as a whole, then each word of the text; empty tokens stay and count to the length."""
    return F.concat(F.transform(keywords, clean), F.transform(words(F.coalesce(text, F.lit(""))), clean))


def fallback_summary(text: Column, lines: int = 3, most: int = 200) -> Column:
    """The first non-blank lines, joined by spaces, cut to ``most`` code points."""
    kept = F.filter(F.transform(F.split(text, r"\n"), strip), lambda x: x != "")
    return F.left(F.array_join(F.slice(kept, 1, lines), " "), F.lit(most))


def keyword_runs(text: Column) -> Column:
    """Lower-cased runs of CJK ideographs, Latin letters and digits of two or more characters."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fa5}a-zA-Z0-9]+)"), F.lit(1)), F.lower), lambda x: F.length(x) >= 2)


def cell_type(c: Column) -> Column:
    return F.when(c.isin(*CELL_TYPES), c).otherwise(F.lit("fact"))


def known_role(c: Column) -> Column:
    return F.when(c.isin(*ROLES), c).otherwise(F.lit("user"))


def needs_rewrite(query: Column, tokens: Column, below: int = 10) -> Column:
    """A short query, or one with a pronoun anywhere in it."""
    lower = F.lower(query)
    hit = F.lit(False)
    for p in PRONOUNS:
        hit = hit | lower.contains(p)
    return (tokens < below) | hit


def lenient_json(text: Column) -> Column:
    """VARIANT of the first reading that parses: as it is, the first fenced block, the braces, the brackets; null if none."""

    def parsed(c: Column) -> Column:
        return F.try_parse_json(F.when(F.trim(c).rlike(r"(?s)^[\{\[].*[\}\]]$"), F.trim(c)))

    def unfinished(c: Column) -> Column:
        return F.regexp_replace(c, r",(\s*[}\]])", "$1")

    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces, brackets = F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(parsed(text), parsed(fence), parsed(braces), parsed(unfinished(braces)), parsed(brackets), parsed(unfinished(brackets)))


def split_indices(reply: Column, n_turns: Column) -> Column:
    """Valid cut points of a detector's reply: numbers from 1 to ``n_turns``, distinct, ascending; junk gives none."""
    v = lenient_json(reply)
    found = None
    for path in ("$.split_indices", "$.split_points", "$.boundaries", "$"):
        numbers = F.try_variant_get(v, path, "array<double>")
        numbers = F.when(F.size(numbers) > 0, numbers)
        found = numbers if found is None else F.coalesce(found, numbers)
    whole = F.transform(F.coalesce(found, F.array().cast("array<double>")), lambda x: F.floor(x).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: (x > 0) & (x <= n_turns))))


def judge_score(reply: Column) -> Column:
    """The first number in a judge's reply within 0 and 1; 0 where there is none or it is malformed."""
    number = F.regexp_extract(reply, r"([\d.]+)", 1).try_cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)), F.lit(0.0))


def lenient_date(text: Column) -> Column:
    """A session date in one of five forms; anything else is 2023-05-01."""
    forms = ("h:mm a 'on' d MMMM, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(strip(text), F.lit(f)) for f in forms], F.lit("2023-05-01 00:00:00").cast("timestamp"))
