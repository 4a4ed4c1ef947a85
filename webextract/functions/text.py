"""Text and scoring functions as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules

#: White space, as a class without Unicode lookups.
SPACES = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = f"[{SPACES}]+"


def normalized(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0))


def excerpt(text: Column, length: int = rules.EXCERPT_CHARS) -> Column:
    """Normalised text, or its start, cut at a space after 70 % of the length if there is one, with dots."""
    t = normalized(text)
    cut = F.left(t, F.lit(length))
    last = F.lit(length) - F.locate(" ", F.reverse(cut))  # index from 0 of the last space; ``length`` if none
    at = F.when((F.locate(" ", F.reverse(cut)) > 0) & (last > 0.7 * length), last).otherwise(length)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.rtrim(F.left(cut, at)), F.lit("...")))


def clean_excerpt(text: Column, length: int = 160) -> Column:
    """Normalised text, or its start with an ellipsis."""
    t = normalized(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.left(t, F.lit(length)), F.lit("…")))


def comma_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def paragraph_points(length: Column, commas: Column) -> Column:
    """Score of a paragraph by its length and commas."""
    return F.when(length < rules.MIN_PARAGRAPH_CHARS, 0).otherwise(1 + commas + F.least(F.floor(length / 100), F.lit(3))).cast("double")


def paragraph_score(text: Column) -> Column:
    return paragraph_points(F.length(text), comma_count(text))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + rules.either(parts))


def tag_score(tag: Column) -> Column:
    """Score of a tag, 0 where it has none."""
    table = F.create_map(*[F.lit(x) for kv in rules.TAG_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tag), F.lit(0))


def class_weight(class_id: Column) -> Column:
    """Weight of "class id"; blank has none."""
    weigh = lambda parts, w: F.when(_any(class_id, parts), w).otherwise(0)
    total = weigh(rules.POSITIVE, rules.POSITIVE_WEIGHT) + weigh(rules.NEGATIVE, rules.NEGATIVE_WEIGHT)
    total = total + weigh(rules.PHOTO, rules.PHOTO_WEIGHT) + weigh((rules.ASSET,), rules.ASSET_WEIGHT)
    return F.when(F.trim(class_id) == "", 0).otherwise(total)


def is_unlikely(class_id: Column) -> Column:
    """Whether "class id" names something other than content."""
    return (F.trim(class_id) != "") & _any(class_id, rules.UNLIKELY) & ~_any(class_id, rules.MAYBE)


def is_extractable(html: Column) -> Column:
    """Whether a page sent with an error status may still hold an article."""
    low = F.lower(html)
    return (F.length(html) >= rules.EXTRACTABLE_CHARS) & reduce(or_, [low.contains(x) for x in rules.EXTRACTABLE_SIGNS])


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 if they are, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def _file_of(src: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(src, "^([^?#]*)", 1), "([^/]*)$", 1)


def _domain_of(src: Column) -> Column:
    rest = F.when(src.startswith("//"), F.substring(src, 3, 1_000_000)).otherwise(F.regexp_extract(src, r"^.*?://(.*)$", 1))
    return F.regexp_extract(rest, "^([^/?#]*)", 1)


def _bare_file_valid(name: Column) -> Column:
    last = F.regexp_extract(name, "([^/]*)$", 1)
    return F.regexp_extract(last, r"\.([^.]*)$", 1).isin(*rules.IMAGE_EXTENSIONS) & (F.length(F.trim(F.regexp_extract(last, r"^(.*)\.", 1))) >= 2)


def is_image_source(src: Column) -> Column:
    """Whether an image's src is worth keeping: no trackers, no empty or odd values."""
    s = F.lower(F.trim(src))
    name, domain = _file_of(s), _domain_of(s)
    tracker = name.isin(*rules.TRACKING_FILES) | domain.rlike("^(" + rules.either(rules.TRACKING_DOMAINS).replace(".", r"\.") + ")")
    return (
        F.when(src.isNull() | (s == ""), False)
        .when(s.startswith("data:"), s.rlike("^data:image/(" + rules.either(rules.DATA_IMAGES) + ")"))
        .when(tracker, False)
        .when(s.rlike("^(https?:)?//"), (name == "") | ~name.contains(".") | _bare_file_valid(name))
        .when(s.rlike(r"^(/|\./|\.\./)"), True)
        .otherwise(_bare_file_valid(s))
    )


def is_boilerplate(class_id: Column, text: Column, length: Column, density: Column) -> Column:
    """The block test: hints in class and id, phrases in the text, length and share of links."""
    c, t = F.lower(F.trim(class_id)), F.lower(normalized(text))
    hint, strong = _any(c, rules.BOILERPLATE_HINTS), _any(c, rules.STRONG_HINTS)
    phrase = F.coalesce(*[F.when(t.contains(p), True) for p in rules.BOILERPLATE_PHRASES], F.lit(False))
    found = (
        (strong & ((length < 5000) | (density > 0.08)))
        | (hint & (length < 2500) & (density > 0.05))
        | (is_unlikely(class_id) & ((length < 1600) | (density > 0.2)))
        | (phrase & hint & ((density > 0.08) | (length < 1200)))
        | (phrase & (density > 0.35))
        | (phrase & strong & (length < 2500))
    )
    return (length > 0) & found


def is_transient(error: Column) -> Column:
    """Whether an error speaks of a missing page."""
    return error.rlike("404|410")


def is_retryable(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 429)


def backoff(attempt: Column) -> Column:
    """Seconds before attempt n + 1."""
    return F.least(F.lit(0.3) * attempt, F.lit(1.5))


def low_words_warning(words: Column, least: int) -> Column:
    """Warnings of an article of too few words."""
    said = F.format_string(f"Content below minimum word count (%d < {least})", words)
    return F.when(words < least, F.array(said)).otherwise(F.array().cast("array<string>"))


def status_route(status: Column, html: Column) -> Column:
    """What becomes of a response: extract, try (a missing page that may hold an article), or fail."""
    missing = status.isin(*rules.GONE)
    return F.when(missing & is_extractable(html), "try").when(status >= 400, "fail").otherwise("extract")


def statsd_line(namespace: str | None, name: Column, value: Column, kind: Column, tags: Column) -> Column:
    """One StatsD datagram; null for unknown kinds."""
    code = F.when(kind == "counter", "c").when(kind == "timer", "ms")
    prefix = (namespace or "").strip().rstrip(".")
    body = F.concat(F.lit(prefix + "." if prefix else ""), name, F.lit(":"), value, F.lit("|"), code)
    joined = F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return F.when(F.coalesce(joined, F.lit("")) != "", F.concat(body, F.lit("|#"), joined)).otherwise(body)


def fingerprint(payload: Column) -> Column:
    return F.sha2(payload, 256)


def canonical_json(tags: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def request_id(header: Column) -> Column:
    """The trimmed header, or a new random id."""
    return F.coalesce(F.nullif(F.trim(header), F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit("")))
