"""Scalar columns: numbers as printed, display forms, locators, questions, HTML and file types. All inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that say there is no number.
NULL_TOKENS = ("", "-", "\u2013", "\u2014", "na", "n.a.", "n/a", "nil", "not available", "*", "--", "\u2026")


def _cell(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(raw), r"[*\u2020\u2021#]+\s*$", ""))


def is_null_token(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin(*NULL_TOKENS)


def parse_number(raw: Column) -> Column:
    """The number a cell prints, or null: parentheses negate, % and thousands commas go, inner spaces refuse."""
    text = _cell(raw)
    negative = text.rlike(r"^\(.*\)$")
    body = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\((.*)\)$", "$1")), r"%$", ""))
    fits = ~F.lower(text).isin(*NULL_TOKENS) & body.rlike(r"^[-+]?[\d,]*\.?\d+$")
    value = F.when(fits, F.regexp_replace(body, ",", "").try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def unit_in(text: Column) -> Column:
    """The first parenthetical that is not a number."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda p: ~F.trim(p).rlike(r"^[-+\d.,%\s]*$"))
    return F.trim(F.get(found, F.lit(0)))


def indian(value: Column, digits: int = 2) -> Column:
    """1,23,45,678.90: the last three digits, then pairs; halves away from zero; never -0."""
    text = F.abs(value).cast("string").cast("decimal(38,12)")
    rounded = F.round(text, digits).cast(f"decimal(38,{digits})").cast("string")
    whole, part = F.split_part(rounded, F.lit("."), F.lit(1)), F.split_part(rounded, F.lit("."), F.lit(2))
    head = F.when(F.length(whole) > 3, whole.substr(F.lit(1), F.length(whole) - 3))
    grouped = F.concat_ws(",", F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,")), F.right(whole, F.lit(3)))
    out = F.concat_ws(".", grouped, F.nullif(part, F.lit("")))
    return F.when(value.isNull(), None).when((value < 0) & rounded.rlike("[1-9]"), F.concat(F.lit("-"), out)).otherwise(out)


def _number(value: Column, digits: int) -> Column:
    """Grouped, with ``digits`` decimals at most."""
    shown = indian(value, digits)
    return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else shown


def tonnes(value: Column) -> Column:
    """In the unit that the sector prints: MT from a million on, lakh t from a hundred thousand on."""
    size = F.abs(value)
    said = lambda scale, digits, unit: F.concat(_number(value / scale, digits), F.lit(f" {unit}"))
    return F.when(size >= 1e6, said(1e6, 2, "MT")).when(size >= 1e5, said(1e5, 2, "lakh t")).otherwise(said(1.0, 2, "t"))


def tick(value: Column) -> Column:
    """A short label on an axis, without its unit."""
    size, out = F.abs(value), None
    for least, digits, unit in ((1e7, 1, " cr"), (1e6, 0, "M"), (1e5, 0, " L"), (1e3, 0, "k")):
        label = F.concat(_number(value / least, digits), F.lit(unit))
        out = F.when(size >= least, label) if out is None else out.when(size >= least, label)
    return out.otherwise(_number(value, 0))


def shown(value: Column, unit: Column) -> Column:
    """A value in whichever unit it is stored in."""
    money = lambda scale, name: F.concat(F.lit("\u20b9"), _number(value / scale, 2), F.lit(name))
    rupees = F.when(F.abs(value) >= 1e7, money(1e7, " crore")).when(F.abs(value) >= 1e5, money(1e5, " lakh")).otherwise(money(1.0, ""))
    return (
        F.when(unit == "t", tonnes(value)).when(unit == "t/yr", F.concat(tonnes(value), F.lit("/yr"))).when(unit == "fraction", F.concat(_number(value * 100, 2), F.lit("%")))
        .when(unit == "inr", rupees).otherwise(F.concat(_number(value, 2), F.lit(" "), unit))
    )


def percent(fraction: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(fraction * 100, digits).cast("string"), F.lit("%"))


def bytes_size(n: Column, to_even: bool = False) -> Column:
    """500 B, 2 KB, 3.0 MB. Halves go up; ``to_even``: those of tenths of a megabyte go to the even tenth, as printf has them."""
    whole = F.concat(F.round(n / 1024, 0).cast("long").cast("string"), F.lit(" KB"))
    tenths = (F.bround if to_even else F.round)(n / (1 << 20), 1)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, whole).otherwise(F.concat(F.format_string("%.1f", tenths), F.lit(" MB")))


def duration(seconds: Column) -> Column:
    """A span in words: 47 s, 4 min, 2 h, 3 d."""
    s = F.greatest(F.lit(0.0), F.round(seconds.cast("double"), 0))
    said = lambda per, unit: F.concat(F.round(s / per, 0).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(s < 60, said(1, "s")).when(s < 3600, said(60, "min")).when(s < 86400, said(3600, "h")).otherwise(said(86400, "d"))


def humanize(key: Column) -> Column:
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def entity_label(entity: Column) -> Column:
    return F.when(F.length(entity) <= 5, F.upper(entity)).otherwise(humanize(entity))


def locator(document: Column, version: Column, page: Column, table: Column, cell: Column) -> Column:
    """Where a figure stands, without what is not known and without version 1."""
    return F.concat_ws(" ", F.concat(F.lit("doc:"), document), F.when(version > 1, F.concat(F.lit("v"), version.cast("string"))), F.concat(F.lit("p."), page.cast("string")), table, cell)


def india_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, "Asia/Kolkata"))


def india_stamp(at: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(at, "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))


def new_id(prefix: str, *columns: Column | str) -> Column:
    """A stable id: the same row gets the same one when a task runs again."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16))


def fill(template: str, **values: Column) -> Column:
    """{{key}} replaced by each row's value."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value, F.lit("")))
    return out


# What kind of answer a question wants, tried in this order.
DRAFT = r"(?i)\b(draft|write|compose|prepare)\b.*\b(reply|response|answer|note|letter|para|paragraph)\b|parliamentary\s+(question|answer)|\bpq\b|\bstarred\b"
NARRATIVE = r"(?i)\b(why|explain|reason|because|driver|cause[ds]?|due to|account for|how come|what happened|attribut)\w*"
COMPARISON = r"(?i)\b(compare|comparison|versus|vs\.?|trend|over time|year[- ]on[- ]year|yoy|across|each year|by year|growth|change)\b"


def intent(question: Column, entity: Column, metric: Column, period: Column) -> Column:
    """draft, narrative, exact_figure, comparison or discovery."""
    q = F.trim(question)
    return (
        F.when(q.rlike(DRAFT), "draft").when(q.rlike(NARRATIVE), "narrative").when(entity.isNotNull() & metric.isNotNull() & period.isNotNull(), "exact_figure")
        .when(metric.isNotNull() & (q.rlike(COMPARISON) | period.isNull()), "comparison").otherwise("discovery")
    )


NUMBER = r"\d[\d,]*(?:\.\d+)?%?"


def numbers(text: Column) -> Column:
    """The numerals of a text as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: F.regexp_replace(t, "[,%]", "").try_cast("double"))


def unsupported(sentence: Column, allowed: Column) -> Column:
    """Numerals of a sentence that no allowed value is close to; bare years are let through."""
    tokens = F.regexp_extract_all(sentence, F.lit(NUMBER), F.lit(0))
    value = lambda t: F.regexp_replace(t, "[,%]", "").try_cast("double")
    near = lambda t: F.exists(allowed, lambda a: F.abs(value(t) - a) <= F.greatest(F.lit(1e-6), F.abs(a) * 1e-6))
    return F.filter(tokens, lambda t: ~t.rlike(r"^(19|20)\d\d$") & value(t).isNotNull() & ~F.coalesce(near(t), F.lit(False)))


def verified(prose: Column, allowed: Column) -> Column:
    """The sentences whose numerals are all supported."""
    sentences = F.split(F.trim(prose), r"(?<=[.!?])\s+")
    return F.trim(F.array_join(F.filter(sentences, lambda s: (s != "") & (F.size(unsupported(s, allowed)) == 0)), " "))


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))


def site(url: Column) -> Column:
    """The registrable domain: the last two labels, three before a two-letter country with a short second label."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    return F.when(host.rlike(r"\.(co|gov|nic|org|ac|net|com)\.[a-z]{2}$"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def absolute(base: Column, href: Column) -> Column:
    """A link against its page: absolute ones as they are, rooted ones on the host, others beside the page."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-z]+://[^/]+(?:/.*)?/)", 1)
    beside = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(beside, href))


# The first bytes of file types, as hex.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))


def sniff(content: Column) -> Column:
    """File type by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, name in MAGIC:
        out = F.when(head.startswith(magic), name) if out is None else out.when(head.startswith(magic), name)
    return out


# Letter confusions of a recogniser, and its numbers broken by spaces.
ARTEFACTS = ("IVI", "I\\/I", "|ONAL", "TI-IE", "TFIE", "0F ", "1'", "l\\/l", "VIANCE", "COIVI", "PERFORI")
BROKEN = r"(?<![\d.])\d+ +\.\d|(?<![\d.])\d+ +\d(?!\d)"


def recognised_layer(text: Column) -> Column:
    """Whether a page's text layer came from a recogniser: two artefacts, or three broken numbers, line by line."""
    hits = F.lit(0)
    for a in ARTEFACTS:
        hits = hits + ((F.length(text) - F.length(F.replace(text, F.lit(a), F.lit("")))) / len(a)).cast("int")
    broken = F.aggregate(F.transform(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(BROKEN))), F.lit(0), lambda a, b: a + b)
    return F.coalesce((hits >= 2) | (broken >= 3), F.lit(False))


def page_class(pages_with_text, pages) -> Column:
    """Class of a document from its pages with a trusted text layer."""
    return F.when(pages_with_text == pages, "text_pdf").when(pages_with_text == 0, "scanned_pdf").otherwise("mixed_pdf")
