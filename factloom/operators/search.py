"""Lexical search over evidence: quoted phrases, OR and NOT; a cover-density-like rank of our own; marked snippets.

A query is a disjunction of conjunctions of terms and phrases, each maybe negated; single words without content
do not count. Words match by a light English stem. The rank is the sum over matched words of 1 / (1 + the gap to the next matched word).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topics import ENGLISH


STOPWORDS = frozenset(ENGLISH)


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negated: bool = False


def parse(query: str) -> list[list[Term]]:
    """Alternatives, each a list of terms that must all hold; never raises."""
    out: list[list[Term]] = [[]]
    for negated, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not negated:
            out.append([])
            continue
        plain = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        words = tuple(stem(w) for w in plain)
        if words and not (len(plain) == 1 and plain[0] in STOPWORDS):
            out[-1].append(Term(words, bool(negated)))
    return [a for a in out if a]


def stem(word: str) -> str:
    """Plural, -ing, -ed and -e endings go where a stem of three letters stays."""
    for ending in ("ies", "ing", "ed", "es", "s", "e"):
        if word.endswith(ending) and len(word) - len(ending) >= 3 and not word.endswith("ss"):
            return word[: -len(ending)] + ("y" if ending == "ies" else "")
    return word


def stems(text: Column) -> Column:
    """The text's words by the same rule, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.endswith("ss"), w).otherwise(F.regexp_replace(F.regexp_replace(w, "^(.{3,})ies$", "$1y"), "^(.{3,}?)(?:ing|ed|es|s|e)$", "$1")))


def matches(query: str, words: Column) -> Column:
    """Whether an array of stems satisfies the query; a blank one matches nothing."""
    any_ = F.lit(False)
    for terms in parse(query):
        all_ = F.lit(True)
        for t in terms:
            if len(t.words) == 1:
                hit = F.array_contains(words, t.words[0])
            else:
                hit = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(t.words) + " ")
            all_ = all_ & (~hit if t.negated else hit)
        any_ = any_ | all_
    return any_


def hint(query: str, text: Column) -> Column:
    """What a text must hold to match, cheap to test: a piece of each wanted word of an alternative."""
    any_ = F.lit(False)
    for terms in parse(query):
        pieces = sorted({w.removesuffix("y") if len(w) > 3 else w for t in terms if not t.negated for w in t.words})
        all_ = F.lit(True)
        for piece in pieces:
            all_ = all_ & F.contains(F.lower(text), F.lit(piece))
        any_ = any_ | all_
    return any_


def ranked(evidence: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Matching rows with their rank."""
    wanted = sorted({w for a in parse(query) for t in a if not t.negated for w in t.words})
    if not wanted:
        return evidence.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    rows = evidence.where(hint(query, F.col(text))).withColumn("_w", stems(F.col(text))).where(matches(query, F.col("_w")))
    places = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*wanted), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_p", places)
    gaps = F.zip_with(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: 1.0 / (a - b))
    return rows.withColumn("rank", F.round(1.0 + F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b), 6)).drop("_w", "_p")


def search(evidence: DataFrame, query: str, text: str = "text", order: tuple[str, ...] = ("document_id", "page"), limit: int | None = 20) -> DataFrame:
    """Matching rows with rank and snippet, best first."""
    wanted = sorted({w for a in parse(query) for t in a if not t.negated for w in t.words})
    rows = ranked(evidence, query, text).orderBy(F.desc("rank"), *order)
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("snippet", snippet(F.col(text), wanted) if wanted else F.lit(""))


def snippet(text: Column, wanted: list[str], most: int = 28, least: int = 8, fragments: int = 2) -> Column:
    """Up to ``fragments`` pieces of ``least`` to ``most`` words, each from a little before a hit that no earlier one has, joined by
    dots; hits between [[ and ]]."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    pattern = r"(?i)\b((?:" + "|".join(map(re.escape, wanted)) + r")(?:y|ies|ing|ed|es|s|e)?)\b"
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())

    def pick(a, i):
        # a piece ends a few words after the last hit that it can hold
        start = F.greatest(F.least(i - 4, F.size(words) - least), F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)), F.lit(0))
        last = F.array_max(F.filter(hits, lambda j: (j >= i) & (j < start + most)))
        end = F.least(F.size(words), start + most, F.greatest(last + 5, start + least))
        new = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.when((F.size(a) < fragments) & (i >= F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0))), F.array_append(a, new)).otherwise(a)

    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(hits, none, pick)
    spans = F.when(F.size(spans) == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(most).alias("end")))).otherwise(spans)
    pieces = F.transform(spans, lambda s: F.array_join(F.slice(words, s["start"] + 1, s["end"] - s["start"]), " "))
    return F.regexp_replace(F.array_join(pieces, " ... "), pattern, "[[$1]]")
