"""Questions: what they name, the kind of answer, and an answer by figure, series or passages."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, periods, text
from ..scope import Scope
from ..shared import saved
from . import facts as fact_ops
from . import resolve, search

# How a question may name a period, most specific first.
PERIODS = (
    r"q[1-4]\s*(?:fy)?\s*\d{2,4}(?:\s*[-–]\s*\d{2,4})?", r"h[12]\s*(?:fy)?\s*\d{2,4}(?:\s*[-–]\s*\d{2,4})?", r"fy\s*\d{2,4}(?:\s*[-–]\s*\d{2,4})?",
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*'?\s*\d{2,4}", r"\b\d{4}\s*[-–]\s*\d{2,4}\b", r"\bas\s+(?:on|at|of)\b[^,.;]{0,20}", r"\b(?:19|20)\d{2}\b",
)


def slots(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with entity, metric, period (label) and kind of answer. Every question is read by columns; the periods
    that they may name are read once for each distinct string."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))
    forms = {f" {' '.join(re.findall('[a-z0-9]+', form.lower()))} ": e.entity_id for e in names.ENTITIES for form in (e.code, e.name, *e.aliases)}
    longest = sorted(forms, key=len, reverse=True)
    asked = questions.withColumn("_q", F.monotonically_increasing_id()).withColumn("_words", spaced(F.col(question)))
    asked = asked.withColumn("entity", F.coalesce(*[F.when(F.col("_words").contains(f), forms[f]) for f in longest]))
    asked = saved(asked.withColumn("metric", names.metric(F.col(question))).drop("_words"), "questions")
    mentions = F.concat(*[F.regexp_extract_all(F.lower(question), F.lit(p), F.lit(0)) for p in PERIODS])
    said = asked.select("_q", F.posexplode(mentions).alias("at", "raw"))
    read = said.join(periods.lookup(said, "raw").where("kind is not null"), "raw")
    first = read.groupBy("_q").agg(F.min_by("label", F.struct(F.col("fiscal_year").isNull(), "at")).alias("period"))
    out = asked.join(first, "_q", "left").drop("_q")
    return out.withColumn("kind", text.intent(F.col(question), F.col("entity"), F.col("metric"), F.col("period")))


def answer(spark: SparkSession, question: str, facts: DataFrame, evidence: DataFrame, scope: Scope) -> tuple[str, DataFrame]:
    """The kind of answer and its rows; narrative and draft questions get the passages that prose would stand on."""
    s = slots(spark.createDataFrame([(question,)], "question string")).first()  # one question
    if s.kind == "exact_figure":
        request = spark.createDataFrame([(s.entity, s.metric, s.period)], "entity_id string, metric string, period_label string")
        return s.kind, resolve.resolve(request, facts, scope)
    if s.kind == "comparison":
        rows = fact_ops.series(facts, s.metric, scope)
        return s.kind, rows if s.entity is None else rows.where(rows.entity_id == s.entity)
    return s.kind, search.search(evidence, question, limit=10 if s.kind == "discovery" else 6)


def degrade(spark: SparkSession, question: str, facts: DataFrame, evidence: DataFrame, scope: Scope, model: Callable[[list, list], str] | None = None) -> tuple[str, object]:
    """A prose answer as far as it can be had: prose whose numbers are supported, else passages, else figures, else out_of_corpus."""
    s = slots(spark.createDataFrame([(question,)], "question string")).first()  # one question
    passages = search.search(evidence, question, limit=6)
    figures = fact_ops.query(facts, scope, entity=s.entity, metric=s.metric, limit=12) if s.entity and s.metric else facts.where(F.lit(False))
    found, known = passages.collect(), figures.collect()  # 6 and 12 rows at most
    if model is not None and (found or known):
        try:
            prose = model(found, known)
        except (ConnectionError, TimeoutError):
            prose = None
        if prose is not None:
            said = spark.createDataFrame([(prose, [r.value for r in known], [r.snippet for r in found])], "prose string, figures array<double>, snippets array<string>")
            named = F.flatten(F.transform("snippets", text.numbers))
            kept = said.select(text.verified(F.col("prose"), F.concat("figures", F.array_compact(named))).alias("prose")).first()
            return "prose", kept.prose
    if found:
        return "passages", passages
    return ("figures", figures) if known else ("out_of_corpus", None)


def suggestions(facts: DataFrame, scope: Scope, terms: DataFrame | None = None, prose: bool = False, limit: int = 5) -> DataFrame:
    """place, question, kind: what the corpus can answer, from its most answerable figure, its most comparable metric, and the first of
    ``terms`` (term, document_count, score); with ``prose``, questions for a model too."""
    fact_ops.bounded(limit, most=12)
    label = F.lower(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m in names.METRICS for x in (m.key, m.label)]), F.col("metric")), F.replace("metric", F.lit("_"), F.lit(" "))))
    who = F.coalesce(names.code_of(F.col("entity_id")), F.upper("entity_id"))
    top = fact_ops.answerable(facts, scope, 1).select(F.concat_ws(" ", who, label).alias("what"), "period_label")
    row = lambda df, place, kind, *words: df.select(F.lit(place).alias("place"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]).alias("question"), F.lit(kind).alias("kind"))
    out = row(top, 1, "exact_figure", F.col("what"), " ", F.col("period_label"))
    most = fact_ops.comparable_metrics(facts, scope).orderBy(F.desc("entities"), "metric").limit(1)
    out = out.unionByName(row(most, 2, "comparison", "compare ", label, " across subsidiaries"))
    if terms is not None:
        first = terms.orderBy(F.desc("document_count"), F.desc("score"), "term").limit(1)
        out = out.unionByName(row(first, 3, "discovery", "documents mentioning ", F.col("term")))
    if prose:
        out = out.unionByName(row(top, 4, "narrative", "explain ", F.col("what"), " in ", F.col("period_label")))
        out = out.unionByName(row(top, 5, "draft", "draft a reply to a parliamentary question on ", F.col("what"), " ", F.col("period_label")))
    return out.orderBy("place").limit(limit)
