"""Tokens, TF-IDF keyphrases, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# English and domain words without content.
ENGLISH = """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down
during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on
once only or other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to
too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves""".split()
DOMAIN = """coal production limited tonnes tonne mining mine mines india indian company corporation ltd lt total sub grand annual monthly month year years figures figure table
page annexure annexures statement statements report reports performance target targets actual achievement percentage percent growth cumulative quantity qty value values unit
units lakh lakhs crore crores million tons mt te number no sl sr note notes source sources subsidiary subsidiaries overall provisional revised during period periods""".split()
STOPWORDS = sorted({w for w in [*ENGLISH, *DOMAIN] if len(w) >= 4})
MIN_OCCURRENCES, TOP = 2, 60


def tokens(text: Column) -> Column:
    """Lower-case words of four letters or more without stop words; inner hyphens and apostrophes stay."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]{3,}"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"^[-']+|[-']+$", "")))
    return F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS))


def counted(words: Column) -> Column:
    """Distinct words with their number, as (term, occurrences): sorted, then cut where the word changes."""
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda b, j: F.struct(F.get(s, b).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - b).cast("long").alias("occurrences")))
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return let(F.array_sort(words), lambda s: let(starts(s), lambda at: runs(s, at)))


def term_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, term, occurrences, most (of the document's terms); a document is a row."""
    rows = docs.select(F.col(key), counted(tokens(F.col(text))).alias("_t"))
    rows = rows.withColumn("most", F.array_max(F.transform("_t", lambda t: t["occurrences"])))
    return rows.select(key, "most", F.inline("_t")).select(key, "term", "occurrences", "most")


def _scored(counts: DataFrame, frequency: DataFrame, total: Column, key: str, top: int) -> DataFrame:
    rows = counts.where(F.col("occurrences") >= MIN_OCCURRENCES).join(frequency, "term")
    tf = (1 + F.log("occurrences")) / (1 + F.log("most"))
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    rows = rows.select(key, "term", "occurrences", F.round(tf * idf, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def tfidf(docs: DataFrame, text: str = "text", key: str = "doc_id", top: int = TOP) -> DataFrame:
    """Best terms of each document; the largest count is taken before rare terms go. Only the terms' frequencies, the join with them
    and the ranking move rows."""
    counts = term_counts(docs, text, key)
    total = docs.agg(F.count("*").alias("n"))  # one row
    frequency = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    return _scored(counts, frequency, F.col("n"), key, top)


def tfidf_of_new(new: DataFrame, phrases: DataFrame, text: str = "text", key: str = "doc_id", top: int = TOP) -> DataFrame:
    """Terms of ``new`` documents against the stored phrases of the others: an approximation between two full passes. Each new
    document counts itself once, also when it was stored before."""
    others = phrases.join(new.select(key).distinct(), key, "left_anti")
    counts = term_counts(new, text, key)
    total = others.agg((F.countDistinct(key) + 1).alias("n"))  # one row
    known = others.groupBy("term").agg(F.countDistinct(key).alias("df"))
    frequency = counts.select("term").distinct().join(known, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + 1).alias("df"))
    return _scored(counts, frequency.crossJoin(F.broadcast(total)), F.col("n"), key, top)


def cloud(phrases: DataFrame, documents: DataFrame, limit: int = 120, **filters: str) -> DataFrame:
    """Terms by the number of documents that have them."""
    rows = documents
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    joined = phrases.join(rows.select("doc_id"), "doc_id")
    out = joined.groupBy("term").agg(F.countDistinct("doc_id").alias("document_count"), F.sum("occurrences").alias("occurrences"), F.max("score").alias("score"))
    return out.orderBy(F.desc("document_count"), F.desc("score"), "term").limit(limit)


def cloud_sizes(terms: DataFrame, sizes: int = 5) -> DataFrame:
    """Display bucket 0..sizes-1 of each term of a (short) cloud."""
    span = terms.agg(F.min("document_count").alias("lo"), F.max("document_count").alias("hi"))  # one row
    ratio = (F.col("document_count") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    return terms.crossJoin(F.broadcast(span)).select("term", "document_count", F.least(F.lit(sizes - 1), F.floor(ratio * sizes)).cast("int").alias("size"))


def prevalence(phrases: DataFrame, documents: DataFrame, term: str, by: str = "fiscal_year") -> DataFrame:
    """Documents that have a term, by fiscal year."""
    rows = documents.where(F.col(by).isNotNull()).select("doc_id", by)
    return phrases.where(F.col("term") == term).join(rows, "doc_id").groupBy(by).agg(F.countDistinct("doc_id").alias("documents"))


def documents_for(phrases: DataFrame, documents: DataFrame, term: str) -> DataFrame:
    return phrases.where(F.col("term") == term).join(documents.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "term", "lang", "source", "occurrences", "score")
