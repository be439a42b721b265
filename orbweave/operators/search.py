"""Ranked full-text search: tokens, postings, BM25 over title and content, highlights."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.schemas import FRAGMENT_CHARS, FRAGMENTS, HIGHLIGHT_POST, HIGHLIGHT_PRE

K1, B = 1.2, 0.75
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits. Text without blanks (Chinese, Japanese) is not segmented further."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda t: t != "")


def query_terms(keyword: str) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", keyword.lower()) if t))


def postings(docs: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(term, key, tf, length) of one field."""
    tokenised = docs.select(key, tokens(F.col(field)).alias("t")).withColumn("length", F.size("t"))
    return tokenised.select(key, "length", F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def field_statistics(docs: DataFrame, field: str) -> DataFrame:
    """Documents with the field, and their mean length."""
    length = F.size(tokens(F.col(field)))
    return docs.select(length.alias("n")).filter("n > 0").agg(F.count("*").alias("documents"), F.avg("n").alias("mean_length"))


def bm25(docs: DataFrame, field: str, terms: list[str], key: str = "id", statistics: DataFrame | None = None) -> DataFrame:
    """(key, score) of the documents that hold at least one of the terms.

    Term counts are taken per document without exploding it, so only hits leave the scan. Number of documents
    and mean length (one row) come to the driver; document frequencies are one row a query term.
    """
    statistics = docs if statistics is None else statistics
    bag = docs.select(key, tokens(F.col(field)).alias("t"))
    wanted = F.array(*(F.lit(t) for t in terms))
    hits = (
        bag.filter(F.arrays_overlap("t", wanted))
        .select(key, F.size("t").alias("length"), F.explode(F.filter("t", lambda t: t.isin(terms))).alias("term"))
        .groupBy(key, "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    corpus = field_statistics(statistics, field).first()
    n, mean = float(corpus["documents"] or 0), float(corpus["mean_length"] or 1.0)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    df, tf, dl = (F.col(c).cast("double") for c in ("df", "tf", "length"))
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))
    return hits.join(F.broadcast(frequency), "term").groupBy(key).agg(F.sum(part).alias("score"))


#: Buckets of terms in which postings are stored, and the row under which a field's totals stand.
TERM_BUCKETS, TOTALS = 64, ""


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def inverted(docs: DataFrame, fields: tuple[str, ...] = ("title", "content"), key: str = "id") -> DataFrame:
    """(bucket, field, term, key, version, tf, length): the inverted index, and per field and document a row with the empty term for the totals.

    Stored by bucket, a search reads the buckets of its terms and that of the totals, whatever the number of documents.
    """
    parts = []
    for field in fields:
        bag = docs.select(key, "version", tokens(F.col(field)).alias("t")).withColumn("length", F.size("t")).filter("length > 0")
        terms = bag.select(key, "version", "length", F.explode("t").alias("term")).groupBy("term", key, "version").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
        totals = bag.groupBy().agg(F.count("*").alias("tf"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        none = F.lit(None)
        totals = totals.select(F.lit(TOTALS).alias("term"), none.cast("bigint").alias(key), none.cast("int").alias("version"), "tf", F.col("length").cast("bigint").alias("length"))
        parts += [x.select(F.lit(field).alias("field"), "term", key, "version", "tf", F.col("length").cast("bigint").alias("length")) for x in (terms, totals)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("bucket", term_bucket(F.col("term"))).repartition("bucket")


def bm25_of_postings(postings: DataFrame, field: str, terms: list[str], key: str = "id") -> DataFrame:
    """`bm25` from stored postings: (key, version, score). Only the buckets of the terms and of the totals are read."""
    wanted = F.array(*(F.lit(t) for t in terms))
    # bucket numbers as literals, so partitions are pruned
    spark = postings.sparkSession
    numbers = {r[0] for r in spark.createDataFrame([(t,) for t in [*terms, TOTALS]], "term string").select(term_bucket(F.col("term"))).collect()}
    mine = postings.filter(F.col("bucket").isin(*numbers) & (F.col("field") == field))
    hits = mine.filter(F.array_contains(wanted, F.col("term")))
    totals = mine.filter(F.col("term") == TOTALS).agg(F.sum("tf").alias("n"), (F.sum("length") / F.sum("tf")).alias("mean")).first()
    n, mean = float(totals["n"] or 0), float(totals["mean"] or 1.0)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    df, tf, dl = (F.col(c).cast("double") for c in ("df", "tf", "length"))
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))
    return hits.join(F.broadcast(frequency), "term").groupBy(key, "version").agg(F.sum(part).alias("score"))


def scored(docs: DataFrame, keyword: str, version: int | None = -1, cat: str | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Documents that match, with their score: a term has to be in the title, content only adds.

    Version below 0 and blank category do not filter; a blank keyword matches everything with score 1. Statistics
    are those of the whole index, as the filters do not change them. With `postings` (see inverted) texts are not read for it.
    """
    found = docs
    if version is not None and version >= 0:
        found = found.filter(F.col("version") == version)
    if cat:
        found = found.filter(F.col("cat") == cat)
    terms = query_terms(keyword or "")
    if not terms:
        return found.withColumn("score", F.lit(1.0)) if not (keyword or "").strip() else found.limit(0).withColumn("score", F.lit(0.0))
    if postings is not None:
        title = bm25_of_postings(postings, "title", terms).withColumnRenamed("score", "title_score")
        content = bm25_of_postings(postings, "content", terms).withColumnRenamed("score", "content_score")
        both = title.alias("t").join(content.alias("c"), (F.col("t.id") == F.col("c.id")) & F.col("t.version").eqNullSafe(F.col("c.version")), "left")
        scores = both.select("t.id", "t.version", (F.col("title_score") + F.coalesce("content_score", F.lit(0.0))).alias("score"))
        same = (F.col("d.id") == F.col("s.id")) & F.col("d.version").eqNullSafe(F.col("s.version"))
        return found.alias("d").join(scores.alias("s"), same).select("d.*", "s.score")
    title = bm25(docs, "title", terms, statistics=docs).withColumnRenamed("score", "title_score")
    content = bm25(docs, "content", terms, statistics=docs).withColumnRenamed("score", "content_score")
    scores = title.join(content, "id", "left").select("id", (F.col("title_score") + F.coalesce("content_score", F.lit(0.0))).alias("score"))
    return found.join(scores, "id")


def top(hits: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """A page of hits, best first, ties by id and version."""
    return hits.orderBy(F.desc("score"), "id", "version").offset((max(1, number) - 1) * size).limit(size)


def fragments(text: str | None, terms: list[str], chars: int = FRAGMENT_CHARS, most: int = FRAGMENTS) -> str | None:
    """Best windows of about `chars` characters at word boundaries with the terms marked, joined by a blank.

    Without a hit, the first window. Windows rank by hits, then by place; they come in the order of the text.
    """
    if text is None:
        return None
    pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, terms)) + r")(?!\w)", re.I) if terms else None
    windows, at = [], 0
    while at < len(text):
        end = min(len(text), at + chars)
        if end < len(text):
            cut = text.rfind(" ", at, end + 1)
            end = cut if cut > at else end
        windows.append(text[at:end].strip())
        at = end + (1 if end < len(text) and text[end] == " " else 0)
    if pattern is None or not windows:
        return windows[0] if windows else ""
    ranked = sorted(((len(pattern.findall(w)), -i) for i, w in enumerate(windows)), reverse=True)
    chosen = sorted(-i for hits, i in ranked[:most] if hits)
    if not chosen:
        return windows[0]
    return " ".join(pattern.sub(rf"{HIGHLIGHT_PRE}\1{HIGHLIGHT_POST}", windows[i]) for i in chosen)


def highlighted(page: DataFrame, keyword: str, columns: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """A page of hits with marked fragments in place of the fields; to be used after the limit."""
    terms = query_terms(keyword)

    @F.pandas_udf("string")
    def mark(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fragments(t, terms))

    return page.withColumns({c: mark(F.col(c)) for c in columns})


def search(
    docs: DataFrame, keyword: str, version: int | None = -1, cat: str | None = None, number: int = 1, size: int = 10,
    postings: DataFrame | None = None,
) -> DataFrame:
    """One page of results, ranked, highlighted, with the time as a timestamp."""
    page = top(scored(docs, keyword, version, cat, postings), number, size)
    marked = highlighted(page, keyword) if query_terms(keyword or "") else page
    return marked.withColumn("create_time", F.timestamp_millis("create_time"))


def hit_count(docs: DataFrame, keyword: str, version: int | None = -1, cat: str | None = None) -> DataFrame:
    """Number of documents that match."""
    return scored(docs, keyword, version, cat).agg(F.count("*").alias("hits"))
