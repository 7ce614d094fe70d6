"""Counts of tags and terms: SUMMARIZE, TF-IDF, token frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquery.functions import text as fn
from leafquery.lang.lexer import QueryError

# Common English words that carry no topic.
STOPWORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its of on or she that the their they to was were with you".split()
)
#: Comments, scripted elements to their ends, and tags; what is not closed goes to the end of the text.
_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<noscript.*?(?:</noscript>|\z)|<[^>]*+(?:>|\z)"


def tokens(markup: Column) -> Column:
    """Lower-case runs of letters, digits and _ of the text in some markup, without scripts, styles and comments."""
    plain = F.regexp_replace(markup, _MARKUP, "")
    return F.filter(F.split(fn.lower(plain), r"[^a-z0-9_]+"), lambda t: t != "")


def summarize(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (…, tag): how often each tag occurs for each value of by."""
    return rows.groupBy(*by, "tag").agg(F.count("*").alias("count"))


def counted(tags: Column) -> Column:
    """How often each of some tags occurs, as (tag, count), within the row: sorted, a tag goes up to where the next begins."""

    def of(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda t, k: F.when((k == 0) | (t != F.get(s, k - 1)), k)), lambda k: k.isNotNull())
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda k, at: F.struct(F.get(s, k).alias("tag"), (F.coalesce(F.get(b, at + 1), F.size(s)) - k).cast("long").alias("count"))))[0]

    return F.transform(F.array(F.sort_array(tags)), of)[0]


def tfidf(rows: DataFrame, by: list[str], top: int = 30, min_df: int = 1, max_df: int = 0, stopwords: bool = True) -> DataFrame:
    """rows (by…, node_id, parent_id, tag, terms): terms_score, a map of each row's best terms. A doc_id that is not in by
    still tells rows of several documents apart.

    The matched rows of a group are the documents. Terms are counted before anything is shuffled; the rows of a group
    are counted by the same partial sums.
    """
    keep = [c for c in ("doc_id", "node_id", "parent_id", "tag") if c in rows.columns and c not in by]
    terms = F.filter("terms", lambda t: ~t.isin(*sorted(STOPWORDS))) if stopwords else F.col("terms")
    rows = rows.withColumn("terms", terms)
    counted = rows.select(*by, *keep, F.size("terms").alias("total"), F.explode("terms").alias("term")).groupBy(*by, *keep, "total", "term").agg(F.count("*").alias("c"))
    df = counted.groupBy(*by, "term").agg(F.count("*").alias("df"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    scored = counted.join(df, [*by, "term"])
    scored = scored.join(n, by) if by else scored.crossJoin(F.broadcast(n))  # n is one row
    scored = scored.where((F.col("df") >= min_df) & ((F.lit(max_df) == 0) | (F.col("df") <= max_df)))
    scored = scored.withColumn("score", F.col("c") / F.col("total") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    best = Window.partitionBy(*by, *keep).orderBy(F.desc("score"), "term")
    top_terms = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    maps = top_terms.groupBy(*by, *keep).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "score")))).alias("terms_score"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, *keep]]
    joined = rows.select(*by, *keep).alias("l").join(maps.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.{c}") for c in [*by, *keep]], F.coalesce("r.terms_score", F.create_map().cast("map<string,double>")).alias("terms_score"))


#: lang -> texts as a column to arrays of tokens as a column.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {}


def register_tokenizer(lang: str, split: Callable[[str], list[str]] | None = None, column: Callable[[Column], Column] | None = None) -> None:
    """How summarize_content reads texts of a language: a function of a column, or one of a text, which then runs in
    Arrow batches on the executors."""
    if column is None:
        run = F.pandas_udf(lambda texts: texts.map(lambda t: [] if t is None else [str(x) for x in split(t)]), "array<string>")
        column = run
    TOKENIZERS[lang.lower()] = column


def summarize_content(docs: DataFrame, text: str = "text", max_tokens: int = 20, by: list[str] | None = None, lang: str | None = None) -> DataFrame:
    """The most frequent tokens of each group (or of everything): token, count, score = count / total. lang: a registered
    tokenizer's."""
    by = by or []
    if lang is not None and lang.lower() not in TOKENIZERS:
        raise QueryError("RUN-0002", f"no tokenizer is registered for {lang}")
    split = tokens if lang is None else TOKENIZERS[lang.lower()]
    counts = docs.select(*by, F.explode(split(F.col(text))).alias("token")).where(~F.col("token").isin(*sorted(STOPWORDS))).groupBy(*by, "token").agg(F.count("*").alias("count"))
    total = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    counts = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
    counts = counts.withColumn("score", F.col("count") / F.col("total")).drop("total")
    if not by:
        return counts.orderBy(F.desc("score"), F.desc("count"), "token").limit(max_tokens)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("count"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_tokens).drop("rank")
