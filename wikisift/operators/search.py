"""Ranked search over postings, for one query or a table of queries (J2, Q-*)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikisift.functions.text import tokens
from wikisift.operators.blocks import Report, keep_candidates, top_by_blocks
from wikisift.operators.postings import TextIndex
from wikisift.operators.ranking import ranked
from wikisift.operators.skew import BROADCAST_ROWS, fits_broadcast, join_lookup
from wikisift.sources.tables import bucket_count, materialize, with_bucket

TF_MODES = ("raw", "log", "max")
# Batches of up to this many queries are summed up on the driver.
SMALL_BATCH = 1000
# So many of the shortest lists of a query find its candidates.
RARE_TERMS = 4
MODE_COLUMNS = ("similarity", "tf", "normalize")


def query_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query_text string")


def query_terms(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    """``(query_id, n_terms, term, ...)`` with the distinct tokens of each query."""
    others = [c for c in queries.columns if c not in ("query_id", text_col)]
    distinct = queries.withColumn("_terms", F.array_distinct(tokens(F.col(text_col))))
    return distinct.select(
        "query_id", *others, F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term")
    )


def hit_order() -> list[Column]:
    """Best score first, then document id (Q-RANK).

    Distributed sums add in any order, so equal scores may differ in their last bits;
    compared at nine decimals they tie the same way in every run.
    """
    return [F.desc(F.round("score", 9)), F.asc("doc_id")]


@dataclass(frozen=True)
class _ListSizes:
    """What the document frequencies tell about a search before any posting is read."""

    total: int
    shortest: int
    rare: int
    terms: list[str]


def _list_sizes(weighted: DataFrame) -> _ListSizes:
    """Rows of all posting lists, of the shortest one and the few shortest ones of each query, and the terms if few.

    Spark pushes a list of values down to Parquet whole only up to a number of them;
    with more terms the buckets alone have to do.
    """
    rarest = F.slice(F.sort_array(F.collect_list("df")), 1, RARE_TERMS)
    per_query = weighted.groupBy("query_id").agg(
        F.sum("df").alias("total"),
        F.min("df").alias("shortest"),
        F.aggregate(rarest, F.lit(0).cast("bigint"), lambda total, df: total + df).alias("rare"),
        F.slice(F.collect_set("term"), 1, _pushed_values(weighted) + 1).alias("terms"),
    )
    rows = per_query.limit(SMALL_BATCH + 1).collect()
    if len(rows) > SMALL_BATCH:
        sums = per_query.agg(*(F.sum(c).alias(c) for c in ("total", "shortest", "rare"))).first()
        return _ListSizes(sums.total, sums.shortest, sums.rare, [])
    terms = {term for row in rows for term in row.terms}
    few = sorted(terms) if len(terms) <= _pushed_values(weighted) else []
    return _ListSizes(*(sum(r[c] for r in rows) for c in ("total", "shortest", "rare")), few)


def few_terms(weighted: DataFrame) -> list[str]:
    """The distinct terms, if no more than a scan takes as a list; else none."""
    most = _pushed_values(weighted)
    terms = [row.term for row in weighted.select("term").distinct().limit(most + 1).collect()]
    return terms if len(terms) <= most else []


def _pushed_values(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))


def _prune(matches: DataFrame, weighted: DataFrame, postings: DataFrame) -> DataFrame:
    """Keep only matches in documents that hold the rarest term of their query.

    A hit has to hold every term, so the shortest posting list of a query bounds its
    hits. These lists are broadcast, and the long lists of common words shrink to the
    candidates before anything is shuffled.
    """
    rarest = weighted.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("rarest"))
    rarest = rarest.select("query_id", "rarest.df", "rarest.term")
    keyed, keys = with_bucket(rarest.where(F.col("df") > 0).drop("df"), postings)
    holding = postings.join(F.broadcast(keyed), keys).select("query_id", "doc_id")
    return matches.join(F.broadcast(holding), ["query_id", "doc_id"], "left_semi")


def _prune_by_rare_terms(matches: DataFrame, weighted: DataFrame, index: TextIndex, prune_rows: int) -> DataFrame:
    """The same where the rarest lists are too long to be broadcast: keep only matches in documents that hold the rare terms of their query.

    The few shortest lists of each query are intersected by a shuffle. What is left, near
    the number of hits, is broadcast if it fits. Else it meets the document vectors by
    document, one shuffle that goes with the tables of documents and candidates and not
    with the lists of common words.
    """
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    rare = weighted.withColumn("_nth", F.row_number().over(rarest)).where(F.col("_nth") <= RARE_TERMS)
    rare = rare.select("query_id", "term", F.least("n_terms", F.lit(RARE_TERMS)).alias("_wanted"))
    keyed, keys = with_bucket(materialize(rare, "rare-terms").where(F.col("_wanted") > 0), index.postings)
    holding = index.postings.join(F.broadcast(keyed), keys).groupBy("query_id", "doc_id", "_wanted").agg(F.count(F.lit(1)).alias("_held"))
    holding = materialize(holding.where(F.col("_held") == F.col("_wanted")).select("query_id", "doc_id"), "candidates")
    if holding.count() <= prune_rows:
        return matches.join(F.broadcast(holding), ["query_id", "doc_id"], "left_semi")
    vectors = index.vectors.select("doc_id", "terms", "tf_max", "sum_sq")
    met = holding.hint("merge").join(vectors, "doc_id").select("query_id", "doc_id", "tf_max", "sum_sq", F.inline("terms"))
    return met.join(F.broadcast(weighted.drop("df")), ["query_id", "term"])


def _checked(tf: str, normalize: str | None, similarity: str) -> dict[str, str]:
    if tf not in TF_MODES or normalize not in (None, "euc") or similarity not in ("tfidf", "cos"):
        raise ValueError(f"Unknown mode: tf={tf!r} normalize={normalize!r} similarity={similarity!r}")
    return {"tf": tf, "normalize": normalize or "none", "similarity": similarity}


def _weighted_terms(queries: DataFrame, index: TextIndex) -> tuple[DataFrame, list[str], bool]:
    """Terms of the queries whose terms are all known, the columns that set modes, and whether they fit a broadcast."""
    per_query = [c for c in MODE_COLUMNS if c in queries.columns]
    terms = query_terms(queries.select("query_id", "query_text", *per_query))
    terms = terms.withColumnsRenamed({c: f"q_{c}" for c in per_query})
    fits = fits_broadcast(terms)
    # At most as many rows as there are query terms, so what fits before fits after.
    weighted = index.lookup(terms, fits)
    # A query with an unknown term has no hits, so none of its other lists is read.
    known = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return weighted.withColumn("_known", known).where(F.col("_known") == F.col("n_terms")).drop("_known"), per_query, fits


def _hits(matches: DataFrame, defaults: dict[str, str], per_query: list[str]) -> DataFrame:
    """``(query_id, doc_id, score)`` of the documents whose matches are all terms of a query."""

    def mode(name: str) -> Column:
        default = F.lit(defaults[name])
        return F.coalesce(F.col(f"q_{name}"), default) if name in per_query else default

    raw = F.col("tf").cast("double")
    weight = (
        F.when(mode("tf") == "log", F.lit(1.0) + F.log(raw))
        .when(mode("tf") == "max", F.lit(0.5) + F.lit(0.5) * raw / F.col("tf_max"))
        .otherwise(raw)
    )
    cosine = mode("similarity") == "cos"
    term_score = F.when(cosine, raw).otherwise(weight * F.col("idf"))
    euclid = F.sqrt(F.col("sum_sq").cast("double"))

    per_doc = matches.groupBy("query_id", "doc_id", "n_terms", *(f"q_{c}" for c in per_query)).agg(
        F.sum(term_score).alias("total"),
        F.count(F.lit(1)).alias("matched"),
        F.max("sum_sq").alias("sum_sq"),
    )
    score = (
        F.when(cosine, F.col("total") / (euclid * F.sqrt(F.col("n_terms").cast("double"))))
        .when(mode("normalize") == "euc", F.col("total") / euclid)
        .otherwise(F.col("total"))
    )
    return per_doc.where(F.col("matched") == F.col("n_terms")).select("query_id", "doc_id", score.alias("score"))


def search(
    queries: DataFrame,
    index: TextIndex,
    tf: str = "raw",
    normalize: str | None = None,
    similarity: str = "tfidf",
    limit: int | None = None,
    rank: bool = True,
    prune_rows: int | None = None,
) -> DataFrame:
    """Documents that hold all tokens of a query: ``(query_id, doc_id, score, rank)``.

    ``tf`` is ``raw``, ``log`` (1 + ln tf) or ``max`` (0.5 + 0.5 tf / tf_max);
    ``normalize="euc"`` scales by the Euclidean length of the document;
    ``similarity="cos"`` uses a binary query vector and ignores both. A column of the
    same name in ``queries`` sets a mode per query. Ranks follow descending score,
    then ascending document id. ``limit`` keeps the best hits of each query; without
    ``rank`` the complete hits are returned unordered. Lists of more than ``prune_rows``
    postings (as many as are broadcast, unless given) are cut before the shuffle, to the documents of the rarest term of the query
    if they are no more than that, else by the bitmaps of the index, if it has them, else to
    the documents of its few rarest terms, where these lists are the smaller part.
    """
    defaults = _checked(tf, normalize, similarity)
    weighted, per_query, fits = _weighted_terms(queries, index)
    stored = bucket_count(index.postings) is not None
    if stored:
        # The condition always holds; Spark prunes partitions only by a side that has one.
        weighted = materialize(weighted, "query-terms").where(F.col("n_terms") > 0)
    postings, long, short = index.postings, False, False
    if stored and fits:
        lists = _list_sizes(weighted)
        prune_rows = BROADCAST_ROWS if prune_rows is None else prune_rows
        long, short = lists.total > prune_rows, lists.shortest <= prune_rows
        if lists.terms:
            # Files are sorted by term: the scan skips the row groups and pages of others.
            postings = postings.where(F.col("term").isin(lists.terms))
    keyed, keys = with_bucket(weighted.drop("df"), postings)
    matches = join_lookup(postings, keyed, keys, "doc_id", fits)
    if long and short:
        matches = _prune(matches, weighted, postings)
    elif long and index.bitmaps is not None:
        matches = keep_candidates(matches, weighted, index.bitmaps)
    elif long and lists.rare <= lists.total / 2:
        matches = _prune_by_rare_terms(matches, weighted, index, prune_rows)
    hits = _hits(matches, defaults, per_query)
    if not rank and limit is None:
        return hits
    return ranked(hits, "query_id", hit_order(), limit)


def search_best(
    queries: DataFrame, index: TextIndex, limit: int, tf: str = "raw", normalize: str | None = None, similarity: str = "tfidf",
) -> tuple[DataFrame, Report]:
    """What :func:`search` finds with a ``limit``, by the block maxima of the index, and the postings read (Q-TOP).

    Ranges of documents whose bound does not reach the last hit wanted are not read. Modes
    per query and sets of queries beyond a broadcast go through :func:`search`.
    """
    defaults = _checked(tf, normalize, similarity)
    weighted, per_query, fits = _weighted_terms(queries, index)
    if index.blocks is None or per_query or not fits:
        found = materialize(weighted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df")), "list-sizes").first()[0]
        return search(queries, index, tf, normalize, similarity, limit), Report(found, found)
    weighted = materialize(weighted, "query-terms").where(F.col("n_terms") > 0)
    cosine = similarity == "cos"
    kind = "raw_euc" if cosine else tf + ("_euc" if normalize else "")
    factor = 1 / F.sqrt(F.col("n_terms").cast("double")) if cosine else F.col("idf")
    return top_by_blocks(
        weighted, index, limit, kind, factor,
        lambda matches: _hits(matches, defaults, per_query), lambda hits: ranked(hits, "query_id", hit_order(), limit),
    )


def top_hits(hits: DataFrame, limit: int = 100) -> DataFrame:
    """Best hits of a single query in order (Q-TOP): each task keeps its own best ones."""
    return hits.orderBy(*hit_order()).limit(limit)
