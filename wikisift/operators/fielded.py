"""Multi-field ranked search with numeric ranges (G9, Q-FIELD, F7, Q-TOP, Q-SHOW).

A term scores in each field by BM25 (Robertson & Zaragoza, 2009), times the boost of
the field; scores of all terms and fields add up.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikisift.functions.expr import once
from wikisift.functions.text import term_vector, token_bag
from wikisift.functions.urls import result_url
from wikisift.operators.ranking import ranked
from wikisift.operators.search import few_terms, hit_order, query_terms, with_bucket
from wikisift.operators.skew import fits_broadcast, join_lookup
from wikisift.sources.tables import bucket_count, choose_buckets, materialize, write_by_term

# Searched fields with their boosts, ranged columns, result limit.
BOOSTS = {"title": 4.0, "text": 1.0, "company": 5.0, "architecture": 5.0, "logic": 5.0}
RANGE_COLUMNS = ("release", "word_size", "clock_speed")
LIMIT = 100
# So many matches are scored in a task.
MATCHES_PER_TASK = 1_000_000
K1, B = 1.2, 0.75

Range = tuple[float | None, float | None]


def _field_tokens(docs: DataFrame, field: str) -> Column:
    if docs.schema[field].dataType.typeName() == "array":
        return F.flatten(F.transform(F.col(field), token_bag))
    return token_bag(F.col(field))


def fielded_vectors(docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """``(field, doc_id, len, terms, ranged columns)`` of fields that have terms, counted inside each row."""
    none = F.array().cast("array<string>")
    entries = F.array(
        *(
            F.struct(F.lit(f).alias("field"), F.coalesce(_field_tokens(docs, f), none).alias("tokens"))
            for f in fields
        )
    )
    carried = _ranged(docs)
    return docs.select("doc_id", *carried, F.inline(entries)).where(F.size("tokens") > 0).select(
        "field",
        "doc_id",
        F.size("tokens").cast("bigint").alias("len"),
        once(term_vector(F.col("tokens"))).alias("terms"),
        *carried,
    )


def _ranged(table: DataFrame) -> list[str]:
    return [c for c in RANGE_COLUMNS if c in table.columns]


def fielded_postings(vectors: DataFrame) -> DataFrame:
    """``(field, term, doc_id, tf, len)``; ``len`` is the length of the document's field.

    The ranged columns stand in every posting, so documents outside a range are left out
    by the scan and never scored.
    """
    carried = _ranged(vectors)
    exploded = vectors.select("field", "doc_id", "len", *carried, F.explode("terms").alias("t"))
    return exploded.select("field", "t.term", "doc_id", "t.tf", "len", *carried)


def field_stats(vectors: DataFrame) -> DataFrame:
    """``(field, n_docs, avg_len)`` over documents in which the field has terms."""
    return vectors.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")
    )


def field_term_stats(postings: DataFrame) -> DataFrame:
    """``(field, term, df)``."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class FieldIndex:
    """Search documents and what a ranked search over their fields reads."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    searched: tuple[str, ...] = tuple(BOOSTS)

    @classmethod
    def build(cls, docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> FieldIndex:
        """A lazy index; save a large one, as every use of a table reads the documents again."""
        vectors = fielded_vectors(docs, fields)
        postings = fielded_postings(vectors)
        return cls(docs, postings, field_term_stats(postings), field_stats(vectors), tuple(fields))

    def save(self, path: str, buckets: int | None = None) -> FieldIndex:
        """Write all tables, replacing an index of an earlier run."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        fielded_vectors(docs, self.searched).write.mode("overwrite").parquet(f"{path}/vectors")
        vectors = spark.read.parquet(f"{path}/vectors")
        rows = vectors.agg(F.sum(F.size("terms.tf"))).first()[0] or 0  # reads no term
        buckets = buckets or choose_buckets(rows)
        keys = ["term", "field", "doc_id"]
        write_by_term(fielded_postings(vectors), f"{path}/postings", keys, buckets, rows)
        postings = spark.read.parquet(f"{path}/postings")
        write_by_term(field_term_stats(postings), f"{path}/terms", ["term", "field"], buckets)
        field_stats(vectors).write.mode("overwrite").parquet(f"{path}/fields")
        return FieldIndex.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FieldIndex:
        names = ("docs", "postings", "terms", "fields")
        tables = [spark.read.parquet(f"{path}/{name}") for name in names]
        return cls(*tables, tuple(r["field"] for r in tables[-1].orderBy("field").collect()))


def in_ranges(ranges: Mapping[str, Range]) -> Column:
    """Condition for inclusive ranges; an end that is None is open."""
    condition = F.lit(True)
    for name, (low, high) in ranges.items():
        if low is not None:
            condition = condition & (F.col(name) >= low)
        if high is not None:
            condition = condition & (F.col(name) <= high)
        if low is None and high is None:
            condition = condition & F.col(name).isNotNull()
    return condition


def _with_occur(queries: DataFrame, *columns: str) -> DataFrame:
    occur = F.col("occur") if "occur" in queries.columns else F.lit(None).cast("string")
    return queries.select(*columns, F.coalesce(occur, F.lit("should")).alias("occur"))


def _query_limits(query_ranges: DataFrame) -> DataFrame:
    """One row per query: for each ranged column whether it is limited, and the tightest ends."""
    own = [F.col("column") == c for c in RANGE_COLUMNS]
    return query_ranges.groupBy("query_id").agg(
        *[F.count(F.when(is_own, 1)).alias(f"limits_{c}") for c, is_own in zip(RANGE_COLUMNS, own)],
        *[F.max(F.when(is_own, F.col("low"))).alias(f"low_{c}") for c, is_own in zip(RANGE_COLUMNS, own)],
        *[F.min(F.when(is_own, F.col("high"))).alias(f"high_{c}") for c, is_own in zip(RANGE_COLUMNS, own)],
    )


def _within_limits(columns: list[str]) -> Column:
    """Condition that a match lies within the limits of its query, if it has any."""
    condition = F.lit(True)
    for c in columns:
        value, low, high = F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")
        inside = value.isNotNull() & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
        condition = condition & ((F.coalesce(F.col(f"limits_{c}"), F.lit(0)) == 0) | inside)
    return condition


def _by_document(postings: DataFrame, weighted: DataFrame) -> DataFrame:
    """The postings of the weighted terms, dealt by document into as many tasks as their matches ask for.

    A posting is moved once and meets all queries behind the shuffle, where a document's
    matches are together. Before it, a task would hold the sums of every query for every
    document of its part of a list.
    """
    matches = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    tasks = -(-matches // MATCHES_PER_TASK)
    if tasks <= 1:
        return postings
    wanted, keys = with_bucket(weighted.select("term", "field", "avg_len").distinct(), postings)
    found = postings.join(F.broadcast(wanted.where(F.col("avg_len") > 0)), [*keys, "field"], "left_semi")
    return found.repartition(tasks, "doc_id")


def fielded_search(
    queries: DataFrame,
    index: FieldIndex,
    boosts: Mapping[str, float] | None = None,
    ranges: Mapping[str, Range] | None = None,
    field_queries: DataFrame | None = None,
    require_all: bool = False,
    limit: int | None = LIMIT,
    query_ranges: DataFrame | None = None,
) -> DataFrame:
    """Best documents of each query: ``(query_id, doc_id, score, rank)``.

    ``queries(query_id, query_text)`` holds terms that are tried in every field of
    ``boosts``; ``field_queries(query_id, field, query_text)`` holds terms for one
    field. Both may have a column ``occur``: ``should`` (or null), ``must``, or ``must_not``
    for terms that no hit may hold. ``ranges`` filters the documents of all queries,
    ``query_ranges(query_id, column, low, high)`` those of one; neither adds to the score.
    ``require_all`` keeps documents that hold every term of the query.
    """
    occurs = "occur" in queries.columns or (field_queries is not None and "occur" in field_queries.columns)
    weights = dict(boosts or BOOSTS)
    boost_entries = F.array(
        *(F.struct(F.lit(f).alias("field"), F.lit(w).alias("boost")) for f, w in weights.items())
    )
    terms = query_terms(_with_occur(queries, "query_id", "query_text")).drop("n_terms")
    wanted = terms.select("query_id", "term", "occur", F.inline(boost_entries), F.col("term").alias("clause"))
    if field_queries is not None:
        own = query_terms(_with_occur(field_queries, "query_id", "field", "query_text"))
        boost = F.coalesce(
            F.element_at(F.create_map(*(F.lit(x) for item in weights.items() for x in item)), F.col("field")),
            F.lit(1.0),
        )
        wanted = wanted.unionByName(
            own.select("query_id", "term", "occur", "field", boost.alias("boost"),
                       F.concat_ws(":", "field", "term").alias("clause"))
        )

    fits = fits_broadcast(wanted)
    keyed, keys = with_bucket(wanted, index.terms)
    weighted = join_lookup(index.terms, keyed, [*keys, "field"], "term", fits).drop("term_bucket")
    # One row per field of the index, a handful.
    weighted = weighted.join(F.broadcast(index.fields), "field")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.select(
        "query_id", "clause", "occur", "term", "field", "avg_len", "df", (F.col("boost") * idf).alias("weight")
    )
    if query_ranges is not None:
        weighted = weighted.join(_query_limits(query_ranges), "query_id", "left")
    postings = index.postings
    late = {c for c in RANGE_COLUMNS if c not in postings.columns}
    early = {c: r for c, r in (ranges or {}).items() if c not in late}
    if early:
        postings = postings.where(in_ranges(early))
    if bucket_count(postings) is not None and fits:
        # The condition always holds; Spark prunes partitions only by a side that has one.
        weighted = materialize(weighted, "query-terms").where(F.col("avg_len") > 0)
        terms = few_terms(weighted)
        postings = postings.where(F.col("term").isin(terms)) if terms else postings
        postings = _by_document(postings, weighted)
    weighted, keys = with_bucket(weighted.drop("df"), postings)
    matches = join_lookup(postings, weighted, [*keys, "field"], "doc_id", fits)
    if query_ranges is not None:
        if late:  # an index without these columns
            matches = matches.join(index.docs.select("doc_id", *[c for c in late if c in index.docs.columns]), "doc_id")
        matches = matches.where(_within_limits(_ranged(matches)))
    tf = F.col("tf").cast("double")
    score = F.col("weight") * tf / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))

    if occurs:
        per_clause = matches.groupBy("query_id", "doc_id", "clause", "occur").agg(F.sum(score).alias("score"))
        must = (F.col("occur") == "must") | (F.lit(require_all) & (F.col("occur") == "should"))
        needed = wanted.where(must).groupBy("query_id").agg(F.count_distinct("clause").alias("needed"))
        hits = per_clause.groupBy("query_id", "doc_id").agg(
            F.sum(F.when(F.col("occur") != "must_not", F.col("score"))).alias("score"),
            F.count(F.when(must, 1)).alias("held"), F.count(F.when(F.col("occur") == "must_not", 1)).alias("barred"),
        )
        needed = F.broadcast(needed) if fits else needed
        hits = hits.where("barred = 0").join(needed, "query_id", "left").where("held = coalesce(needed, 0)")
    elif require_all:
        per_clause = matches.groupBy("query_id", "doc_id", "clause").agg(F.sum(score).alias("score"))
        needed = wanted.groupBy("query_id").agg(F.count_distinct("clause").alias("n_clauses"))
        hits = per_clause.groupBy("query_id", "doc_id").agg(
            F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_clauses")
        )
        needed = F.broadcast(needed) if fits else needed
        hits = hits.join(needed, ["query_id", "n_clauses"], "left_semi").drop("n_clauses")
    else:
        hits = matches.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))
    if set(ranges or ()) & late:
        allowed = index.docs.where(in_ranges(ranges)).select("doc_id")
        hits = hits.join(allowed, "doc_id", "left_semi")
    return ranked(hits.select("query_id", "doc_id", "score"), "query_id", hit_order(), limit)


def range_search(docs: DataFrame, ranges: Mapping[str, Range], limit: int | None = LIMIT) -> DataFrame:
    """Documents within the ranges in id order, for a search without terms."""
    found = docs.where(in_ranges(ranges)).select("doc_id", F.lit(0.0).alias("score")).orderBy("doc_id")
    return found if limit is None else found.limit(limit)


def show_hits(hits: DataFrame, docs: DataFrame, extern_base: str, site_base: str) -> DataFrame:
    """Add title and result URLs to hits (Q-SHOW, P15).

    The hits are written first: the best few per query are then a small table that
    Spark broadcasts by its known size, instead of shuffling all documents.
    """
    shown = docs.select(
        "doc_id",
        "title",
        result_url(F.col("extern_title"), extern_base).alias("extern_url"),
        result_url(F.col("site_title"), site_base).alias("site_url"),
    )
    return materialize(hits, "hits").join(shown, "doc_id")
