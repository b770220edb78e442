"""Term statistics of a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikisift.functions.expr import let, once
from wikisift.functions.text import term_vector, token_bag
from wikisift.operators.blocks import BITMAP_LEAST, BLOCK_ROWS, write_blocks
from wikisift.operators.skew import join_lookup
from wikisift.sources.tables import choose_buckets, with_bucket, write_by_term


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, terms array<struct<term,tf>>, tf_max, sum_sq, len)``: no shuffle.

    Terms are counted inside each row. Documents are identified by ``id_col``, one row
    each. ``sum_sq`` is the sum of squared term counts, ``len`` the number of tokens.
    """
    counted = let(token_bag(F.col(text_col)), lambda bag: F.struct(term_vector(bag).alias("terms"), F.size(bag).alias("len")))
    vectors = docs.select(F.col(id_col).alias("doc_id"), once(counted).alias("c"))
    zero = F.lit(0).cast("bigint")
    return vectors.select(
        "doc_id",
        "c.terms",
        F.coalesce(F.array_max(F.col("c.terms.tf")), zero).alias("tf_max"),
        F.aggregate("c.terms.tf", zero, lambda total, tf: total + tf * tf).alias("sum_sq"),
        F.when(F.size("c.terms") > 0, F.col("c.len")).otherwise(0).cast("bigint").alias("len"),
    )


def postings_of(vectors: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, tf_max, sum_sq)``, one row per term of a document (G1).

    The two document-level numbers stand in every posting, so that no ranking mode
    has to join the hits with a table of all documents; unused ones are not read.
    They come from an earlier step: next to the explode they would be computed per term.
    """
    exploded = vectors.select("doc_id", "tf_max", "sum_sq", F.explode("terms").alias("t"))
    return exploded.select("t.term", "doc_id", "t.tf", "tf_max", "sum_sq")


def doc_stats(vectors: DataFrame) -> DataFrame:
    """``(doc_id, tf_max, euc, len)`` of documents with at least one term."""
    euc = 1 / F.sqrt(F.col("sum_sq").cast("double"))
    return vectors.where(F.col("len") > 0).select("doc_id", "tf_max", euc.alias("euc"), "len")


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return postings_of(document_vectors(docs, id_col, text_col))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df)``."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_idf(stats: DataFrame, doc_count: DataFrame) -> DataFrame:
    """Add ``idf = ln(N / df)`` (G4); ``doc_count`` has one row and one column, N."""
    return stats.withColumn("idf", F.log(doc_count.scalar() / F.col("df")))


def count_docs(stats: DataFrame) -> DataFrame:
    """Number of documents with terms, as a one-row table."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"))


@dataclass(frozen=True)
class TextIndex:
    """The tables a search reads: document vectors, postings, terms ``(term, df, idf)``; see ``blocks`` for the last two."""

    vectors: DataFrame
    postings: DataFrame
    terms: DataFrame
    bitmaps: DataFrame | None = None
    blocks: DataFrame | None = None

    @property
    def docs(self) -> DataFrame:
        return doc_stats(self.vectors)

    @classmethod
    def of_vectors(cls, vectors: DataFrame) -> TextIndex:
        postings = postings_of(vectors)
        return cls(vectors, postings, with_idf(term_stats(postings), count_docs(doc_stats(vectors))))

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """A lazy index; save a large one, as every use of a table reads the documents again."""
        return cls.of_vectors(document_vectors(docs, id_col, text_col))

    def lookup(self, terms: DataFrame, fits: bool) -> DataFrame:
        """``df`` and ``idf`` of each row of ``terms`` whose term is known; ``fits`` says that they may be broadcast."""
        keyed, keys = with_bucket(terms, self.terms)
        return join_lookup(self.terms, keyed, keys, "term", fits).drop("term_bucket")

    def save(
        self, path: str, buckets: int | None = None, blocks: bool = False, bitmap_least: int = BITMAP_LEAST, block_rows: int = BLOCK_ROWS
    ) -> TextIndex:
        """Write all tables. Texts are tokenised once: the rest is read from the vectors.

        With ``blocks``, also the bitmaps of lists of ``bitmap_least`` documents and more, and
        the maxima of blocks of about ``block_rows`` postings.
        """
        spark = self.vectors.sparkSession
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        vectors = spark.read.parquet(f"{path}/vectors")
        rows = vectors.agg(F.sum(F.size("terms.tf"))).first()[0] or 0  # reads no term
        buckets = buckets or choose_buckets(rows)
        write_by_term(postings_of(vectors), f"{path}/postings", ["term", "doc_id"], buckets, rows)
        postings = spark.read.parquet(f"{path}/postings")
        # Counted by the bucket too, as the table is stored: the shuffle after it is by the same columns.
        counts = postings.groupBy("term_bucket", "term").agg(F.count(F.lit(1)).alias("df")).select("term", "df")
        terms = with_idf(counts, count_docs(doc_stats(vectors)))
        write_by_term(terms, f"{path}/terms", ["term"], buckets)
        if blocks:
            write_blocks(TextIndex.load(spark, path), path, buckets, bitmap_least, block_rows)
        return TextIndex.load(spark, path, blocks)

    @classmethod
    def load(cls, spark: SparkSession, path: str, blocks: bool = False) -> TextIndex:
        tables = ("vectors", "postings", "terms", *("bitmaps", "blocks") * blocks)
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in tables))


def documents_of_term(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("doc_id", "tf")


def terms_of_document(vectors: DataFrame, doc_id: int) -> DataFrame:
    return vectors.where(F.col("doc_id") == doc_id).select(F.inline("terms"))


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``known`` yet."""
    return df.join(known.select(key), key, "left_anti")
