
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce, wraps
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles
from wikisift.functions import presets
from wikisift.functions import text as T
from wikisift.functions import urls as U
from wikisift.functions import values as V
from wikisift.functions.attributes import Attribute, Source, extract_attributes
from wikisift.functions.expr import is_blank
from wikisift.operators import fielded, links, pages, postings, ranking, searchdocs
from wikisift.operators.search import query_table, search, search_best, top_hits
from wikisift.plans import dump_pipeline, table_wiki
from wikisift.sources.dump import read_dump
from wikisift.sources.site import distinct_pages
from wikisift.sources.tables import materialize, scratch_dir, spread, stream_table
from wikisift.streaming import incremental
from wikisift.streaming.segments import compact, create_index

# The operators for training data are an optional part; if they are there, whatever they lack is an error.
if find_spec("corpus_pipeline") and find_spec("wikisift.llm") and find_spec("wikisift.llm.queries"):
    import corpus_pipeline
    from wikisift.llm import queries as llm
else:
    corpus_pipeline = llm = None

SITE = "https://"
EXTERN_BASE, SITE_BASE = "https://en.wikipedia.org/wiki/", "https://site.example/wiki/"
TWO_TERMS = "the and"

Query = Callable[[SparkSession, str], DataFrame]
_stored: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "part") else df


def stored(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[str], object]):
    """An index is built once per session and input, then read by every search."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        run = spark.range(1).select(F.uuid()).first()[0]
        _stored[key] = build(f"{scratch_dir(spark)}/{kind}-{run}")
    return _stored[key]


def document_index(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    return stored(
        "documents", spark, sf_dir,
        lambda path: postings.TextIndex.build(table(spark, sf_dir, "documents")).save(path),
    )


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, page_name, url, html)``; a page is named by its URL relative to the site."""
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", U.page_name(F.col("url"), SITE).alias("page_name"), "url", "html")


def page_index(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    texts = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
    return stored(
        "pages", spark, sf_dir, lambda path: postings.TextIndex.build(texts, id_col="page_id").save(path)
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a query for the documents that hold all its words."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


# Text


def tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return words.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def page_checks(spark, sf_dir):
    df = named_pages(spark, sf_dir)
    return df.select(
        "page_id",
        "page_name",
        T.title_from_page_name(F.col("page_name")).alias("title"),
        U.is_content_url(F.col("url"), SITE).alias("is_content"),
        pages.is_article_page(F.col("page_name"), F.col("html")).alias("is_article"),
    )


def excluded_pages(spark, sf_dir):
    """The pages under names of every kind that is left out, some as redirects, and blank pieces of their text."""
    names = F.array(*(F.lit(n) for n in oracles.NAME_KINDS))
    df = table(spark, sf_dir, "pages").withColumn("kind", F.element_at(names, (F.col("page_id") % len(oracles.NAME_KINDS) + 1).cast("int")))
    name = F.concat("kind", F.col("page_id").cast("string"), F.when(F.col("page_id") % 11 == 0, "#top").otherwise(""))
    html = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(presets.REDIRECT_MARK), "html")).otherwise(F.col("html"))
    piece = F.substring("html", F.lit(1), (F.col("page_id") % 3).cast("int"))
    return df.select(
        "page_id", pages.is_article_page(name, html).alias("is_article"),
        U.is_content_url(F.concat(F.lit(SITE), name), SITE).alias("is_content"),
        is_blank(F.concat(F.lit(" \t\n"), piece)).alias("is_blank"),
    )


def normalized_titles(spark, sf_dir):
    wiki = table_wiki.part_dump(table(spark, sf_dir, "part"))
    return wiki.select("id", "title", T.normalize_title(F.col("title")).alias("n_title"))


def result_urls(spark, sf_dir):
    wiki = table_wiki.part_dump(table(spark, sf_dir, "part"))
    return wiki.select("id", U.result_url(F.col("title"), EXTERN_BASE).alias("url"))


def page_name_decoding(spark, sf_dir):
    """File names as the crawler stores them, decoded back to page names."""
    name = F.concat("p_name", F.lit(":"), "p_brand")
    stored_name = name
    for char in " :#":
        stored_name = F.replace(stored_name, F.lit(char), F.lit(f"({ord(char):x})"))
    files = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(stored_name, F.lit(".html")).alias("file_name")
    )
    return files.select("p_partkey", "file_name", U.decode_file_name(F.col("file_name")).alias("page_name"))


# Index


def postings_tf(spark, sf_dir):
    return document_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


def term_statistics(spark, sf_dir):
    terms = document_index(spark, sf_dir).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_statistics(spark, sf_dir):
    docs = document_index(spark, sf_dir).docs
    return docs.select("doc_id", "tf_max", F.round("euc", 9).alias("euc"), "len")


def index_counts(spark, sf_dir):
    index = document_index(spark, sf_dir)
    counts = (
        table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_documents")),
        postings.count_docs(index.docs).withColumnRenamed("n_docs", "n_with_terms"),
        index.terms.agg(F.count(F.lit(1)).alias("n_terms")),
        index.postings.agg(F.sum("tf").alias("n_tokens")),
    )
    first, *rest = counts
    return first.select("*", *(df.scalar().alias(df.columns[0]) for df in rest))


def page_postings(spark, sf_dir):
    return page_index(spark, sf_dir).postings.select("term", F.col("doc_id").alias("page_id"), "tf")


def term_lookup(spark, sf_dir):
    found = postings.documents_of_term(document_index(spark, sf_dir).postings, "the")
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


def terms_of_toxic_documents(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    vectors = document_index(spark, sf_dir).vectors.join(toxic, "doc_id", "left_semi")
    return vectors.select("doc_id", F.inline("terms"))


def document_ids(spark, sf_dir):
    names = distinct_pages(named_pages(spark, sf_dir).select("page_name"))
    return ranking.assign_ids(names, "page_name")


def unseen_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return postings.unseen(df, table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


def incremental_ids(spark, sf_dir):
    """Index the plain-http pages, then all pages: the second batch adds only the rest."""
    path = f"{scratch_dir(spark)}/incremental-{spark.range(1).select(F.uuid()).first()[0]}"
    df = table(spark, sf_dir, "pages").select(F.col("url").alias("page_name"), "html")
    create_index(spark, path)
    incremental.incremental_index(df.where(F.startswith("page_name", F.lit("http://"))), path, 0)
    incremental.incremental_index(df, path, 1)
    # Another run that begins at 0 again replaces nothing and finds nothing new.
    incremental.incremental_index(df, path, 0)
    ids = incremental.read_table(spark, path, "doc_ids")
    vectors = incremental.read_table(spark, path, "vectors")
    return ids.join(vectors.select("doc_id", F.size("terms").cast("bigint").alias("n_terms")), "doc_id").select(
        "doc_id", "page_name", "batch_id", "n_terms"
    )


def streamed_ids(spark, sf_dir):
    """The page table as a stream of files, indexed batch by batch."""
    base = f"{scratch_dir(spark)}/streamed-{spark.range(1).select(F.uuid()).first()[0]}"
    schema = "page_id bigint, url string, html string"
    files = stream_table(spark, f"{sf_dir}/pages.parquet", schema)
    stream = files.select(F.col("url").alias("page_name"), "html")
    incremental.stream_index(stream, f"{base}/index", f"{base}/offsets").awaitTermination()
    return incremental.read_table(spark, f"{base}/index", "doc_ids").select("doc_id", "page_name", "batch_id")


def incremental_search(spark, sf_dir):
    """Three batches of pages, two of them compacted into one segment, searched as one index."""
    path = f"{scratch_dir(spark)}/segments-{spark.range(1).select(F.uuid()).first()[0]}"
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_name"), "html")
    create_index(spark, path)
    for batch, part in enumerate((F.startswith("page_name", F.lit("http://")), F.col("page_id") % 2 == 0, F.lit(True))):
        incremental.incremental_index(df.where(part).drop("page_id"), path, batch, "r")
        if batch == 1:
            compact(spark, path)
    hits = search(query_table(spark, [TWO_TERMS]), incremental.stored_index(spark, path), normalize="euc", rank=False)
    names = incremental.read_table(spark, path, "doc_ids").select("doc_id", "page_name")
    return _scores(hits.join(names, "doc_id"), "page_name").drop("doc_id")


def streamed_batches(spark, sf_dir):
    """Pages that arrive in three rounds, each with those of the rounds before, from a stream with keyed state."""
    base = f"{scratch_dir(spark)}/streamed-{spark.range(1).select(F.uuid()).first()[0]}"
    df = table(spark, sf_dir, "pages").select(F.col("url").alias("page_name"), "html")
    first = F.startswith("page_name", F.lit("http://"))
    df.where(first).write.parquet(f"{base}/pages")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/pages")
    for arriving in (None, df.where(first | (F.length("page_name") % 2 == 0)), df):
        if arriving is not None:
            arriving.write.mode("append").parquet(f"{base}/pages")
        incremental.stream_index(stream, f"{base}/index", f"{base}/offsets").awaitTermination()
    return incremental.read_table(spark, f"{base}/index", "doc_ids").select("doc_id", "page_name", "batch_id")


# Search


def _scores(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), *columns)


def search_two_terms(spark, sf_dir):
    return _scores(search(query_table(spark, [TWO_TERMS]), document_index(spark, sf_dir)), "rank")


def search_top_hits(spark, sf_dir):
    hits = search(query_table(spark, [TWO_TERMS]), document_index(spark, sf_dir), rank=False)
    return _scores(top_hits(hits))


def batch_search(**options) -> Query:
    def query(spark, sf_dir):
        hits = search(benchmark_queries(spark, sf_dir), document_index(spark, sf_dir), rank=False, **options)
        return _scores(hits)

    return query


def search_batch_top10(spark, sf_dir):
    hits = search(benchmark_queries(spark, sf_dir), document_index(spark, sf_dir), tf="log", normalize="euc", limit=10)
    return _scores(hits, "rank")


def search_mixed_modes(spark, sf_dir):
    modes = F.array(
        *(
            F.struct(
                F.lit(i).alias("m"),
                F.lit(tf).alias("tf"),
                F.lit(normalize).cast("string").alias("normalize"),
                F.lit(similarity).cast("string").alias("similarity"),
            )
            for i, (tf, normalize, similarity) in enumerate(oracles.MODES)
        )
    )
    each = benchmark_queries(spark, sf_dir).select("query_id", "query_text", F.inline(modes))
    numbered = each.withColumn("query_id", F.col("query_id") * len(oracles.MODES) + F.col("m")).drop("m")
    return _scores(search(numbered, document_index(spark, sf_dir), rank=False))


def block_index(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    """The documents with bitmaps and block maxima."""
    return stored(
        "blocks", spark, sf_dir,
        lambda path: postings.TextIndex.build(table(spark, sf_dir, "documents")).save(path, blocks=True, bitmap_least=64, block_rows=32),
    )


def frequent_word_queries(spark: SparkSession) -> DataFrame:
    return query_table(spark, ["the and", "of the in", "der die und", "de la", "the"])


def search_bitmaps(spark, sf_dir):
    """Words that fill large parts of the table: their lists are intersected as bitmaps."""
    return _scores(search(frequent_word_queries(spark), block_index(spark, sf_dir), rank=False, prune_rows=10))


def search_block_top10(spark, sf_dir):
    """The same searches cut to ten hits, by the block maxima."""
    hits, _ = search_best(frequent_word_queries(spark), block_index(spark, sf_dir), 10, tf="log", normalize="euc")
    return _scores(hits, "rank")


def page_search(spark, sf_dir):
    hits = search(query_table(spark, [TWO_TERMS]), page_index(spark, sf_dir), normalize="euc", rank=False)
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return _scores(hits.join(urls, "doc_id"), "url")


def hit_counts(spark, sf_dir):
    hits = search(benchmark_queries(spark, sf_dir), document_index(spark, sf_dir), rank=False)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))


# Links


def page_links(spark, sf_dir):
    return links.resolved_links(table(spark, sf_dir, "pages")).withColumn("position", F.col("position").cast("bigint"))


def site_links(spark, sf_dir):
    found = links.extract_links(table(spark, sf_dir, "pages"), SITE)
    return found.withColumn("position", F.col("position").cast("bigint"))


def crawl_frontier(spark, sf_dir):
    known = named_pages(spark, sf_dir).select("page_name")
    found = links.frontier(links.extract_links(table(spark, sf_dir, "pages"), SITE), known)
    return found.withColumn("position", F.col("position").cast("bigint"))


def crawl_order(spark, sf_dir):
    """A crawl of the pages where a link leads to the next page that has the same link, from the pages without such a one before."""
    found = links.raw_links(table(spark, sf_dir, "pages")).join(table(spark, sf_dir, "pages").select("url", "page_id"), "url")
    first = found.groupBy("page_id", "url", "href").agg(F.min("position").alias("position"))
    same = Window.partitionBy("href").orderBy("page_id")
    linked = first.withColumn("to_page", F.lead("url").over(same)).where(F.col("to_page").isNotNull())
    # A link leads to the next such page, so pages of near numbers are near each other.
    linked = materialize(linked.select(F.col("url").alias("from_page"), "to_page", "position", F.col("page_id").alias("place")), "page-graph")
    roots = table(spark, sf_dir, "pages").select(F.col("url").alias("page_name"), F.col("page_id").alias("position"))
    roots = roots.join(linked.select(F.col("to_page").alias("page_name")), "page_name", "left_anti")
    return links.crawl_order(linked, roots)


# Attributes


def _pairs(df: DataFrame, key: str, text: str, rules: tuple[Source, ...]) -> DataFrame:
    found = df.select(key, F.posexplode(extract_attributes(text, rules)).alias("n", "a"))
    return found.select(key, F.col("n").cast("bigint").alias("n"), "a.name", "a.value")


def attributes_anywhere(spark, sf_dir):
    rules = (Source(attributes=(Attribute("k", '"K"', r"(\d+)"), Attribute("tens", value=r"(\d)\d"))),)
    return _pairs(table(spark, sf_dir, "events"), "event_id", "props", rules)


def attributes_first_success(spark, sf_dir):
    rules = (
        Source(
            segment=r'<a href="[^"]*">[^<]*</a>',
            attributes=(
                Attribute("article", 'href="/the', r">([^<]*)<"),
                Attribute("number", value=r"(\d+)"),
                Attribute("link", value=r">([^<]+)<"),
            ),
        ),
    )
    return _pairs(table(spark, sf_dir, "pages"), "page_id", "html", rules)


def attributes_all_matches(spark, sf_dir):
    rules = (
        Source(
            segment=r"[A-Z][a-z]+ [a-z]+[^.]*",
            all_attributes=True,
            attributes=(
                Attribute("th", value=r"\b(th[a-z]*) (an[a-z]*)", multiple=True, concat=True),
                Attribute("ion", "TION", explicit="yes"),
            ),
        ),
    )
    return _pairs(table(spark, sf_dir, "documents"), "doc_id", "text", rules)


def wiki_attributes(spark, sf_dir):
    dump = table_wiki.part_dump(table(spark, sf_dir, "part"))
    return _pairs(dump, "id", "value", presets.COMPUTERS)


def wiki_dump_scan(spark, sf_dir):
    """Write the part wiki as bz2 XML and scan it back."""
    path = f"{scratch_dir(spark)}/dump-{spark.range(1).select(F.uuid()).first()[0]}"
    xml = table_wiki.dump_xml(table_wiki.part_dump(table(spark, sf_dir, "part")))
    xml.write.option("compression", "bzip2").text(path)
    dump = read_dump(spark, path)
    return dump.select("id", "ns", "title", F.col("revision.text._VALUE").alias("value"))


def changed_dumps(spark, sf_dir):
    """Three dumps by part size, of which one is replaced and one removed between two builds of the article table."""
    base = f"{scratch_dir(spark)}/changing-{spark.range(1).select(F.uuid()).first()[0]}"
    parts = table(spark, sf_dir, "part")
    sizes = {"small": F.col("p_size") <= 15, "middle": F.col("p_size").between(16, 35), "large": F.col("p_size") > 35}

    def write(name, rows):
        xml = table_wiki.dump_xml(table_wiki.part_dump(rows))
        xml.write.mode("overwrite").option("compression", "bzip2").text(f"{base}/dumps/{name}")

    for name, chosen in sizes.items():
        write(name, parts.where(chosen))
    for changed in (False, True):
        if changed:
            write("small", parts.where(sizes["small"] & (F.col("p_partkey") % 2 == 0)))
            write("large", parts.where("false"))
        found = dump_pipeline.dump_attribute_table(spark, f"{base}/dumps/*", "*", f"{base}/work")
        found = found.select("title", F.size("attributes").cast("bigint").alias("n_attributes"), "value")
        if not changed:
            found.count()
    return found


def _dump_articles(spark, sf_dir):
    return pages.dump_articles(table_wiki.as_dump_rows(table_wiki.part_dump(table(spark, sf_dir, "part"))))


def _site_articles(spark, sf_dir):
    return pages.site_articles(
        table_wiki.site_pages(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"))
    )


def dump_topic_filter(spark, sf_dir):
    return _dump_articles(spark, sf_dir).select(
        "title", T.dump_categories(F.col("value")).alias("categories")
    )


def site_topic_filter(spark, sf_dir):
    return _site_articles(spark, sf_dir).select("title", T.site_categories(F.col("value")).alias("categories"))


def _joined(spark, sf_dir, **limits):
    return searchdocs.join_titles(
        pages.with_attributes(_dump_articles(spark, sf_dir)),
        pages.with_attributes(_site_articles(spark, sf_dir)),
        **limits,
    )


def _title_rows(joined: DataFrame) -> DataFrame:
    return joined.select(
        "title", "extern_title", "site_title", V.attributes_to_string(F.col("attributes")).alias("attributes"), "value"
    )


def title_join(spark, sf_dir):
    return _title_rows(_joined(spark, sf_dir))


def brand_pairs(spark, sf_dir):
    """Titles cut to their first word: frequent keys on both sides, joined as grids of small cells."""

    def short(df):
        return df.select(F.concat(F.element_at(F.split("title", " "), 1), F.lit("x")).alias("title"), "attributes", "value")

    sides = [materialize(short(pages.with_attributes(read(spark, sf_dir))), "short-titles") for read in (_dump_articles, _site_articles)]
    # Pairs are many and titles few: a pair is counted by the number of its title, which is cheaper to look up.
    titles = materialize(ranking.assign_ids(sides[0].select("title").union(sides[1].select("title")).distinct(), "title", "title_id"), "title-numbers")
    dump, site = (side.join(titles, "title", "left") for side in sides)
    joined = searchdocs.join_titles(dump, site, rows_per_split=50, pairs_per_task=100, keep=("title_id",))
    counts = joined.groupBy(F.coalesce("title_id", F.lit(-1)).alias("title_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("extern_title").isNotNull() & F.col("site_title").isNotNull()).alias("n_pairs"),
        F.sum("n_attributes").alias("n_attributes"),
    )
    return counts.join(titles, "title_id", "left").select("title", "n_rows", "n_pairs", "n_attributes")


def attribute_strings(spark, sf_dir):
    """The joined attributes written as strings and parsed again."""
    joined = _joined(spark, sf_dir).select("title", V.attributes_to_string(F.col("attributes")).alias("line"))
    parsed = joined.select("title", F.posexplode(V.attributes_from_string(F.col("line"))).alias("n", "a"))
    return parsed.select("title", F.col("n").cast("bigint").alias("n"), "a.name", "a.value")


def field_index(spark: SparkSession, sf_dir: str) -> fielded.FieldIndex:
    return stored(
        "fields", spark, sf_dir,
        lambda path: fielded.FieldIndex.build(searchdocs.build_search_docs(_joined(spark, sf_dir))).save(path),
    )


def search_documents(spark, sf_dir):
    docs = field_index(spark, sf_dir).docs
    return docs.withColumn("company", F.array_join("company", "; "))


def field_statistics(spark, sf_dir):
    return field_index(spark, sf_dir).fields.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def brand_queries(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("query_id"),
        F.concat("p_brand", F.lit(" works serial")).alias("query_text"),
    )


def fielded_search(spark, sf_dir):
    return _scores(fielded.fielded_search(brand_queries(spark, sf_dir), field_index(spark, sf_dir), limit=None))


def fielded_search_top(spark, sf_dir):
    return _scores(fielded.fielded_search(brand_queries(spark, sf_dir), field_index(spark, sf_dir)), "rank")


def fielded_search_ranges(spark, sf_dir):
    index = field_index(spark, sf_dir)
    hits = fielded.fielded_search(
        brand_queries(spark, sf_dir), index, ranges={"release": (1950, 1980), "word_size": (None, 35)},
        require_all=True, limit=None,
    )
    shown = fielded.show_hits(_scores(hits), index.docs, EXTERN_BASE, SITE_BASE)
    return shown.select("query_id", "doc_id", "score", "title", "extern_url", "site_url")


def fielded_search_query_ranges(spark, sf_dir):
    """Each brand with its own years, and every third with a largest word size."""
    queries = brand_queries(spark, sf_dir)
    years = queries.select(
        "query_id", F.lit("release").alias("column"), (F.col("query_id") % 20 + 1945).cast("double").alias("low"),
        F.when(F.col("query_id") % 2 == 0, F.col("query_id") % 20 + 1960).cast("double").alias("high"),
    )
    sizes = queries.where("query_id % 3 = 0").select(
        "query_id", F.lit("word_size").alias("column"), F.lit(None).cast("double").alias("low"), F.lit(30.0).alias("high")
    )
    return _scores(
        fielded.fielded_search(queries, field_index(spark, sf_dir), limit=None, query_ranges=years.union(sizes))
    )


def fielded_search_must_not(spark, sf_dir):
    """Serial machines of a brand that are not built of transistors."""
    queries = brand_queries(spark, sf_dir)
    own = queries.select("query_id", F.explode(F.array(
        F.struct(F.lit("architecture").alias("field"), F.lit("serial").alias("query_text"), F.lit("must").alias("occur")),
        F.struct(F.lit("logic").alias("field"), F.lit("transistor").alias("query_text"), F.lit("must_not").alias("occur")),
    )).alias("c")).select("query_id", "c.*")
    return _scores(fielded.fielded_search(queries, field_index(spark, sf_dir), field_queries=own, limit=None))


def fielded_search_one_field(spark, sf_dir):
    own = brand_queries(spark, sf_dir).withColumn("field", F.lit("company"))
    none = own.select("query_id", "query_text").where("false")
    hits = fielded.fielded_search(none, field_index(spark, sf_dir), field_queries=own, limit=None)
    return _scores(hits)


def range_search(spark, sf_dir):
    found = fielded.range_search(field_index(spark, sf_dir).docs, {"clock_speed": (10e6, 40e6)}, limit=None)
    return found.select("doc_id", "score")


# Values


def most_frequent_quantity(spark, sf_dir):
    return ranking.most_frequent_by(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


def document_number(spark, sf_dir):
    """The in-row form: the numbers in a document, settled and cut to an int."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), V.parse_number)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", V.to_int_saturating(V.most_frequent(found)).alias("number"))


def parsed_numbers(spark, sf_dir):
    """Numbers and clock speeds written as text, read back."""
    text = F.when(F.col("event_type") == "error", "sixteen").when(
        F.col("event_type") == "view", F.concat("event_type", F.col("value").cast("string"))
    ).otherwise(F.col("value").cast("string"))
    unit = (
        F.when(F.col("event_type") == "click", "MHz").when(F.col("event_type") == "error", "kHz").otherwise("GHz")
    )
    number, speed = V.parse_number(text), V.clock_hertz(F.concat(text, F.lit(" "), unit))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.least(number, F.lit(1e18)), 6).alias("number"),
        V.to_int_saturating(speed).alias("hertz"),
    )


def technologies(spark, sf_dir):
    dump = table_wiki.part_dump(table(spark, sf_dir, "part"))
    found = dump.select("id", V.attribute_values(extract_attributes("value", presets.COMPUTERS), "tech").alias("tech"))
    architecture, logic = V.technology(F.col("tech"))
    return found.select("id", architecture.alias("architecture"), logic.alias("logic"))


def with_library_path(query: Query) -> Query:
    """Python workers get the folder of this library, wherever the driver was started."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = os.path.dirname(os.path.abspath(__file__))
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if home not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Two-term ranked search over the smallest documents table."""
    return search_two_terms(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    plain = (
        tokens, page_text, page_checks, excluded_pages, normalized_titles, result_urls, page_name_decoding,
        postings_tf, term_statistics, doc_statistics, index_counts, page_postings, term_lookup,
        terms_of_toxic_documents, document_ids, unseen_documents, incremental_ids, streamed_ids,
        incremental_search, streamed_batches,
        search_two_terms, search_top_hits, search_batch_top10, search_bitmaps, search_block_top10, search_mixed_modes, page_search,
        hit_counts, page_links, site_links, crawl_frontier, crawl_order, attributes_anywhere,
        attributes_first_success, attributes_all_matches, wiki_attributes, wiki_dump_scan, changed_dumps,
        dump_topic_filter, site_topic_filter, title_join, brand_pairs, attribute_strings, search_documents,
        field_statistics, fielded_search, fielded_search_top, fielded_search_ranges,
        fielded_search_one_field, fielded_search_query_ranges, fielded_search_must_not, range_search, most_frequent_quantity, document_number,
        parsed_numbers, technologies,
    )
    found: dict[str, Query] = {query.__name__: query for query in plain}
    found["search_batch_raw"] = batch_search()
    found["search_batch_log"] = batch_search(tf="log")
    found["search_batch_max_tf"] = batch_search(tf="max")
    found["search_batch_euc"] = batch_search(normalize="euc")
    found["search_batch_cos"] = batch_search(similarity="cos")
    if llm:
        training = llm.QUERIES | {"pipeline": corpus_pipeline.run}
        found |= {name: with_library_path(query) for name, query in training.items()}
    return found


def oracle_sql() -> dict[str, str]:
    sql = oracles.all_sql()
    if llm:
        sql |= llm.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return sql
