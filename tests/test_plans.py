"""Plan shapes that keep the jobs cheap at scale."""

from pyspark.sql import functions as F

from wikisift.operators.links import extract_links
from wikisift.operators.pages import site_articles, with_attributes
from wikisift.operators.postings import build_postings, doc_stats, document_vectors
from wikisift.operators.searchdocs import join_titles, typed_documents

BAG = "title string, attributes array<struct<name:string,value:string>>, value string"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counting_terms_does_not_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id bigint, text string")
    vectors = document_vectors(docs)
    for df in (build_postings(docs), vectors, doc_stats(vectors)):
        assert "Exchange" not in physical(df)
    # counted once per document, below the explode
    plan = optimized(build_postings(docs))
    assert plan.count("sort_array") == 1
    assert plan.index("Generate explode(terms") < plan.index("sort_array")


def test_page_text_is_extracted_once(spark):
    pages = spark.createDataFrame([("A", "<p>x</p>")], "page_name string, html string")
    once = optimized(pages.select("page_name"))
    assert "regexp_replace" not in once
    # one pass over the tags, although a filter and two columns read the text
    assert optimized(with_attributes(site_articles(pages))).count("$1$2$3") == 1


def test_links_are_resolved_once(spark):
    pages = spark.createDataFrame([("http://x/A", '<a href="B">')], "url string, html string")
    assert optimized(extract_links(pages, "http://x/")).count("href=") == 1


def test_no_python_in_the_plans(spark):
    dump = spark.createDataFrame([("A", [("release", "1970")], "v")], BAG)
    joined = join_titles(dump, dump)
    for df in (joined, typed_documents(joined), with_attributes(dump.select("title", "value"))):
        assert "EvalPython" not in physical(df) and "InPandas" not in physical(df)
    # without frequent keys the title join is the plain one: no salts, one shuffle per side
    assert physical(joined).count("Exchange hashpartitioning") == 2
    assert "_salt" not in physical(joined)
    assert "Exchange" not in physical(typed_documents(dump.select("title", F.lit("a").alias("site_title"), F.lit("b").alias("extern_title"), "attributes", "value")))


def test_pairs_of_frequent_keys_are_counted_where_they_are_made(spark):
    """Packs carry what is read and nothing else, and pairs do not become rows before they are counted."""
    tables = [spark.createDataFrame([(t, [("a", str(i))] * (i % 3), "v") for i in range(n) for t in ("hot", None)] + [("one", None, "v")], BAG)
              .withColumn("number", F.when(F.col("title") == "hot", 7)) for n in (23, 17)]
    joined = join_titles(*tables, rows_per_split=5, pairs_per_task=20, keep=("number",))
    sums = joined.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("n_attributes").alias("a"), F.sum(F.size("attributes")).alias("b"))
    expected = sum(i % 3 + j % 3 for i in range(23) for j in range(17))
    alone = sum(i % 3 for i in range(23)) + sum(j % 3 for j in range(17))
    assert {tuple(r) for r in sums.collect()} == {(7, 23 * 17, expected, expected), (None, 1 + 23 + 17, alone, alone)}
    plan = physical(joined.groupBy("number").agg(F.count(F.lit(1)), F.sum("n_attributes")))
    assert plan.index("Generate posexplode(_left_rows") < plan.index("Union") and not any(c in plan for c in ("_value", "extern_attributes", "site_attributes"))
