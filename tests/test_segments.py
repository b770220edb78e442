from pyspark.sql import functions as F

from wikisift.operators.postings import TextIndex
from wikisift.operators.search import query_table, search
from wikisift.streaming import incremental as inc
from wikisift.streaming import segments as seg

PAGES = "page_name string, html string"
QUERIES = ["c x", "x", "b", "missing x", "x a", "z1 x"]


def batches():
    """Four batches with repeats; names begin with the batch in which they are new."""
    out = []
    for b in range(4):
        rows = [(f"{b}-{i}", f"x {'abc'[i % 3]} z{i} " * (1 + i % 4)) for i in range(12)]
        out.append(rows + [(f"{max(b - 1, 0)}-{i}", "changed x") for i in range(5)] + [(f"{b}-e", "")])
    return out


def names_and_scores(hits, ids):
    joined = hits.join(ids.select("doc_id", "page_name"), "doc_id")
    return sorted((r.query_id, r.page_name, round(r.score, 9)) for r in joined.collect())


def at_once(spark):
    first = {}
    for rows in batches():
        for name, html in sorted(rows, key=lambda r: r[1]):
            first.setdefault(name, html)
    docs = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(sorted(first.items()))], "doc_id bigint, page_name string, text string")
    return TextIndex.build(docs), docs


def build(spark, path, rounds=4):
    seg.create_index(spark, path, 4)
    for b, rows in enumerate(batches()[:rounds]):
        # Of several contents in one batch the smallest counts, as in ``at_once``.
        inc.incremental_index(spark.createDataFrame(rows, PAGES), path, b, "r")


def test_segments_search_as_one_index(spark, tmp_path):
    path, queries = str(tmp_path / "index"), query_table(spark, QUERIES)
    build(spark, path)
    whole, docs = at_once(spark)
    for options in ({}, {"tf": "log", "normalize": "euc"}, {"tf": "max"}, {"similarity": "cos"}):
        found = names_and_scores(search(queries, inc.stored_index(spark, path), **options), inc.read_table(spark, path, "doc_ids"))
        assert found == names_and_scores(search(queries, whole, **options), docs) and found
    counts = {r.term: (r.df, round(r.idf, 9)) for r in inc.stored_index(spark, path).terms.collect()}
    assert counts == {r.term: (r.df, round(r.idf, 9)) for r in whole.terms.collect()}


def test_plan_reads_buckets_of_postings_only(spark, tmp_path):
    path = str(tmp_path / "index")
    build(spark, path, 2)
    hits = search(query_table(spark, ["c x"]), inc.stored_index(spark, path), rank=False)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Generate" not in plan and "/vectors" not in plan


def test_compaction(spark, tmp_path):
    path, queries = str(tmp_path / "index"), query_table(spark, QUERIES)
    build(spark, path)

    def state():
        ids = inc.read_table(spark, path, "doc_ids")
        found = names_and_scores(search(queries, inc.stored_index(spark, path)), ids)
        return found, sorted(tuple(r) for r in ids.select("doc_id", "page_name").collect())

    before = state()
    merged = seg.compact(spark, path, most_rows=0)
    assert merged is None and len(seg.live(seg.published(spark, path))) == 4
    merged = seg.compact(spark, path)
    assert len(merged.replaces) == 4 and seg.live(seg.published(spark, path)) == [merged]
    assert state() == before and seg.compact(spark, path) is None
    # A batch that was merged is not indexed again, and a later one goes on after its ids.
    inc.incremental_index(spark.createDataFrame(batches()[1], PAGES), path, 1, "r")
    assert state() == before
    inc.incremental_index(spark.createDataFrame([("0-0", "x"), ("new", "c x")], PAGES), path, 4, "r")
    assert state()[1] == [*before[1], (len(before[1]), "new")]
    assert {s.run for s in seg.remove_replaced(spark, path)} == {"r"}
    assert not (tmp_path / "index/postings/run=r/batch_id=0").exists()
    after = state()
    assert seg.compact(spark, path).n_docs == len(before[1]) + 1 - 4  # an empty page in each batch
    assert state() == after


def test_batches_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "index")
    build(spark, path, 2)
    ids = sorted(tuple(r) for r in inc.read_table(spark, path, "doc_ids").select("doc_id", "page_name", "batch_id").collect())
    # What lacks its row in ``batches`` is not read; the same batch run again replaces it.
    for table in seg.STORED:
        inc.read_table(spark, path, table).limit(3).drop("run", "batch_id").write.parquet(f"{path}/{table}/run=r/batch_id=2")
    assert sorted(tuple(r) for r in inc.read_table(spark, path, "doc_ids").select("doc_id", "page_name", "batch_id").collect()) == ids
    for _ in range(2):
        inc.incremental_index(spark.createDataFrame(batches()[2], PAGES), path, 2, "r")
    assert inc.read_table(spark, path, "doc_ids").where("batch_id = 2").count() == 13
    assert inc.read_table(spark, path, "vectors").count() == len(ids) + 13


def test_empty_index_and_empty_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    seg.create_index(spark, path)
    assert search(query_table(spark, ["x"]), inc.stored_index(spark, path)).count() == 0
    inc.incremental_index(spark.createDataFrame([], PAGES), path, 0, "r")
    inc.incremental_index(spark.createDataFrame([("A", "x")], PAGES), path, 1, "r")
    assert [r.doc_id for r in search(query_table(spark, ["x"]), inc.stored_index(spark, path)).collect()] == [0]
    assert inc.stored_index(spark, path).vectors.where(F.col("len") > 0).count() == 1


def test_stream_looks_up_names_of_other_runs_only(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "index"), str(tmp_path / "pages")
    asked = []
    plain = inc.unseen
    monkeypatch.setattr(inc, "unseen", lambda df, known, key: (asked.append(sorted(r[0] for r in known.select("page_name").collect())), plain(df, known, key))[1])
    seg.create_index(spark, path)
    inc.incremental_index(spark.createDataFrame([("old", "x")], PAGES), path, 0, "call")
    assert asked == []
    for part in ([("A", "x"), ("old", "y")], [("A", "x"), ("B", "x b")], [("B", "x b"), ("C", "x c")]):
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(PAGES).parquet(folder)
        assert inc.stream_index(stream, path, str(tmp_path / "offsets")).awaitTermination(120)
    assert asked == [["old"]] * 3
    ids = sorted((r.doc_id, r.page_name) for r in inc.read_table(spark, path, "doc_ids").collect())
    assert ids == [(0, "old"), (1, "A"), (2, "B"), (3, "C")]
