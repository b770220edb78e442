import random

import corpus_pipeline
from tests.llm.cases import SCHEMA, awkward, documents, edited, frame, prose
from tests.llm.test_language import text_in

PASSAGE = " ".join(text_in("aa", 5000, 30).split())
ITEMS = [(1, PASSAGE), (2, None), (3, "")]
LANGUAGES = ["aa", "bb"]
GOOD = [(i, text_in(LANGUAGES[i % 2], i, 60 + i % 40), LANGUAGES[i % 2], f"s{i % 3}") for i in range(240)]
ODD = [(i + 2000 if i is not None else None, t, s, o) for i, t, s, o in awkward()] + [
    (3000, "12 34 !", "aa", "s0"), (3001, None, "aa", "s0"), (3002, GOOD[7][1], "bb", "s1"), (3003, edited(GOOD[9][1], [40]), "aa", None),
    (3004, text_in("aa", 77) + " " + PASSAGE.upper() + " " + text_in("aa", 78), "aa", "s2"), GOOD[11],
]


def run_stages(spark, tmp_path, docs):
    out, results = documents(spark, tmp_path, []), {}
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.mode("overwrite").parquet(f"{out}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        got.write.parquet(f"{out}/{name}")
        docs = results[name] = spark.read.parquet(f"{out}/{name}")
    return results


def test_stages_do_their_part(spark, tmp_path):
    rows = GOOD + ODD
    random.Random(0).shuffle(rows)
    found = run_stages(spark, tmp_path, frame(spark, rows))
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in found.items()}
    good = {r[0] for r in GOOD}
    assert good <= set(ids["language"]) and not {3000, 3001, 2004, 2005, 2006} & set(ids["language"])
    assert good <= set(ids["near_duplicates"]) and not {3002, 3003, 2002, 2003} & set(ids["near_duplicates"])
    named = [i for i in ids["near_duplicates"] if i is not None]
    assert len(named) == len(set(named)) and ids["near_duplicates"].count(None) == 1
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {3004}
    mixed, words = {}, {}
    for r in found["decontamination"].collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for r in found["mixing"].collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    assert abs(sum(mixed.values()) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())
    assert max(ids["mixing"].count(i) for i in good) == 2
    shards = found["sharding"].collect()
    assert len(shards) == len(ids["mixing"]) and {r.shard for r in shards} <= set(range(corpus_pipeline.SHARDS))
    for s in range(corpus_pipeline.SHARDS):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_empty_table(spark, tmp_path):
    assert run_stages(spark, tmp_path, spark.createDataFrame([], SCHEMA))["sharding"].count() == 0


def test_run_reads_documents(spark, tmp_path):
    folder = documents(spark, tmp_path, GOOD + [(999, prose(1, 50), None, None)])
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 200
