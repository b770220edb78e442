import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, collected, documents, frame, prose
from wikisift.llm.suffix_dedup import op1_suffix_dedup, remove_repeated, repeated_windows


def brute(rows, length):
    seen = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, str(type(x)), x) for x in r])


PASSAGE = prose(77, 60)
CASES = awkward() + [(100 + i, prose(200 + i, 30) + PASSAGE + prose(300 + i, 30), "xx", "a") for i in range(9)] + [
    (200, PASSAGE[:150] + " " + PASSAGE[:150], "xx", "a"), (201, "ab" * 300, "xx", "a"), (202, "\0" * 230 + "x", "xx", "b"),
]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_equals_brute_force(spark, chunk):
    found = remove_repeated(frame(spark, CASES), length=200, chunk=chunk)
    digest = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert collected(digest) == brute(CASES, 200)
    for r in found.collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_other_lengths(spark):
    found = remove_repeated(frame(spark, CASES[:12]), length=40, gram=12)
    assert collected(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute(CASES[:12], 40)


@pytest.mark.parametrize("least", [1, 7, 100_000])
@pytest.mark.parametrize("chunk", [1, 2, 4])
def test_copied_texts_of_a_cut_group(spark, chunk, least):
    """Copies of a text over many batches must not hide that its anchors go on after a cut."""
    other = prose(78, 60)
    texts = [prose(400 + i, 30) + PASSAGE[: 330 + i % 2] + prose(500 + i, 30) for i in range(6)] + [prose(410, 30) + other, other + prose(411, 30)]
    rows = [(i, text) for i, text in enumerate(texts) for _ in range(1 + 11 * (i % 3 == 0))]
    seen = Counter(text[i : i + 200] for text in texts for i in range(len(text) - 199))
    want = {(t, i) for t, text in enumerate(texts) for i in range(len(text) - 199) if seen[text[i : i + 200]] > 1}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        found = repeated_windows(spark.createDataFrame(rows, "t bigint, text string").repartition(3), 200, 64, chunk, least).collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.t, i) for r in found for i in range(r["first"], r["last"] + 1)} == want


def test_query_and_empty_table(spark, tmp_path):
    assert collected(op1_suffix_dedup(spark, documents(spark, tmp_path / "a", CASES))) == brute(CASES, 200)
    assert op1_suffix_dedup(spark, documents(spark, tmp_path / "b", [])).count() == 0
