import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, collected, documents, frame, words
from wikisift.llm.lines import dedup_lines, op5_line_dedup


def brute(rows, min_lines=2, long_words=8):
    """Windows seen before are deleted; each id and text once, in the order of ids."""
    result, seen = {}, {}
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0]))
    for key, text in order:
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if words(line)]
        gone = set()
        for size in {1, min_lines}:
            for i in range(len(solid) - size + 1):
                window = tuple(lines[j] for j in solid[i : i + size])
                counts = size == min_lines or len(words(window[0])) >= long_words
                if counts and window in seen:
                    gone.update(range(i, i + size))
                seen[window] = True
        kept = "\n".join(line for i, line in enumerate(lines) if i not in {solid[g] for g in gone})
        runs = sum(g - 1 not in gone for g in gone)
        result[key, text] = (key, len(solid), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    return sorted((result[r[0], r[1]] for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


CASES = awkward([
    (50, "p\nq\nr\ns\nt", "xx", "a"), (51, "x\nq\nr\ns\ny", "xx", "a"), (52, "q\nr\nq\nr\nq\nr", "xx", "a"), (53, "\n\np\n\nq\n \nz\n", "xx", "a"),
    (54, "the same long line of boilerplate text again and again", "xx", "a"), (55, "a\nthe same long line of boilerplate text again and again\nb", "xx", "a"),
    (56, "s\ns\ns\ns", "xx", "a"), (57, "r\ns\nt\nu", "xx", "a"),
])


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_equals_brute_force(spark, min_lines):
    found = dedup_lines(frame(spark, CASES), min_lines=min_lines)
    digest = found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept").cast("binary"), 256))
    assert collected(digest) == brute(CASES, min_lines, 1 if min_lines == 1 else 8)


def test_query_and_empty_table(spark, tmp_path):
    assert collected(op5_line_dedup(spark, documents(spark, tmp_path / "a", CASES))) == brute(CASES)
    assert op5_line_dedup(spark, documents(spark, tmp_path / "b", [])).count() == 0
