import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import awkward, collected, frame, prose
from wikisift.llm import decontamination as D
from wikisift.llm import ragged

ITEMS = [(i, " ".join(prose(700 + i, 18).split())) for i in range(12)] + [(50, None), (51, ""), (52, "ab"), (53, "kalomi 1234")]


def fold(text):
    return "".join(c.lower()[0] for c in text or "" if c.isalnum())


def distance_inside(text, item):
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corrupted(text, n, seed):
    rng, chars = random.Random(seed), list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at] = rng.choice(["", "x", chars[at] + "y"])
    return "".join(chars)


def corpus():
    rows = [r for r in awkward() if len(r[1] or "") < 3000]
    for i in range(12):
        passage = ITEMS[i][1]
        body = (passage, passage.upper(), passage.replace(" ", "!! "), corrupted(passage, i, i), passage[: len(passage) // 2])[i % 5]
        rows.append((600 + i, prose(i, 40) + " " + body + " " + prose(i + 50, 20), "xx", "a"))
    rows += [(640, ITEMS[1][1], "xx", "a"), (641, "kalomi 12 34 é", "xx", "a"), (642, ITEMS[2][1] + ITEMS[3][1], "xx", "a")]
    return rows


def brute(rows, q=8, rate=0.08):
    out = []
    for key, text, *_ in rows:
        for item, passage in ITEMS:
            m = fold(passage)
            if len(m) >= q:
                budget = min(int(len(m) * rate), len(m) // q - 1)
                d = distance_inside(fold(text), m)
                if d <= budget:
                    out.append((key, item, d))
    return sorted(out, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("block_bytes", [1 << 24, 600])
def test_equals_full_alignment(spark, block_bytes):
    rows = corpus()
    docs, items = frame(spark, rows), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = D.find_leaks(docs, items, block_bytes=block_bytes)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=lambda r: (r[0] is not None, r)) == brute(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found.collect():
        part = fold(texts[r.doc_id][r.start : r.end])
        assert distance_inside(part, fold(dict(ITEMS)[r.item_id])) == r.edits
    kept = D.without_leaks(docs, items, block_bytes=block_bytes)
    leaked = {r[0] for r in brute(rows)}
    assert kept.schema == docs.schema
    assert collected(kept.select("doc_id")) == collected(docs.where(~docs.doc_id.isin(*leaked) | docs.doc_id.isNull()).select("doc_id"))


def test_empty_tables(spark):
    docs, items = frame(spark, corpus()), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert D.find_leaks(docs, items.where("false")).count() == 0 and D.without_leaks(docs, items.where("false")).count() == docs.count()
    assert D.find_leaks(docs.where("false"), items).count() == 0 and D.without_leaks(docs.where("false"), items).count() == 0


def test_grams_of_any_length():
    codes = np.arange(20, dtype=np.uint32)
    for q in range(1, 12):
        g = D._grams(codes, q)
        assert len(g) == 20 - q + 1 and len(set(g.tolist())) == len(g)
        assert D._grams(codes[5 : 5 + q], q)[0] == g[5]


def test_a_phrase_of_all_items_takes_little_memory():
    phrase = "the quick brown fox jumps over "
    items = D.prepare([(i, phrase + prose(3000 + i, 12)) for i in range(5000)], 8, 0.08)
    text = (phrase + "filler words. ") * 6 + phrase + prose(3007, 12)
    piece = next(ragged.pieces(pa.array(["x", text, "", text[50:] + phrase])))
    tracemalloc.start()
    found = D._matches(piece, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert {(d, items.ids[i]) for d, i, *_ in found} == {(1, 7), (3, 7)}


@pytest.mark.parametrize("together", [50, 1_000_000])
def test_slices_change_nothing(monkeypatch, together):
    monkeypatch.setattr(D, "_TOGETHER", together)
    items = D.prepare([(0, "a" * 40), (1, prose(5, 20)), (2, "ab" * 25), (3, prose(5, 20) + " tail end of it")], 8, 0.08)
    texts = ["a" * 300, prose(5, 20), "x" + prose(5, 20) + " tail end of it", "ab" * 60 + "a" * 60, None, prose(9, 60)]
    found = D._matches(next(ragged.pieces(pa.array(texts))), items)
    assert {(d, i) for d, i, *_ in found} == {(0, 0), (1, 1), (2, 1), (2, 3), (3, 0), (3, 2)}
