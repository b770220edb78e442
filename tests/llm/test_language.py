import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.cases import awkward, collected, documents, frame
from wikisift.llm import language as L
from wikisift.llm import ragged

VOCABULARY = {
    "aa": ["the", "of", "and", "thing", "with", "was", "here", "tion"], "bb": ["der", "und", "nicht", "schön", "ist", "wir", "keit", "heit"],
    "cc": ["дом", "мир", "река", "слово", "он", "что"], "dd": ["水", "山水", "火花", "日本", "人"],
}


def text_in(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(1, 2))) for _ in range(n)) + "."


ROWS = [(i, text_in(lang, i), lang, "a") for i, lang in enumerate(list(VOCABULARY) * 60)]


def test_held_out_accuracy_and_spans(spark):
    docs = frame(spark, ROWS)
    model = L.train(docs.where(L.fold() != 0))
    found = {r.doc_id: r for r in L.identify(docs, model).collect()}
    held_out = [r for r in ROWS if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held_out and sum(found[r[0]].lang_pred == r[2] for r in held_out) >= 0.98 * len(held_out)
    mixed = text_in("aa", 1000) + " 123 " + text_in("cc", 1001, 30) + " " + text_in("bb", 1002, 40)
    row = L.identify(frame(spark, [(1, mixed, None, "a")]), model).first()
    assert [s["lang"] for s in row["spans"]] == ["aa", "cc", "bb"]
    parts = [mixed[s["start"] : s["end"]] for s in row["spans"]]
    assert parts[0] == text_in("aa", 1000)[:-1] and parts[1] == text_in("cc", 1001, 30)[:-1]
    assert row.lang_pred == "aa" and 0 < row.score < 1


def many_labels(n_languages, docs, n_words):
    """Languages of eight words each; one is hot, the last by name is the rarest."""
    def text(k, seed):
        own, rng = random.Random(k), random.Random(seed)
        vocabulary = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)]
        return " ".join(rng.choice(vocabulary) for _ in range(n_words))

    names = [f"l{k:03}" for k in range(n_languages)]
    counts = [docs * (4 if k == 0 else 2 if k < n_languages - 1 else 1) for k in range(n_languages)]
    labels = [k for k, n in enumerate(counts) for _ in range(n)]
    return [(i, text(k, i), names[k], "a") for i, k in enumerate(labels)]


def test_every_label_is_learned(spark, tmp_path):
    rows = many_labels(150, 4, 12)
    found = L.op10_language_id(spark, documents(spark, tmp_path, rows)).collect()
    by_id = {r.doc_id: r.lang_pred for r in found}
    assert sum(by_id[i] == lang for i, _, lang, _ in rows) >= 0.99 * len(rows)
    assert all(by_id[i] == lang for i, _, lang, _ in rows[-4:])


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = rng.integers(0, 7, 5)
        emit = -rng.random((counts.sum(), 3)) * 4
        before = np.concatenate([[0], np.cumsum(counts)])
        got = L._viterbi(emit.astype(np.float32), before, 1.5)
        for a, b in zip(before[:-1], before[1:]):
            def value(path):
                return sum(emit[a + i, p] for i, p in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

            paths = [[]]
            for _ in range(b - a):
                paths = [[*p, k] for p in paths for k in range(3)]
            assert np.isclose(value(list(got[a:b])), max(map(value, paths)), atol=1e-4)


def test_defined_results(spark, tmp_path):
    rows = ROWS + [(i + 1000 if i is not None else None, *rest) for i, *rest in awkward()] + [(5000, "12 34 — € !", "aa", "a")]
    found = L.op10_language_id(spark, documents(spark, tmp_path / "a", rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1004, 1005, 1006, 5000))
    assert all(0 <= r.score <= 1 for r in found) and by_id[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert L.op10_language_id(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "some words", None, "a"), (2, None, None, "a")])
    model = L.train(docs)
    assert collected(L.identify(docs, model, spans=False).select("doc_id", "lang_pred")) == [(1, "und"), (2, "und")]
    assert L.keep_identified(docs, model).count() == 0


def test_filter_keeps_rows_as_they_are(spark):
    docs = frame(spark, ROWS[:40] + [(900, "?!", "aa", "a"), (901, None, "aa", "a")])
    model = L.train(docs)
    kept = L.keep_identified(docs, model)
    assert kept.schema == docs.schema and collected(kept) == collected(docs.where("doc_id < 900"))


def test_features_and_labels_take_little_memory():
    """A piece of 3 MB once took over 100 MB in each Python worker for its hashes and trigrams alone."""
    rng = np.random.default_rng(8)
    letters = rng.integers(97, 123, 3 << 20).astype(np.uint8)
    letters[rng.integers(0, len(letters), len(letters) // 6)] = 0x20
    texts = [part.tobytes().decode() for part in np.array_split(letters, 400)]
    langs = ["aa", "bb", None, "cc"] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], names=["text", "lang"])
    languages = ["aa", "bb", "cc"]

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] >> 20
        finally:
            tracemalloc.stop()

    def counted():
        total = {0: 0, 1: 0, 2: 0}
        for out in L._count_features(languages)([batch]):
            total[out.column(0)[0].as_py()] += sum(out.column(3).to_pylist())
        return total

    total, most = peak(counted)
    words = [t.split() for t, lang in zip(texts, langs) if lang]
    n_words, n_letters = sum(map(len, words)), sum(len(w) for t in words for w in t)
    assert total == {0: n_words, 1: n_letters, 2: n_words}
    assert most < 120
    scores = np.zeros((1 << 15, 3), np.float32)
    model = L.LanguageModel(languages, np.zeros(0, np.uint64), np.zeros((0, 3), np.float32), scores, np.ones((len(L.SCRIPT_NAMES), 3), bool))
    piece = next(ragged.pieces(batch.column(0), L._PIECE_BYTES))
    assert peak(lambda: L._label_piece(model, piece, False))[1] < 120


def test_feature_counts_equal_plain_counts():
    texts, langs = [text_in(k, i, 40) for i, k in enumerate(list(VOCABULARY) * 3)], [*VOCABULARY, *"abcd", *VOCABULARY]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], names=["text", "lang"])
    found, wanted = collections.Counter(), collections.Counter()
    for out in L._count_features(list(VOCABULARY))([batch]):
        for kind, key, language, n in zip(*(c.to_pylist() for c in out.columns)):
            found[kind, key, language] += n
    for text, lang in zip(texts, langs):
        if lang not in VOCABULARY:
            continue
        data = ragged.LETTERS_ONLY[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, _ = ragged.words(data, np.array([0, len(data)]))
        language = list(VOCABULARY).index(lang)
        for k, (a, b) in enumerate(zip(starts, ends)):
            wanted[0, int(ragged.Hasher(data).spans(starts, ends)[k].view(np.int64)), language] += 1
            wanted[2, L._script(data[a:b].tobytes()), language] += 1
            for cell in L._grams(data[a:b], np.array([0]), np.array([b - a]))[0]:
                wanted[1, int(cell), language] += 1
    assert found == wanted


def test_keeping_over_several_pieces(spark):
    texts = [text_in("aa", i, 900) if i % 3 else "1 2 3" for i in range(2000)]
    docs = frame(spark, [(i, t, "aa", "a") for i, t in enumerate(texts)]).coalesce(1)
    model = L.train(docs)
    kept = L.keep_identified(docs, model, min_score=0.0)
    assert collected(kept) == collected(docs.where("doc_id % 3 <> 0"))
