"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word; a Viterbi pass over per-word
scores with a penalty for each switch then labels spans. The document's language is the
one whose spans hold most letters.

The word and character models are counted by Spark over a sample of labelled rows: at
most about ``docs_per_language`` documents of each language that occurs, picked by a
hash of the id. The models have ``max_words`` words and ``2**_GRAM_BITS`` character
trigram cells; sample and models grow with the number of languages only. Prediction
reads nothing but the text, whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no
spans; so is every text when there was nothing to learn from. A tie goes to the language
that sorts first. Repeated rows give repeated rows; a null id is neither learned from nor
held out. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm import ragged

_GRAM_BITS = 15
_PIECE_BYTES = 3 << 20
UNDETERMINED = "und"

# First and last code point of the blocks that tell scripts apart.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ["other"]
_SCRIPT_OF = [(SCRIPT_NAMES.index(name), first, last) for name, first, last in SCRIPTS]

@dataclass
class LanguageModel:
    """Log scores per language (columns in the order of ``languages``)."""

    languages: list[str]
    word_keys: np.ndarray  # sorted hashes of known words
    word_scores: np.ndarray
    gram_scores: np.ndarray
    scripts: np.ndarray  # [script, language]: the language is written in it
    switch_penalty: float = 6.0
    spread: float = 6.0  # a word counts at most so much against a language
    script_penalty: float = 12.0


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of each word, bounded by a blank on each side, and their word."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + place
    middle = data[at].astype(np.uint64)
    left = np.where(place > 0, data[np.maximum(at - 1, 0)], 0x20).astype(np.uint64)
    last = place == np.repeat(lengths, lengths) - 1
    right = np.where(last, 0x20, data[np.minimum(at + 1, len(data) - 1)]).astype(np.uint64)
    code = (left << np.uint64(16)) | (middle << np.uint64(8)) | right
    return (ragged.mix(code) >> np.uint64(64 - _GRAM_BITS)).astype(np.int64), owner


def _gram_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for some of the words at a time, as a cell takes many times the memory of its bytes."""
    for block in ragged.blocks(starts, ends):
        cells, owner = _grams(data, starts[block], ends[block])
        yield cells, owner + block.start


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of their counts."""
    unique, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, inverse, n)
    return unique, sums


def _script(word: bytes) -> int:
    """Script of the first letter, -1 for a word without one."""
    for char in word.decode("utf-8", "replace"):
        if char.isalpha():
            code = ord(char)
            return next((s for s, first, last in _SCRIPT_OF if first <= code <= last), len(SCRIPT_NAMES) - 1)
    return -1


def _distinct(data: np.ndarray, offsets: np.ndarray):
    """Words of a piece and its distinct words: spans, words before each document, first occurrence, number."""
    folded = ragged.LETTERS_ONLY[data]
    starts, ends, before = ragged.words(folded, offsets)
    keys = ragged.word_hashes(folded, starts, ends)
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return folded, starts, ends, before, unique, first, inverse


def _count_features(languages: list[str]):
    """Per batch: counts of words, trigram cells and scripts by language, as (kind, key, language, n)."""
    index = {name: i for i, name in enumerate(languages)}
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("language", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = np.array([index.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            for piece in ragged.pieces(b.column(0)):
                folded, starts, ends, before, unique, first, inverse = _distinct(piece.data, piece.offsets)
                if not len(starts):
                    continue
                count = len(languages)
                label = np.repeat(labels[piece.rows], np.diff(before))
                script = np.array([_script(folded[starts[i] : ends[i]].tobytes()) for i in first])
                # Cells and scripts of a word are counted once, times its occurrences in each language.
                word, times = np.unique(inverse[label >= 0] * count + label[label >= 0], return_counts=True)
                word, lang = word // count, word % count
                cells = [_summed(cell * count + lang[owner], times[owner]) for cell, owner in _gram_blocks(folded, starts[first[word]], ends[first[word]])]
                if not cells:
                    continue
                cells = _summed(*(np.concatenate(part) for part in zip(*cells)))
                lettered = script[word] >= 0
                scripts = _summed((script[word] * count + lang)[lettered], times[lettered])
                for kind, (pair, n) in enumerate(((word * count + lang, times), cells, scripts)):
                    key_of = pair // count
                    out = unique[key_of].view(np.int64) if kind == 0 else key_of
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), kind, np.int8)), pa.array(out), pa.array((pair % count).astype(np.int32)), pa.array(n)],
                        schema=schema,
                    )

    return run


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    docs_per_language: int = 1500, max_words: int = 50_000, **settings,
) -> LanguageModel:
    """Learn from the rows of ``labelled`` with a language and a text, within the bounds of the module docstring."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.collect()
    languages = sorted(r["lang"] for r in top)
    if not languages:
        empty = np.zeros((0, 0), np.float32)
        return LanguageModel([], np.zeros(0, np.uint64), empty, empty, np.zeros((len(SCRIPT_NAMES), 0), bool))
    limits = [(r["lang"], min(int(2**64 * min(1.0, docs_per_language / r["n"])) - 2**63, 2**63 - 1)) for r in top]
    limits = labelled.sparkSession.createDataFrame(limits, "lang string, most bigint")
    counts = (
        rows.join(F.broadcast(limits), "lang").where("h <= most").select("text", "lang")
        .mapInArrow(_count_features(languages), "kind tinyint, key bigint, language int, n bigint")
        .groupBy("kind", "key", "language").agg(F.sum("n").alias("n"))
    )
    found = counts.where("kind = 0").groupBy("key").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by")
    )
    best = found.orderBy(F.desc("total"), "key").limit(max_words).collect()
    rest = counts.where("kind > 0").toArrow()  # at most 2**_GRAM_BITS cells and the scripts, of each language
    width = len(languages)

    def matrix(kind, height):
        of, key, language, n = (rest.column(name).to_numpy() for name in ("kind", "key", "language", "n"))
        m = np.zeros((height, width))
        m[key[of == kind], language[of == kind]] = n[of == kind]
        return m

    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    words = np.zeros((len(best), width))
    for row, i in enumerate(order):
        for language, n in best[i]["by"].items():
            words[row, language] = n
    grams, scripts = matrix(1, 1 << _GRAM_BITS), matrix(2, len(SCRIPT_NAMES))

    def log_share(m):
        return np.log((m + 0.5) / (m.sum(axis=0, keepdims=True) + 0.5 * len(m))).astype(np.float32)

    used = scripts >= np.maximum(scripts.sum(axis=0, keepdims=True) * 0.01, 1)
    return LanguageModel(languages, keys[order], log_share(words) if len(best) else np.zeros((0, width), np.float32), log_share(grams), used, **settings)


def _emissions(model: LanguageModel, folded, starts, ends, unique, first) -> tuple[np.ndarray, np.ndarray]:
    """Score of each distinct word in each language, best 0, and which of them have a letter."""
    width = len(model.languages)
    scores = np.zeros((len(unique), width), np.float32)
    at = np.minimum(np.searchsorted(model.word_keys, unique), max(len(model.word_keys) - 1, 0))
    known = model.word_keys[at] == unique if len(model.word_keys) else np.zeros(len(unique), bool)
    scores[known] = model.word_scores[at[known]]
    new = np.flatnonzero(~known)
    lettered = np.ones(len(unique), bool)
    script = np.full(len(unique), -2)
    plain = folded[starts[first]] < 128  # words begin with an ASCII letter, or else are looked at
    script[plain] = 0
    for i in np.flatnonzero(~plain):
        script[i] = _script(folded[starts[first[i]] : ends[first[i]]].tobytes())
        lettered[i] = script[i] >= 0
    if len(new):
        for cells, owner in _gram_blocks(folded, starts[first[new]], ends[first[new]]):
            words, low = new[owner[0] : owner[-1] + 1], owner[0]
            scores[words] = np.stack([np.bincount(owner - low, model.gram_scores[cells, k], len(words)) for k in range(width)], axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    np.maximum(scores, -model.spread, out=scores)
    fits = model.scripts[script]  # for a script that no language has, all stay candidates
    scores -= np.where(fits | ~fits.any(axis=1, keepdims=True), 0, model.script_penalty).astype(np.float32)
    scores[~lettered] = 0
    return scores, lettered


def _viterbi(emit: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. All documents of a piece advance word by word together, the long ones last."""
    counts = np.diff(before)
    order = np.argsort(-counts, kind="stable")
    base, counts = before[:-1][order], counts[order]
    kind = np.min_scalar_type(-max(emit.shape[1], 1))  # one byte up to 128 languages
    labels = np.zeros(len(emit), kind)
    if not len(emit):
        return labels
    steps = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # documents with more than t words
    came = np.zeros(emit.shape, kind)
    own = np.arange(emit.shape[1], dtype=kind)
    value = emit[base[: active[0]]].astype(np.float64)
    last = np.zeros(active[0], kind)
    for t in range(1, steps + 1):
        n = active[t] if t < steps else 0
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        if not n:
            break
        best = value.argmax(axis=1)
        switched = value[np.arange(n), best][:, None] - penalty
        stay = value >= switched
        at = base[:n] + t
        came[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, switched) + emit[at]
    state = np.zeros(0, kind)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        state = np.concatenate([state, last[len(state) : n]])
        at = base[:n] + t
        labels[at] = state
        if t:
            state = came[at, state]
    return labels


def _piece_bytes(model: LanguageModel) -> int:
    """Size of pieces: a word has a score for each language, so many languages make smaller ones."""
    return _PIECE_BYTES * 16 // max(len(model.languages), 16)


def _label_piece(model: LanguageModel, piece: ragged.Piece, with_spans: bool):
    """Predicted language number (-1: none), score, and spans of each document of a piece."""
    n, width = piece.n, len(model.languages)
    if not width:
        return np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
    folded, starts, ends, before, unique, first, inverse = _distinct(piece.data, piece.offsets)
    emit, lettered = _emissions(model, folded, starts, ends, unique, first)
    emit, weight = emit[inverse], (ends - starts) * lettered[inverse]
    labels = _viterbi(emit, before, model.switch_penalty)
    owner = np.repeat(np.arange(n), np.diff(before))
    held = np.bincount(owner * width + labels, weight, n * width).reshape(n, width)
    total = held.sum(axis=1)
    best = np.where(total > 0, held.argmax(axis=1), -1)
    sums = np.stack([np.bincount(owner, emit[:, k], n) for k in range(width)], axis=1)
    likely = np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0))
    likely = likely[np.arange(n), np.maximum(best, 0)] / likely.sum(axis=1)
    share = held[np.arange(n), np.maximum(best, 0)] / np.maximum(total, 1)
    # Many spans of other languages do not make a long text doubtful: each counts by its letters.
    score = np.where(total > 0, share * np.maximum(likely, share), 0.0)
    spans = [[] for _ in range(n)]
    if with_spans and len(starts):
        characters = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        opens = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])]))
        closes = np.concatenate([opens[1:], [len(labels)]]) - 1
        for i, j in zip(opens, closes):
            doc = owner[i]
            if best[doc] >= 0:
                zero = characters[piece.offsets[doc]]
                spans[doc].append({
                    "start": int(characters[starts[i]] - zero), "end": int(characters[ends[j]] - zero),
                    "lang": model.languages[labels[i]],
                })
    return best, score, spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and, if asked for, ``spans`` (code points) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for b in batches:
            best, score, found = [np.zeros(0, np.int64)], [np.zeros(0)], []
            for piece in ragged.pieces(b.column(b.num_columns - 1), _piece_bytes(shared.value)):
                one, two, three = _label_piece(shared.value, piece, spans)
                best.append(one), score.append(two), found.extend(three)
            out = [*b.columns[:-1], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())]
            if spans:
                out.append(pa.array(found, _SPANS))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score", *["spans"] * spans])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kept}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is determined with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for piece in ragged.pieces(b.column(at), _piece_bytes(shared.value)):
                best, score, _ = _label_piece(shared.value, piece, False)
                # Passed on by the piece: a second copy of a whole batch is never held.
                yield b.slice(piece.rows[0], piece.n).filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def fold(key: str = "doc_id"):
    """The held-out fifth: remainder by 5 of the CRC-32 of the id's decimal text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def op10_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold() != 0))
    found = identify(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
