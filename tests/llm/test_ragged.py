import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import words
from wikisift.llm import ragged
from wikisift.llm.eliasfano import EliasFano, encode
from wikisift.llm.lyndon import suffix_array


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é東\n\t\x0b ", max_size=12)), max_size=8), st.integers(1, 40))
def test_words_of_pieces(texts, limit):
    seen = []
    for piece in ragged.pieces(pa.array(texts, pa.string()), limit):
        starts, ends, before = ragged.words(piece.data, piece.offsets)
        hashes = ragged.Hasher(piece.data).spans(starts, ends)
        for k, row in enumerate(piece.rows):
            part = range(before[k], before[k + 1])
            found = [piece.data[starts[i] : ends[i]].tobytes().decode() for i in part]
            assert found == words(texts[row])
            assert len({(w, int(hashes[i])) for w, i in zip(found, part)}) == len(set(found))
            seen.append(int(row))
    assert seen == list(range(len(texts)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    data = b"xyz" + encode(values) + b"rest"
    code = EliasFano(data, 3)
    assert data[code.end :] == b"rest"
    assert (code.all() == values).all()
    for i in range(0, len(values), 50):
        assert code.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(encode(values)) * 8 / len(values) < 13


def test_word_hashes_equal_those_of_the_whole():
    data = np.frombuffer(b"".join(b"w%d " % (i % 977) for i in range(200_000)) + b"x" * 700_000 + b" end", np.uint8)
    starts, ends, _ = ragged.words(data, np.array([0, len(data)]))
    assert (ragged.word_hashes(data, starts, ends) == ragged.Hasher(data).spans(starts, ends)).all()
    assert len(ragged.word_hashes(data, starts[:0], ends[:0])) == 0
