import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import awkward, documents, frame, prose
from wikisift.llm import ragged
from wikisift.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = awkward([(30, "<|endoftext|> a<|startoftext|>b  c", "xx", "a"), (-5, "it's  we'll x ́y\x1cz", "xx", "a"), (31, "İI ΣΑΣ ﬁ", "xx", "a")])


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n'<|>é1áΣσs"), st.characters(codec="utf-8")), max_size=40))
def test_pieces_between_blanks_give_the_ids_of_the_whole(text):
    check_pieces([text])


def check_pieces(texts):
    words = K._encoder(PATH)
    for piece in ragged.pieces(pa.array(texts)):
        ids, counts = words.piece_ids(piece, 1)
        assert ids.tolist() == [i for k in piece.rows for i in whole(texts[k])]
        assert counts.tolist() == [len(whole(texts[k])) for k in piece.rows]


def test_units_are_kept_and_forgotten(monkeypatch):
    monkeypatch.setattr(K, "_CACHE_WORDS", 60)
    monkeypatch.setattr(K, "_RECENT_WORDS", 20)
    monkeypatch.setattr(K, "_loaded", {})
    texts = [prose(i, 40) + " J\u030c E\u0301. <|ENDOFTEXT|>,x it's,'s " + "long" * 40 for i in range(30)] + [None, "", "<|endoftext|>"]
    for i in range(0, len(texts), 3):
        check_pieces(texts[i : i + 3])
    check_pieces(texts)
    assert len(K._encoder(PATH).tables[0]["key"]) <= 90


def test_round_trip(spark, tmp_path):
    docs = frame(spark, CASES)
    files = K.write_tokens(docs, str(tmp_path / "out"), PATH, words_apart=True, file_ids=300)
    assert files.count() > 8
    found = K.read_tokens(spark, str(tmp_path / "out"), files).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r[0] for r in CASES), key=lambda x: (x is not None, x))
    want = {}
    for r in CASES:
        want.setdefault(r[0], []).append(whole(r[1]))
    start = 0
    for r in found:
        assert r.ids in want[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    again = K.write_tokens(docs, str(tmp_path / "again"), PATH, file_ids=300)
    assert [tuple(r) for r in again.orderBy("file").collect()] == [tuple(r) for r in files.orderBy("file").collect()]
    for r in files.collect():
        content = (tmp_path / "out" / r.file).read_bytes()
        assert content == (tmp_path / "again" / r.file).read_bytes()
        names, bounds, ids = K.read_file(content)
        for i in range(len(names)):
            assert (K.document(content, i) == ids[bounds[i] : bounds[i + 1]]).all()


def test_query_and_empty_table(spark, tmp_path):
    found = K.op3_token_files(spark, documents(spark, tmp_path / "a", CASES))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = {}
    for r in CASES:
        want.setdefault(r[0], set()).add((len(whole(r[1])), zlib.crc32(np.array(whole(r[1]), "<u4").tobytes())))
    start, rows = 0, found.orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in CASES), key=lambda x: (x is not None, x))
    for r in rows:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens


def test_file_of_an_earlier_attempt_stays(tmp_path, monkeypatch):
    args = f"file://{tmp_path}/tokens-1.bin", [1, 2], np.array([0, 1, 3]), np.array([5, 6, 7], "<u2").tobytes(), 2
    K.write_file(*args)
    content = (tmp_path / "tokens-1.bin").read_bytes()

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, *_):
            raise OSError("exists")

    plain = K.pafs.FileSystem.from_uri
    monkeypatch.setattr(K.pafs, "FileSystem", type("Store", (), {"from_uri": staticmethod(lambda uri: (Refusing(plain(uri)[0]), plain(uri)[1]))}))
    K.write_file(*args)
    assert (tmp_path / "tokens-1.bin").read_bytes() == content and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(OSError):
        K.write_file(args[0].replace("-1", "-2"), *args[1:])


def test_empty_table(spark, tmp_path):
    assert K.op3_token_files(spark, documents(spark, tmp_path / "b", [])).count() == 0
