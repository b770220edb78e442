"""Token ids of a corpus in binary files, with Elias-Fano coded document boundaries.

Documents are range-partitioned by id; each task tokenises its run of documents and
writes files of about ``file_ids`` ids. A file is one concatenated little-endian id array
(16 bits where the vocabulary allows it) between two Elias-Fano codes: the document ids,
and the boundaries of the documents in the array. A task that runs again writes the same
bytes under the same names; a file appears under its name only when it is whole.

File: magic, numbers of documents, of documents without an id and of ids, bytes per id,
the code of the document ids, the code of the boundaries (one more than documents), ids.

Defined results: a null or empty text has only the end id; rows without an id come first
and are read back with a null id; rows with the same id stand in the order of their texts.
A text of any length is tokenised whole and stands in one file, which may be longer for
it. An empty table gives no files and no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wikisift.llm import ragged
from wikisift.llm.eliasfano import EliasFano, encode
from wikisift.sources.tables import materialize, scratch_dir

_MAGIC = b"WSTOKEN1"
_HEADER = struct.Struct("<8sQQQB7x")
_CACHE_WORDS = 500_000
_RECENT_WORDS = 40_000
_CACHED_BYTES = 100
_JOINED = 400
_MANIFEST = "file string, part int, number int, n_docs bigint, n_ids bigint"
_loaded: dict = {}


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def _units(piece: ragged.Piece) -> tuple[np.ndarray, ...]:
    """Bytes, start and end of the units of a piece, which are plain, and the number of units before each document.

    A unit is a word, cut again where an ASCII letter meets a full stop or comma. Plain ones
    are lower-cased as far as ASCII goes. Those with a character beyond Latin-1, which may
    compose with its letter, or with the mark of special ids are not plain and stay as they are.
    """
    data = piece.data
    starts, ends, _ = ragged.words(data, piece.offsets)
    if len(data) > 1:
        cut = (_LETTER[data[1:]] & _STOP[data[:-1]]) | (_STOP[data[1:]] & _LETTER[data[:-1]])
        cuts = np.setdiff1d(np.flatnonzero(cut) + 1, piece.offsets)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    odd = np.concatenate([[0], np.cumsum((data >= 0xC4) | (data == 0x3C))])
    odd = odd[ends] > odd[starts]
    folded = ragged.lower_ascii(data)
    if odd.any():
        lengths = (ends - starts)[odd]
        at = np.repeat(starts[odd], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        folded[at] = data[at]
    return folded, starts, ends, ~odd, np.searchsorted(starts, piece.offsets)


class _Words:
    """Ids of units, for a tokenizer that drops white space and case and takes letters apart from stops.

    Units that came up are kept, sorted by a hash and told apart by a second one: a large
    table, and a small one of recent units that is merged into it now and then. When there
    are too many, those not seen for longest go.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ids, self.now = np.zeros(0, self.kind), 0
        self.tables = [self._table(*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3) for _ in range(2)]

    @staticmethod
    def _table(key, check, at, count, seen):
        order = np.argsort(key)
        return {"key": key[order], "check": check[order], "at": at[order], "count": count[order], "seen": seen[order]}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _tokenise(self, units: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, the plain ones first, and how many each has. Plain ones are tokenised many in one call."""
        found, counts = [np.zeros(0, self.kind)], np.zeros(len(units), np.int64)
        at = np.flatnonzero(plain)
        for k in range(0, len(at), _JOINED):
            some = at[k : k + _JOINED]
            joined = [units[i] for i in some.tolist()]
            encoded = self.tokenizer.encode(" ".join(joined), add_special_tokens=False)
            begins = np.cumsum([0] + [len(u) + 1 for u in joined])
            counts[some] = np.diff(np.searchsorted(np.array([a for a, _ in encoded.offsets], np.int64), begins))
            found.append(np.array(encoded.ids, self.kind))
        for i in np.flatnonzero(~plain).tolist():
            found.append(np.frombuffer(self.encode(units[i]), self.kind))
            counts[i] = len(found[-1])
        return np.concatenate(found), counts

    def _keep(self, key, check, at, count):
        """Add units to the recent table; merge and thin out where needed."""
        old, recent = self.tables
        seen = np.full(len(key), self.now)
        recent = self._table(*(np.concatenate([recent[c], x]) for c, x in zip(("key", "check", "at", "count", "seen"), (key, check, at, count, seen))))
        if len(recent["key"]) > _RECENT_WORDS:
            old = {c: np.concatenate([old[c], recent[c]]) for c in old}
            if len(old["key"]) > _CACHE_WORDS:
                keep = np.flatnonzero(old["seen"] > np.quantile(old["seen"], 0.5))
                old = {c: v[keep] for c, v in old.items()}
                self.ids = self.ids[_ranges(old["at"], old["count"])]
                old["at"] = np.cumsum(old["count"]) - old["count"]
            old, recent = self._table(**old), {c: v[:0] for c, v in recent.items()}
        self.tables = [old, recent]

    def piece_ids(self, piece: ragged.Piece, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a piece in a row, each with the end id, and how many each has."""
        self.now += 1
        folded, starts, ends, plain, before = _units(piece)
        key, first, inverse = np.unique(ragged.Hasher(folded).spans(starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        lengths = ends - starts
        check = _second_hash(folded, starts, lengths)
        at, count = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for table in self.tables:
            if len(table["key"]):
                place = np.minimum(np.searchsorted(table["key"], key), len(table["key"]) - 1)
                known = np.flatnonzero((table["key"][place] == key) & (table["check"][place] == check))
                at[known], count[known] = table["at"][place[known]], table["count"][place[known]]
                table["seen"][place[known]] = self.now
        ids = self.ids
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.argsort(~plain[first[new]], kind="stable")]
            raw = folded.tobytes()
            fresh, counts = self._tokenise([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())], plain[first[new]])
            at[new], count[new] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.concatenate([ids, fresh])
            short = lengths[new] <= _CACHED_BYTES
            if short.all():
                self.ids = ids
            else:
                self.ids = np.concatenate([self.ids, fresh[np.repeat(short, counts)]])
            kept = np.cumsum(counts * short) - counts * short + len(self.ids) - (counts * short).sum()
            self._keep(key[new][short], check[new][short], kept[short], counts[short])
        counts = count[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        per_doc = total[before[1:]] - total[before[:-1]] + 1
        out = np.full(int(per_doc.sum()), end_id, self.kind)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(per_doc) - 1] = False
        out[inside] = ids[_ranges(at[inverse], counts)]
        return out, per_doc


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``count`` of them, in a row."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _second_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of spans, independent of that of ``ragged``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(257)
    return ragged.mix(np.add.reduceat(ragged.mix(values * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64)), np.cumsum(lengths) - lengths))


def _encoder(path: str) -> _Words:
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def write_file(target: str, doc_ids: list[int | None], boundaries: np.ndarray, ids: bytes, width: int) -> None:
    """Write one file; ``target`` is a path or a URI that Arrow can open."""
    fs, path = pafs.FileSystem.from_uri(target)
    unnamed = sum(d is None for d in doc_ids)
    named = np.array(doc_ids[unnamed:], np.int64)
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(_HEADER.pack(_MAGIC, len(doc_ids), unnamed, int(boundaries[-1]), width))
        out.write(encode(named))
        out.write(encode(boundaries))
        out.write(ids)
    try:
        fs.move(draft, path)
    except OSError:  # on stores that replace nothing, the file of an earlier attempt stays
        there, own = fs.get_file_info([path, draft])
        if there.type != pafs.FileType.File or there.size != own.size:
            raise
        fs.delete_file(draft)


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, boundaries and the id array of a file."""
    magic, docs, unnamed, n_ids, width = _HEADER.unpack_from(content, 0)
    if magic != _MAGIC:
        raise ValueError("not a token file")
    named = EliasFano(content, _HEADER.size)
    bounds = EliasFano(content, named.end)
    ids = np.frombuffer(content, f"<u{width}", n_ids, bounds.end)
    return [None] * unnamed + named.all().tolist(), bounds.all(), ids


def document(content: bytes, i: int) -> np.ndarray:
    """Ids of document ``i`` of a file, found by two selects."""
    *_, n_ids, width = _HEADER.unpack_from(content, 0)
    bounds = EliasFano(content, EliasFano(content, _HEADER.size).end)
    first, end = bounds.select(i), bounds.select(i + 1)
    return np.frombuffer(content, f"<u{width}", end - first, bounds.end + first * width)


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_tokens(
    docs: DataFrame, output: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
    words_apart: bool = False, file_ids: int = 4_000_000,
) -> DataFrame:
    """Write the files into the folder ``output``; a table of the files in order, with the ids before each.

    ``tokenizer`` is a file of the tokenizers library that every executor can read.
    ``words_apart`` says that it drops white space and case and takes letters apart from
    stops, so words can be looked up instead of tokenised again.
    """
    target = _uri(output)
    fs, path = pafs.FileSystem.from_uri(target)
    fs.create_dir(path, recursive=True)

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = _encoder(tokenizer)
        kind, part, number = words.kind, TaskContext.get().partitionId(), 0
        names, lengths, chunks, held = [], [], [], 0

        def flush():
            nonlocal names, lengths, chunks, held, number
            file = f"tokens-{part:06d}-{number:06d}.bin"
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            write_file(f"{target}/{file}", names, bounds, np.concatenate(chunks).tobytes(), kind.itemsize)
            row = pa.RecordBatch.from_pydict({
                "file": [file], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                "n_docs": [len(names)], "n_ids": [held],
            })
            names, lengths, chunks, held, number = [], [], [], 0, number + 1
            return row

        def whole(piece):
            raw, end = piece.data.tobytes(), np.array([end_id], kind)
            parts = [np.frombuffer(words.encode(raw[a:b].decode()), kind) for a, b in zip(piece.offsets[:-1], piece.offsets[1:])]
            return np.concatenate([x for p in parts for x in (p, end)]), np.array([len(p) + 1 for p in parts])

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for piece in ragged.pieces(b.column(1)):
                ids, counts = words.piece_ids(piece, end_id) if words_apart else whole(piece)
                ends, first = np.cumsum(counts), 0
                while first < piece.n:  # a file ends with the document that fills it
                    done = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, done + file_ids - held)) + 1, piece.n)
                    names += ids_of[piece.rows[first] : piece.rows[first] + last - first]
                    lengths.append(counts[first:last])
                    chunks.append(ids[done : ends[last - 1]])
                    held += int(ends[last - 1]) - done
                    first = last
                    if held >= file_ids:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = materialize(rows.mapInArrow(run, _MANIFEST), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return materialize(files, "token-manifest")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document in the files of a table of ``write_tokens``."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                names, bounds, tokens = read_file(content.as_buffer())
                wide = tokens.astype("<u4")
                crc = [zlib.crc32(wide[i:j].data) for i, j in zip(bounds[:-1], bounds[1:])]
                columns = [pa.array([file] * len(names)), pa.array(names, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(wide.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * ids])

    schema = "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    found = content.mapInArrow(run, schema).join(files.select("file", "first_id"), "file")
    return found.select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), words_apart=True)
    return read_tokens(spark, folder, files, ids=False)
