"""Packing documents into fixed windows by lexical retrieval.

Texts become token ids, with an end id, and are cut into pieces of at most one window. A full piece is a sequence of
its own; the others are dealt to shards in the order of two weighted min-hashes of their ids, so that pieces with rare
words in common stand close, and a shard reads them in blocks. Each block gets an inverted BM25 index over token ids
(document frequencies and the mean length are those of the whole corpus). A seed opens a window and its unused
neighbours fill it, best score first, pieces without a common term last, in order; what the last one has left over is
the next seed. A block hands its open window on to the next, so that only the end of a shard is not full: it is cut
into sequences whose lengths are powers of two, which need no padding.

Nothing but the vocabulary and a count for each of its entries reaches the driver. A task holds one block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import query, table
from cumulus.session import materialise

WINDOW, END = 2_048, 1
K1, B = 1.2, 0.75
#: Pieces of a block, which has its own index; pieces of a shard, about, which one task packs block by block.
BLOCK, SHARD = 1_024, 16_384
#: A vocabulary's size doesn't depend on the data; a larger file is refused.
MAX_FILE_BYTES, MAX_IDS = 64 << 20, 1 << 20
#: Bytes of text that a worker encodes at once; long strings that it remembers, and their lengths in all.
CHARS, KEPT, KEPT_CHARS = 4_000_000, 700_000, 20_000_000
#: Rows and bytes of ids of an output batch.
ROWS, BYTES = 4_000, 16 << 20

# Letters whose lower case and normal form are those of the letter alone, and ASCII but for four signs that Python
# takes for white space.
_SIMPLE = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]*")
_NO_SPACE = np.array([b not in b"\t\n\x0b\x0c\r " for b in range(256)])
_LETTER = "a-z\xdf-\xf6\xf8-ſ"
#: The split pattern of the word vocabulary, for simple text in lower case.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t-\r 0-9{_LETTER}]+")
_LINE = "\n"
_LINED = re.compile(f"{_LINE}|{_WORD.pattern}")
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# What a vocabulary file says when text is split this way.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Known(dict):
    """Numbers of strings in the order in which they were first met, and the ids of all of them in one array.

    Strings of at most eight bytes are kept as whole numbers in a sorted array (``short``, their bytes) instead.
    """

    def __init__(self, dtype: np.dtype):
        super().__init__()
        self.fresh: list[str | bytes] = []
        self.flat, self.ends, self.chars = np.empty(0, dtype), np.zeros(1, np.int64), 0
        self.short, self.short_numbers, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def __missing__(self, text) -> int:
        number = self[text] = self.count
        self.count += 1
        self.fresh.append(text)
        return number

    def full(self) -> bool:
        return len(self) > KEPT or self.count > 4 * KEPT or self.chars > KEPT_CHARS

    def numbers(self, texts: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))

    def short_ones(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of short strings; new ones are ``fresh``."""
        some, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.short, some), max(len(self.short) - 1, 0))
        new = self.short[at] != some if len(self.short) else np.ones(len(some), bool)
        fresh = some[new]
        # a string of n bytes fills the n low bytes of its key, and no byte of it is 0 here
        self.fresh += [x.rstrip(b"\0") for x in fresh.astype("<u8").view("S8").tolist()]
        order = np.argsort(keys := np.concatenate([self.short, fresh]), kind="stable")
        self.short = keys[order]
        self.short_numbers = np.concatenate([self.short_numbers, self.count + np.arange(len(fresh))])[order]
        self.count += len(fresh)
        return self.short_numbers[np.searchsorted(self.short, some)][back]

    def learn(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the fresh strings, one after another."""
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.chars += sum(map(len, self.fresh))
        self.fresh = []

    def ids(self, numbers: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings by number, one after another, and how many come from each group of ``groups`` strings."""
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.diff(np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], groups]))])


def stretches(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, begin and end of every stretch between ASCII spaces, and the number of stretches of each text."""
    plain = texts.cast(pa.large_binary())
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    ends = ends - ends[0]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _NO_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a text's end is one of a stretch, too
    begin = np.flatnonzero(word[1:] & (edge | ~word[:-1]))
    end = np.flatnonzero(word[:-1] & (edge | ~word[1:]))
    return data, begin, end, np.diff(np.searchsorted(begin, ends))


class Encoder:
    """Ids of texts by the ``tokenizers`` library, which sees each word once where words can't touch each other.

    Simple text is cut at spaces and then into words; a stretch between spaces with any other character goes to the
    library whole. A vocabulary with other rules is used as it is, text by text. Special tokens are never added, and
    their strings in a text are ordinary text.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        text = data.decode()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(text)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        if self.size > MAX_IDS:
            raise ValueError(f"the vocabulary has more than {MAX_IDS} ids")
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word = spec.get("normalizer") == _NORMALIZER and pre[0].get("pattern") == {"Regex": _SPLIT} and len(pre) == 2 and spec["model"].get("end_of_word_suffix") == "</w>"
        self.words, self.stretches = _Known(self.dtype), _Known(self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self) -> None:
        parts, sizes = [], []
        if self.words.fresh[:1] == [_LINE]:  # between words it has no ids
            parts, sizes = [self.words.flat], [np.zeros(1, np.int64)]
        for at in range(len(parts), len(self.words.fresh), 2_000):
            some = self.words.fresh[at : at + 2_000]
            ids = self._whole([" ".join(some)])[0] if all(map(_SIMPLE.fullmatch, some)) else self.ends[:0]
            ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ()
            if len(ends) == len(some):  # a word's last id, and no other, is marked as an end
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self._whole(some)
                parts += each
                sizes.append(np.array([len(x) for x in each]))
        if parts:
            self.words.learn(np.concatenate(parts).astype(self.dtype), np.concatenate(sizes))

    def _learn_stretches(self) -> None:
        fresh = self.stretches.fresh
        odd = {i: x.decode() for i, x in enumerate(fresh) if not x.isascii()}
        odd = {i: x for i, x in odd.items() if not _SIMPLE.fullmatch(x)}
        # all simple ones at once, a line each; an odd one is a word of its own
        lines = fresh if not odd else [b"" if i in odd else x for i, x in enumerate(fresh)]
        split = _LINED.findall(b"\n".join(lines).decode().lower())
        lined = self.words.numbers(split)
        at = np.flatnonzero(lined == self.words[_LINE])
        groups = np.diff(np.concatenate([[-1], at, [len(lined)]])) - 1
        numbers = np.delete(lined, at)
        if odd:
            before = (np.cumsum(groups) - groups)[list(odd)]
            numbers = np.insert(numbers, before, self.words.numbers(list(odd.values())))
            groups[list(odd)] = 1
        self._learn_words()
        self.stretches.learn(*self.words.ids(numbers, groups))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; there is no null among them."""
        if not self.by_word:
            return self._whole(texts.to_pylist())
        if self.words.full():
            self.words = _Known(self.dtype)
        self.words[_LINE]  # the first of the words
        if self.stretches.full():
            self.stretches = _Known(self.dtype)
        data, begin, end, groups = stretches(texts)
        size = end - begin
        numbers = np.empty(len(begin), np.int64)
        eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,)) if data else np.empty(0, "<u8")
        keys = eights[begin] & _LOW_BYTES[np.minimum(size, 8)]
        # a byte 0 inside a short stretch would be lost
        short = (size <= 8) & ((data.find(b"\0") < 0) | (keys != 0) & np.logical_and.reduce([(size <= i) | ((keys >> np.uint64(8 * i)) & np.uint64(255) != 0) for i in range(8)]))
        numbers[short] = self.stretches.short_ones(keys[short])
        long = np.flatnonzero(~short)
        numbers[long] = self.stretches.numbers([data[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist())])
        if self.stretches.fresh:
            self._learn_stretches()
        flat, sizes = self.stretches.ids(numbers, groups)
        return np.split(flat, np.cumsum(sizes)[:-1])


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    return data


@functools.lru_cache(maxsize=2)
def _encoder(digest: str, data: bytes) -> Encoder:
    return Encoder(data)


def encoder(data: bytes) -> Encoder:
    return _encoder(hashlib.sha256(data).hexdigest(), data)


@functools.lru_cache(maxsize=2)
def _orders(size: int) -> list[np.ndarray]:
    """Two orders of the ids for min-hashes; late entries of a vocabulary are rare and come first more often."""
    random = np.random.default_rng(0)
    races = [-np.log(1 - random.random(size)) / (1 + np.arange(size)) for _ in range(2)]
    return [np.argsort(np.argsort(x)).astype(np.int32) for x in races]


def pieces(docs: DataFrame, vocabulary: bytes, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, doc_tokens, ids binary, near, nearer, place) of every piece; ``docs`` has doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["doc_id", "start", "doc_tokens", "ids", "near", "nearer", "place"]

    def run(batches):
        enc = encoder(shared.value)
        orders = _orders(enc.size)
        task, count = TaskContext.get().partitionId() << 40, 0

        def cut(keys: list, texts: pa.Array, kind: pa.DataType):
            nonlocal count
            rows: list[tuple] = []
            size = 0
            for key, coded in zip(keys, enc.encode(texts), strict=True):
                coded = np.append(coded, enc.dtype.type(end))
                for start in range(0, len(coded), window):
                    ids = coded[start : start + window]
                    rows.append((key, start, len(coded), ids.tobytes(), *(int(o[ids].min()) for o in orders), task + count))
                    count += 1
                    size += ids.nbytes
                    if len(rows) >= ROWS or size >= BYTES:
                        yield batch_of(rows, kind)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows, kind)

        def batch_of(rows, kind):
            columns = zip(*rows)
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARS)))
                yield from cut(batch.column(0)[at:to].to_pylist(), texts[at:to], batch.column(0).type)
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, doc_tokens long, ids binary, near int, nearer int, place long")


def _distinct(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, id, count) of the distinct ids of each piece, by piece and id."""
    kind = np.uint32 if len(ids) <= 1 << 12 else np.uint64
    flat = np.concatenate(ids).astype(kind)
    flat |= np.repeat(np.arange(len(ids), dtype=kind) << kind(20), [len(x) for x in ids])
    flat.sort()
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    keys = flat[at].astype(np.int64)
    return keys >> 20, keys & (MAX_IDS - 1), np.diff(np.append(at, len(flat)))


def statistics(cut: DataFrame, size: int, dtype: str) -> tuple[np.ndarray, int, int]:
    """Pieces that hold each id, number of pieces, number of ids; a row for each entry of the vocabulary is collected."""

    def run(batches):
        held, rows, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 4_096):
                ids = [np.frombuffer(x.as_buffer(), dtype) for x in column[at : at + 4_096]]
                held += np.bincount(_distinct(ids)[1], minlength=size)
                rows, total = rows + len(ids), total + sum(map(len, ids))
        some = np.flatnonzero(held)
        keys = np.concatenate([some, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([held[some], [rows, total]]))], names=["id", "n"])

    counts = {r["id"]: r["n"] for r in cut.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    held = np.zeros(size, np.int64)
    for i, n in counts.items():
        if i >= 0:
            held[i] = n
    return held, counts.get(-1, 0), counts.get(-2, 0)


class Index:
    """An inverted index of one block: postings by term with BM25 weights."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        piece, term, count = _distinct(ids)
        some = idf[term] > 0
        piece, term, count = piece[some], term[some], count[some]
        self.n = len(ids)
        self.rows = np.searchsorted(piece, np.arange(self.n + 1))
        self.terms = term
        length = np.fromiter(map(len, ids), np.int64, self.n)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[piece] / mean))
        order = np.argsort(term, kind="stable")
        self.pieces, self.weights = piece[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def query_terms(self, i: int) -> np.ndarray:
        return self.terms[self.rows[i] : self.rows[i + 1]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        begin = self.starts[terms]
        sizes = self.starts[terms + 1] - begin
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.pieces[at], self.weights[at], self.n)


class Packer:
    """Windows of one shard. ``put`` takes a block of (doc_id, start, doc_tokens, ids), ``close`` ends the last window."""

    def __init__(self, idf: np.ndarray, mean: float, window: int = WINDOW, first: int = 0):
        self.idf, self.mean, self.window, self.sequence = idf, mean, window, first
        self.filled, self.query, self.open = 0, np.empty(0, np.int64), []

    def _place(self, piece: tuple) -> tuple | None:
        """Put what fits into the open window; the rest is returned."""
        key, start, total, ids = piece
        some = ids[: self.window - self.filled]
        self.open.append((key, start, total, some, self.sequence, self.filled))
        self.filled += len(some)
        return (key, start + len(some), total, ids[len(some) :]) if len(some) < len(ids) else None

    def _done(self) -> Iterator[tuple]:
        yield from self.open
        self.filled, self.open, self.sequence = 0, [], self.sequence + 1

    def put(self, block: list[tuple]) -> Iterator[tuple]:
        for piece in block:
            if len(piece[3]) == self.window:
                yield (*piece, self.sequence, 0)
                self.sequence += 1
        self.open = [(*x[:4], self.sequence, x[5]) for x in self.open]  # the numbers before it went to full pieces
        block = [x for x in block if len(x[3]) < self.window]
        if not block:
            return
        index = Index([x[3] for x in block], self.idf, self.mean)
        free, left, at = np.ones(len(block), bool), len(block), 0
        while left:
            if not self.filled:
                while not free[at]:
                    at += 1
                free[at], left = False, left - 1
                self.query = index.query_terms(at)
                self._place(block[at])
            scores = index.scores(self.query)
            scores[~free] = -1
            for i in np.argsort(-scores, kind="stable")[:left].tolist():
                free[i], left = False, left - 1
                rest = self._place(block[i])
                if self.filled == self.window:
                    yield from self._done()
                    if rest:
                        self.query = index.query_terms(i)
                        self._place(rest)
                    break

    def close(self) -> Iterator[tuple]:
        """The open window as sequences whose lengths are powers of two."""
        last, self.open, self.filled = self.open, [], 0
        size, left = 0, sum(len(x[3]) for x in last)
        for piece in last:
            rest: tuple | None = piece[:4]
            while rest:
                if not size:
                    size = 1 << (left.bit_length() - 1)
                key, start, total, ids = rest
                some = ids[: size - self.filled]
                yield key, start, total, some, self.sequence, self.filled
                self.filled, left = self.filled + len(some), left - len(some)
                rest = (key, start + len(some), total, ids[len(some) :]) if len(some) < len(ids) else None
                if self.filled == size:
                    self.sequence, self.filled, size = self.sequence + 1, 0, 0


def inverse_frequency(held: np.ndarray, rows: int) -> np.ndarray:
    """log((n - df + 0.5) / (df + 0.5)), 0 for ids that half of the pieces hold."""
    return np.where(held > 0, np.maximum(np.log((rows - held + 0.5) / (held + 0.5)), 0), 0)


def pack(docs: DataFrame, vocabulary: bytes, window: int = WINDOW, end: int = END, key: str = "doc_id", text: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece of a packed sequence.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids before the piece, ``offset``
    those before it in its sequence. Every document has its end id, so a null or empty text has one id. Rows with the
    same key, or equal ones, are documents of their own; ties go by place in the input. Sequences hold ``window`` ids
    but at the end of a shard, where their lengths are powers of two. An empty table gives an empty result. Other
    columns are not read.
    """
    enc = encoder(vocabulary)
    dtype, kind = enc.dtype.str, docs.schema[key].dataType.simpleString()
    cut = materialise(pieces(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), vocabulary, window, end), "pieces")
    held, rows, total = statistics(cut, enc.size, dtype)
    shared = docs.sparkSession.sparkContext.broadcast((inverse_frequency(held, rows), total / max(rows, 1)))
    by = ["near", "nearer", "place"]
    dealt = cut.repartitionByRange(max(1, -(-rows // shard)), *by).sortWithinPartitions(*by)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        idf, mean = shared.value
        packer = Packer(idf, mean, window, TaskContext.get().partitionId() << 40)
        key_type = None

        def out(found: Iterator[tuple]):
            some, size = [], 0
            for x in found:
                some.append((x[0], x[1], len(x[3]), x[2], x[4], x[5], x[3].astype("<u4").tobytes()))
                size += len(some[-1][-1])
                if len(some) >= ROWS or size >= BYTES:
                    yield batch_of(some)
                    some, size = [], 0
            if some:
                yield batch_of(some)

        def batch_of(some):
            kinds = [key_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

        held: list[tuple] = []
        for batch in batches:
            key_type = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in range(3)]
            held += zip(*columns, (np.frombuffer(x.as_buffer(), dtype) for x in batch.column(3)))
            while len(held) >= block:
                yield from out(packer.put(held[:block]))
                held = held[block:]
        yield from out(packer.put(held))
        yield from out(packer.close())

    return dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def word_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2,048 ids, with a checksum of every piece."""
    packed = pack(table(spark, sf_dir, "documents"), read_vocabulary(word_file()))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
