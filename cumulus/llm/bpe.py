"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``LONG`` characters are cut where the splitting pattern cannot match across: after a letter that
no letter follows, after a digit that no digit follows, or between a visible character and white space. A run of
white space longer than ``RUN`` is one match of the pattern (but for its last character, if text follows), so it
is merged as one piece without the regular expression. The ids are those of the uncut text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import batches_of, query, table

LONG, RUN = 50_000, 4_096
#: A rank file is a vocabulary: its size doesn't depend on the data. A larger file is refused.
MAX_RANK_BYTES = 64 << 20
#: Rows of one output batch.
ROWS = 1_000

_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})")
_BLANK = regex.compile(r"\p{White_Space}{%d,}" % RUN)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return data


@functools.lru_cache(maxsize=4)
def _encoding(digest: str, pattern: str, data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding(digest, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    return _encoding(hashlib.sha256(data).hexdigest(), pattern, data)


def chunks(text: str) -> Iterator[tuple[bool, str]]:
    """(is one piece, part) for the parts of a text, cut at safe places only."""
    at = 0
    for blank in _BLANK.finditer(text):
        end = blank.end() - (blank.end() < len(text))
        yield from ((False, part) for part in _cut(text, at, blank.start()))
        yield True, text[blank.start() : end]
        at = end
    yield from ((False, part) for part in _cut(text, at, len(text)))


def _cut(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > LONG:
        found = _SAFE.search(text, at + LONG, end)
        if not found or found.start() >= end:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < end:
        yield text[at:end]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG and (len(text) <= RUN or not _BLANK.search(text)):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for whole, part in chunks(text):
        ids += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    return ids


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    values = np.concatenate([np.array(x, dtype=np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def encode(docs: DataFrame, rank_path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text", decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids array<int>[, decoded binary], ``keep``) for every row; other columns are not read.

    A null text counts as empty: no ids. ``decoded`` also turns the ids back into bytes in the same pass. Rows are
    handled one by one, so repeated rows and ties stay as they are, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = docs.schema[key].dataType
    names = [key, "ids", *(["decoded"] if decoded else []), *keep]

    def run(batches):
        enc = encoding(shared.value, pattern)
        for whole in batches:
            for batch in batches_of(whole, ROWS):
                ids = [encode_text(enc, x or "") for x in batch.column(1).to_pylist()]
                columns = [batch.column(0), _lists(ids)]
                if decoded:
                    columns.append(pa.array([enc.decode_bytes(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns + batch.columns[2:], names=names)

    schema = f"`{key}` {kind.simpleString()}, ids array<int>" + (", decoded binary" if decoded else "")
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(key, text, *keep).mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the bytes of every list of ids; null ids give empty bytes, an unknown id is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = tokens.schema[key].dataType

    def run(batches):
        enc = encoding(shared.value, public_tokenizers.PATTERN)
        for whole in batches:
            for batch in batches_of(whole, ROWS):
                out = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {kind.simpleString()}, decoded binary")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, ``more``, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return coded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of ``documents``."""
    return digests(encode(table(spark, sf_dir, "documents"), rank_file(), decoded=True))
