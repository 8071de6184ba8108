import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cumulus.llm import packing
from cumulus.llm.packing import B, END, K1, WINDOW, Encoder, Index, Packer, inverse_frequency, pack, read_vocabulary, word_file


@pytest.fixture(scope="module")
def plain():
    out = Tokenizer.from_file(word_file())
    out.encode_special_tokens = True
    return out


ODD = ["Ünïcode naïve café", "don't WE'LL 'tis ''s o''re", "İstanbul ΣΊΣΥΦΟΣ ſt ŉa", "é å ≠ ", "日本語のテキスト、です", "x" * 5_000, "a1b22 3.14_$%^ --", "\x1c\x1d a\x85b\xa0c d", "", "<|endoftext|> <|startoftext|>", "각", "½ ² ªº ×÷ µ", "🙂🙂 👩‍👩‍👧", "'ré 'S 'Ll"]


def test_words_have_the_library_s_ids(spark, plain):
    enc = Encoder(read_vocabulary(word_file()))
    assert enc.by_word
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    for got, text in zip(enc.encode(pa.array(texts)), texts, strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def check(packed, docs, plain, window=WINDOW):
    rows = packed.collect()
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [END] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], part))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, parts in by_doc.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1]]
        assert sum((p for _, p in parts), []) == ids[d]
    assert by_doc.keys() == ids.keys()
    for parts in by_sequence.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert total == window or total < window and total & (total - 1) == 0
    return by_sequence


def test_every_id_is_in_one_piece(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    vocabulary = read_vocabulary(word_file())
    check(pack(docs, vocabulary), rows, plain)
    check(pack(docs, vocabulary, window=64, block=16, shard=50), rows, plain, 64)


def test_odd_rows(spark, plain, corpus):
    rows = [(i, t) for i, t in enumerate([None, "", *ODD, "the " * 9_000, "same", "same"])]
    check(pack(corpus(rows).withColumn("ids", F.lit(1)).withColumn("start", F.lit("x")), read_vocabulary(word_file())), rows, plain)
    twice = corpus([(1, "a b c"), (1, "a b c"), (None, "d")])
    assert sorted(r["length"] for r in pack(twice, read_vocabulary(word_file())).collect()) in ([1, 2, 4, 4], [2, 4, 4], [2, 2, 2, 4])
    assert pack(corpus([]), read_vocabulary(word_file())).count() == 0


def test_scores_are_those_of_bm25():
    random = np.random.default_rng(0)
    pieces = [random.integers(0, 60, random.integers(1, 40)).astype("<u2") for _ in range(50)]
    held = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=64)
    idf, mean = inverse_frequency(held, len(pieces)), np.mean([len(p) for p in pieces])
    index = Index(pieces, idf, mean)
    for i in (0, 7, 49):
        got = index.scores(index.query_terms(i))
        for j, p in enumerate(pieces):
            want = 0.0
            for t in set(pieces[i].tolist()):
                tf = int((p == t).sum())
                weight = max(0.0, math.log((50 - held[t] + 0.5) / (held[t] + 0.5)))
                want += weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / mean))
            assert abs(got[j] - want) < 1e-9


def test_neighbours_share_a_window():
    # two topics in turn: each window should take one of them
    topics = [np.arange(10, 30), np.arange(40, 60)]
    random = np.random.default_rng(1)
    pieces = [(i, 0, 20, random.permutation(topics[i % 2]).astype("<u2")) for i in range(32)]
    held = np.bincount(np.concatenate([p[3] for p in pieces]), minlength=64)
    idf = np.where(held > 0, 1.0, 0.0)
    packer = Packer(idf, 20.0, window=80)
    rows = [*packer.put(pieces[:16]), *packer.put(pieces[16:]), *packer.close()]
    windows = {}
    for key, _, _, ids, sequence, _ in rows:
        windows.setdefault(sequence, []).append(key % 2)
    assert len(windows) == 8 and all(len(set(w)) == 1 for w in windows.values())
    assert sum(len(r[3]) for r in rows) == 32 * 20


def test_other_vocabularies_are_used_whole(plain):
    enc = Encoder(open(packing.public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    other = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert not enc.by_word
    assert [x.tolist() for x in enc.encode(pa.array(ODD))] == [other.encode(x, add_special_tokens=False).ids for x in ODD]
