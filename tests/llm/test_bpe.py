import hashlib
import random

import public_tokenizers
import pytest

from cumulus.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.read_ranks(bpe.rank_file()), public_tokenizers.PATTERN)


def test_cuts_do_not_change_ids(enc, monkeypatch):
    rng = random.Random(3)
    alphabet = "ab é\n\t'sREll09!?　中  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["x" * 90 + " " * 70 + "y", " " * 100, "a" + "\n" * 64 + "!", "it's" * 40, "1" * 80 + "'ll" * 30]
    whole = [enc.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG", 20)
    monkeypatch.setattr(bpe, "_BLANK", bpe.regex.compile(r"\p{White_Space}{8,}"))
    monkeypatch.setattr(bpe, "RUN", 8)
    for text, ids in zip(texts, whole):
        assert "".join(p for _, p in bpe.chunks(text)) == text
        assert bpe.encode_text(enc, text) == ids


def test_very_long_runs(enc):
    for text in (" " * 600_000 + "x", "ab" * 100_000, "word " * 100_000):
        assert enc.decode(bpe.encode_text(enc, text)) == text


def test_table(spark, corpus, enc):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x"), (1, "Hello wörld"), (4, "<|endoftext|> a" + " " * 5000 + "b"), (5, "é" * 60_000)]
    coded = bpe.encode(corpus(rows), bpe.rank_file(), decoded=True)
    got = sorted(bpe.digests(coded).collect(), key=str)
    want = []
    for key, text in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(spark.createDataFrame([r], coded_schema()).first()))
    back = bpe.decode(coded.select("doc_id", "ids"), bpe.rank_file())
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(corpus(rows).limit(0), bpe.rank_file()).count() == 0


def coded_schema():
    return "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
