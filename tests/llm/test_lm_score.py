import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cumulus.llm import lm_score
from cumulus.llm.common import fold
from cumulus.llm.lm_score import ORDER, score


def brute(rows, held):
    """[(key, held out, tokens, known, training tokens, base score, score)]"""
    follow = [defaultdict(lambda: defaultdict(int)) for _ in range(ORDER + 1)]
    words, total = defaultdict(int), 0
    for key, text in rows:
        if not held(key):
            s = b"\xff" * ORDER + (text or "").encode() + b"\xff"
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    follow[k][s[i - k : i]][s[i]] += 1
            for w in [*(text or "").encode().lower().split(), None]:
                words[w] += 1
                total += 1

    def code(context, byte):
        out, gone = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = {b: n for b, n in follow[k].get(context[ORDER - k :], {}).items() if b not in gone}
            if seen:
                n, q = sum(seen.values()), len(seen)
                if byte in seen:
                    return out + math.log10((2 * seen[byte] - 1) / (2 * n))
                out += math.log10(q / (2 * n))
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    out = []
    for key, text in rows:
        s = b"\xff" * ORDER + (text or "").encode() + b"\xff"
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((words.get(w, 0) + 0.1) / (total + 0.1 * (len(words) + 1))) for w in tokens)
        ppm = sum(code(s[i - ORDER : i], s[i]) for i in range(ORDER, len(s)))
        out.append((key, held(key), len(tokens), sum(w in words for w in tokens), total, base, ppm))
    return sorted(out, key=str)


def by_crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


@pytest.mark.parametrize("block,step", [(32 << 20, 4 << 20), (400, 90)])
def test_matches_brute_force(spark, corpus, monkeypatch, block, step):
    rows = [(r["doc_id"], r["text"][:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(70).collect()]
    rows += [(1_000, None), (1_001, ""), (None, "Null key"), (3, rows[3][1]), (1_002, "\x00\x00 é中\n\n"), (1_003, "zz" * 4_000)]
    pack = lm_score._pack
    # the limits are read on the executors: they go there with the function
    monkeypatch.setattr(lm_score, "_pack", lambda *a: _limited(pack(*a), block, step))
    got = sorted((tuple(r) for r in score(corpus(rows), fold("doc_id", 10) == 0).collect()), key=str)
    want = brute(rows, by_crc)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5])) and abs(a[6] - b[6]) < 1e-6 * (1 + abs(b[6]))


def _limited(run, block, step):
    def limited(batches):
        from cumulus.llm import lm_score

        before = lm_score.BLOCK, lm_score.STEP
        lm_score.BLOCK, lm_score.STEP = block, step
        try:
            yield from run(batches)
        finally:
            lm_score.BLOCK, lm_score.STEP = before

    return limited


def test_no_training_rows_and_empty(corpus):
    docs = corpus([(1, "ab"), (2, None)])
    got = {r["doc_id"]: r for r in score(docs, F.lit(True)).collect()}
    assert abs(got[1]["score"] - 3 * math.log10(1 / 256)) < 1e-6 and abs(got[2]["score"] - math.log10(1 / 256)) < 1e-6
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and abs(got[1]["base_score"]) < 1e-9
    assert score(docs.limit(0), F.lit(True)).count() == 0


def test_block_counts_merge_as_steps_come(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm_score, "STEP", 1_000)
    monkeypatch.setattr(lm_score, "WAITING", 4_000, raising=False)
    sizes, merged = [], lm_score.merged
    monkeypatch.setattr(lm_score, "merged", lambda parts: sizes.append(sum(len(k) for k, _ in parts)) or merged(parts))
    texts = [bytes(np.random.default_rng(i % 5).integers(97, 101, 500).astype(np.uint8)) for i in range(400)]
    held = np.arange(400) % 3 == 0
    keys, counts = lm_score.block_events(texts, held)
    events, lengths = lm_score.events_of(texts)
    want, uses = np.unique(events, return_counts=True)
    assert np.array_equal(keys, want) and counts.sum() == lengths[~held].sum() and (counts <= uses).all()
    assert max(sizes) <= len(want) + 4_000 + 2 * 1_100  # what is held, what may wait and one step
