import itertools
import zlib

import numpy as np
import pytest

from cumulus.llm import toxicity
from cumulus.llm.common import fold
from cumulus.llm.toxicity import DECAY, ORDER, Landmarks, fit, sample, score

SF = "/root/testdata/sf0.1"


def kernel(s, t):
    def weights(x):
        out = {}
        for at in itertools.combinations(range(len(x)), ORDER):
            key = "".join(x[i] for i in at)
            out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    a, b = weights(s), weights(t)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0


def test_kernel_counts_subsequences():
    marks = Landmarks(["idiot", "loser"])
    words = ["idiot", "i-d-i-o-t", "idioot", "xidiot", "loser", "lo5ser", "tiled", "banana", "abc"]
    got = marks.kernel(words)
    for i, w in enumerate(words):
        for j, z in enumerate(marks.words):
            if len(set(z) & set(w)) >= toxicity.LETTERS * len(set(z)):
                assert abs(got[i, j] - kernel(w, z) ** toxicity.SHARP) < 2e-4, (w, z)
            else:
                assert got[i, j] == 0
    assert got[0, 0] > 0.999 and got[5, 1] > 0.3 and got[7].max() == 0


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return fit(*sample(docs, labels.filter(fold("doc_id", 4) != 2), size=800))


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    held = docs.filter(fold("doc_id", 4) == 2).join(labels.select("doc_id"), "doc_id")
    got = [(r["score"] >= 0.3, truth[r["doc_id"]]) for r in score(held, model).collect()]
    assert sum(a == b for a, b in got) > 0.93 * len(got)
    assert sum(a for a, b in got if b) > 0.9 * sum(b for _, b in got)


def test_gaps_and_insertions(model):
    texts = ["the of and thing", "you are an idiot here", "you are an i.d.i.o.t here", "an idi-ot here", "an i d i o t here", ""]
    got = model.score(texts)
    assert (got[1:5] > 0.3).all() and got[0] < 0.05 and got[5] < 0.05


def test_odd_rows(spark, corpus):
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (None, 1), (2, None), (3, 0)], "doc_id bigint, toxic int")
    bad, good = "what a rotten scoundrel he is. fine day", "a fine day it is and the sun is out"
    rows = [(0, bad), (1, good), (2, bad), (3, None), (None, bad), (0, bad), (4, ""), (5, (good + " ") * 3_000 + bad), (6, "scoundrel" * 500)]
    docs = corpus(rows)
    model = fit(*sample(docs, labels))
    got = score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score(docs, fit([], [])).collect()} == {0.0}
    assert {r["score"] for r in score(docs, fit(["x"], [1])).collect()} == {1.0}
    assert score(docs.limit(0), model).count() == 0


def test_margins_are_those_of_the_worst_sentence(model):
    """Against each sentence, and each token alone, by its words one by one."""
    texts = ["You are an IDIOT, really. fine!", "a.b.idiot.c ??? lo5ser", "i-d-i-o-t", "plain words\nand more", "", "x" * 300 + " moron!!"]
    edges = toxicity._EDGES
    for text, got in zip(texts, model.margins(texts)):
        low = toxicity.spelt(text.lower())
        units = [s.split() for s in toxicity._SENTENCE.split(low)] + [[w] for w in low.split()] + [[p] for w in low.split() for p in toxicity._STOP.split(w)]
        best = model.bias
        for unit in units:
            words = {w.strip(edges) for w in unit} - {""}
            known = toxicity.telling(model.landmarks, words)
            if known:
                best = max(best, float(np.max(list(known.values()), axis=0) @ model.white @ model.weights) + model.bias)
        assert abs(best - got) < 1e-4, text
