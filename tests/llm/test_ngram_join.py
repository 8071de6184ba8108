import random

import pytest

from cumulus.llm import ngram_join
from cumulus.llm.ngram_join import join, keep_one


def brute(rows, words=5, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for key, text in rows:
        own = [w for w in "".join(c if c not in "\t\n\v\f\r" else " " for c in (text or "")).translate(lower).split(" ") if w]
        sets.append((key, {tuple(own)} if 0 < len(own) < words else {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}))
    root = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (ki, a) in enumerate(sets):
        for j, (kj, b) in enumerate(sets[:i]):
            c = len(a & b)
            if ki is not None and kj is not None and c and 100 * c >= percent * (len(a) + len(b) - c):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(s), links[i], least.get(find(i)) if k is not None else None) for i, (k, s) in enumerate(sets)), key=str)


def near_copies(seed, sizes, copies):
    """Texts of the given words with copies at many distances, and a passage that many of them share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passage = [word() for _ in range(12)]
    out = []
    for n in sizes:
        base = [word() for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            base[5:17] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, n // 40))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: max(1, len(text) - rng.randrange(len(text) // 8 + 1))]
            out.append(" ".join(text).upper() if rng.random() < 0.2 else "\n".join(text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("frequent,chunk", [(32, 256), (1, 5)])
def test_matches_brute_force(corpus, monkeypatch, frequent, chunk):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = near_copies(1, [1, 3, 4, 5, 6, 9, 14, 24, 33, 34, 36, 38, 41, 43, 60, 90, 150, 151, 300], 9)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t\n"), (903, texts[0]), (3, texts[3]), (None, texts[1]), (None, None), (904, "q " * 30_000), (905, "q " * 20_000)]
    got = sorted((tuple(r) for r in join(corpus(rows)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 100


def test_keep_one(corpus):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (2, text + " more"), (9, "other words stand here alone"), (9, "other words stand here alone"), (None, text), (7, None), (8, "")]
    docs = corpus(rows)
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "7", "8", "9", "None"]
    assert join(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_prefixes_have_room_for_classes():
    for n in range(ngram_join.SHORT + 1, 3_000):
        assert ngram_join.CLASSES < ngram_join.least_shared(n) <= ngram_join.overlap(n) and ngram_join.prefix_size(n) <= n
