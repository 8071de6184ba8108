import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cumulus.llm import divergence as dv
from cumulus.llm.divergence import SCALE, SMOOTH, divergence, pair_sums


def brute(rows, min_docs, top):
    """Every figure by its definition, over rows (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), a or "", s or "") for t, a, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        seen, counts = Counter(), {}
        for words, a, s in docs:
            if a == lang:
                seen.update(set(words))
                counts.setdefault(s, Counter()).update(words)
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        share = lambda c: {t: 1 + SCALE * (c[t] + SMOOTH) // (sum(c[k] for k in kept) + SMOOTH * len(kept)) for t in kept}  # noqa: E731, B023
        whole, own = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts:
            pairs = [(sum(f(own[s][t], own[h][t]) for t in kept), h) for h in counts if h != s]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if counts[s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("whole", F.lit(1))


def test_brute_force(spark):
    random = np.random.default_rng(3)
    words = ["the", "The", "Éclair", "x1y", "zoo", "naïve", "a" * 300, "ß", "日本", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(random.choice(words, random.integers(0, 30))), random.choice(["en", "de"]), f"s{random.integers(0, 5)}") for _ in range(120)]
    rows += [(None, "en", "s0"), ("the zoo", None, None), ("", "fr", "s1"), ("--- 12", "fr", "s2"), rows[0], rows[0], ("the " * 20_000 + "zoo", "en", "s9")]
    for size in (dv.BLOCK, 40):  # one block, and many runs
        assert rows_of(divergence(frame(spark, rows), 4, 3, block_size=size)) == brute(rows, 4, 3)


def test_small_batches_are_cut_between_terms(spark, monkeypatch):
    rows = [(f"a b c d e {'f ' * (i % 7)}", "en", f"s{i % 9}") for i in range(60)]
    monkeypatch.setattr(dv, "ENTRIES", 7)
    monkeypatch.setattr(dv, "PAIRS", 5)
    batches = frame(spark, rows)
    found = dv.frequencies(batches, 2).orderBy("lang", "term", F.col("whole").desc(), "source").toPandas()
    entries = found[~found["whole"]]
    term, source = (entries[c].astype("category").cat.codes.to_numpy().astype(np.int64) for c in ("term", "source"))
    p = entries["n"].to_numpy() + 5
    p0 = np.full(len(p), 2)
    got = pair_sums(term, source, p, p0, 9)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    by = {(t, s): v for t, s, v in zip(term.tolist(), source.tolist(), p.tolist())}
    for g in range(9):
        for h in range(g + 1, 9):
            both = [t for t in set(term.tolist()) if (t, g) in by and (t, h) in by]
            assert got.get((g, h), 0) == sum(f(by[t, g], by[t, h]) - f(by[t, g], 2) - f(2, by[t, h]) + f(2, 2) for t in both)


def test_no_rows_and_no_terms(spark):
    assert rows_of(divergence(frame(spark, []))) == []
    assert rows_of(divergence(frame(spark, [("one", "en", "a"), ("two", "en", "b")]))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
