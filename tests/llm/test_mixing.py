from collections import Counter
from fractions import Fraction

from cumulus.llm.mixing import exact_weights, in_order, mix, plan, schedule, whole_weights, windows


def test_deviation_stays_below_one_block():
    for weights in ({"a": 1, "b": 1}, {"a": 500, "b": 3, "c": 1, None: 70}, {str(i): i * i for i in range(1, 40)}, {"z": 0.9, "y": 0.1}):
        slots = whole_weights(weights)
        period, out = sum(slots.values()), plan(slots)
        assert sorted(t for own in out.values() for t in own) == list(range(period))
        for s, own in out.items():
            assert all(r <= t < d for t, (r, d) in zip(own, windows(slots[s], period)))
            had = 0
            for t in range(period):
                had += t in set(own)
                assert abs(had - slots[s] * (t + 1) / period) < 1


def test_all_rows_are_placed_once(corpus):
    rows = [(i, "t", "en", "hot" if i % 3 else None if i % 2 else "cold") for i in range(900)] + [(None, None, None, "hot"), (4, "t", "en", "hot")]
    got = mix(corpus(rows), {"hot": 2, "cold": 1, None: 1}, block=10).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert len({(r["__slot"], r["__place"]) for r in got}) == len(got)
    for r in got:
        assert r["__release"] <= r["__slot"] < r["__deadline"]
    for source in ("hot", "cold", None):
        at = sorted((r["__block"], r["__place"]) for r in got if r["source"] == source)
        assert at == [(i // 10 + 1, i % 10) for i in range(len(at))]
        slots = [r["__slot"] for r in sorted((r for r in got if r["source"] == source), key=lambda r: r["__block"])]
        assert slots == sorted(slots)


def test_layout_and_empty(corpus):
    rows = [(i, "t", "en", "ab"[i % 2]) for i in range(300)]
    docs = corpus(rows)
    out = in_order(docs, block=10)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(300))
    place = {r["doc_id"]: (r["__slot"], r["__place"]) for r in mix(docs, block=10).collect()}
    at = [place[r["doc_id"]] for r in out.collect()]
    assert at == sorted(at)
    assert mix(docs.limit(0)).count() == 0


def test_deviation_from_the_unrounded_targets(corpus):
    rows = [(i, "t", "en", "b" if i % 3 == 0 else "a") for i in range(12_000)]
    had = Counter()
    for t, r in enumerate(sorted(mix(corpus(rows), {"a": 2, "b": 1}, block=1).collect(), key=lambda r: r["__slot"]), 1):
        assert r["__slot"] == t - 1
        had[r["source"]] += 1
        assert abs(had["a"] - Fraction(2 * t, 3)) < 1 and abs(had["b"] - Fraction(t, 3)) < 1
    weights = {"hot": 0.7, "mid": 0.2999, None: 0.0001}
    had, total = Counter(), sum(map(Fraction, weights.values()))
    for s, at, release, deadline, slot in schedule(exact_weights(weights), {"hot": 28_000, "mid": 11_996, None: 4}):
        assert had[s] == at and release <= slot < deadline
        had[s] += 1
        assert all(abs(had[x] - Fraction(w) * (slot + 1) / total) < 1 for x, w in weights.items())
    assert had == {"hot": 28_000, "mid": 11_996, None: 4}


def test_any_number_of_sources(corpus):
    docs = corpus([(i, "t", "en", f"s{i % 5_000}") for i in range(6_000)])
    for period in (None, 1_000):
        got = mix(docs, block=1, period=period).collect()
        assert len({r["doc_id"] for r in got}) == len({r["__slot"] for r in got}) == len(got) == 6_000
