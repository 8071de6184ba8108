import math
import zlib

import xxhash

from cumulus.llm.sharding import grow, shard, uniform_tree


def place(key, node):
    """The same descent, written for one key."""
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    best = None
    for name, child in node.items():
        h = xxhash.xxh64_intdigest(f"{key}/{name}".encode(), seed=42)
        draw = math.log(((h >> 12) + 1) / 2**52) / weight(child)
        if best is None or draw > best[0]:
            best = (draw, name, child)
    return place(key, best[2]) if isinstance(best[2], dict) else best[1]


def test_rows(corpus):
    rows = [(i, "é" * (i % 7)) for i in range(2_000)] + [(None, "a"), (None, None), (5, "é" * 5), (7, "")]
    tree = uniform_tree(2, 3, 4)
    got = shard(corpus(rows), tree, grown=grow(tree, 24)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == place("null" if r["doc_id"] is None else r["doc_id"], tree)
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append((len((text or "").encode()) + 8, zlib.crc32((text or "").encode())))
    for r in got:
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert 40 < sum(r["grown_shard"] == 24 for r in got) < 130  # a share of 1 in 25
    assert shard(corpus(rows).limit(0), tree).count() == 0


def test_weights(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    light = {"a": {"r": {0: 1.0, 1: 1.0}}, "b": {"q": {2: 2.0, 3: 0.0}}}
    heavy = {"a": {"r": {0: 1.0, 1: 3.0}}, "b": {"q": {2: 2.0, 3: 0.0}}}
    one, two = ({r["doc_id"]: r["shard"] for r in shard(rows, t).collect()} for t in (light, heavy))
    share = lambda x, s: sum(v == s for v in x.values()) / len(x)
    assert abs(share(one, 2) - 0.5) < 0.02 and share(one, 3) == 0 and abs(share(two, 1) - 0.5) < 0.02
    # movement stays in the subtree whose weight changed
    assert all(two[k] in (0, 1) for k in one if one[k] != two[k])
    assert all(two[k] == 1 for k in one if one[k] == 0 and two[k] != 0)
