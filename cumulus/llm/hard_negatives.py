"""Hard negatives from zone-mapped blocks in the order of a Hilbert curve.

Vectors are sorted by label and by their place on a Hilbert curve through the dimensions that vary most, cut into
blocks of one label and written as Parquet, a row for each block, with the least and greatest value of every dimension
(its zone map). A search asks, for each query, for the highest integer inner products inside a window of scores.
Interval arithmetic over a zone map bounds the scores that a block can hold, so a first pass reads the blocks with the
best bounds, which gives a floor under each query's k-th score, and a second pass reads every block whose bounds meet
what is left of the window. Both read the zone maps only to choose; a block that no query wants is not read.

Positives are one search (same label, no window), negatives another (other labels, a window for each positive). Results
are exact. Queries come in chunks of neighbours on the curve, blocks in bundles; nothing is broadcast or collected but
the number of rows and two statistics of each dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.llm.common import query, table
from cumulus.llm.topk import LIMIT, quantised
from cumulus.session import materialise

#: Rows of a block, queries of a chunk, blocks that one task reads for a chunk, zone maps that one task compares with a chunk.
BLOCK, CHUNK, BUNDLE, ZONES = 1_024, 512, 16, 4_096
#: Dimensions of the curve and bits of each; blocks that a query reads first from each group of zone maps.
CURVE, BITS, FIRST = 32, 2, 2
POSITIVES, NEGATIVES = 5, 10
_LEAST, _MOST = -LIMIT, LIMIT


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2^bits, as rows of big-endian bytes (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    planes = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, np.uint8).T.reshape(len(cells), -1), axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as longs or, where they may be larger, Python numbers."""
    most = [int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if bound <= LIMIT >> 1 else a.astype(object) @ b.T.astype(object)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; +-LIMIT where they are outside a long."""
    return _clipped(_product(a, b))


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LIMIT, LIMIT).astype(np.int64) if x.dtype == object else x


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector inside each box."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _clipped(_product(plus, low) + _product(minus, high)), _clipped(_product(plus, high) + _product(minus, low))


def _matrix(cells: pd.Series | list, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, "<i8") for x in cells]).reshape(-1, width) if len(cells) else np.empty((0, width), np.int64)


def packed(rows: DataFrame, parts: int, size: int, by: list[str], with_zones: bool) -> DataFrame:
    """(block, label, n, low, high, <columns of ``rows``>): consecutive rows of one label, each column's values joined.

    Longs are joined as little-endian bytes, and so are the vectors ``w``, whose bytes stand in rows.
    """
    keep = [c for c in rows.columns if c not in ("label", "curve")]
    dealt = rows.repartitionByRange(parts, "label", "curve", *by).sortWithinPartitions("label", "curve", *by).select("label", *keep)
    at = keep.index("w")

    def run(batches):
        count, held, label = 0, [], None

        def close():
            nonlocal count
            number = (TaskContext.get().partitionId() << 40) + count
            count += 1
            columns = list(zip(*held, strict=True))
            w = _matrix(columns[at], len(columns[at][0]) // 8)
            zones = [w.min(axis=0), w.max(axis=0)] if with_zones else [np.empty(0, np.int64)] * 2
            joined = [b"".join(c) if i == at else np.array(c, "<i8").tobytes() for i, c in enumerate(columns)]
            values = [number, label, len(held), *[z.astype("<i8").tobytes() for z in zones], *joined]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * (2 + len(keep))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "label", "n", "low", "high", *keep])

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (own != label or len(held) == size):
                    yield close()
                    held = []
                label = own
                held.append(row)
        if held:
            yield close()

    return dealt.mapInArrow(run, "block long, label long, n long, low binary, high binary, " + ", ".join(f"{c} binary" for c in keep))


def on_curve(rows: DataFrame, curve: int = CURVE, bits: int = BITS) -> DataFrame:
    """(vec_id, label, w binary, curve binary) of rows (vec_id, label, w array<long>); short vectors end in zeros."""
    width = rows.agg(F.max(F.size("w"))).first()[0] or 1
    rows = rows.withColumn("w", F.concat("w", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("w"))))

    def binary(batches):
        for b in batches:
            w = b.column(2)
            flat = np.asarray(w.flatten(), "<i8").reshape(-1, width)
            if flat.size and max(int(flat.max()), -int(flat.min())) >= LIMIT:
                raise ValueError("a component is outside a long")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in flat], pa.binary())], names=["vec_id", "label", "w"])

    plain = materialise(rows.select("vec_id", F.col("label").cast("long").alias("label"), "w").mapInArrow(binary, "vec_id long, label long, w binary"), "vectors")

    def moments(batches):
        sums = np.zeros((3, width))
        for b in batches:
            x = _matrix(b.column(0).to_pylist(), width).astype(np.float64)
            sums += [np.full(width, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *[pa.array(s) for s in sums]], names=["i", "n", "s", "q"])

    stats = {r["i"]: r for r in plain.select("w").mapInArrow(moments, "i long, n double, s double, q double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()}
    mean = np.array([stats[i]["s"] / max(stats[i]["n"], 1) if i in stats else 0.0 for i in range(width)])
    spread = np.sqrt(np.maximum([stats[i]["q"] / max(stats[i]["n"], 1) - mean[i] ** 2 if i in stats else 0.0 for i in range(width)], 0))
    chosen = np.argsort(-spread, kind="stable")[:curve]
    # cells of a normal spread's equal parts, about
    step = np.maximum(spread[chosen], 1e-9) * 4 / (1 << bits) * 0.674 * (2 if bits == 1 else 1)

    def key(batches):
        for b in batches:
            x = _matrix(b.column(2).to_pylist(), width)[:, chosen]
            cells = np.clip(np.floor((x - mean[chosen]) / step) + (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in hilbert(cells, bits)], pa.binary())], names=["vec_id", "label", "w", "curve"])

    return materialise(plain.mapInArrow(key, "vec_id long, label long, w binary, curve binary"), "curve")


def _wanted(zones: pd.DataFrame, own: np.ndarray, label: int, low: np.ndarray, high: np.ndarray, same: bool, first: int | None) -> Iterator[tuple[int, np.ndarray, int]]:
    """(block, mask of the queries that want it, greatest score that it may hold for one of them)."""
    zones = zones[(zones["label"] == label) == same]
    if not len(zones):
        return
    least, most = bounds(own, _matrix(zones["low"], own.shape[1]), _matrix(zones["high"], own.shape[1]))
    want = (most >= low[:, None]) & (least <= high[:, None])
    if first is not None:
        rank = np.argsort(np.argsort(np.where(want, -most, _MOST), axis=1, kind="stable"), axis=1, kind="stable")
        want &= rank < first
    for j in np.flatnonzero(want.any(axis=0)):
        yield int(zones["block"].iloc[j]), want[:, j], int(most[want[:, j], j].max())


def _read(asked: pd.DataFrame, blocks: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """(qid, anchor, vec_id, score): the k best of some blocks for each query of a chunk that wants them, blocks with high bounds first."""
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
    for q in asked.itertuples():
        own, (qid, anchor, low, high) = _matrix([q.w], width), (np.frombuffer(x, "<i8") for x in (q.qid, q.anchor, q.least, q.most))
        # queries of one vector share its scores
        _, one, back = np.unique(own, axis=0, return_index=True, return_inverse=True)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qid)
        held = {b.block: b for b in blocks.itertuples()}
        for wish in sorted(q.wishes, key=lambda x: -x["top"]):
            b = held[wish["block"]]
            want = np.unpackbits(np.frombuffer(wish["want"], np.uint8), count=len(qid)).astype(bool)
            scores = np.zeros((len(one), b.n), np.int64)
            rows = np.unique(back[want])
            scores[rows] = dot(own[one[rows]], _matrix([b.w], width))
            ids = np.frombuffer(b.vec_id, "<i8")
            for i in np.flatnonzero(want):
                mine = scores[back[i]]
                floor = max(low[i], best[i][0][-1]) if len(best[i][0]) == k else low[i]
                some = np.flatnonzero((mine >= floor) & (mine <= high[i]) & (ids != anchor[i]))
                if len(some):
                    s, v = np.concatenate([best[i][0], mine[some]]), np.concatenate([best[i][1], ids[some]])
                    order = np.lexsort((v, -s))[:k]
                    best[i] = s[order], v[order]
                    if abs(best[i][0]).max() >= LIMIT:
                        raise ValueError("a score is outside a long")
        sizes = [len(s) for s, _ in best]
        out.append((np.repeat(qid, sizes), np.repeat(anchor, sizes), np.concatenate([v for _, v in best]), np.concatenate([s for s, _ in best])))
    return pd.DataFrame(dict(zip(("qid", "anchor", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def search(queries: DataFrame, blocks: DataFrame, k: int, same: bool, width: int, chunk: int = CHUNK, bundle: int = BUNDLE, zones: int = ZONES, first: int = FIRST) -> DataFrame:
    """(qid, anchor, vec_id, score, rank) of the k highest scores from ``least`` to ``most`` for each query; ties to the smaller vec_id.

    ``queries`` has qid, anchor, label, w, curve, least, most; a query never meets the id of its anchor. ``same`` asks
    for blocks of the query's label, otherwise for those of all others. The result is exact: bounds only leave out
    blocks that can't hold a part of it.
    """
    n, maps = queries.count(), blocks.select("block", "label", "low", "high")
    total = maps.count()
    groups, slices, bundles = max(1, -(-total // zones)), max(1, -(-n // (16 * chunk))), max(1, -(-total // bundle))
    dealt = maps.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def choose(asked: pd.DataFrame, boxes: pd.DataFrame, seeds: int | None) -> pd.DataFrame:
        rows = []
        for c in asked.itertuples():
            own, low, high = _matrix([c.w], width), np.frombuffer(c.least, "<i8"), np.frombuffer(c.most, "<i8")
            rows += [(c.chunk, block, top, np.packbits(want).tobytes()) for block, want, top in _wanted(boxes, own, c.label, low, high, same, seeds)]
        return pd.DataFrame(rows, columns=["chunk", "block", "top", "want"])

    def answers(asking: DataFrame, seeds: int | None) -> DataFrame:
        chunks = packed(asking.select("qid", "anchor", "label", "w", "curve", "least", "most"), max(1, -(-n // (8 * chunk))), chunk, ["qid"], False)
        chunks = materialise(chunks.withColumnRenamed("block", "chunk").drop("low", "high"), "chunks")
        left = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int"))
        wanted = left.groupBy("group", "slice").cogroup(dealt.groupBy("group", "slice")).applyInPandas(lambda q, z: choose(q, z, seeds), "chunk long, block long, top long, want binary")
        wanted = materialise(wanted.withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)).cast("int")), "wanted")
        wishes = wanted.groupBy("chunk", "bundle").agg(F.collect_list(F.struct("block", "top", "want")).alias("wishes")).join(chunks, "chunk")
        parts = wanted.select(F.col("chunk").alias("c"), F.col("bundle").alias("u"), "block").join(blocks.select("block", "n", "vec_id", "w"), "block")
        found = wishes.groupBy("chunk", "bundle").cogroup(parts.groupBy("c", "u")).applyInPandas(lambda q, b: _read(q, b, k, width), "qid long, anchor long, vec_id long, score long")
        best = W.partitionBy("qid", "anchor").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    floors = answers(queries, first).filter(F.col("rank") == k).select("qid", "anchor", F.col("score").alias("floor"))
    raised = queries.join(floors, ["qid", "anchor"], "left").withColumn("least", F.greatest("least", F.coalesce("floor", "least")))
    return answers(raised, None)


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 3, high: int = 9, block: int = BLOCK, **sizes) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, w array<long>).

    Anchors are the rows whose id is divisible by ``every``. Positives are an anchor's best rows of its label; for each,
    negatives are the best rows of other labels whose score is from ``low`` to ``high`` tenths of the positive's. Rows
    with a null in any of the columns take no part, equal rows count once, vectors under one id are rows of their own,
    and a row never meets its own id. Short vectors end in zeros. An anchor without positives or negatives has no
    rows, an empty table gives an empty result. A component or score outside a long is an error.
    """
    plain = rows.select("vec_id", F.col("label").cast("long").alias("label"), "w").dropna().dropDuplicates()
    curve = on_curve(plain)
    head = curve.select("w").first()
    width = len(head["w"]) // 8 if head else 1
    blocks = materialise(packed(curve, max(1, -(-curve.count() // (16 * block))), block, ["vec_id"], True), "blocks")
    anchors = curve.filter(F.col("vec_id") % every == 0).withColumn("qid", F.xxhash64("vec_id", "label", "w"))
    asked = materialise(anchors.withColumnRenamed("vec_id", "anchor").withColumns({"least": F.lit(_LEAST), "most": F.lit(_MOST)}), "anchors")
    found = search(asked, blocks, positives, True, width, **sizes)
    pairs = materialise(found.withColumn("pair", F.xxhash64("qid", "vec_id", "rank")), "positives")
    tenths = lambda n, up: f"score div 10 * {int(n)} + (score % 10 * {int(n)} + {9 * up}) div 10"
    windows = pairs.filter("score >= 0").select("qid", "anchor", "pair", F.expr(tenths(low, 1)).alias("least"), F.expr(tenths(high, 0)).alias("most"))
    asked = windows.filter("least <= most").join(asked.drop("least", "most"), ["qid", "anchor"]).drop("qid").withColumnRenamed("pair", "qid")
    far = search(materialise(asked, "windows"), blocks, negatives, False, width, **sizes)
    near = pairs.select(F.col("pair").alias("qid"), F.col("anchor").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(near, "qid").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@query(
    "op11_hard_negatives",
    f"""
    WITH v AS (
      SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.w, c.w)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for every vec_id divisible by 100; every seventh row's label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), quantised(F.col("embedding"), 256).alias("w")))
