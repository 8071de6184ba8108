"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. Time is a row of slots, one block each. Block j of a source with weight w (its share of
the slots) is released at floor((j - 1) / w) and due at ceil(j / w); among the released blocks the one due first takes
the slot (earliest deadline first). On one sequence this meets every deadline, so after any number t of slots a source
has had more than w t - 1 and fewer than w t + 1 blocks.

Weights are taken as exact fractions and never rounded, so the bound holds against the targets over the whole run. The
driver plans the blocks that exist, one at a time from the sources' counts, and writes the plan in slices; rows find
their slot by one join on source and block. Every row is placed once. When a source has run out its slots stay empty,
and the others go on in their proportions.

With a ``period`` weights are first rounded to whole slots of it, and the plan of one period is repeated: the bound
then holds against the rounded weights only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import ordinals, query, table
from cumulus.session import materialise

BLOCK = 64
#: Slots of a repeated period, where one is asked for; blocks of the plan that the driver holds at a time.
PERIOD, SLICE = 1_000, 1 << 18
#: The weights of ``op3_mixing`` are whole numbers of this part, so that its SQL has the same.
UNIT = 1 << 20
#: Without given weights a source's weight is its number of rows to this power.
SMOOTHING = 0.7

Source = str | None
#: source, number from 0 of a block, release, deadline, slot
Placed = tuple[Source, int, int, int, int]


def exact_weights(weights: dict[Source, float]) -> dict[Source, int]:
    """Whole numbers in exactly the proportions of the weights."""
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights are finite and above zero")
    shares = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*[w.denominator for w in shares.values()])
    return {s: int(w * scale) for s, w in shares.items()}


def whole_weights(weights: dict[Source, float], period: int = PERIOD) -> dict[Source, int]:
    """Slots of each source in one period: its share of ``period``, rounded, at least 1."""
    total = sum(weights.values())
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights are finite and above zero")
    return {s: max(1, math.floor(period * w / total + 0.5)) for s, w in weights.items()}


def windows(slots: int, period: int) -> list[tuple[int, int]]:
    """(release, deadline) of the blocks of one period."""
    return [((j - 1) * period // slots, -(-j * period // slots)) for j in range(1, slots + 1)]


def plan(slots: dict[Source, int]) -> dict[Source, list[int]]:
    """The slots that each source's blocks take in one period; ties go to the source first by name, null before all."""
    period = sum(slots.values())
    names = sorted(slots, key=lambda s: (s is not None, s or ""))
    waiting = sorted((r, d, i) for i, s in enumerate(names) for r, d in windows(slots[s], period))[::-1]
    out: dict[Source, list[int]] = {s: [] for s in names}
    ready: list[tuple[int, int]] = []
    for t in range(period):
        while waiting and waiting[-1][0] <= t:
            _, d, i = waiting.pop()
            heapq.heappush(ready, (d, i))
        out[names[heapq.heappop(ready)[1]]].append(t)
    return out


def schedule(weights: dict[Source, int], blocks: dict[Source, int]) -> Iterator[Placed]:
    """The blocks of all sources by slot; ties go to the source first by name, null before all."""
    total, names = sum(weights.values()), sorted(blocks, key=lambda s: (s is not None, s or ""))
    done, own, ends = [0] * len(names), [weights[s] for s in names], [blocks[s] for s in names]
    waiting, ready, t = [(0, i) for i, n in enumerate(ends) if n], [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * total // own[i]), i))
        deadline, i = heapq.heappop(ready)
        yield names[i], done[i], done[i] * total // own[i], deadline, t
        done[i] += 1
        if done[i] < ends[i]:
            heapq.heappush(waiting, (done[i] * total // own[i], i))
        t += 1


def repeated(slots: dict[Source, int], blocks: dict[Source, int]) -> Iterator[Placed]:
    """The blocks of all sources in a plan of one period that is repeated."""
    period, plans = sum(slots.values()), plan(slots)
    for s, n in blocks.items():
        own = windows(slots[s], period)
        for at in range(n):
            begin, j = at // slots[s] * period, at % slots[s]
            yield s, at, begin + own[j][0], begin + own[j][1], begin + plans[s][j]


def plan_table(spark: SparkSession, placed: Iterable[Placed]) -> DataFrame:
    """(__source, __at, __release, __deadline, __slot) as a written table; the driver holds one slice at a time."""
    kinds = pa.schema([("__source", pa.string()), *[(c, pa.int64()) for c in ("__at", "__release", "__deadline", "__slot")]])
    rows, parts = iter(placed), []
    while (some := list(islice(rows, SLICE))) or not parts:
        columns = list(zip(*some)) or [[]] * len(kinds)
        parts.append(materialise(spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)), "plan"))
    return reduce(DataFrame.unionByName, parts)


def source_sizes(docs: DataFrame, source: str = "source") -> dict[Source, int]:
    return {r["s"]: r["n"] for r in docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}


def mix(docs: DataFrame, weights: dict[Source, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, period: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with (__block, __release, __deadline, __slot, __place).

    The mixed order is that of (__slot, __place), the place in the block. Inside a source rows keep the order of their
    key's MD5. Null sources form one source; null keys count as text ``null``; equal rows may swap places. A source
    that ``weights`` doesn't name is an error, one that has no rows leaves its slots empty. An empty table stays empty.
    """
    sizes = source_sizes(docs, source)
    if weights is None:
        weights = {s: n**SMOOTHING for s, n in sizes.items()}
    if missing := sizes.keys() - weights.keys():
        raise ValueError(f"no weight for {sorted(map(str, missing))[:5]}")
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    placed = schedule(exact_weights(weights), blocks) if period is None else repeated(whole_weights(weights, period), blocks)
    entries = plan_table(docs.sparkSession, placed)
    marked = docs.withColumn("__s", F.col(source).cast("string")).withColumn("__digest", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    numbered = ordinals(marked, ["__s"], "__digest", [key], "__n").withColumn("__b", F.expr(f"__n div {int(block)}"))
    return numbered.join(entries, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__at"))).select(
        *docs.columns,
        (F.col("__at") + 1).alias("__block"),
        "__release",
        "__deadline",
        "__slot",
        F.expr(f"__n % {int(block)}").alias("__place"),
    )


def in_order(docs: DataFrame, weights: dict[Source, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, laid out in the mixed order: ranges of slots by partition, sorted inside."""
    mixed = mix(docs, weights, source, key, block)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(parts, "__slot", "__place").sortWithinPartitions("__slot", "__place").select(*docs.columns)


@query(
    "op3_mixing",
    f"""
    WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    k AS (SELECT source, floor(n ** {SMOOTHING} * {UNIT})::HUGEINT AS k, ((n + {BLOCK - 1}) // {BLOCK})::HUGEINT AS e FROM n),
    l AS (SELECT list(source ORDER BY source NULLS FIRST) AS ss, list(k ORDER BY source NULLS FIRST) AS ks, list(e ORDER BY source NULLS FIRST) AS es, sum(k)::HUGEINT AS q FROM k),
    edf AS (
      SELECT -1::HUGEINT AS t, [0::HUGEINT FOR x IN ks] AS js, 0::BIGINT AS pick, ks, es, ss, q FROM l
      UNION ALL
      SELECT u, [js[i] + (i = p)::HUGEINT FOR i IN range(1, len(ks) + 1)], p, ks, es, ss, q
      FROM (SELECT *, list_min([[((js[i] + 1) * q + ks[i] - 1) // ks[i], i::HUGEINT] FOR i IN range(1, len(ks) + 1) IF js[i] < es[i] AND js[i] * q // ks[i] <= u])[2]::BIGINT AS p
        FROM (SELECT *, greatest(t + 1, list_min([js[i] * q // ks[i] FOR i IN range(1, len(ks) + 1) IF js[i] < es[i]])) AS u FROM edf
          WHERE len([i FOR i IN range(1, len(ks) + 1) IF js[i] < es[i]]) > 0))),
    slots AS (SELECT ss[pick] AS source, ks[pick] AS k, js[pick] AS j, t, q FROM edf WHERE t >= 0),
    r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM documents)
    SELECT r.doc_id, r.source, s.j::BIGINT AS block, ((s.j - 1) * q // k)::BIGINT AS release, ((s.j * q + k - 1) // k)::BIGINT AS deadline, t::BIGINT AS slot, n % {BLOCK} AS place
    FROM r JOIN slots s ON r.source IS NOT DISTINCT FROM s.source AND s.j = n // {BLOCK} + 1
    """,
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all ``documents``, mixed by source in proportion to the sources' rows to the power 0.7, a whole number of 2^-20."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    weights = {s: float(math.floor(n**SMOOTHING * UNIT)) for s, n in source_sizes(docs).items()}
    return mix(docs, weights).select("doc_id", "source", *[F.col(f"__{c}").alias(c) for c in ("block", "release", "deadline", "slot", "place")])
