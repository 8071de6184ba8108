"""Language-model scores of documents by prediction by partial matching (PPM, method D).

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over the training documents. A byte is coded in the
longest context that has been seen; if it has not followed there, an escape is coded (distinct / 2 count, against
(2 uses - 1) / 2 count for a byte that has) and the next shorter context is tried, without the symbols that the longer one has ruled out, down to a uniform order
-1. A text starts after bytes 0xFF, which UTF-8 doesn't have, and ends with one. The score is the log10 probability
of the text and its end.

A step's probability depends only on the last ``ORDER`` bytes and the next one, so:

1. One pass packs documents into blocks and writes, for each block, its texts and its distinct events and words with
   their training counts, cut by shard. An event's shard hangs on the last two bytes of its context, so all its
   contexts of two bytes and more lie in one shard; a word's shard is its hash.
2. Counts are merged by shard into the trie and the vocabulary, as a written table that grows with the corpus. Contexts
   of one byte and none make at most 65,536 numbers.
3. Every shard answers the blocks' events and words in one sorted stream, the model's row first.
4. Every block joins its answers and sums them by document.

Nothing but sums and the 65,536 numbers reaches the driver; a task holds one block or one shard of the model. Words are
keyed by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import fold, query, release, table
from cumulus.session import materialise

ORDER = 5
#: Bytes of text in a block and in a step of work; most shards of the model.
BLOCK, STEP, MAX_SHARDS = 16 << 20, 1 << 20, 4_096
#: Documents in a step, so that an event and a document's place fit 64 bits.
STEP_DOCS = 1 << 16
#: Shards that a task handles one after the other: a task holds one of them at a time.
SPLIT = 4
#: Counts are merged when so many are waiting; rows of a batch that are turned into Python values together.
WAITING, ROWS = 1_000_000, 256
_END = b"\xff"
_PAD = _END * ORDER


def words_of(text: bytes) -> list[bytes]:
    """ASCII lower case, cut at ASCII white space: what bytes.lower and bytes.split do."""
    return text.lower().split()


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart, which compress well."""
    return zstandard.compress(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def events_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(events of all texts in order, number of events of each); an event is its context and next byte, packed."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.frombuffer(b"".join(_PAD + t + _END for t in texts), np.uint8)
    packed = np.zeros(max(0, len(flat) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        packed = (packed << np.uint64(8)) | flat[j : j + len(packed)]
    begins = np.cumsum(sizes + ORDER) - sizes - ORDER
    at = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return packed[at], sizes


def event_shard(events: np.ndarray, shards: int) -> np.ndarray:
    pair = (events >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return keys % np.uint64(shards)


def _steps(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about STEP bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= STEP or i + 1 - at >= STEP_DOCS:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts' sums."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def block_events(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct events of a block and how often its training texts have them; steps are merged as they come."""
    parts, waiting = [], 0
    for step in _steps(texts):
        events, sizes = events_of(texts[step])
        out = np.repeat(held[step], sizes)
        parts.append(np.unique(events[~out], return_counts=True))
        rest = np.unique(events[out])
        parts.append((rest, np.zeros(len(rest), np.int64)))
        waiting += len(parts[-2][0]) + len(rest)
        if waiting > WAITING:
            parts, waiting = [merged(parts)], 0
    return merged(parts)


def hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def block_words(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word keys of a block and how often its training texts have them."""
    uses: Counter = Counter()
    rest: set[bytes] = set()
    for text, out in zip(texts, held.tolist(), strict=True):
        if out:
            rest.update(words_of(text))
        else:
            uses.update(words_of(text))
    rest -= uses.keys()
    return merged([(hashes(uses), np.fromiter(uses.values(), np.int64, len(uses))), (hashes(rest), np.zeros(len(rest), np.int64))])


def _by_shard(keys: np.ndarray, shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of each shard's keys, ascending by key."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(1, shards).astype(shard.dtype))
    return np.split(order, ends)


class Trie:
    """Contexts of two bytes and more of one shard, and the shared ones of one byte and none."""

    def __init__(self, events: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        """``pairs``: how often byte j follows byte i, 256 x 256."""
        self.pairs = pairs
        self.single = pairs.sum(axis=0)
        self.levels: dict[int, tuple] = {}
        below = None
        for k in range(ORDER, 1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys, sums = merged([(events & mask, counts)])
            contexts = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.empty(0, np.int64)
            total = np.add.reduceat(sums, first) if len(first) else np.empty(0, np.int64)
            distinct = np.diff(np.append(first, len(keys)))
            self.levels[k] = (keys, sums, contexts[first], total, distinct)
        for k in range(ORDER, 1, -1):  # how often the symbols seen in a context follow the next shorter one
            keys, _, names, *_ = self.levels[k]
            if k > 2:
                below, its = self.levels[k - 1][:2]
                shorter = its[np.searchsorted(below, keys & np.uint64((1 << 8 * k) - 1))]
            else:
                shorter = pairs[(keys >> np.uint64(8)) & np.uint64(255), keys & np.uint64(255)]
            first = np.searchsorted(keys >> np.uint64(8), names)
            ruled = np.add.reduceat(shorter, first) if len(first) else np.empty(0, np.int64)
            self.levels[k] += (ruled,)

    @staticmethod
    def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(names):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return at, names[at] == wanted

    def log10(self, events: np.ndarray) -> np.ndarray:
        """log10 of the probability of each event's last byte after its context."""
        out = np.zeros(len(events))
        live = np.ones(len(events), bool)
        out_n, out_q = np.zeros(len(events), np.int64), np.zeros(len(events), np.int64)

        def step(seen, n, q, c, ruled):
            """Code in one context: ``n`` symbols, ``q`` distinct, ``c`` of the wanted one, ``ruled`` for the next."""
            nonlocal live
            n, q_left = n - out_n, q - out_q
            open_ = live & seen & (q_left > 0)
            hit, miss = open_ & (c > 0), open_ & (c <= 0)
            out[hit] += np.log10((2 * c[hit] - 1) / (2 * n[hit]))
            out[miss] += np.log10(q_left[miss] / (2 * n[miss]))
            live = live & ~hit
            out_n[seen], out_q[seen] = ruled[seen], q[seen]

        for k in range(ORDER, 1, -1):
            keys, sums, names, total, distinct, ruled = self.levels[k]
            at, seen = self._find(names, (events >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            e, found = self._find(keys, events & np.uint64((1 << 8 * (k + 1)) - 1))
            pick = lambda x, i=at, s=seen: np.where(s, x[i], 0) if len(x) else np.zeros(len(events), np.int64)
            step(seen, pick(total), pick(distinct), np.where(found, sums[e], 0) if len(sums) else np.zeros(len(events), np.int64), pick(ruled))
        last, byte = ((events >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (events & np.uint64(255)).astype(np.int64)
        total, distinct = self.pairs.sum(axis=1), (self.pairs > 0).sum(axis=1)
        ruled = ((self.pairs > 0) * self.single[None, :]).sum(axis=1)
        step(total[last] > 0, total[last], distinct[last], self.pairs[last, byte], ruled[last])
        everything = np.full(len(events), self.single.sum(), np.int64)
        known = np.full(len(events), (self.single > 0).sum(), np.int64)
        step(everything > 0, everything, known, self.single[byte], everything)
        out[live] -= np.log10(256 - known[live])
        return out


_PARTS = "kind string, shard int, block long, ids array<{id}>, held array<boolean>, sizes binary, keys binary, counts binary"


def _pack(shards: int, names: list[str], id_type: pa.DataType):
    """Documents (id, held out, text) to rows of one block: kind b its texts, e events and w words by shard."""

    def rows(number: int, ids: list, held: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        flags = np.array(held, bool)
        sizes = np.array([len(t) for t in texts], np.int64)
        out = [("b", -1, ids, held, sizes.tobytes(), zstandard.compress(b"".join(texts), 3), b"")]
        events, counts = block_events(texts, flags)
        keys, uses = block_words(texts, flags)
        for kind, k, c, shard in (("e", events, counts, event_shard(events, shards)), ("w", keys, uses, word_shard(keys, shards))):
            for s, at in enumerate(_by_shard(k, shard, shards)):
                if len(at):
                    out.append((kind, s, None, None, None, packed(k[at]), zstandard.compress(c[at].tobytes(), 1)))
        kind, shard, i, h, z, k, c = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(shard, pa.int32()), pa.array([number] * len(kind), pa.int64()), pa.array(i, pa.list_(id_type)), pa.array(h, pa.list_(pa.bool_())), pa.array(z, pa.binary()), pa.array(k, pa.binary()), pa.array(c, pa.binary())],
            names=names,
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t.encode() if t else b"")
                size += len(texts[-1]) + 64
                if size >= BLOCK:
                    yield from rows(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
        if ids:
            yield from rows(number, ids, held, texts)

    return run


def _read(batches, names: list[str]) -> Iterator[dict]:
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield {n: c[i] for n, c in zip(names, columns, strict=True)}


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _merge(batches):
    """Rows sorted by (kind, shard) to one row each with the trained keys and their counts."""
    names = ["kind", "shard", "keys", "counts", "total", "distinct", "pair_keys", "pair_counts"]

    def row(at, parts):
        keys, counts = merged(parts)
        keys, counts = keys[counts > 0], counts[counts > 0]
        pairs = merged([(keys & np.uint64(0xFFFF), counts)]) if at[0] == "e" else (np.empty(0, np.uint64), np.empty(0, np.int64))
        values = [at[0], at[1], keys.tobytes(), counts.tobytes(), int(counts.sum()), len(keys), pairs[0].astype(np.int64).tolist(), pairs[1].tolist()]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    now, parts, waiting = None, [], 0
    for r in _read(batches, ["kind", "shard", "keys", "counts"]):
        at = (r["kind"].as_py(), r["shard"].as_py())
        if at != now:
            if now:
                yield row(now, parts)
            now, parts, waiting = at, [], 0
        parts.append((unpacked(r["keys"].as_buffer()), np.frombuffer(zstandard.decompress(r["counts"].as_buffer()), np.int64)))
        waiting += len(parts[-1][0])
        if waiting > WAITING:
            parts, waiting = [merged(parts)], 0
    if now:
        yield row(now, parts)


def _answer(pairs: np.ndarray):
    """Rows sorted by (kind, shard, block), the model's row first with block -1, to one answer for each other row."""

    def run(batches):
        now, trie, keys, counts = None, None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for r in _read(batches, ["kind", "shard", "block", "keys", "counts"]):
            at, block = (r["kind"].as_py(), r["shard"].as_py()), r["block"].as_py()
            if at != now:
                now, trie, keys, counts = at, None, np.empty(0, np.uint64), np.empty(0, np.int64)
                if block < 0:
                    keys, counts = _array(r["keys"], np.uint64), _array(r["counts"], np.int64)
                trie = Trie(keys, counts, pairs) if at[0] == "e" else None
                if block < 0:
                    continue
            wanted = unpacked(r["keys"].as_buffer())
            if trie:
                values = trie.log10(wanted).astype(np.float32)
            else:
                i, found = Trie._find(keys, wanted)
                values = np.where(found, counts[i], 0) if len(counts) else np.zeros(len(wanted), np.int64)
            columns = [pa.array([block], pa.int64()), pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([r["keys"].as_py()], pa.binary()), pa.array([zstandard.compress(values.tobytes(), 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "shard", "keys", "values"])

    return run


def _known(answers: list[tuple[np.ndarray, bytes]], kind) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of all answers with their values."""
    keys = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in answers]])
    values = np.concatenate([np.empty(0, kind), *[np.frombuffer(v, kind) for _, v in answers]])
    order = np.argsort(keys)
    return keys[order], values[order]


def _sum(key: str, id_type: pa.DataType, ends: int, total: int, distinct: int):
    """Rows sorted by (block, kind), answers before the texts (kind z), to one row for each document."""
    floor = total + 0.1 * (distinct + 1)

    def score(answers: dict, ids, held: list[bool], texts: list[bytes]):
        events, value = _known(answers["e"], np.float32)
        keys, uses = _known(answers["w"], np.int64)
        words = list(set().union(*map(words_of, texts)))
        use = uses[np.searchsorted(keys, hashes(words))] if words else np.empty(0, np.int64)
        place = dict(zip(words, range(len(words)), strict=True))
        base, seen = np.log10((use + 0.1) / floor), use > 0
        n, known = np.ones(len(texts), np.int64), np.full(len(texts), int(ends > 0), np.int64)
        scores, bases = np.zeros(len(texts)), np.full(len(texts), np.log10((ends + 0.1) / floor))
        for step in _steps(texts):
            some, sizes = events_of(texts[step])
            mixed = (some << np.uint64(16)) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            mixed.sort()  # equal events lie together, so each is looked up once
            some = mixed >> np.uint64(16)
            first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            own = np.repeat(value[np.searchsorted(events, some[first])], np.diff(np.append(first, len(some))))
            scores[step] = np.bincount((mixed & np.uint64(0xFFFF)).astype(np.int64), weights=own, minlength=len(sizes))
            for i, t in enumerate(texts[step], step.start):
                at = np.fromiter(map(place.__getitem__, words_of(t)), np.int64)
                n[i] += len(at)
                known[i] += int(seen[at].sum())
                bases[i] += float(base[at].sum())
        columns = [pa.array(ids, id_type), pa.array(np.array(held, bool)), pa.array(n), pa.array(known), pa.array(np.full(len(texts), total)), pa.array(bases), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        now, answers = None, {}
        for r in _read(batches, ["block", "kind", "ids", "held", "sizes", "keys", "values"]):
            if r["block"].as_py() != now:
                now, answers = r["block"].as_py(), {"e": [], "w": []}
            if r["kind"].as_py() != "z":
                answers[r["kind"].as_py()].append((unpacked(r["keys"].as_buffer()), zstandard.decompress(r["values"].as_buffer())))
                continue
            data = zstandard.decompress(r["values"].as_buffer())
            stops = np.cumsum(_array(r["sizes"], np.int64)).tolist()
            texts = [data[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905
            del data
            yield score(answers, r["ids"].as_py(), r["held"].as_py(), texts)
            answers = {"e": [], "w": []}

    return run


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a boolean column; the other rows are the training documents. ``score`` is the PPM model's log10
    probability of the text; ``base_score`` that of its words and one end under smoothed single-word counts (0.1
    added to each of the distinct training tokens and one unknown). A null text counts as empty. Without training
    rows every byte has probability 1/256. Repeated rows are rows of their own; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tasks = max(1, min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shards = min(MAX_SHARDS, SPLIT * tasks)
    kind = docs.schema[key].dataType.simpleString()
    names = ["kind", "shard", "block", "ids", "held", "sizes", "keys", "counts"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    rows = docs.select(F.col(key) if kind in ("bigint", "int", "string") else F.col(key).cast("string").alias(key), F.coalesce(held_out, F.lit(False)), text)
    parts = materialise(rows.mapInArrow(_pack(shards, names, id_type), _PARTS.format(id=rows.schema[0].dataType.simpleString())), "blocks")
    asked = parts.filter("kind <> 'b'")
    dealt = lambda t, *by: t.repartition(tasks, *by[:2])
    model = dealt(asked.select("kind", "shard", "keys", "counts"), "kind", "shard").sortWithinPartitions("kind", "shard")
    model = materialise(model.mapInArrow(_merge, "kind string, shard int, keys binary, counts binary, total long, distinct long, pair_keys array<long>, pair_counts array<long>"), "model")
    release(spark)
    pairs = np.zeros((256, 256), np.int64)
    zipped = model.filter("kind = 'e'").select(F.explode(F.arrays_zip("pair_keys", "pair_counts")).alias("p"))
    for r in zipped.groupBy(F.col("p.pair_keys").alias("k")).agg(F.sum("p.pair_counts").alias("n")).collect():  # 65,536 rows at most
        pairs[r["k"] >> 8, r["k"] & 255] = r["n"]
    words, distinct = model.filter("kind = 'w'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = parts.filter("kind = 'b'").select(F.aggregate("held", F.lit(0).cast("long"), lambda n, h: n + F.when(h, 0).otherwise(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stream = model.select("kind", "shard", F.lit(-1).cast("long").alias("block"), "keys", "counts").unionByName(asked.select("kind", "shard", "block", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = dealt(stream, "kind", "shard").sortWithinPartitions("kind", "shard", "block").mapInArrow(_answer(pairs), "block long, kind string, shard int, keys binary, values binary")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ids", parts.schema["ids"].dataType), ("held", parts.schema["held"].dataType), ("sizes", "binary"))]
    texts = parts.filter("kind = 'b'").select("block", F.lit("z").alias("kind"), "ids", "held", "sizes", F.lit(None).cast("binary").alias("keys"), F.col("keys").alias("values"))
    both = answers.select("block", "kind", *nothing, "keys", "values").unionByName(texts)
    ready = dealt(both, "block").sortWithinPartitions("block", "kind")
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(_sum(key, id_type, int(ends), int(words + ends), int(distinct + (ends > 0))), schema)


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and single-word scores of all whole ``documents``; rows with crc32(doc_id) mod 10 other than 0 are learned."""
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)
