"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds the hashes of its distinct word shingles. Two sets that are alike enough share a minimum of
tokens, so with any order of all tokens they also share some inside prefixes (prefix filtering). Here:

* Documents with equal sets are joined first; one of them goes on with their number.
* The order is that of the hashes. A prefix has the tokens that a partner may lack, ``slack``, and ``extension``
  more: two partners share at least the smaller extension among their prefixes' tokens (k-wise prefixes).
* Tokens in the prefix of one set only are dead. A set with fewer live tokens than the least extension a partner may
  have links with nothing. This ends most sets.
* The others take their live tokens from rare to frequent until partners must meet (``signatures``). Rare tokens are
  signatures alone; frequent ones fall into ``CLASSES`` classes by hash, and pairs of tokens of one class are
  signatures, for which one more token of each class is taken. Short sets use single tokens only.
* Sets that share a signature, directly or through others, form a candidate group. No pair outside a group can link.
* Inside a group all pairs are verified with whole sets, in chunks of at most ``CHUNK`` sets, as products of
  membership matrices. A task returns sums of links and a spanning forest of what it linked, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.llm.common import batches_of, query, release, table
from cumulus.llm.components import components
from cumulus.session import materialise

WORDS, PERCENT = 5, 80
#: Prefixes are longer than needed by this share of the set, or this many tokens.
EXTEND, LEAST = 0.1, 20
#: A token in more prefixes than this is frequent. Classes must stay below LEAST.
FREQUENT, CLASSES = 32, 16
#: Sets up to this size use single tokens only, as their extension may not reach LEAST.
SHORT = 30
CHUNK = 1_024
_KEPT = 1_000_000
_M1, _M2, _64 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


class _Hashes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Hashes of word shingles; remembers the hashes of words."""

    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending distinct 64-bit hashes; with fewer words than a shingle has, one of the whole sequence."""
        own = text.encode().lower().split() if text else []
        if not own:
            return np.empty(0, np.uint64)
        if len(own) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=1)], np.uint64)
        if len(self.seen) > _KEPT:
            self.seen = _Hashes()
        h = np.fromiter(map(self.seen.__getitem__, own), np.uint64, len(own))
        out = np.zeros(len(h) - self.words + 1, np.uint64)
        for j in range(self.words):
            out = (out ^ h[j : j + len(out)]) * np.uint64(_M1)
            out ^= out >> np.uint64(29)
        out *= np.uint64(_M2)
        return np.unique(out ^ (out >> np.uint64(32)))


def overlap(size: int, percent: int = PERCENT) -> int:
    """Tokens that a set of this size must share with any partner; also the smallest size of a partner."""
    return -(-size * percent // 100)


def extension(size: int, percent: int = PERCENT) -> int:
    return min(overlap(size, percent), max(int(EXTEND * size) + 1, LEAST))


def prefix_size(size: int, percent: int = PERCENT) -> int:
    return size - overlap(size, percent) + extension(size, percent)


def least_shared(size: int, percent: int = PERCENT) -> int:
    """Tokens that a set shares with any partner among both prefixes."""
    return min(extension(size, percent), extension(overlap(size, percent), percent))


def _mix(a: int, b: int) -> int:
    x = ((a ^ (b >> 31)) * _M1 + b) & _64
    return ((x ^ (x >> 32)) * _M2) & _64


def signatures(size: int, tokens: list[tuple[int, int]], percent: int = PERCENT) -> list[int]:
    """Signatures of a set with the given live (sets, token) pairs; none if it can't have a partner."""
    shared = least_shared(size, percent)
    if len(tokens) < shared:
        return []
    tokens = sorted(tokens)
    spare = len(tokens) - shared
    out = []
    if overlap(size, percent) <= SHORT:  # short, or maybe a partner of a short set
        out = [_mix(t, 1) for _, t in tokens[: spare + 1]]
        if size <= SHORT:
            return out
    rare, classes = [], {}
    for taken, (sets, token) in enumerate(tokens, 1):
        if sets <= FREQUENT:
            rare.append(_mix(token, 2))
        else:
            classes.setdefault(token % CLASSES, []).append(token)
        if taken - spare > len(classes):  # without a signature a partner could share one token of each class
            break
    pairs = [_mix(*sorted((a, b))) for own in classes.values() for i, a in enumerate(own) for b in own[:i]]
    return out + rare + pairs


def _sets(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for whole in batches:
            for batch in batches_of(whole, 2_000):
                sets = [shingles(x) for x in batch.column(1).to_pylist()]
                sizes = [len(s) for s in sets]
                heads = [s[: prefix_size(len(s), percent)].view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "digest", "prefix"])

    return run


def _signed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 1_000):
                reps, out = [], []
                for rep, size, live in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    own = signatures(size, [(x["sets"], x["token"] & _64) for x in live], percent)
                    reps += [rep] * len(own)
                    out += own
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], names=["rep", "signature"])

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingles(words), None
        for whole in batches:
            for batch in batches_of(whole, 1_000):
                # equal rows of one key come together
                reps = batch.column(1).to_pylist()
                batch = batch.filter(pa.array([a != b for a, b in zip(reps, [last, *reps])]))  # noqa: B905
                last = reps[-1]
                sets = [shingles(x).tobytes() for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "tokens"])

    return run


def _overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    flat = np.concatenate(tokens)
    own = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    names, column, sets = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(tokens), len(tokens)), np.float32)
    common = sets > 1
    place = np.cumsum(common) - 1
    some = common[column]
    own, column = own[some], place[column[some]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    for at in range(0, int(common.sum()), 4_096):
        lo, hi = np.searchsorted(column, [at, at + 4_096])
        block = np.zeros((len(tokens), 4_096), np.float32)
        block[own[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """(id, links, root) of the sets that this task linked: all pairs of one chunk, or those between two."""
        pdf = pdf.drop_duplicates("rep").sort_values("rep", kind="stable")
        ids, copies = pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        shared = _overlaps(sets).astype(np.int64)
        alike = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        np.fill_diagonal(alike, False)
        chunk = pdf["chunk"].to_numpy()
        if pdf["one"].iloc[0] != pdf["two"].iloc[0]:
            alike &= chunk[:, None] != chunk[None, :]
        links = (alike * copies[None, :]).sum(axis=1)
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root, np.where(alike, root[None, :], len(ids)).min(axis=1))
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, n_links, component_id) of every row.

    Keys are integers. Equal rows link with each other, as equal texts do; a row with a null key, or without words,
    links with nothing and is its own component. Long texts are read whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sets = docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(_sets(words, percent), "id long, size long, digest binary, prefix array<long>")
    sets = materialise(sets, "sets")
    same = ["size", "digest"]
    reps = materialise(sets.filter("size > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("prefix").alias("prefix")), "reps")
    release(spark)
    postings = reps.select("rep", "size", F.explode("prefix").alias("token"))
    counts = materialise(postings.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "tokens")
    release(spark)
    live = materialise(postings.join(counts, "token").groupBy("rep").agg(F.first("size").alias("size"), F.collect_list(F.struct("sets", "token")).alias("live")), "live")
    release(spark)
    signed = materialise(live.mapInArrow(_signed(percent), "rep long, signature long"), "signatures")
    first = materialise(signed.groupBy("signature").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("signature", "first"), "first")
    groups = components(signed.join(first, "signature").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    groups = materialise(groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "groups")
    release(spark)
    chunks = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n"))
    members = groups.join(chunks, "group").select("rep", "group", "n", F.pmod(F.xxhash64("rep"), "n").cast("int").alias("chunk"))
    members = materialise(members.join(reps.select("rep", "copies"), "rep"), "members")
    # merged at every size: members grow with the rows, so broadcasting them would only suit small tables
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("__text")).join(members.hint("merge"), "rep").select("__text", "rep", "copies", "group", "n", "chunk")
    whole = materialise(texts.mapInArrow(_whole(words), "rep long, copies long, group long, n int, chunk int, tokens binary"), "whole")
    release(spark)
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, "chunk").alias("one"), F.greatest(i, "chunk").alias("two")))
    tasks = whole.withColumn("p", F.explode(pairs)).select("group", "p.one", "p.two", "chunk", "rep", "copies", "tokens")
    found = materialise(tasks.groupBy("group", "one", "two").applyInPandas(_verify(percent), "id long, links long, root long"), "links")
    named = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = reps.select("size", "digest", "rep", "copies").join(links, "rep", "left").join(named, "rep", "left")
    classes = materialise(classes.select(F.col("size").alias("s"), F.col("digest").alias("d"), "rep", "copies", "links", "component"), "classes")
    out = sets.select("id", "size", "digest").join(classes, (F.col("id").isNotNull()) & (F.col("size") == F.col("s")) & (F.col("digest") == F.col("d")), "left")
    return out.select(
        F.col("id").alias(key),
        F.col("size").alias("n_shingles"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that link with nothing or have the smallest key of their component, with all columns.

    Rows with a null key stay, and so do equal rows of a kept key but one.
    """
    kept = join(docs, words, percent, key, text).filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept")).distinct()
    again = docs.join(materialise(kept, "kept"), F.col(key) == F.col("__kept"), "left_semi")
    first = again.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(key))).filter("__n = 1")
    return first.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


@query(
    "op9_ngram_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+') IF x <> ''] AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
    k AS (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k, 0)::BIGINT AS n_links, component_id
    FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return join(table(spark, sf_dir, "documents"))
