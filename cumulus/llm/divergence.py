"""Divergence of sources from their language and from each other, by single-pass in-memory indexing.

A task reads documents into a block of postings in memory, (language, term) -> (source, count, documents). When the
block is full it is spilled as a term-sorted run to the exchange, which deals terms to hash shards; a shard's runs are
merged in the order of terms (Spark's sort is the heap merge of sorted runs, and spills) and read as one stream, in
which the entries of a term meet: they become its frequencies, and only terms in enough documents of the language stay.

The second pass streams the frequencies, with the shares of every group, and adds up the corrections of pairs. A
group's share of a term that it doesn't have is the same for all such terms, so the distance of two sources is a base
(both lack the term), a part of each source alone (from how many of its terms have the same count), and corrections
for the terms that both have. Only the last needs terms and pairs at once, and only inside a block of the stream.

All sums are whole numbers. Nothing is broadcast by hint or collected; state is a block of postings or of entries.
"""

from __future__ import annotations

from collections import _count_elements  # the counting loop of Counter, for plain dictionaries
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.llm.common import query, table
from cumulus.session import materialise

MIN_DOCS, TOP = 10, 10
#: Postings of a block in memory (some 150 bytes each) and rows of a batch that a task hands on.
BLOCK, ROWS = 400_000, 20_000
#: Entries that are handled at once in the second pass; pairs of sources whose sums a task holds before it hands them on.
ENTRIES, PAIRS = 200_000, 1_000_000
#: Groups are copied so often that no join on the language alone has one task for a language.
SALTS = 16
#: Shares are whole numbers of this part, and every count is raised by SMOOTH.
SCALE, SMOOTH = 1_000_000_000, 2

# bytes of a term stay (letters in lower case, all of what isn't ASCII), others separate terms
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def spilled(block: dict[tuple, tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
    """A block as a run of rows, sorted by language, term and source."""
    for lang in sorted({k[0] for k in block}):
        groups = sorted((s, *v) for (x, s), v in block.items() if x == lang)
        rows = sorted((term, i) for i, (_, counts, _) in enumerate(groups) for term in counts)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            names = pa.array([g[0] for g in groups]).take(pa.array([i for _, i in some], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(some), pa.string()),
                    pa.array([t for t, _ in some], pa.binary()).cast(pa.string()),
                    names.cast(pa.string()),
                    pa.array([groups[i][1][t] for t, i in some], pa.int64()),
                    pa.array([groups[i][2][t] for t, i in some], pa.int64()),
                ],
                schema=_RUN,
            )


def term_runs(docs: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(lang, term, source, n occurrences, d documents) of every block of postings."""

    def run(batches):
        block: dict[tuple, tuple[dict, dict]] = {}
        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                counts, seen = block.setdefault((lang, source), ({}, {}))
                words, before = terms(text.as_py()), len(counts)
                _count_elements(counts, words)
                _count_elements(seen, set(words))
                held += len(counts) - before
                if held >= block_size:
                    yield from spilled(block)
                    block, held = {}, 0
        yield from spilled(block)

    return docs.mapInArrow(run, "lang string, term string, source string, n long, d long")


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Positions at which a row differs from the one before in any of the columns."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        if n > 1:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def merged(batches, min_docs: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, whole, n) of a stream sorted by language, term and source.

    A term in fewer than ``min_docs`` documents of the language goes; each other gets a row with ``whole`` for the language.
    """
    rest: pa.Table | None = None

    def sums(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        at = _starts([part[c].combine_chunks() for c in ("lang", "term", "source")])
        if not len(at):
            return part
        totals = [pa.array(np.add.reduceat(part[c].to_numpy(), at)) for c in ("n", "d")]
        return pa.table([*[part[c].take(pa.array(at)) for c in ("lang", "term", "source")], *totals], schema=_RUN)

    def closed(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        at = _starts([part[c].combine_chunks() for c in ("lang", "term")])
        if not len(at):
            return
        size = np.diff(np.append(at, part.num_rows))
        keep = np.add.reduceat(part["d"].to_numpy(), at) >= min_docs
        heads, rows = pa.array(at[keep]), pa.array(np.flatnonzero(np.repeat(keep, size)))
        total = pa.array(np.add.reduceat(part["n"].to_numpy(), at)[keep])
        own = part.take(rows)
        of_lang = [part["lang"].take(heads), part["term"].take(heads), pa.array([""] * len(heads), pa.string()), pa.array([True] * len(heads)), total]
        names = ["lang", "term", "source", "whole", "n"]
        out = [pa.table(of_lang, names=names), pa.table([own["lang"], own["term"], own["source"], pa.array([False] * len(rows)), own["n"]], names=names)]
        yield from pa.concat_tables(out).combine_chunks().to_batches()

    for batch in batches:
        part = pa.Table.from_batches([batch.select(_RUN.names).cast(_RUN)])
        part = sums(part if rest is None else pa.concat_tables([rest, part]))
        at = _starts([part[c].combine_chunks() for c in ("lang", "term")])
        last = int(at[-1]) if len(at) else 0
        yield from closed(part.slice(0, last))
        rest = part.slice(last)
    if rest is not None:
        yield from closed(rest)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block_size: int = BLOCK) -> DataFrame:
    """(lang, term, source, whole, n) of the terms kept, each language's own row with ``whole``; ``docs`` has lang, source, text."""
    runs = term_runs(docs.select("lang", "source", "text"), block_size)
    shards = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(lambda batches: merged(batches, min_docs), "lang string, term string, source string, whole boolean, n long")


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers up to 10^9 + 1."""
    return (p - q) * (p - q) // (p + q)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Sums:
    """Sums by (language, source, source) and the best terms by (language, source), handed on when they grow large."""

    def __init__(self, top: int):
        self.top, self.pairs, self.best = top, {}, {}

    def add(self, lang: str, names: list[str], sums: dict[tuple[int, int], int]) -> None:
        for (g, h), v in sums.items():
            key = (lang, names[g], names[h])
            self.pairs[key] = self.pairs.get(key, 0) + v

    def offer(self, lang: str, source: str, found: list[tuple[int, bytes]]) -> None:
        key = (lang, source)
        self.best[key] = sorted(self.best.get(key, []) + found)[: self.top]

    def full(self) -> bool:
        return len(self.pairs) + len(self.best) > PAIRS

    def rows(self) -> Iterator[pa.RecordBatch]:
        rows = [(k[0], k[1], "pair", k[2].encode(), v) for k, v in self.pairs.items()]
        rows += [(k[0], k[1], "term", t, -v) for k, some in self.best.items() for v, t in some]
        self.pairs, self.best = {}, {}
        for at in range(0, len(rows), ROWS):
            some = list(zip(*rows[at : at + ROWS], strict=True))
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(some, kinds, strict=True)]
            columns[3] = columns[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def pair_sums(term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, sources: int) -> dict[tuple[int, int], int]:
    """For sources g < h: the sum over the terms that both have of what counting each alone gets wrong.

    Rows are sorted by term; ``p`` is the share of a term in a source, ``p0`` that of a term which the source lacks.
    """
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(starts, len(term)))
    group = np.cumsum(np.diff(term, prepend=-1) != 0) - 1
    out: dict[tuple[int, int], int] = {}
    for g in range(sources):
        own = np.flatnonzero(source == g)
        if not len(own):
            continue
        # in slices, as a source may share its terms with many others
        most = np.cumsum(sizes[group[own]])
        for part in np.split(own, np.searchsorted(most, np.arange(ENTRIES, most[-1], ENTRIES))):
            if not len(part):
                continue
            count = sizes[group[part]]
            other = np.repeat(starts[group[part]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            mine = np.repeat(part, count)
            some = source[other] > g
            other, mine = other[some], mine[some]
            if len(other):
                wrong = distance(p[mine], p[other]) - distance(p[mine], p0[other]) - distance(p0[mine], p[other]) + distance(p0[mine], p0[other])
                sums = np.zeros(sources, np.int64)
                np.add.at(sums, source[other], wrong)
                for h in np.unique(source[other]).tolist():
                    out[g, h] = out.get((g, h), 0) + int(sums[h])
    return out


def corrections(batches, top: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value) of a stream of (lang, term, whole, source, p, p0) sorted by language and term, ``whole`` first.

    ``pair``: corrections of source < item, to be added up; ``term``: the best terms of the stream for the source.
    """
    sums, rest = _Sums(top), None

    def handle(part: pa.Table) -> None:
        part = part.combine_chunks()
        lang_at = [*_starts([part["lang"].combine_chunks()]).tolist(), part.num_rows]
        for a, b in zip(lang_at, lang_at[1:]):
            one = part.slice(a, b - a).combine_chunks()
            lang = one["lang"][0].as_py()
            heads = _starts([one["term"].combine_chunks()])
            term = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, one.num_rows)))
            whole, p, p0 = (one[c].to_numpy() for c in ("whole", "p", "p0"))
            q = p[heads][term]
            coded = one["source"].combine_chunks().dictionary_encode()
            own = ~whole
            names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            order = sorted(range(len(names)), key=lambda i: names[i].encode())
            place = np.argsort(np.array(order))
            source, names = place[source], [names[i] for i in order]
            sums.add(lang, names, pair_sums(term[own], source[own], p[own], p0[own], len(names)))
            more = np.flatnonzero(own & (p > q))
            value = distance(p[more], q[more])
            by = more[np.lexsort((term[more], -value, source[more]))]
            at = np.flatnonzero(np.diff(source[by], prepend=-1))
            for x, y in zip(at, np.append(at[1:], len(by))):
                best = by[x : min(y, x + top)]
                words = one["term"].take(pa.array(best)).cast(pa.binary()).to_pylist()
                sums.offer(lang, names[source[best[0]]], list(zip((-distance(p[best], q[best])).tolist(), words)))

    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        if rest.num_rows >= ENTRIES:
            rest = rest.combine_chunks()
            last = int(_starts([rest[c].combine_chunks() for c in ("lang", "term")])[-1])
            handle(rest.slice(0, last))
            rest = rest.slice(last)
            if sums.full():
                yield from sums.rows()
    if rest is not None and rest.num_rows:
        handle(rest)
    yield from sums.rows()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text", block_size: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of a language; see ``op12_divergence`` for the figures.

    A null text, language or source counts as ''. A source without terms is a group all the same, and a language
    without kept terms has pairs of value 0. Repeated rows count as often as they stand; ties go to the item that is
    first by its bytes. An empty table gives an empty result. Other columns are not read.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    freq = materialise(frequencies(named, min_docs, block_size), "frequencies")
    own, whole = freq.filter("not whole"), freq.filter("whole")
    vocabulary = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    counted = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(vocabulary.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", F.lit(False).alias("whole"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    sizes = groups.unionByName(vocabulary.select("lang", F.lit("").alias("source"), F.lit(True).alias("whole"), "total", "v"))
    share = lambda n: f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(25,0)) div cast(total + {SMOOTH} * v as decimal(25,0))"
    sizes = materialise(sizes.withColumn("p0", F.when(F.col("v") > 0, F.expr(share(0))).otherwise(1)), "sizes")
    groups = sizes.filter("not whole").select("lang", "source", "v", "p0")

    entries = materialise(freq.join(sizes, ["lang", "source", "whole"]).select("lang", "term", "whole", "source", F.expr(share("n")).alias("p"), "p0"), "entries")
    shards = entries.repartition("lang", "term").sortWithinPartitions("lang", "term", F.col("whole").desc(), "source")
    streamed = materialise(shards.mapInArrow(lambda batches: corrections(batches, top), "lang string, source string, part string, item string, value long"), "corrections")

    other = groups.select("lang", F.col("source").alias("item"), F.col("v").alias("w"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    base = salted(groups, "source").join(other, ["lang", "salt"]).filter("source <> item").select("lang", "source", "item", (F.col("v") * _distance(F.col("p0"), F.col("q0"))).alias("value"))
    alike = entries.filter("not whole").groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    alone = salted(alike, "source", "p").join(other, ["lang", "salt"]).filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_distance(F.col("p"), F.col("q0")) - _distance(F.col("p0"), F.col("q0")))).alias("value"))
    both = alone.unionByName(streamed.filter("part = 'pair'").select("lang", "source", "item", "value"))
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(both).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = streamed.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    by = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(best)
    return ranked.withColumn("rank", F.row_number().over(by)).filter(F.expr(f"part = 'pair' or rank <= {int(top)}"))


@query(
    "op12_divergence",
    f"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
    t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
    v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    z AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
        (SELECT count(*) FROM v WHERE v.lang = g.lang) AS v FROM g),
    l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM v GROUP BY lang),
    p AS (SELECT z.lang, z.source, v.term, coalesce(c.n, 0) AS n,
        (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (z.total + {SMOOTH} * z.v))::BIGINT AS p,
        (1 + {SCALE}::HUGEINT * (v.n + {SMOOTH}) // (l.total + {SMOOTH} * l.v))::BIGINT AS q
      FROM z JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = v.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r)
    SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}
    """,
)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of ``documents``, and the ten terms that a source has most above its language."""
    return divergence(table(spark, sf_dir, "documents"))
