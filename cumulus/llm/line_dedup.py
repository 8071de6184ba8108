"""Line deduplication by a log-template tree.

A line is parsed at a fixed depth, as log parsers do: by its number of tokens, then by its first ``LEADING`` tokens;
tokens with a digit are variable fields and read as ``<*>``. At the leaf a line has up to three templates: all its
tokens with variable fields generalised, and, from ``HALVES`` tokens on, its first and its second half with the rest
of the line generalised. So a line that differs from another in any fields of one half falls under its template, and
at least half of the tokens agree. The template of a whole line of ``HALVES`` tokens or more is recurring from
``LONG_DOCS`` documents on, others from ``min_docs`` on. The first document that has it, by key, keeps its lines;
elsewhere they are dropped. Keys of templates are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import query, table
from cumulus.session import materialise

LEADING, HALVES, MIN_DOCS, LONG_DOCS = 3, 12, 3, 2


def templates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__row, key, line, template, long) for every template of every line with a token; lines count from 0.

    ``__row`` is a hash of key and text, ``long`` marks whole lines of ``HALVES`` tokens or more. Null texts have no lines.
    """
    lines = docs.select(F.xxhash64(key, text).alias("__row"), F.col(key).alias("__key"), F.posexplode(F.split(text, "\n")).alias("line", "__body"))
    tokens = F.array_remove(F.split("__body", r"[ \t\r\f\x0B]+"), "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    # an exploded one-element array keeps the optimiser from computing the tokens once for each use
    parsed = lines.select("__row", "__key", "line", F.explode(F.array(masked)).alias("t")).filter(F.size("t") > 0)
    parsed = parsed.withColumn("n", F.size("t")).withColumn("h", F.expr("n div 2"))
    leaf = [F.col("n"), F.slice("t", 1, LEADING)]
    whole = F.xxhash64(F.lit("all"), *leaf, F.col("t"))
    halves = [F.xxhash64(F.lit(name), *leaf, part) for name, part in (("first", F.slice("t", F.lit(1), F.col("h"))), ("second", F.slice("t", F.col("h") + 1, F.col("n") - F.col("h"))))]
    every = F.when(F.col("n") >= HALVES, F.array(whole, *halves)).otherwise(F.array(whole))
    found = parsed.select("__row", "__key", "line", "n", F.posexplode(every).alias("kind", "template"))
    return found.select("__row", "__key", "line", "template", ((F.col("kind") == 0) & (F.col("n") >= HALVES)).alias("long"))


def recurring(found: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(template, __first) of the templates in enough documents; ``__first`` is the row that keeps it."""
    by_doc = found.groupBy("template", "long", "__row").agg(F.min("__key").alias("__key"))
    counts = by_doc.groupBy("template", "long").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("__key", "__row")).alias("first"))
    enough = F.when(F.col("long"), long_docs).otherwise(min_docs)
    return counts.filter(F.col("docs") >= enough).select("template", "long", F.col("first.__row").alias("__first"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text", long_docs: int = LONG_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` with lines of recurring templates dropped, and (__lines, __dropped).

    Rows equal in key and text are one document and stay alike; a null key comes before all others. Lines without a
    token stay, so do repeats inside the document that keeps a template. A null text stays null with no lines; an
    empty text has one. Columns of ``docs`` named like the two results are replaced. An empty table stays empty.
    """
    found = materialise(templates(docs, key, text), "templates")
    again = materialise(recurring(found, min_docs, long_docs), "recurring")
    lost = found.join(again, ["template", "long"]).filter(F.col("__row") != F.col("__first")).groupBy("__row").agg(F.collect_set("line").alias("__drops"))
    # the caller's other columns travel in one, so that no name can clash
    named = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    others = [c for c in named if c not in (key, text)]
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.struct(F.lit(0).alias("__none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("__others"))
    # lines are split once and not again for each use: an exploded one-element array is a column of its own
    split = plain.withColumn("__row", F.xxhash64("__key", "__text")).join(lost, "__row", "left").select("*", F.explode(F.array(F.split("__text", "\n"))).alias("__body"))
    whole, body, drops = split, F.col("__body"), F.coalesce("__drops", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(body) - 1), drops)
    kept = F.when(F.col("__drops").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(body, i)), "\n"))
    place = {c: f"__others.c{i}" for i, c in enumerate(others)}
    return whole.select(
        *[kept.alias(c) if c == text else F.col("__key" if c == key else place[c]).alias(c) for c in named],
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(body)).cast("long").alias("__lines"),
        F.size(drops).cast("long").alias("__dropped"),
    )


def keep_lines(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with recurring lines dropped, in the same columns; a document that has lost all it had goes.

    Documents that lost nothing stay as they are, empty ones too. A ``size`` column is set to the text's length where
    lines were dropped.
    """
    out = dedup_lines(docs, min_docs, key, text)
    changed = F.col("__dropped") > 0
    out = out.filter(~changed | F.col(text).rlike(r"\S"))
    return out.select(*[F.when(changed, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == size else F.col(c) for c in docs.columns])


_SQL = f"""
    WITH l AS (SELECT doc_id, i - 1 AS line, regexp_split_to_array(b[i], '[ \\t\\r\\f\\v]+') AS t
      FROM (SELECT doc_id, string_split(text, chr(10)) AS b, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    m AS (SELECT doc_id, line, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN t IF x <> ''] AS t FROM l),
    k AS (
      SELECT doc_id, line, 'a' AS kind, len(t) AS n, t FROM m WHERE len(t) > 0
      UNION ALL SELECT doc_id, line, 'f', len(t), t[:{LEADING}] || ['/'] || t[:len(t) // 2] FROM m WHERE len(t) >= {HALVES}
      UNION ALL SELECT doc_id, line, 's', len(t), t[:{LEADING}] || ['/'] || t[len(t) // 2 + 1:] FROM m WHERE len(t) >= {HALVES}),
    r AS (SELECT kind, n, t, min(doc_id) AS first FROM k GROUP BY kind, n, t
      HAVING count(DISTINCT doc_id) >= CASE WHEN kind = 'a' AND n >= {HALVES} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
    d AS (SELECT DISTINCT k.doc_id, k.line FROM k JOIN r USING (kind, n, t) WHERE k.doc_id <> r.first),
    e AS (SELECT doc_id, list(line) AS drops FROM d GROUP BY doc_id),
    o AS (SELECT doc_id, string_split(text, chr(10)) AS b, coalesce(drops, []) AS drops FROM documents LEFT JOIN e USING (doc_id))
    SELECT doc_id, array_to_string([b[i] FOR i IN range(1, len(b) + 1) IF NOT list_contains(drops, i - 1)], chr(10)) AS text,
      len(b) AS n_lines, len(drops) AS n_dropped FROM o
"""


@query("op7_line_dedup", _SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines of templates that recur: long lines in two documents or more, others in three."""
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))
