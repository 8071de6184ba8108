"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against it
greedily: a phrase is the longest match from the current place, and the next phrase starts after it (Ziv and Merhav
1993). The language that needs the fewest phrases, normalised by the letters read, wins. Parsing walks the automata
of all languages and all pieces of a batch in step; pieces have at most ``PIECE`` bytes and no phrase crosses their
edge, so a long text is read whole with bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.llm.common import batches_of, fold, query, table

#: Bounds of the sample: documents of one language, characters of each, bytes of all languages together.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 300, 4_000, 160_000
PIECE = 1_024
ROWS = 2_000

_LETTER = regex.compile(r"\p{L}")
_ASCII = regex.compile(rb"[A-Za-z]")
# ASCII letters in lower case, all other ASCII as space, bytes of other characters as they are
_PLAIN = bytes(b if b >= 128 else (b | 32) if chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Letters and single spaces in UTF-8."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text))


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by state of the suffix automaton of a text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Parser:
    """Automata of all languages in one table; column 0 stands for bytes that no sample holds."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.code = np.zeros(256, np.uint8)  # UTF-8 without ASCII but letters and space has under 200 bytes
        used = sorted(set().union(*samples.values())) if samples else []
        self.code[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.starts: list[int] = []
        self.edges: list[np.ndarray] = []
        at = 0
        for language in self.languages:
            moves = automaton(samples[language])
            self.starts.append(at)
            self.edges.append(np.array([(at + s, int(self.code[c]), at + t) for s, row in enumerate(moves) for c, t in row.items()], np.int32).reshape(-1, 3))
            at += len(moves)
        self.states = at
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}  # built again where it is used: the edges are far smaller

    def phrases(self, pieces: list[bytes]) -> np.ndarray:
        """(language, piece): how many phrases each piece needs."""
        if self.table is None:
            # targets are stored as row offsets; 0 means no transition (no edge leads to a start state but 0 is one)
            self.table = np.zeros(self.states * self.width, np.int32)
            for edges in self.edges:
                self.table[edges[:, 0] * self.width + edges[:, 1]] = edges[:, 2] * self.width
        count = np.zeros((len(self.languages), len(pieces)), np.int32)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order], np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        flat = self.code[np.frombuffer(b"".join(pieces[i].ljust(longest, b"\0") for i in order), np.uint8)].reshape(len(order), longest)
        columns = np.ascontiguousarray(flat.T)
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # pieces longer than each place
        for k, start in enumerate(self.starts):
            root = start * self.width
            state = np.full(len(order), root, np.int32)
            open_ = np.zeros(len(order), np.int32)
            first = self.table[root : root + self.width]
            first = np.where(first == 0, root, first).astype(np.int32)
            for at in range(longest):
                n = live[at]
                code = columns[at, :n]
                to = self.table[state[:n] + code]
                failed = to == 0
                open_[:n] += failed | (state[:n] == root)  # a phrase starts here
                state[:n] = np.where(failed, first[code], to)
            count[k, order] = open_
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, phrases by letter) of every text.

        The score is how much fewer phrases the language needs than the next: 1 - best / second, 1 with one language.
        """
        bodies = [plain(x) if x and has_letter(x) else b"" for x in texts]
        owner, pieces = [], []
        for i, body in enumerate(bodies):
            for at in range(0, len(body), PIECE):
                owner.append(i)
                pieces.append(body[at : at + PIECE])
        out, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages or not pieces:
            return out, score, rate
        totals = np.zeros((len(self.languages), len(texts)), np.int64)
        np.add.at(totals, (slice(None), np.array(owner)), self.phrases(pieces))
        best = totals.argmin(axis=0)
        ranked = np.sort(totals, axis=0)
        for i, body in enumerate(bodies):
            if body:
                out[i] = self.languages[best[i]]
                score[i] = 1 - ranked[0, i] / ranked[1, i] if len(ranked) > 1 else 1.0
                rate[i] = ranked[0, i] / len(body)
        return out, score, rate


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Labelled text by language: up to ``SAMPLE_DOCS`` documents of each, first by a hash of the id.

    All languages share ``SAMPLE_BYTES`` evenly. Rows without text, letter or language are left out.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.substring(text, 1, SAMPLE_CHARS).alias("t"), F.xxhash64(key, text).alias("h"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("l").orderBy("h"))).filter(F.col("n") <= SAMPLE_DOCS)
    texts: dict[str, list[bytes]] = {}
    for r in sorted(first.select("l", "t", "n").collect(), key=lambda r: (r["l"], r["n"])):
        texts.setdefault(r["l"], []).append(plain(r["t"]))
    share = SAMPLE_BYTES // max(1, len(texts))
    return {language: b" ".join(x)[:share] for language, x in texts.items()}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Parser:
    return Parser(sample(docs, text, lang, key))


def identify(docs: DataFrame, parser: Parser, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rate) of every row; other columns are not read.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or empty, has no letter, or
    nothing was learned; ties go to the language first in the alphabet. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, ROWS):
                languages, score, rate = shared.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(score), pa.array(rate)], names=[key, "lang_pred", "score", "rate"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rate double")


def keep_identified(docs: DataFrame, parser: Parser, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; the others are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    place = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, ROWS):
                languages, _, _ = shared.value.predict(batch.column(place).to_pylist())
                yield batch.filter(pa.array([x != "und" for x in languages], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op2_langid")
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from rows with crc32(doc_id) mod 4 other than 2."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.filter(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
