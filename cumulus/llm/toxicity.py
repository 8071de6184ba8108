"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel between two words is the gap-weighted count of common subsequences of ``ORDER`` letters (Lodhi et al. 2002),
normalised, so an insult keeps most of its value when letters are inserted, doubled or left apart. Landmarks are words
of the training sample; a sentence is described by its best word for each landmark, whitened by the landmarks' own
kernel matrix (Nystroem). A squared-hinge machine is trained on sentences: those of clean documents, and of each toxic
document the sentence whose words speak most for the label. A text's margin is that of its worst sentence, turned into
a probability by a logistic fit on training documents.

The model is fitted on a bounded sample (``SAMPLE_DOCS`` documents of either label, ``SAMPLE_CHARS`` characters of
each) and has a fixed size; every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import batches_of, fold, query, table

ORDER, DECAY = 3, 0.8
#: The normalised kernel is taken to this power, which is a kernel again and tells near words from equal ones.
SHARP = 2
#: Bounds of the training sample: documents of either label, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 20_000
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 40, 4
#: A landmark is seen in so many toxic documents; beginnings of words up to so many letters can be landmarks.
LEAST, BEGIN = 3, 8
#: A landmark is left out when this share of its documents has one that is chosen already.
ALIKE = 0.8
#: Share of a landmark's letters that a word must hold to be compared.
LETTERS = 0.75
#: Words longer than this are read in windows that overlap by half.
WIDTH = 24
#: Words whose kernel with every landmark stays below this say nothing.
FLOOR = 0.2
ROWS = 4_000
#: Pairs whose kernels are found at once.
SLICE = 256
#: Words that a worker remembers between batches.
KEPT = 300_000

_SENTENCE = re.compile(r"[.!?\n]+\s*")
_STOP = re.compile("[.!?]+")
_SPELT = re.compile(r"(?<!\w)(?:\w[ \t._*\-]){3,}\w(?!\w)")
_EDGES = ".,;:!?\"'()[]{}<>*$%&#@~_-+=/\\|`^"


def spelt(text: str) -> str:
    """The text with words that are spelt out letter by letter put together."""
    return _SPELT.sub(lambda m: re.sub(r"[ \t._*\-]", "", m[0]), text)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points by (word, position); 0 after the end."""
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(words)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pairs(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of rows of ``s`` with rows of ``t``, pair by pair; code 0 matches nothing."""
    if len(s) > SLICE:
        return np.concatenate([_pairs(s[at : at + SLICE], t[at : at + SLICE]) for at in range(0, len(s), SLICE)])
    n, a, b = len(s), s.shape[1], t.shape[1]
    s, t = s.T, t.T
    same = ((s[:, None] == t[None]) & (s != 0)[:, None]).astype(np.float32)
    same *= np.float32(DECAY * DECAY)
    decay, prev = np.float32(DECAY), np.ones((a + 1, b + 1, n), np.float32)
    for _ in range(ORDER - 1):
        now, run = np.zeros((a + 1, b + 1, n), np.float32), np.zeros((a, n), np.float32)
        for j in range(b):
            run *= decay
            run += same[:, j] * prev[:-1, j]
            now[1:, j + 1] = run
        for i in range(a):
            now[i + 1] += decay * now[i]
        prev = now
    return np.einsum("ijn,ijn->n", same, prev[:-1, :-1])


#: By length, the part of a word's kernel with itself that its equal subsequences make: the square root of the least it can be.
_OWN = np.sqrt([sum((n - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(ORDER, n + 1)) for n in range(64)])


def _masks(codes: np.ndarray) -> np.ndarray:
    """A set of 64 letter classes for each row."""
    bits = np.where(codes == 0, np.uint64(0), np.left_shift(np.uint64(1), (codes % 63 + 1).astype(np.uint64)))
    return np.bitwise_or.reduce(bits, axis=1)


class Landmarks:
    """Normalised kernels of words with fixed landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = _codes(words, max(map(len, words)))
        self.sizes = np.array([len(w) for w in words])
        self.masks = _masks(self.codes)
        self.need = np.ceil(LETTERS * np.bitwise_count(self.masks)).astype(np.int64)
        self.own = np.sqrt(_pairs(self.codes, self.codes))

    def kernel(self, words: list[str], floor: float = 0.0) -> np.ndarray:
        """(word, landmark); pairs that share too few of the landmark's letters count as 0.

        Words whose values are all below ``floor`` may be left at 0: the kernel of a word with itself, the dearest to
        find, is only taken where a bound by its length doesn't show that.
        """
        out = np.zeros((len(words), len(self.words)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 8_192):
            part = np.array(order[at : at + 8_192])
            codes = _codes([words[i] for i in part], max(ORDER, len(words[part[-1]])))
            masks = _masks(codes)
            near = np.bitwise_count(masks[:, None] & self.masks[None, :]) >= self.need[None, :]
            if not near.any():
                continue
            raw = np.zeros(near.shape, np.float32)
            for z in range(len(self.words)):
                rows = np.flatnonzero(near[:, z])
                if len(rows):
                    mark = np.broadcast_to(self.codes[z, : self.sizes[z]], (len(rows), self.sizes[z]))
                    raw[rows, z] = _pairs(codes[rows], mark) / self.own[z]
            least = _OWN[(codes != 0).sum(axis=1)]
            some = np.flatnonzero((raw.max(axis=1) >= 0.999 * floor ** (1 / SHARP) * least) & near.any(axis=1))
            own = np.sqrt(np.maximum(_pairs(codes[some], codes[some]), 1e-12))
            out[part[some]] = np.round(raw[some] / own[:, None], 4) ** SHARP
        return out


def _plain(token: str) -> str:
    return token.strip(_EDGES)


def _marks(token: str) -> list[str]:
    """What a token offers as landmarks: the word between its edges, and its beginnings."""
    word = _plain(token)
    return [f"^{word}$", *(f"^{word[:n]}" for n in range(ORDER, min(len(word), BEGIN) + 1))] if ORDER <= len(word) <= WIDTH else []


def _cover(docs: list[set[str]], odds: dict[str, float]) -> list[str]:
    """Marks that speak for the label, chosen one by one for the documents that have fewest of them so far."""
    holders: dict[str, list[int]] = {}
    for i, marks in enumerate(docs):
        for m in marks:
            holders.setdefault(m, []).append(i)
    weight, out, taken = np.ones(len(docs)), [], []
    while holders and len(out) < TOXIC_LANDMARKS:
        best = max(holders, key=lambda m: (odds[m] * weight[holders[m]].sum(), m))
        own = set(holders.pop(best))
        if all(len(own & x) < ALIKE * len(own | x) for x in taken):
            out.append(best)
            taken.append(own)
            weight[list(own)] *= 0.4
    return out


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def telling(landmarks: Landmarks, words) -> dict[str, np.ndarray]:
    """Landmark kernels of the words, without signs around them, that come near some landmark."""
    by: dict[str, list[str]] = {}
    for word in words:
        if len(word) >= ORDER:
            bare = word if word.isalnum() else "".join(filter(str.isalnum, word))  # without signs put between letters
            for form in {word, bare}:
                for part in _windows(f"^{form}$"):
                    by.setdefault(part, []).append(word)
    parts = list(by)
    out: dict[str, np.ndarray] = {}
    for at in range(0, len(parts), 65_536):
        some = parts[at : at + 65_536]
        values = landmarks.kernel(some, FLOOR)
        for i in np.flatnonzero(values.max(axis=1) >= FLOOR):
            for word in by[some[i]]:
                out[word] = np.maximum(out[word], values[i]) if word in out else values[i]
    return out


def _sentences(text: str) -> list[list[str]]:
    return [[_plain(w) for w in s.split()] for s in _SENTENCE.split(text) if s]


def _strongest(text: str, known: dict[str, np.ndarray], width: int) -> np.ndarray:
    """(sentence, landmark) for the sentences that hold a telling word."""
    out = [np.max([known[w] for w in words], axis=0) for s in _sentences(text) if (words := [w for w in s if w in known])]
    return np.array(out, np.float32).reshape(len(out), width)


class Model:
    def __init__(self, landmarks: Landmarks | None, white=None, weights=None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0, share: float = 0.0):
        self.landmarks, self.white, self.weights, self.bias, self.slope, self.shift, self.share = landmarks, white, weights, bias, slope, shift, share
        self.forget()

    def forget(self) -> None:
        """Empty the memory: kernels of telling words, a row each; each word's row (-1: none); each telling token's row, its own and with its parts."""
        self.kernels = np.empty((0, len(self.landmarks.words) if self.landmarks else 0), np.float32)
        self.by_word: dict[str, int] = {}
        self.row: dict[str, int] = {}
        self.rows: dict[str, tuple[int, ...]] = {}

    def learn(self, tokens: set[str]) -> None:
        # a sign that ends a sentence cuts a token, too: such parts are tokens of their own
        parts = {t: [p for p in _STOP.split(t) if p] if _STOP.search(t) else () for t in tokens}
        words = {p: _plain(p) for p in tokens.union(*parts.values())}
        fresh = set(words.values()) - self.by_word.keys()
        found = telling(self.landmarks, fresh)
        self.by_word.update(dict.fromkeys(fresh, -1))
        self.by_word.update((w, len(self.kernels) + i) for i, w in enumerate(found))
        self.kernels = np.concatenate([self.kernels, *([v[None] for v in found.values()])])
        self.row.update((p, r) for p, w in words.items() if (r := self.by_word[w]) >= 0)
        self.rows.update((t, tuple({self.row[p] for p in (t, *own) if p in self.row})) for t, own in parts.items())

    def margins(self, texts: list[str]) -> np.ndarray:
        texts = [spelt(x.lower()) for x in texts]
        own = [set(x.split()) for x in texts]
        if len(self.rows) > KEPT:
            self.forget()
        self.learn(set().union(*own) - self.rows.keys())
        speech = self.white @ self.weights
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            single = set(chain.from_iterable(map(self.rows.__getitem__, own[i])))
            if single:
                sentences = [found for s in _SENTENCE.split(text) if (found := [r for w in s.split() if (r := self.row.get(w)) is not None])]
                flat = [*chain.from_iterable(sentences), *single]
                starts = np.cumsum([0, *map(len, sentences), *[1] * (len(single) - 1)])
                strongest = np.maximum.reduceat(self.kernels[flat], starts, axis=0)
                out[i] = max(self.bias, float((strongest @ speech).max()) + self.bias)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine, by Newton steps; both labels weigh the same in all."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    c = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum())) / len(y)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-8])
    for _ in range(30):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        gradient = ridge @ w - 2 * x.T @ (c * y * slack)
        step = np.linalg.solve(ridge + 2 * (x[on] * c[on, None]).T @ x[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(label 1) on the margins, with smoothed targets (Platt)."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of a labelled sample. Without both labels every text gets the share of label 1 (0 without rows)."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, share=share)
    texts = [spelt(x.lower()) for x in texts]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    own = [{m for w in set(t.split()) for m in _marks(w)} for t in texts]
    for marks, label in zip(own, labels, strict=True):
        seen[label].update(marks)
    sizes = [int((y == 0).sum()), int((y == 1).sum())]
    odds = {w: np.log((n + 0.5) / (sizes[1] + 1)) - np.log((seen[0][w] + 0.5) / (sizes[0] + 1)) for w, n in seen[1].items() if n >= LEAST}
    chosen = _cover([{m for m in marks if odds.get(m, 0) > 1.5} for marks, label in zip(own, labels, strict=True) if label], odds)
    if not chosen:
        return Model(None, share=share)
    common = sorted((w for w in seen[0] if w.endswith("$") and odds.get(w, -1) < 0.2 and len(w) > ORDER + 2), key=lambda w: (-seen[0][w], w))
    landmarks = Landmarks(chosen + common[:PLAIN_LANDMARKS])
    gram = landmarks.kernel(landmarks.words).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    white = (vectors / np.sqrt(np.maximum(values, 0.1)) @ vectors.T).astype(np.float32)
    known = telling(landmarks, {w for t in texts for s in _sentences(t) for w in s})
    rows, signs = [np.zeros((1, len(landmarks.words)), np.float32)], [np.array([-1])]
    for text, label in zip(texts, labels, strict=True):
        found = _strongest(text, known, len(landmarks.words))
        if not len(found):
            continue
        if label:
            found = found[[int(found[:, : len(chosen)].max(axis=1).argmax())]]
            # the same insult with a letter inserted, at every second place
            words = [w for t in _sentences(text) for w in t if w in known and known[w][: len(chosen)].max() == found[0, : len(chosen)].max()][:1]
            bent = [f"^{w[:i]}x{w[i:]}$" for w in words for i in range(1, len(w), 2)]
            if bent:
                found = np.concatenate([found, landmarks.kernel([b[:WIDTH] for b in bent])])
        rows.append(found)
        signs.append(np.full(len(found), 1 if label else -1))
    signed = np.concatenate(signs)
    if (signed > 0).sum() == 0:
        return Model(None, share=share)
    weights, bias = _machine(np.concatenate(rows) @ white, signed)
    model = Model(landmarks, white, weights, bias, share=share)
    model.slope, model.shift = _logistic(model.margins(texts), y)
    model.forget()  # the model travels without the training words
    return model


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``size`` documents of either label, first by a hash of the id; only given rows are read.

    An id with both labels counts as toxic; null ids, labels and texts are left out.
    """
    one = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = [one.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for t in (0, 1)]
    picked = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    rows = picked.select("doc_id", F.substring("text", 1, chars).alias("text"), "toxic").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; a null text counts as empty. Other columns are not read, repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, ROWS):
                values = shared.value.score([x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``; labels of rows with crc32(doc_id) mod 4 other than 2 are learned."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*sample(docs, labels.filter(fold("doc_id", 4) != 2)))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
