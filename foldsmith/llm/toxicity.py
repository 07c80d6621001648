"""Toxicity: words as bags of character n-grams, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams, so a misspelling shares most of its
vector with the word it stands for.  A passage is the mean of its words, a linear softmax gives its logit, and a text
is as toxic as its most toxic passage.  Embeddings and softmax are trained together on a bounded sample of labelled
texts.

As everything up to the logit is linear, scoring needs one number per distinct word, which a task keeps in a table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import map_batches, utf8

BUCKETS = 1 << 16
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
LEAST_TEXTS = 4  # sampled texts an n-gram must occur in to be learned
PASSAGE = 48  # words; passages overlap by half
SAMPLE_ROWS = 3000  # labelled texts per class, at most, by a hash of the id
SAMPLE_WORDS = 600  # of a sampled text, at most, a run that starts at random; scoring reads whole texts
STEPS = 160
BATCH = 3000  # passages
RATE = 0.03
DECAY = 0.05
PADDING = 16  # neutral words added to every passage, so that a few words alone do not decide
KNOWN_WORDS = 400_000  # entries of a task's word table before it is emptied

PIECE, SHARED = 64, 8  # bytes of a word, at most, and bytes that the pieces of a longer run share at least

SEPARATORS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def pieces(run: bytes) -> list[bytes]:
    """A run longer than a word, as in scripts without spaces, in overlapping pieces that no character is cut by.

    Neighbours share at least ``SHARED`` bytes, so every n-gram of the run is in a piece.
    """
    def back(at: int) -> int:  # to the first byte of a character; bytes that are no UTF-8 are cut anywhere
        return next((k for k in range(at, at - 4, -1) if run[k] & 0xC0 != 0x80), at)

    out, start = [], 0
    while len(run) - start > PIECE:
        end = back(start + PIECE)
        out.append(run[start:end])
        start = back(end - SHARED)
    return [*out, run[start:]]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; a word said again and again counts once."""
    words = text.lower().translate(SEPARATORS).split()
    if max(map(len, words), default=0) > PIECE:
        words = [p for w in words for p in (pieces(w) if len(w) > PIECE else (w,))]
    return [w for w, before in zip(words, [None, *words]) if w != before]


def excerpt(text: bytes) -> list[bytes]:
    """The run of at most ``SAMPLE_WORDS`` words of a text that training reads."""
    words = words_of(text)
    skip = zlib.crc32(text) % max(1, len(words) - SAMPLE_WORDS + 1)
    return words[skip:skip + SAMPLE_WORDS]


def ngrams(word: bytes) -> set[int]:
    """Hashed byte n-grams of one word, with marks at both ends, and the word itself."""
    marked = b"<" + word + b">"
    size = len(marked)
    return {zlib.crc32(marked[i:i + n]) % BUCKETS for n in NGRAMS for i in range(size - n + 1)} | {
        zlib.crc32(marked) % BUCKETS}


@dataclass
class Model:
    embeddings: np.ndarray  # (BUCKETS, DIMENSIONS)
    softmax: np.ndarray  # (DIMENSIONS, 2)
    bias: np.ndarray  # (2,)
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)  # of a text's top passage, constant, per log of passages

    def gram_logits(self) -> np.ndarray:
        """What each n-gram adds to the log odds of a one-gram word."""
        return self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def passage_cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of ``n`` words; each word is in at least one."""
    step = PASSAGE // 2
    starts = np.arange(0, max(1, n - step), step)
    return starts, np.minimum(starts + PASSAGE, n)


class Corpus:
    """Passages of the sample as flat arrays: passage -> words -> n-grams."""

    def __init__(self, texts: Sequence[bytes], labels: Sequence[int]):
        known: dict[bytes, int] = {}
        grams: list[np.ndarray] = []
        tokens, starts, ends, owners = [], [], [], []
        seen = np.zeros(BUCKETS, np.int64)
        size = 0
        for text, data in enumerate(texts):
            words = excerpt(data)
            if not words:
                continue
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    grams.append(np.fromiter(ngrams(w), np.int32))
            ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
            seen[np.unique(np.concatenate([grams[k] for k in np.unique(ids)]))] += 1
            a, b = passage_cuts(len(ids))
            starts.append(a + size)
            ends.append(b + size)
            owners.append(np.full(len(a), text))
            tokens.append(ids)
            size += len(ids)
        self.grams, self.tokens = grams, np.concatenate(tokens)
        self.starts, self.ends, self.owner = (np.concatenate(x) for x in (starts, ends, owners))
        self.learned = seen >= LEAST_TEXTS
        self.labels = np.asarray(labels, np.int64)[self.owner]

    def passage_means(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values[self.tokens])])
        return (sums[self.ends] - sums[self.starts]) / (self.ends - self.starts + PADDING)


def train(texts: Sequence[bytes], labels: Sequence[int], seed: int = 7) -> Model:
    """Fit embeddings and softmax together by Adam on the cross-entropy of passages, half of a batch of each class.

    A passage has its text's label; n-grams of few texts stay at zero.  Then the scale of a text's score is fitted.
    Without examples of both classes everything gets a score just below one half.
    """
    random = np.random.default_rng(seed)
    model = Model(random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32),
                  random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.array([0.0, -0.01], np.float32))
    usable = [(t, y) for t, y in zip(texts, labels) if words_of(t)]
    if len({y for _, y in usable}) < 2:
        model.embeddings[:] = 0
        return model
    # every fifth text is left out here, and the scale is fitted on scores the model could not learn by heart
    checked = usable[::5] if len({y for _, y in usable[::5]}) == 2 and len(usable) >= 100 else usable
    learned = [x for k, x in enumerate(usable) if k % 5] if checked is not usable else usable
    data = Corpus(*zip(*learned))
    model.embeddings[~data.learned] = 0
    parameters = [model.embeddings, model.softmax, model.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    clean, toxic = (np.flatnonzero(data.labels == y) for y in (0, 1))
    hard = clean
    for t in range(1, STEPS + 1):
        if t % 40 == 0:  # from here half of the clean passages are the most toxic-looking ones
            values = Scorer(model)
            logits = data.passage_means(np.array([sum(map(values.grams.__getitem__, g)) / len(g) for g in data.grams]))
            hard = clean[np.argsort(-logits[clean], kind="stable")[:max(BATCH // 4, len(clean) // 10)]]
        pools = ((toxic, BATCH // 2), (clean, BATCH // 4), (hard, BATCH // 4))
        picked = [random.choice(c, min(len(c), n), replace=False) for c, n in pools]
        rows = np.concatenate(picked)
        weight = np.concatenate([np.full(len(r), n / BATCH / len(r)) for r, (_, n) in zip(picked, pools)])
        for p, g, m, v in zip(parameters, _gradients(data, model, rows, weight), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * DECAY * p
            p -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        model.embeddings[~data.learned] = 0
    model.scale = _fit_scale(model, [t for t, _ in checked], np.array([y for _, y in checked]))
    return model


def _gradients(data: Corpus, model: Model, rows: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    counts = data.ends[rows] - data.starts[rows]
    first = np.cumsum(counts) - counts
    tokens = data.tokens[np.repeat(data.starts[rows] - first, counts) + np.arange(counts.sum())]
    words, tokens = np.unique(tokens, return_inverse=True)
    grams = [data.grams[k] for k in words]
    gram_count = np.array([len(g) for g in grams])
    grams = np.concatenate(grams)
    vectors = np.add.reduceat(model.embeddings[grams], np.cumsum(gram_count) - gram_count, axis=0) / gram_count[:, None]
    means = np.add.reduceat(vectors[tokens], first, axis=0) / (counts + PADDING)[:, None]
    logits = means @ model.softmax + model.bias
    chance = np.exp(logits - logits.max(axis=1, keepdims=True))
    chance /= chance.sum(axis=1, keepdims=True)
    chance[np.arange(len(rows)), data.labels[rows]] -= 1
    back = chance * weight[:, None]
    to_means = (back @ model.softmax.T) / (counts + PADDING)[:, None]
    passage, word = np.repeat(np.arange(len(rows)), counts), np.repeat(np.arange(len(words)), gram_count)
    to_words = np.stack([np.bincount(tokens, d[passage], len(words)) for d in to_means.T]) / gram_count
    to_grams = np.stack([np.bincount(grams, d[word], BUCKETS) for d in to_words], axis=1)
    return [to_grams.astype(np.float32), (means.T @ back).astype(np.float32), back.sum(axis=0).astype(np.float32)]


def _fit_scale(model: Model, texts: Sequence[bytes], labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the top passage and the log of their number, by Newton's method."""
    scorer = Scorer(model)
    x = np.array([(*scorer.top(t), 1.0) for t in texts])[:, [0, 2, 1]]
    x[:, 2] = np.log(x[:, 2])
    spread_x = max(1e-6, float(x[:, 0].std()))
    x[:, 0] /= spread_x
    # the rarer class counts more, by the square root of what would make both equal
    weight = np.sqrt(np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-2 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), slope)
    return float(w[0] / spread_x), float(w[1]), float(w[2])


class Scorer:
    """Scores texts with one number per distinct word."""

    def __init__(self, model: Model):
        self.grams, self.offset, self.scale = model.gram_logits().tolist(), model.offset(), model.scale
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        grams, values = ngrams(word), self.grams
        return sum(values[g] for g in grams) / len(grams)

    def top(self, text: bytes) -> tuple[float, int]:
        """Log odds of the most toxic passage, and the number of passages; a text without words is one of none."""
        words, known = words_of(text), self.known
        if not words:
            return self.offset, 1
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        sums = np.zeros(len(words) + 1)
        np.cumsum(np.fromiter(map(known.__getitem__, words), np.float64, len(words)), out=sums[1:])
        a, b = passage_cuts(len(words))
        return self.offset + float(((sums[b] - sums[a]) / (b - a + PADDING)).max()), len(a)

    def score(self, text: bytes) -> float:
        top, n = self.top(text)
        slope, constant, per_log = self.scale
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * top + constant + per_log * math.log(n)))))


def crc_fold(id_col: str, folds: int = 5):
    """crc32 of an id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        most: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``most`` labelled texts per class, the first by a hash of their id; null labels are left out.

    Ids whose fold is 0 are held out.  An id with two labels counts once for each.
    """
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()).distinct()
              .filter(crc_fold("id") != 0).withColumn("draw", F.xxhash64("id", F.lit("toxicity"))))
    # the ids are cut to the sample before any text is read
    chosen = None
    for label in (0, 1):
        part = marked.filter(F.col("label") == label).orderBy("draw", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col(text_col).isNotNull())
    # of a sampled text only the run of words that training reads leaves the executors
    joined = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def make():
        def step(batch: pa.RecordBatch):
            return {"id": batch.column("id"), "label": batch.column("label"),
                    "run": [b" ".join(excerpt(t)) for t in utf8(batch.column("text"))]}
        return step

    kind = joined.schema["id"].dataType.simpleString()
    rows = map_batches(joined, make, f"id {kind}, label int, run binary").orderBy("id", "label", "run").collect()
    return train([bytes(r.run) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 from the whole text; null and empty texts get that of no words.

    All other columns stay as they are, whatever they are named, but for one named ``score``, which is replaced.
    An empty table stays empty.
    """
    docs = docs.drop("score")
    return _scored(docs, model, text_col).toDF(*docs.columns, "score")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with their own columns, one named ``score`` included."""
    kept = _scored(docs, model, text_col).filter(F.col("score") < limit)
    return kept.drop("score").toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... and ``score``."""
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    at = names.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def make():
        scorer = Scorer(sent.value)

        def step(batch: pa.RecordBatch):
            out = {f"c{k}": batch.column(k) for k in range(batch.num_columns)}
            out["score"] = [scorer.score(t) for t in utf8(batch.column(at))]
            return out

        return step

    ddl = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds)) + ", score double"
    return map_batches(spread(docs.toDF(*[f"c{k}" for k in range(len(names))])), make, ddl)
