"""A toxicity classifier with counterfactual regularisation.

A logistic model over word presence is fitted on a bounded sample of labelled texts. Every
sampled text with a term that could as well be another has a twin in which each such term is swapped;
the loss adds the squared change of the score between the two. So the model cannot lean on a
mention of a group, and neutral mentions are not scored up.

Terms are the identity terms of a fixed list, and pairs learned from the labelled texts: frequent
words that both classes have at like rates, each with the one that stands most in the same
contexts. So there are twins in any language and whether or not a listed term occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import textvec
from larkspur.llm.common import raw_texts, slices, staged, with_added

# Identity terms that stand for one another, a kind per line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Labelled texts of each class that are used at most.
SAMPLE_PER_CLASS = 2500
#: Words that are paired by their contexts at most, the hash buckets of a context word on one side, the least cosine of a pair.
PAIRED, BUCKETS, LIKENESS = 256, 512, 0.3
#: How much stronger the ridge is on learned words than on others.
NEUTRAL_RIDGE = 100.0


def text_words(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each word, hash of each word) for runs of texts."""
    for begin, end in slices(texts):
        data, offsets = textvec.joined(texts[begin:end])
        data = data.lower()
        starts, ends = textvec.word_spans(data, textvec.LETTERS)
        yield begin, end - begin, np.searchsorted(offsets, starts, side="right") - 1, textvec.word_hashes(data, starts, ends)


def hash_word(word: str) -> np.uint64:
    return next(text_words([word.encode()]))[3][0]


def identity_swaps() -> dict[int, int]:
    """The hash of each identity term and of the term that replaces it."""
    return {int(hash_word(a)): int(hash_word(b)) for kind in IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights and the intercept; the twins it was fitted with and the mean absolute change of the score between twins."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    twins: int = 0
    change: float = 0.0

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        shift = np.uint64(48)
        known = np.zeros(1 << 16, dtype=bool)
        known[self.words >> shift] = True
        for begin, _, row, h in text_words(texts):
            at = np.flatnonzero(known[h >> shift])
            if not len(self.words) or not len(at):
                continue
            place = np.searchsorted(self.words, h[at])
            place[place == len(self.words)] = 0
            hit = self.words[place] == h[at]
            pairs = np.unique(row[at][hit] * len(self.words) + place[hit])
            np.add.at(total, begin + pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gains(positive: np.ndarray, every: np.ndarray, rate: float) -> np.ndarray:
    """Roots of the likelihood ratios of words' class counts."""
    negative = every - positive
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(positive > 0, positive * np.log(positive / (every * rate)), 0) + np.where(negative > 0, negative * np.log(negative / (every * (1 - rate))), 0)
    return np.sqrt(2 * np.maximum(gain, 0))


def neutral_words(bags: list[np.ndarray], toxic: np.ndarray, *, most: int = PAIRED, least: int = 4, z: float = 1.0) -> np.ndarray:
    """Sorted hashes of the words in most texts that both classes have at like rates."""
    if not len(bags) or toxic.min() == toxic.max():
        return np.empty(0, dtype=np.uint64)
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    vocabulary, column = np.unique(np.concatenate(bags), return_inverse=True)
    positive, every = np.bincount(column, toxic[rows], len(vocabulary)), np.bincount(column, minlength=len(vocabulary))
    good = np.flatnonzero((every >= least) & (positive > 0) & (positive < every) & (_gains(positive, every, float(toxic.mean())) < z))
    return np.sort(vocabulary[good[np.lexsort((vocabulary[good], -every[good]))][:most]])


def learned_swaps(words: np.ndarray, contexts: np.ndarray, likeness: float = LIKENESS) -> dict[int, int]:
    """Each word with the other whose contexts (a row of counts a word) are most like its own, if their cosine is at least likeness."""
    if len(words) < 2:
        return {}
    m = np.sqrt(contexts)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    like = m @ m.T
    np.fill_diagonal(like, -1)
    near = like.argmax(axis=1)
    return {int(words[i]): int(words[j]) for i, j in enumerate(near) if like[i, j] >= likeness}


def fit(
    bags: list[np.ndarray], toxic: np.ndarray, base_rate: float, *, swaps: dict[int, int] | None = None, penalty: float = 4.0, ridge: float = 0.02, least: int = 4, z: float = 4.0, steps: int = 400
) -> Model:
    """Logistic regression on word presence; `penalty` weighs squared score changes between counterfactual twins, made with swaps and the identity terms."""
    toxic = np.asarray(toxic, dtype=np.float64)
    if not len(bags) or toxic.min() == toxic.max():
        rate = float(np.clip(base_rate, 1e-3, 1 - 1e-3))
        return Model(np.empty(0, dtype=np.uint64), np.empty(0), float(np.log(rate / (1 - rate))))
    swap = (swaps or {}) | identity_swaps()
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    vocabulary, column = np.unique(np.concatenate(bags), return_inverse=True)
    positive = np.bincount(column, toxic[rows], len(vocabulary))
    every = np.bincount(column, minlength=len(vocabulary))
    n_pos, n_neg = toxic.sum(), (1 - toxic).sum()
    strength = _gains(positive, every, n_pos / (n_pos + n_neg))
    terms = np.array(sorted(swap), dtype=np.uint64)
    chosen = ((every >= least) & (strength >= z)) | np.isin(vocabulary, terms)
    words = vocabulary[chosen]
    if not len(words):
        return fit([], toxic, base_rate)
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(words))
    x = np.zeros((len(bags), len(words)), dtype=np.float32)
    use = place[column] >= 0
    x[rows[use], place[column[use]]] = 1
    twins = np.flatnonzero(np.array([bool(np.isin(b, terms).any()) for b in bags]))
    other = x[twins].copy()
    for k, t in enumerate(twins):
        mine = [int(w) for w in bags[t][np.isin(bags[t], terms)]]
        for gone in mine:
            if len(at := np.flatnonzero(words == np.uint64(gone))):
                other[k, at] = 0
        for come in {swap[w] for w in mine}:
            if len(at := np.flatnonzero(words == np.uint64(come))):
                other[k, at] = 1
    change = x[twins] - other
    hold = np.where(np.isin(words, np.array(sorted(swaps or {}), dtype=np.uint64)), NEUTRAL_RIDGE, 1.0)  # learned words say nothing by themselves
    weight = np.where(toxic == 1, 0.5 / n_pos, 0.5 / n_neg)
    w, b = np.zeros(len(words)), 0.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
        gradient = x.T @ error + ridge * hold * w / len(words)
        if len(twins):
            gradient += 2 * penalty / len(twins) * (change.T @ (change @ w))
        g = np.append(gradient, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    rate = float(np.clip(base_rate, 1e-3, 1 - 1e-3))  # the classes weigh the same above; put their true odds back, by half
    bias = float(b + 0.5 * np.log(rate / (1 - rate)))
    moved = np.abs(1 / (1 + np.exp(-(x[twins] @ w + bias))) - 1 / (1 + np.exp(-(other @ w + bias))))
    return Model(words, w, bias, len(twins), float(moved.mean()) if len(twins) else 0.0)


def sampled_labels(labels: DataFrame, *, id_col: str, label_col: str, per_class: int) -> tuple[list[tuple], float]:
    """At most per_class ids of each class, least hash first, and the share of toxic labels."""
    one = labels.where(f"`{label_col}` in (0, 1) and `{id_col}` is not null").groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    h = F.xxhash64(F.col("id").cast("string"))
    rows = [(r["id"], r["y"]) for y in (0, 1) for r in one.where(F.col("y") == y).orderBy(h, "id").limit(per_class).collect()]
    return rows, counts.get(1, 0) / max(1, sum(counts.values()))


def _contexts(part: DataFrame, words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket of words stands left and right of each word; counted in the engine, at most words x 2 x buckets numbers."""

    def count(batches):
        for b in batches:
            for _, _, row, h in text_words(raw_texts(b.column(0))):
                place = np.searchsorted(words, h)
                place[place == len(words)] = 0
                at = np.flatnonzero(words[place] == h)
                keys = []
                for side, step in ((0, -1), (1, 1)):
                    near = at[(at + step >= 0) & (at + step < len(h))]
                    near = near[row[near + step] == row[near]]
                    keys.append((place[near] * 2 + side) * buckets + (h[near + step] >> np.uint64(32)).astype(np.int64) % buckets)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    out = np.zeros(len(words) * 2 * buckets)
    if len(words):
        got = part.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(words), 2 * buckets)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, **kw) -> Model:
    """Fit on labelled rows only (pass labels without held-out rows); at most 2 * per_class texts reach the driver, as word hashes.

    Of several labels of an id the greatest counts; labels other than 0 and 1, null ids and ids without a
    document teach nothing. Null and empty texts have no words; repeated documents count each time.
    Ties in the sample go by id hash, then id. Without both labels the model is their rate, or 0.05.
    Other columns do not matter.
    """
    chosen, rate = sampled_labels(labels, id_col=id_col, label_col=label_col, per_class=per_class)
    if not chosen:
        return fit([], np.empty(0), 0.05)
    spark = docs.sparkSession
    pick = spark.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())]))
    part = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(pick), "id")  # pick has at most 2 * per_class rows

    def bags(column: pa.Array) -> list[pa.Array]:
        out: list = []
        for _, n, row, h in text_words(raw_texts(column)):
            cut = np.searchsorted(row, np.arange(n + 1))
            out += [np.unique(h[cut[i] : cut[i + 1]]).view(np.int64) for i in range(n)]
        return [pa.array(out, type=pa.list_(pa.int64()))]

    part = staged(part.select("id", "y", "text"), "labelled")
    rows = with_added(part, [T.StructField("bag", T.ArrayType(T.LongType()))], "text", bags).select("id", "y", "bag").toPandas()
    rows = rows.sort_values(["id", "y"], kind="stable").reset_index(drop=True)
    words, toxic = [np.asarray(b, dtype=np.int64).view(np.uint64) for b in rows["bag"]], rows["y"].to_numpy(dtype=np.float64)
    neutral = neutral_words(words, toxic) if len(rows) else np.empty(0, dtype=np.uint64)
    return fit(words, toxic, rate, swaps=learned_swaps(neutral, _contexts(part, neutral)), **kw)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs plus the score of the whole text; null and empty texts get that of a text without known words.

    Repeated rows get equal scores, an empty table none; a column named like the new one is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: only words of the bounded sample
    return with_added(docs, [T.StructField(score_col, T.DoubleType())], text_col, lambda c: [pa.array(held.value.scores(raw_texts(c)))])
