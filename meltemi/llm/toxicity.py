"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.llm.frames import bounded_broadcast, first_by_hash, map_columns

BITS = 17
ORDERS = (4, 5, 6)
BLANK = np.uint32(32)


@dataclass(frozen=True)
class Settings:
    """The bounded sample that the model is fitted on, and how. At most ``positives + negatives`` texts of at most ``most_bytes`` each reach the driver.

    A bucket weighs by how many standard errors beyond ``errors`` its share of toxic texts stands off its share of others; ``still`` is the weight of a
    zero vector that joins every average, so that little evidence moves a text little.
    """

    positives: int = 1500
    negatives: int = 2500
    most_bytes: int = 8_192
    width: int = 8
    epochs: int = 16
    least_steps: int = 400
    batch: int = 128
    rate: float = 0.05
    seen_in: int = 2
    errors: float = 4.0
    still: float = 5.0
    decay: float = 1e-4
    seed: int = 7


@lru_cache(maxsize=1)
def _word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class Subwords:
    """Subwords of a block of texts.

    Words are runs of letters and digits, lower case, between blanks; subwords are their n-grams, the blanks at both ends included. Every word counts
    alike: its subwords share it.
    """

    def __init__(self, texts: pa.Array) -> None:
        parts = [" " + (t or "").lower() + " " for t in texts.to_pylist()]
        self.n_texts = len(parts)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        letter = _word_letters()[points]
        # A blank is kept where a word follows it; words then stand as blank, letters, blank ...
        keep = letter.copy()
        keep[:-1] |= letter[1:]
        kept = np.flatnonzero(keep)
        points, letter = points[kept], letter[kept]
        self.starts = np.flatnonzero(~letter)
        n = len(points)
        self.points = np.where(letter, points, BLANK)
        self.letters = np.diff(np.append(self.starts, n)) - 1
        self.owner = np.searchsorted(ends, kept[self.starts], side="right")
        self.per_word = sum(np.maximum(self.letters + 3 - order, 0) for order in ORDERS)

    def weights(self) -> np.ndarray:
        """Of a word's subwords: 1 / subwords of the word."""
        return 1.0 / np.maximum(self.per_word, 1)

    def grams(self):
        """Per order: the bucket of the n-gram that starts at each place, and whether it stays in its word."""
        n = len(self.points)
        padded = np.append(self.points, np.full(max(ORDERS), BLANK))
        ahead = np.repeat(self.starts + self.letters + 2, self.letters + 1) - np.arange(n)
        h = np.full(n, 0x9E3779B1, np.uint32)
        for k in range(max(ORDERS)):
            h = (h ^ padded[k : k + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            if k + 1 in ORDERS:
                yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS), ahead >= k + 1


def _bags(texts: pa.Array) -> list[list]:
    """Per text its distinct buckets and their summed weights."""
    s = Subwords(texts)
    word = np.repeat(np.arange(len(s.starts)), s.letters + 1)
    buckets, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bucket, inside in s.grams():
        buckets.append(bucket[inside].astype(np.int64))
        words.append(word[inside])
    bucket, of = np.concatenate(buckets), np.concatenate(words)
    key, inverse = np.unique(s.owner[of] << BITS | bucket, return_inverse=True)
    total = np.bincount(inverse, weights=s.weights()[of], minlength=len(key)).astype(np.float32)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    ids = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [[ids[a:b] for a, b in zip(cut, cut[1:])], [total[a:b] for a, b in zip(cut, cut[1:])]]


@dataclass(frozen=True)
class Model:
    """Per bucket what its embedding adds to the log odds of label 1, times its weight, and the weight; the bias; the weight of the zero vector.

    A text's score is the logistic of its weighted average plus the bias.
    """

    odds: np.ndarray
    weight: np.ndarray
    bias: float
    still: float = 1.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        s = Subwords(texts)
        if not len(s.starts):
            return np.full(len(texts), self.bias)
        odds, weight = np.zeros((2, len(s.points)), np.float32)
        for bucket, inside in s.grams():
            odds += np.where(inside, self.odds[bucket], np.float32(0))
            weight += np.where(inside, self.weight[bucket], np.float32(0))
        top, below = (np.bincount(s.owner, weights=np.add.reduceat(x, s.starts) * s.weights(), minlength=len(texts)) for x in (odds, weight))
        return top / (below + self.still) + self.bias


def telling(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, s: Settings) -> np.ndarray:
    """The weight of every bucket; 0 where chance could explain how it is shared between the classes, or in fewer than ``seen_in`` texts."""
    with_label = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[b for (b, _), k in zip(bags, y) if k == c]]), minlength=1 << BITS) for c in (0, 1)]
    n = [max(int((y == c).sum()), 1) for c in (0, 1)]
    share = (with_label[0] + with_label[1] + 1) / (len(y) + 2)
    error = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    off = np.abs(with_label[1] / n[1] - with_label[0] / n[0]) / error
    return np.where(with_label[0] + with_label[1] >= s.seen_in, np.maximum(off - s.errors, 0), 0).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings, prior: float) -> Model:
    """Embeddings and softmax by Adam on mini-batches. ``prior`` is the log odds of label 1 over all labelled rows, for the bias.

    A text's vector is the average of its subwords' by weight. Buckets without weight take no part.
    """
    y = labels.astype(int)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), prior, s.still)
    rng = np.random.default_rng(s.seed)
    weight = telling(bags, y, s)
    used = np.flatnonzero(weight > 0)
    slot = np.zeros(1 << BITS, np.int32)
    slot[used] = np.arange(len(used))
    bags = [(slot[b[k]], w[k] * weight[b[k]]) for b, w in bags for k in [weight[b] > 0]]
    bags = [(b, w / np.float32(w.sum() + s.still)) for b, w in bags]
    emb = rng.normal(0, 0.05, (len(used), s.width)).astype(np.float32)
    out = rng.normal(0, 0.3, (s.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = (emb, out, bias)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, epochs = 0, max(s.epochs, s.least_steps * s.batch // len(y))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = s.rate * (1 - epoch / epochs)
        for a in range(0, len(y), s.batch):
            rows = order[a : a + s.batch]
            sizes = np.array([len(bags[i][0]) for i in rows])
            ids = np.concatenate([bags[i][0] for i in rows])
            w = np.concatenate([bags[i][1] for i in rows])
            of = np.repeat(np.arange(len(rows)), sizes)
            h = np.zeros((len(rows), s.width), np.float32)
            filled = np.flatnonzero(sizes)
            if len(filled):
                h[filled] = np.add.reduceat(emb[ids] * w[:, None], (np.cumsum(sizes) - sizes)[filled], axis=0)
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ out.T).T
            g = np.stack([np.bincount(ids, weights=back[k][of] * w, minlength=len(used)) for k in range(s.width)], axis=1).astype(np.float32)
            step += 1
            for param, grad, (m, v) in zip(params, (g, h.T @ p, p.sum(axis=0)), state):
                grad += np.float32(s.decay) * param
                m += np.float32(0.1) * (grad - m)
                v += np.float32(0.01) * (grad * grad - v)
                param -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    odds = np.zeros(1 << BITS, np.float32)
    odds[used] = weight[used] * (emb @ (out[:, 1] - out[:, 0]))
    sampled = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Model(odds, weight, float(bias[1] - bias[0] + prior - sampled), s.still)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows (key, label 0 or 1); rows without a label or text do not count.

    The sample is the rows of each class that come first by a hash of the key. Class shares are counted over all labels.
    """
    named = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    share = {r["_y"]: r["n"] for r in named.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5)))
    short = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & (F.octet_length(text) <= s.most_bytes))
    judged = short.select(key).join(named, key)
    wanted = [first_by_hash(judged.where(F.col("_y") == y), key, n) for y, n in ((1, s.positives), (0, s.negatives))]
    rows = short.join(F.broadcast(wanted[0].unionByName(wanted[1]).distinct()), key).select(text, "_y")
    got = map_columns(rows, "ids array<int>, w array<float>, y int", lambda t, y: [*_bags(t), y], text=text).toArrow()
    bags = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(got.column("ids"), got.column("w"))] if got.num_rows else []
    return train(bags, got.column("y").to_numpy(), s, prior)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (key, extra columns, ``score``, ``predicted``) of every whole text.

    Null, empty and wordless texts, and those without a telling subword, get the score of the bias alone. Texts of any length are averaged whole. Repeated rows come out each.
    """
    shared = bounded_broadcast(docs.sparkSession, model, model.odds.nbytes + model.weight.nbytes, "the toxicity model")
    kept = docs.select(key, text, *[c.alias(n) for n, c in (extra or {}).items()])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text]

    def work(keys: pa.Array, texts: pa.Array, *rest: pa.Array) -> list:
        m = shared.value
        p = 1 / (1 + np.exp(-np.clip(m.logits(texts), -500, 500)))
        return [keys, *rest, p, (p >= 0.5).astype(np.int32)]

    return map_columns(kept, ", ".join([*fields, "score double", "predicted int"]), work, text=text, max_bytes=1 << 20)


def accepted(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, that the model does not call toxic. Rows pass through the scoring map whole; nothing is joined.

    What the bias alone would call toxic stays: a text is rejected for what stands in it, so null, empty and wordless texts are kept.
    """
    carried = {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    rows = score(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *[c.alias(n) for n, c in carried.items()]), model, key="_key", text="_text", extra={n: F.col(n) for n in carried})
    fine = F.col("predicted") == 0
    if model.bias >= 0:
        fine |= F.col("score") <= 1 / (1 + math.exp(-min(model.bias, 500.0)))
    return rows.where(fine).select(*[F.col(n).alias(c) for n, c in zip(carried, docs.columns)])
