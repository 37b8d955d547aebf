"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.llm.frames import bounded_broadcast, map_columns, sliced

#: Name of the language of a text without a letter.
UNDETERMINED = "und"
BITS = 15
ORDERS = (2, 3)
#: Languages of one slice of a model; with the bits it bounds what is collected, broadcast and held at once.
SLICE = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lowered code points of all texts, each led by a blank; where each text starts and all end). Runs of non-letters count as one blank."""
    parts = [" " + (t or "").lower() for t in texts.to_pylist()]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    new = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=new[1:])
    return np.where(letter, points, np.uint32(32))[keep], new[at]


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each point; the last ``order - 1`` points start none."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _grams(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: buckets, and the range of each text among them. An n-gram that runs into the next text is cut out by the range."""
    for order in ORDERS:
        b = _buckets(points, order)
        yield b, np.minimum(np.stack([at[:-1], np.maximum(at[1:] - order + 1, at[:-1])]), len(b))


def counts(labelled: DataFrame, *, lang: str, text: str) -> DataFrame:
    """Rows (lang, bucket, n) over every labelled text: each task adds up its own, Spark adds the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                at = np.flatnonzero(n)
                # Bucket -1 holds the number of texts.
                columns = [pa.array([name] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[name], *n[at].tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

        for batch in batches:
            for part in sliced(batch, text, 4 << 20):
                names = np.array(part.column(lang).to_pylist(), dtype=object)
                points, at = _points(part.column(text))
                grams = list(_grams(points, at))
                for name in sorted(set(names)):
                    mine = np.flatnonzero(names == name)
                    docs[name] = docs.get(name, 0) + len(mine)
                    n = held.setdefault(name, np.zeros(1 << BITS, np.int64))
                    for b, (lo, hi) in grams:
                        n += np.bincount(np.concatenate([b[lo[i] : hi[i]] for i in mine]), minlength=1 << BITS)
                    if len(held) >= SLICE:
                        yield from sums()
                        held.clear()
                        docs.clear()
        yield from sums()

    summed = labelled.select(lang, text).mapInArrow(run, "lang string, bucket int, n long")
    return summed.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, *, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [bucket, language], log priors), add-one smoothed.

    What comes to the driver is one number a language and bucket, whatever the corpus, for ``SLICE`` languages at a time; it keeps 128 KB a language.
    """
    table = counts(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang=lang, text=text).persist()
    try:
        names = sorted(r[0] for r in table.where("bucket = -1").select("lang").collect())
        prior = np.zeros(len(names))
        log_p = np.zeros((1 << BITS, len(names)), np.float32)
        for a in range(0, len(names), SLICE):
            mine = names[a : a + SLICE]
            place = {x: i for i, x in enumerate(mine)}
            rows = table.where(F.col("lang").between(mine[0], mine[-1])).toArrow()
            n = np.zeros((1 << BITS, len(mine)))
            column = np.array([place[x] for x in rows.column("lang").to_pylist()], int)
            bucket, count = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
            whole = bucket < 0
            prior[a + column[whole]] = count[whole]
            n[bucket[~whole], column[~whole]] = count[~whole]
            log_p[:, a : a + len(mine)] = np.log(n + 1) - np.log(n.sum(axis=0) + n.shape[0])
    finally:
        table.unpersist()
    return names, log_p, np.log(prior) - np.log(max(prior.sum(), 1))


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None
) -> DataFrame:
    """Rows (key, extra columns, ``lang_pred``, ``score``) of every whole text.

    ``score`` is the posterior of the language. A null, empty or letterless text, and any text where the
    model has no language, is ``und`` with score 0; equal posteriors go to the first language by name. Repeated rows come out each.
    Any number of languages takes part: ``SLICE`` of them are broadcast as one table, and the slices are looked at one after the other.
    """
    names, log_p, prior = model
    kept = docs.select(key, text, *[c.alias(n) for n, c in (extra or {}).items()])
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    starts = range(0, max(len(names), 1), SLICE)
    for a in starts:
        part = slice(a, a + SLICE)
        shared = bounded_broadcast(docs.sparkSession, (names[part], np.ascontiguousarray(log_p[:, part]), prior[part]), log_p[:, part].nbytes, "a slice of the language model")
        kept = _slice(kept, shared, key, text, types, first=a == 0, last=a == starts[-1])
    return kept


def _slice(kept: DataFrame, shared: Any, key: str, text: str, types: dict[str, str], *, first: bool, last: bool) -> DataFrame:
    """One slice of the languages over every text. Between slices a row carries its best language so far, that one's log odds, and the sum of all odds as multiples of it."""

    def work(keys: pa.Array, texts: pa.Array, *rest: pa.Array) -> list:
        langs, table, odds = shared.value
        rest, before = (rest, None) if first else (rest[:-3], rest[-3:])
        if not langs:
            return [keys, *rest, [UNDETERMINED] * len(keys), [0.0] * len(keys)]
        points, at = _points(texts)
        has = np.add.reduceat(points != 32, at[:-1]) > 0
        total = np.tile(odds, (len(keys), 1))
        for b, (lo, hi) in _grams(points, at):
            if not len(b):
                continue
            run = np.zeros((len(b) + 1, len(langs)))
            np.cumsum(table[b], axis=0, dtype=np.float64, out=run[1:])
            total += run[hi] - run[lo]
        top = total.max(axis=1)
        whole = np.exp(total - top[:, None]).sum(axis=1)
        best = np.array([langs[i] for i in total.argmax(axis=1)], dtype=object)
        if before is not None:
            old, held = (x.to_numpy(zero_copy_only=False) for x in before[1:])
            now = np.maximum(old, top)
            whole = held * np.exp(old - now) + whole * np.exp(top - now)
            best = np.where(top > old, best, np.array(before[0].to_pylist(), dtype=object))
            top = now
        if not last:
            return [keys, texts, *rest, best.tolist(), top, whole]
        return [keys, *rest, [x if h else UNDETERMINED for x, h in zip(best, has)], np.where(has, 1 / whole, 0.0)]

    columns = [f"`{n}` {t}" for n, t in types.items() if n != text or not last]
    columns += ["lang_pred string", "score double"] if last else ["_best string", "_top double", "_whole double"]
    return map_columns(kept, ", ".join(columns), work, text=text, max_bytes=1 << 20)
