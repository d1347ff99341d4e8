"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hashed parts (the word, its first 3 to 5 letters, its last 3), so
inflected and compound forms share what they have in common. Filters of widths 1, 2 and 3 slide over the whole text;
each filter's maximum feeds a logistic output. The network is trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import chunks, crc_mod, words

PARTS = 5
#: Bytes of text that are scored at a time, about; a longer text is scored by itself.
CHUNK = 2 << 20


@dataclass
class CnnConfig:
    #: Labelled rows used for training at most: the only sampling of this operator.
    sample: int = 8000
    buckets: int = 1 << 16
    dim: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 6
    #: Small samples are passed over more often, until there were so many steps.
    least_steps: int = 1500
    spread: float = 0.02
    batch: int = 16
    rate: float = 0.05
    seed: int = 7
    #: A language with fewer positive validation rows keeps the threshold 0.5.
    least_positive: int = 5


@dataclass
class Cnn:
    config: CnnConfig
    embed: np.ndarray
    conv: np.ndarray  # dim x (filters of every width and offset)
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray  # intercept of the output, then slope and intercept of the calibration
    thresholds: dict[str, float] = field(default_factory=dict)


def parts(word: bytes, buckets: int) -> list[int]:
    """Buckets of a word's parts; bucket 0 is no part."""
    w = word.decode("utf-8", "replace")
    return [1 + zlib.crc32(p.encode("utf-8", "replace")) % (buckets - 1) for p in (w, f"<{w[:3]}", f"<{w[:4]}", f"<{w[:5]}", f"{w[-3:]}>")]


def encode(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts of the distinct words, row 0 being padding, and each text as word numbers, padded to 3 words at least."""
    seen: dict[bytes, int] = {}
    docs = []
    for t in texts:
        ids = [seen.setdefault(w, len(seen) + 1) for w in words(t)]
        docs.append(np.array(ids + [0] * max(0, 3 - len(ids)), dtype=np.int32))
    table = np.zeros((len(seen) + 1, PARTS), dtype=np.int32)
    if seen:
        table[1:] = np.fromiter((p for w in seen for p in parts(w, buckets)), np.int32, len(seen) * PARTS).reshape(-1, PARTS)
    return table, docs


def _columns(config: CnnConfig) -> list[tuple[int, int, slice]]:
    """(width number, offset, columns of the convolution)"""
    out, at = [], 0
    for i, w in enumerate(config.widths):
        for k in range(w):
            out.append((i, k, slice(at, at + config.filters)))
            at += config.filters
    return out


def _pooled(config: CnnConfig, proj: np.ndarray, idx: np.ndarray, starts: np.ndarray, with_args: bool):
    """Maximum of every filter over each text; texts lie end to end in idx. Positions of the maxima if asked for."""
    n, pooled, args = len(idx), [], []
    ends = np.append(starts[1:], n)
    for i, w in enumerate(config.widths):
        z = None
        for j, k, cols in _columns(config):
            if j == i:
                part = proj[idx[k : n - w + 1 + k], cols]
                z = part if z is None else z + part
        z = np.concatenate([z, np.full((w - 1, config.filters), -np.inf, dtype=z.dtype)]) if w > 1 else z
        for back in range(1, w):  # windows that would run into the next text
            z[ends - back] = -np.inf
        pooled.append(np.maximum.reduceat(z, starts, axis=0))
        if with_args:
            args.append(np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
    return np.concatenate(pooled, axis=1), args


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(model: Cnn, texts: list[bytes | None]) -> np.ndarray:
    """Raw outputs for whole texts; nulls count as empty."""
    c = model.config
    table, docs = encode(texts, c.buckets)
    starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
    proj = model.embed[table].sum(1) @ model.conv
    pooled, _ = _pooled(c, proj, np.concatenate(docs), starts, False)
    return np.maximum(pooled + model.bias, 0) @ model.out + model.shift[0]


def scores(model: Cnn, texts) -> np.ndarray:
    """Calibrated scores, by groups of texts of about CHUNK bytes."""
    raw = [logits(model, part) for part in chunks(texts, CHUNK)]
    return _sigmoid(model.shift[1] * np.concatenate([*raw, np.zeros(0)]).astype(np.float64) + model.shift[2])


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with smoothed targets, found by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The score that separates best by F1, halfway to the next score below."""
    best, at = -1.0, 0.5
    order = np.unique(s)
    for lo, hi in zip(np.append(0.0, order[:-1]), order, strict=True):
        hit = s >= hi
        f1 = 2 * (hit & (y > 0)).sum() / max(1, hit.sum() + y.sum())
        if f1 > best:
            best, at = f1, (lo + hi) / 2
    return float(at)


def fit(sample: pd.DataFrame, config: CnnConfig | None = None) -> Cnn:
    """Trains on four fifths of the sample (text, y, lang) and calibrates on the rest. No row or one class: score 0.5 or that class's share."""
    c = config or CnnConfig()
    rng = np.random.default_rng(c.seed)
    total = sum(w for w in c.widths) * c.filters
    model = Cnn(c, rng.normal(0, c.spread, (c.buckets, c.dim)).astype(np.float32), rng.normal(0, 0.3, (c.dim, total)).astype(np.float32), np.zeros(len(c.widths) * c.filters, np.float32), rng.normal(0, 0.1, len(c.widths) * c.filters).astype(np.float32), np.array([0.0, 1.0, 0.0]))
    model.embed[0] = 0
    y = sample["y"].to_numpy(dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model.out[:] = 0
        model.shift[2] = np.log(share / (1 - share))
        return model
    part = rng.permutation(len(y))
    held, train = part[: len(y) // 5], part[len(y) // 5 :]
    table, docs = encode(sample["text"].tolist(), c.buckets)
    share = np.clip(y[train].mean(), 0.02, 0.98)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    e_sq = np.full((c.buckets, 1), 1e-2, np.float32)
    dense = {k: np.full_like(getattr(model, k), 1e-2) for k in ("conv", "bias", "out")}
    shift_sq = 1e-2
    for _ in range(max(c.epochs, -(-c.least_steps * c.batch // max(1, len(train))))):
        rng.shuffle(train)
        for lo in range(0, len(train), c.batch):
            rows = train[lo : lo + c.batch]
            idx = np.concatenate([docs[r] for r in rows])
            starts = np.cumsum([0] + [len(docs[r]) for r in rows[:-1]])
            used, idx = np.unique(idx, return_inverse=True)
            x = model.embed[table[used]].sum(1)
            pooled, args = _pooled(c, x @ model.conv, idx, starts, True)
            act = np.maximum(pooled + model.bias, 0)
            d = (_sigmoid(act @ model.out + model.shift[0]) - y[rows]).astype(np.float32) * weight[rows] / len(rows)
            d_act = np.outer(d, model.out) * (act > 0)
            d_proj = np.zeros((len(used), total), np.float32)
            for i, k, cols in _columns(c):
                f = np.arange(c.filters)
                np.add.at(d_proj, (idx[args[i] + k], cols.start + f[None, :]), d_act[:, i * c.filters : (i + 1) * c.filters])
            grads = {"conv": x.T @ d_proj, "bias": d_act.sum(0), "out": act.T @ d}
            touched = np.flatnonzero(np.abs(d_proj).sum(1))
            d_x = d_proj[touched] @ model.conv.T
            for k, g in grads.items():
                dense[k] += g * g
                v = getattr(model, k)
                v -= c.rate * g / np.sqrt(dense[k])
            shift_sq += float(d.sum()) ** 2
            model.shift[0] -= c.rate * float(d.sum()) / shift_sq**0.5
            cells = table[used[touched]]
            flat, inv = np.unique(cells, return_inverse=True)
            g = np.zeros((len(flat), c.dim), np.float32)
            np.add.at(g, inv.ravel(), np.repeat(d_x, PARTS, axis=0))
            e_sq[flat] += (g * g).mean(1, keepdims=True)
            model.embed[flat] -= c.rate * g / np.sqrt(e_sq[flat])
            model.embed[0] = 0
    texts = sample["text"]
    if len(held) and 0 < y[held].sum() < len(held):
        raw = np.concatenate([logits(model, part) for part in chunks(texts.iloc[held], CHUNK)]).astype(np.float64)
        model.shift[1:] = _calibrate(raw, y[held])
        s, lang = scores(model, texts.iloc[held]), sample["lang"].to_numpy()[held]
        for one in np.unique(lang):
            of = lang == one
            if c.least_positive <= y[held][of].sum() < of.sum():
                model.thresholds[str(one)] = _threshold(s[of], y[held][of])
    return model


def score_toxicity(documents: DataFrame, labels: DataFrame, config: CnnConfig | None = None, fold: int = 5, out_at: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, rejected for every row of documents.

    score is from the text alone; predicted is 1 from 0.5 on. rejected compares the score with the threshold that was
    calibrated for the row's language (0.5 where too few rows of the language are labelled). A null or empty text is
    scored as a text of no words; repeated rows get equal scores; other columns are ignored; an empty table gives none.
    Without labelled rows every score is 0.5. Null ids count as held out.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(labelled_sample(documents, labels, "toxic", fold, out_at, (config or CnnConfig()).sample, 11), config))
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", (crc_mod(fold) == out_at).alias("held_out"), F.coalesce(lang, F.lit("")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        m = model.value
        for b in batches:
            s = scores(m, (x.as_py() for x in b.column("text")))
            cut = np.array([m.thresholds.get(x, 0.5) for x in b.column("lang").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(cut), pa.array(s >= cut)],
                names=["doc_id", "held_out", "score", "predicted", "lang_threshold", "rejected"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, lang_threshold double, rejected boolean")


def drop_toxic(documents: DataFrame, labels: DataFrame, config: CnnConfig | None = None) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns; one pass, no join back.

    Texts, ids and ties as in score_toxicity.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "toxic", 5, 0, (config or CnnConfig()).sample, 11), config))

    def run(batches):
        m = model.value
        for b in batches:
            texts, lang = b.column("text"), b.column("lang").to_pylist() if "lang" in b.schema.names else [""] * b.num_rows
            s = scores(m, (t.as_py() and t.as_py().encode() for t in texts))
            keep = s < np.array([m.thresholds.get(x or "", 0.5) for x in lang], dtype=np.float64)
            yield b.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
