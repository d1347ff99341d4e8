"""Quality: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. A line's potentials come from its own features and those of the lines before and after; a
transition matrix ties neighbours. Forward-backward marginals, weighted by the lines' lengths, give the document's
quality. It is trained in numpy on a bounded sample of labelled documents, whose lines take the document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import chunks, crc_mod
from .toxicity import _calibrate, _sigmoid

#: Byte classes whose shares are features of a line.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:", "mark": b"!?",
    "rule": b"|-_=~", "odd": b"#$%&*+@^<>{}[]\\/`", "quote": b"'\"()", "high": bytes(range(128, 256)),
}
_CLASS_OF = np.full(256, len(CLASSES), dtype=np.uint8)
for _i, _b in enumerate(CLASSES.values()):
    _CLASS_OF[list(_b)] = _i
OWN = len(CLASSES) + 6
_RANDOM = np.random.default_rng(0)
_BYTE_KEY = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64)
_PLACE_KEY = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = 3 * OWN + 1


@dataclass
class CrfConfig:
    #: Labelled documents used for training at most: the only sampling of this operator.
    sample: int = 4000
    steps: int = 250
    #: Rounds in which the lines are labelled anew, and the steps of each.
    rounds: int = 2
    round_steps: int = 60
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 5


@dataclass
class Crf:
    weights: np.ndarray  # FEATURES: log odds of good against bad
    moves: np.ndarray  # 2 x 2
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def lines(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, end to end; their lengths in bytes; the number of lines of each text (1 at least)."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1)
    length = ends - starts
    kinds = _CLASS_OF[raw]
    of = np.repeat(np.arange(len(ends)), length + 1)
    width = len(CLASSES) + 1
    counts = np.bincount(of * width + kinds, minlength=len(ends) * width).reshape(-1, width)[:, :-1].astype(np.float64)
    share = counts / np.maximum(length, 1)[:, None]
    n_words, twice = _repeats(raw, kinds, of, len(ends))
    text_ends = np.cumsum([len(t or b"") + 1 for t in texts]) - 1
    per = np.diff(np.append(-1, np.searchsorted(ends, text_ends)))
    own = np.column_stack([share, np.log1p(length) / 5, length / np.maximum(n_words, 1) / 10, (length == 0), np.minimum(share[:, 7] + share[:, 6] + share[:, 5], 0.2) * 5, twice])
    return own, length, per


def _repeats(raw: np.ndarray, kinds: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line, and what share of them equals the word before, and the word before that."""
    inside = (raw != 10) & (kinds != 3)
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if len(start) == 0:
        return np.zeros(n), np.zeros((n, 2))
    place = np.arange(len(raw)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(raw)]])))
    keyed = np.where(inside, _BYTE_KEY[raw] * _PLACE_KEY[np.minimum(place, 63)], np.uint64(0))
    word, line = np.add.reduceat(keyed, start), of[start]
    n_words = np.bincount(line, minlength=n)
    shares = []
    for back in (1, 2):
        same = (word[back:] == word[:-back]) & (line[back:] == line[:-back])
        shares.append(np.bincount(line[back:][same], minlength=n) / np.maximum(n_words - back, 1))
    return n_words, np.column_stack(shares)


def with_neighbours(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Features of every line: its own, those of the line before and after (zero at the ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.cumsum(np.append(0, per[:-1]))
    before[first] = 0
    after[np.cumsum(per) - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))])


def marginals(score: np.ndarray, moves: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and, summed over each text's neighbouring lines, the expected 2 x 2 moves.

    All texts advance together, line by line, the longest texts first; score is the log odds of good.
    """
    order = np.argsort(-per, kind="stable")
    first = np.cumsum(np.append(0, per[:-1]))[order]
    n = per[order]
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    emit = np.column_stack([np.zeros(len(score)), score])
    most = int(n.max(initial=0))
    alive = np.searchsorted(-n, -np.arange(1, most + 1), side="right")  # texts with at least t lines
    alpha[first] = emit[first]
    for t in range(1, most):
        i = first[: alive[t]] + t
        a = alpha[i - 1]
        alpha[i] = emit[i] + np.logaddexp(a[:, :1] + moves[0], a[:, 1:] + moves[1])
    for t in range(most - 1, 0, -1):
        i = first[: alive[t]] + t
        b = beta[i] + emit[i]
        beta[i - 1] = np.column_stack([np.logaddexp(moves[s, 0] + b[:, 0], moves[s, 1] + b[:, 1]) for s in (0, 1)])
    good = _sigmoid((alpha + beta)[:, 1] - (alpha + beta)[:, 0])
    inner = np.ones(len(score), bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    joint = alpha[i - 1][:, :, None] + moves[None] + (beta[i] + emit[i])[:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True)) if len(i) else joint
    joint = joint / joint.sum((1, 2), keepdims=True) if len(i) else joint
    return good, joint.sum(0) if len(i) else np.zeros((2, 2))


def quality(model: Crf, texts: list[bytes | None]) -> np.ndarray:
    """Length-weighted mean of the lines' P(good), as log odds."""
    own, length, per = lines(texts)
    x = (with_neighbours(own, per) - model.centre) / model.scale
    good, _ = marginals(x @ model.weights, model.moves, per)
    doc = np.repeat(np.arange(len(per)), per)
    w = length + 1.0
    p = np.bincount(doc, good * w, len(per)) / np.bincount(doc, w, len(per))
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def scores(model: Crf, texts: list[bytes | None]) -> np.ndarray:
    return _sigmoid(model.slope * quality(model, texts) + model.shift)


def relabelled(own_label: np.ndarray, good: np.ndarray, length: np.ndarray, at: np.ndarray, doubt: float = 0.1) -> np.ndarray:
    """Labels of lines: their document's, but for those of which the model is surer than 1 - ``doubt`` that they are the other.

    Lines of half a document's length at most change, those that fit its label least, so that a document keeps its label.
    at: the document of each line.
    """
    fits = np.where(own_label > 0, good, 1 - good)
    order = np.lexsort((fits, at))
    size = (length + 1.0)[order]
    total = np.bincount(at, length + 1.0)
    so_far = np.cumsum(size) - (np.cumsum(total) - total)[at[order]]
    change = np.zeros(len(at), bool)
    change[order] = (so_far <= total[at[order]] / 2) & (fits[order] < doubt)
    return np.where(change, 1 - own_label, own_label)


def fit(sample: pd.DataFrame, config: CrfConfig | None = None) -> Crf:
    """Maximum likelihood by Adam steps over the whole sample (text, y). No row or one class: that class's share.

    Labels are of documents; lines begin with their document's and are labelled anew in each of ``rounds`` rounds.
    """
    c = config or CrfConfig()
    model = Crf(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES))
    y = sample["y"].to_numpy(dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model.slope, model.shift = 0.0, float(np.log(share / (1 - share)))
        return model
    rng = np.random.default_rng(c.seed)
    part = rng.permutation(len(y))
    held, train = np.sort(part[: len(y) // 5]), np.sort(part[len(y) // 5 :])
    own, length, per = lines(sample["text"].iloc[train].tolist())
    x = with_neighbours(own, per)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model.centre[-1], model.scale[-1] = 0, 1
    x = (x - model.centre) / model.scale
    own_label = np.repeat(y[train], per)
    gold = own_label.copy()
    # a document counts once, however many lines it has, and both classes count alike
    share = np.clip(y[train].mean(), 0.02, 0.98)
    weight = np.repeat(np.where(y[train] > 0, 0.5 / share, 0.5 / (1 - share)) / per, per) / len(train)
    at = np.repeat(np.arange(len(per)), per)
    pairs = np.flatnonzero(at[1:] == at[:-1]) + 1
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, c.steps + c.rounds * c.round_steps + 1):
        if t > c.steps and (t - c.steps) % c.round_steps == 1 % c.round_steps:
            good, _ = marginals(x @ model.weights, model.moves, per)
            gold = relabelled(own_label, good, length, at)
        same = np.array([[(weight[pairs] * ((gold[pairs - 1] == a) & (gold[pairs] == b))).sum() for b in (0, 1)] for a in (0, 1)]) if t == 1 or t > c.steps else same
        model.weights, model.moves = theta[:FEATURES], np.clip(theta[FEATURES:], -2, 2).reshape(2, 2)
        good, joint = marginals(x @ model.weights, model.moves, per)
        g = np.concatenate([x.T @ ((good - gold) * weight), (joint / max(1, len(pairs)) * same.sum() - same).ravel()]) + c.decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - c.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.moves = theta[:FEATURES], np.clip(theta[FEATURES:], -2, 2).reshape(2, 2)
    if len(held) and 0 < y[held].sum() < len(held):
        model.slope, model.shift = _calibrate(quality(model, sample["text"].iloc[held].tolist()), y[held])
    return model


def score_quality(documents: DataFrame, labels: DataFrame, config: CrfConfig | None = None, fold: int = 3, out_at: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines for every row of documents; predicted is 1 from 0.5 on.

    A null or empty text is one empty line; repeated rows get equal scores; a null id is not held out; other columns
    are ignored; an empty table gives none. Without labelled rows every score is 0.5.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "quality", fold, out_at, (config or CrfConfig()).sample, 13), config))
    rows = documents.select("doc_id", (crc_mod(fold) == out_at).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        m = model.value
        for b in batches:
            s, n = [np.zeros(0)], [np.zeros(0, np.int64)]
            for part in chunks((x.as_py() for x in b.column("text")), 1 << 20):
                s.append(scores(m, part))
                n.append(np.array([(t or b"").count(b"\n") + 1 for t in part], dtype=np.int64))
            s = np.concatenate(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.concatenate(n))], names=["doc_id", "held_out", "score", "predicted", "n_lines"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_lines long")
