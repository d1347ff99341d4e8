"""LM scoring: stupid backoff from trigrams to words, computed relationally from n-gram count tables.

    S(w | u v) = c(u v w) / c(u v)     if another document has u v w
                 a c(v w) / c(v)       else, if another document has v w
                 a^2 c(w) / N          else, if another document has w
                 a^3 / N               else

c counts the n-grams of all documents but the one that is scored (``leave_out``): a model that held the text itself would
find every n-gram of it and never back off. Every word, bigram and trigram of every document is counted; nothing is cut.

Documents are read once, into batches of about ``batch_words`` words: their different words and each text as numbers of
them. A batch asks the count tables for each of its different n-grams once, with the times it has them, so that a hot
n-gram is a row a batch at most. The tables are hash-partitioned: an n-gram's bucket is a range of its hash, trigrams lie
with the bigram they continue, and the number of buckets grows with the corpus so that one holds about ``bucket_grams``.
What other batches counted goes back to the batch, where the terms of each document are summed.

N-grams are known by their hash: 64 bits for words and bigrams, and for a trigram those of its bigram and 32 of its last
word. Among n different bigrams one is taken for another with a probability of n / 2^64, and a trigram for another one with
the same first two words, of which m different words follow, with m / 2^32.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_bytes, word_pieces

_P = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)))
#: Bits of the last word of a trigram, beside the bigram that it continues.
LAST = 32


@dataclass(frozen=True)
class LmConfig:
    backoff: float = 0.4
    #: A document is scored by the counts of all others; False: of all documents, itself included.
    leave_out: bool = True
    batch_words: int = 1 << 20
    bucket_grams: int = 1 << 21


def pack(a: np.ndarray) -> bytes:
    """The numbers byte by byte (all lowest bytes, then the next), compressed; high bytes are mostly zero."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
    return len(a).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def unpack(held: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    if n == 0:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(held[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of the word pairs (a[i], b[i]), given as hashes."""
    x = a * _P[0] + b
    x ^= x >> np.uint64(32)
    x *= _P[1]
    x ^= x >> np.uint64(29)
    x *= _P[2]
    return x ^ (x >> np.uint64(32))


def encoded(documents: DataFrame, batch_words: int) -> DataFrame:
    """(batch, doc_id array, n_words array, words, vocabulary): the texts of a batch end to end as numbers of its different words."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: dict[bytes, int] = {}
        ids, sizes, names, held = [], [], [], 0

        def out(doc_type):
            vocabulary = np.frombuffer(b" ".join(seen), np.uint8)
            words = np.concatenate([*ids, np.zeros(0, np.uint32)])
            columns = [pa.array([uuid.uuid4().hex]), pa.array([names], pa.list_(doc_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(words)], pa.binary()), pa.array([pack(vocabulary)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_id", "n_words", "words", "vocabulary"])

        kept_type = None
        for b in batches:
            kept_type = b.schema.field("doc_id").type
            for t, d in zip(b.column("text"), b.column("doc_id").to_pylist(), strict=True):
                n = 0
                for w in word_pieces(t.as_py()):
                    ids.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.uint32, len(w)))
                    n += len(w)
                names.append(d)
                sizes.append(n)
                held += n
                if held >= batch_words:
                    yield out(kept_type)
                    seen.clear()
                    ids, sizes, names, held = [], [], [], 0
        if names:
            yield out(kept_type)

    return text_bytes(documents, "doc_id").mapInArrow(run, f"batch string, doc_id array<{kind}>, n_words array<long>, words binary, vocabulary binary")


@dataclass
class Grams:
    """Different n-grams of a batch in the order of their hashes, how often each occurs, and which one ends at each place (-1: none)."""

    keys: list[np.ndarray]  # words, bigrams: hash; trigrams: number of the bigram, then LAST bits of the last word
    times: list[np.ndarray]
    at: list[np.ndarray]


def grams(words: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Grams:
    """words: numbers into hashes; first: the place begins a text."""
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    one = rank[words]
    out = Grams([hashes[order]], [np.bincount(one, minlength=len(order))], [one])
    h = hashes[words]
    ends = np.flatnonzero(~first)  # a bigram ends there
    keys, inverse, n = np.unique(pair_hash(h[ends - 1], h[ends]), return_inverse=True, return_counts=True)
    two = np.full(len(words), -1, np.int64)
    two[ends] = inverse
    out.keys.append(keys), out.times.append(n), out.at.append(two)
    ends = ends[two[ends - 1] >= 0] if len(ends) else ends
    last = (h[ends] * _P[3]) >> np.uint64(64 - LAST)
    keys, inverse, n = np.unique((two[ends - 1].astype(np.uint64) << np.uint64(LAST)) | last, return_inverse=True, return_counts=True)
    three = np.full(len(words), -1, np.int64)
    three[ends] = inverse
    out.keys.append(keys), out.times.append(n), out.at.append(three)
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the order of hashes is that of buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, hashes, first of a row of encoded()."""
    words, vocabulary = unpack(row["words"], np.uint32), unpack(row["vocabulary"], np.uint8).tobytes().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    sizes = np.array(row["n_words"], dtype=np.int64)
    first = np.zeros(len(words), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return words, hashes, first


_ASKED = ("ones", "n_ones", "twos", "n_twos", "next", "lasts", "n_threes")


def _ask(table: DataFrame, buckets: int) -> DataFrame:
    """A row for each batch and bucket: the different n-grams, and how often the batch has them."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                g = grams(*_read(row))
                cut = [np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1)) for k in g.keys[:2]]
                prefix = (g.keys[2] >> np.uint64(LAST)).astype(np.int64)
                follow = np.bincount(prefix, minlength=len(g.keys[1]))
                cut.append(np.append(0, np.cumsum(follow))[cut[1]])
                last = g.keys[2] & np.uint64((1 << LAST) - 1)
                n = [x.astype(np.uint32) for x in g.times]
                made: list[list] = [[] for _ in range(len(_ASKED) + 1)]
                for k in np.flatnonzero((np.diff(cut[0]) > 0) | (np.diff(cut[1]) > 0)).tolist():
                    o, t, r = (slice(c[k], c[k + 1]) for c in cut)
                    parts = (_gaps(g.keys[0][o]), n[0][o], _gaps(g.keys[1][t]), n[1][t], follow[t].astype(np.uint32), last[r].astype(np.uint32), n[2][r])
                    for held, value in zip(made, (k, *map(pack, parts)), strict=True):
                        held.append(value)
                columns = [pa.array([row["batch"]] * len(made[0]), pa.string()), pa.array(made[0], pa.int64()), *(pa.array(x, pa.binary()) for x in made[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "bucket", *_ASKED])

    return table.select("batch", "n_words", "words", "vocabulary").mapInArrow(run, "batch string, bucket long, " + ", ".join(f"{x} binary" for x in _ASKED))


def _others(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry how often the others have its key, and the key's number."""
    every, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, weights=n, minlength=len(every)).astype(np.int64)[inverse] - n, inverse


def _count(asked: DataFrame) -> DataFrame:
    """(batch, bucket, ones, twos, threes): how often other batches have the n-grams that were asked for, in their order."""

    def run(table: pa.Table) -> pa.Table:
        names = ("ones", "twos", "threes")
        rows = table.to_pylist()
        key = {x: [np.cumsum(unpack(r[x], np.uint64)) for r in rows] for x in ("ones", "twos")}
        n = {x: [unpack(r[f"n_{x}"], np.uint32).astype(np.int64) for r in rows] for x in names}
        out = {}
        out["ones"], _ = _others(np.concatenate(key["ones"]), np.concatenate(n["ones"]))
        out["twos"], number = _others(np.concatenate(key["twos"]), np.concatenate(n["twos"]))
        follow = np.concatenate([unpack(r["next"], np.uint32) for r in rows])
        last = np.concatenate([unpack(r["lasts"], np.uint32) for r in rows])
        out["threes"], _ = _others(np.repeat(number.astype(np.uint64), follow) << np.uint64(LAST) | last, np.concatenate(n["threes"]))
        cut = {x: np.append(0, np.cumsum([len(a) for a in n[x]])) for x in names}
        packed = [pa.array([pack(out[x][cut[x][i] : cut[x][i + 1]]) for i in range(len(rows))], pa.binary()) for x in names]
        return pa.Table.from_arrays([table["batch"].combine_chunks(), table["bucket"].combine_chunks(), *packed], names=["batch", "bucket", *names])

    return asked.groupBy("bucket").applyInArrow(run, "batch string, bucket long, ones binary, twos binary, threes binary")


def _own(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place how often its document has the n-gram that ends there."""
    some = np.flatnonzero(at >= 0)
    out = np.zeros(len(at), np.int64)
    if len(some):
        _, inverse, n = np.unique(doc[some] * (int(at.max()) + 1) + at[some], return_inverse=True, return_counts=True)
        out[some] = n[inverse]
    return out


def log_scores(g: Grams, counts: list[np.ndarray], sizes: np.ndarray, first: np.ndarray, total: int, c: LmConfig) -> np.ndarray:
    """The sum of ln S over each text. counts: of the n-grams of g, over all documents."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    have = [np.append(k, 0)[a] - (_own(a, doc) if c.leave_out else 0) for k, a in zip(counts, g.at, strict=True)]
    one, two, three = have[0], np.where(g.at[1] >= 0, have[1], 0), np.where(g.at[2] >= 0, have[2], 0)
    n = np.maximum(1, total - (sizes[doc] if c.leave_out else 0))
    back = math.log(c.backoff)
    depth = (g.at[1] >= 0).astype(np.int64) + (g.at[2] >= 0)  # context words
    score = depth * back + np.log(np.maximum(one, 1)) - np.log(n) + np.where(one > 0, 0.0, back)
    before = lambda x: np.maximum(np.append(0, x[:-1]), 1)
    score = np.where(two > 0, (depth - 1) * back + np.log(np.maximum(two, 1)) - np.log(before(one)), score)
    score = np.where(three > 0, np.log(np.maximum(three, 1)) - np.log(before(two)), score)
    return np.bincount(doc, weights=score, minlength=len(sizes)).astype(np.float64)


def score_lm(documents: DataFrame, config: LmConfig | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S over the whole text), mean_log_score (null without words) for every row.

    The first word of a text has no context and the second one word; they are scored by what they have, without a
    backoff factor for it. Null and empty texts have no words and score 0. Repeated rows are documents of their own,
    each counted and scored; null ids stay; other columns are ignored; an empty table gives none. A text is held whole,
    at some 100 bytes a word.
    """
    c = config or LmConfig()
    table = materialize(encoded(documents, c.batch_words), "encoded-texts", compression="zstd")
    total = table.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    found = _count(_ask(table, max(1, -(-total // c.bucket_grams))))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        words, hashes, first = _read(row)
        g, sizes = grams(words, hashes, first), np.array(row["n_words"], dtype=np.int64)
        counts = []
        answers = answers.sort_by("bucket")
        for name, n in zip(("ones", "twos", "threes"), g.times, strict=True):
            others = np.concatenate([*(unpack(x.as_py(), np.int64) for x in answers[name]), np.zeros(0, np.int64)])
            if len(others) != len(n):
                raise RuntimeError(f"{len(others)} counts for {len(n)} n-grams")
            counts.append(others + n)
        score = log_scores(g, counts, sizes, first, total, c)
        mean = pa.array(score / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.Table.from_arrays([texts["doc_id"].combine_chunks().values, pa.array(sizes), pa.array(score), mean], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    both = table.groupBy("batch").cogroup(found.groupBy("batch"))
    return both.applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
