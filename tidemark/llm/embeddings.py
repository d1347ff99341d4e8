"""Embedding near-dedup with an inverted multi-index.

Vectors are cut in halves; each half has a codebook of its own, so that the pairs of codewords form a product grid of
cells. Every vector is stored in its cell, and visits cells in the order of their distance (multi-sequence traversal
over the two sorted lists of codewords) until the number of cells that reached the target recall on a calibration set:
on pairs made at exactly the threshold around its vectors, whether links are drawn or not, and on the links it has.
What it meets there is verified by cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, find, materialize, union


@dataclass
class ImiConfig:
    threshold: float = 0.95
    #: Vectors on which the codebooks are fitted at most.
    sample: int = 20_000
    #: Vectors of the calibration set at most; each is compared with all vectors.
    calibration: int = 256
    target_recall: float = 0.995
    #: Pairs that are made around each vector of the calibration set.
    made: int = 8
    #: Vectors of a cell, about; with it the codebooks grow, up to most_words for each half.
    cell_rows: int = 64
    most_words: int = 1024
    #: Fewest cells that a vector visits; the target decides how many more.
    least_visits: int = 4
    #: Stored vectors that one task verifies at a time; larger cells are dealt over several.
    block: int = 2048
    seed: int = 3


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        for j in np.flatnonzero(n):
            centres[j] = x[near == j].mean(0)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T, 0)


def visits(d1: np.ndarray, d2: np.ndarray, most: int) -> np.ndarray:
    """For each row the ``most`` cells of the least d1[i] + d2[j], nearest first, as i * (columns of d2) + j: multi-sequence traversal.

    Of two sorted lists the pair at places (i, j) comes after the (i + 1) (j + 1) - 1 pairs at or before both, so the pairs
    that can be among the first are a staircase, the same for all rows, which are traversed together.
    """
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    wide = np.minimum(most // np.arange(1, min(most, d1.shape[1]) + 1), d2.shape[1])
    i = np.repeat(np.arange(len(wide)), wide)
    j = np.concatenate([np.arange(w) for w in wide])
    out, step = np.empty((len(d1), most), np.int64), max(1, (1 << 21) // len(i))
    for lo in range(0, len(d1), step):
        part = slice(lo, lo + step)
        sums = s1[part][:, i] + s2[part][:, j]
        first = np.argpartition(sums, most - 1, axis=1)[:, :most]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(sums, first, 1), axis=1, kind="stable"), 1)
        out[part] = np.take_along_axis(o1[part], i[first], 1) * d2.shape[1] + np.take_along_axis(o2[part], j[first], 1)
    return out


@dataclass
class Imi:
    left: np.ndarray
    right: np.ndarray
    n_visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return squared(x[:, :h], self.left), squared(x[:, h:], self.right)

    def cells(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """For each vector the cells that it visits, the first being its own."""
        d1, d2 = self.distances(x)
        most = min(self.n_visits if most is None else most, len(self.left) * len(self.right))
        return visits(d1, d2, most)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; they are scaled by their largest component first, as squares of very small or large ones have no place in a double."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _reach(need: np.ndarray, weight: np.ndarray, share: float) -> int:
    """The least number of cells with which ``share`` of the weight is met."""
    order = np.argsort(need, kind="stable")
    sums = weight[order].cumsum()
    return int(need[order][min(np.searchsorted(sums, share * sums[-1] - 1e-9), len(need) - 1)])


def _need(model: Imi, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each x[i]: how many cells it takes to meet y[i] in its own."""
    cell = model.cells(y, 1)[:, 0]
    d1, d2 = model.distances(x)
    at = np.arange(len(x))
    dist = d1[at, cell // len(model.right)] + d2[at, cell % len(model.right)]
    full = len(model.left) * len(model.right)
    return np.array([min(full, 1 + int((np.add.outer(d1[i], d2[i]) < dist[i]).sum())) for i in at], dtype=np.int64)


def made_visits(model: Imi, x: np.ndarray, config: ImiConfig) -> int:
    """Visits that find the target share of pairs at exactly the threshold, of x and random vectors; either side may find it."""
    rng = np.random.default_rng(config.seed)
    x = np.repeat(x, config.made, axis=0)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-300)
    y = config.threshold * x + np.sqrt(max(0.0, 1 - config.threshold**2)) * off
    return _reach(np.minimum(_need(model, x, y), _need(model, y, x)), np.ones(len(x)), config.target_recall)


def fit(vectors: DataFrame, config: ImiConfig, n: int, dim: int) -> Imi:
    """Codebooks from a bounded sample; the number of visits from pairs made around a calibration set, and from its links with
    all vectors, where each vector of the set weighs the same."""
    c = config
    rng = np.random.default_rng(c.seed)
    drawn = vectors.where(F.size("v") == dim).select("rep", "v").orderBy(F.xxhash64(F.lit(c.seed), "rep"), "rep").limit(c.sample).toPandas()
    x = unit(np.stack(drawn["v"].to_numpy()))
    h = dim // 2
    k = int(np.clip(np.ceil(np.sqrt(n / c.cell_rows)), 1, c.most_words))
    model = Imi(kmeans(x[:, :h], k, rng), kmeans(x[:, h:], k, rng), c.least_visits)
    shown = vectors.sparkSession.sparkContext.broadcast((x[: c.calibration], drawn["rep"].to_numpy()[: c.calibration], model))

    def ranks(batches):
        """For every link of the calibration set: how many cells it takes to meet the other vector."""
        q, ids, m = shown.value
        full = len(m.left) * len(m.right)
        d1, d2 = m.distances(q)
        for b in batches:
            y = unit(_matrix(b.column("v")))
            i, j = np.nonzero(y @ q.T >= c.threshold)
            other = np.asarray(b.column("rep"))[i] != ids[j]
            i, j = i[other], j[other]
            cell = m.cells(y[i], 1)[:, 0] if len(i) else np.zeros(0, np.int64)
            dist = d1[j, cell // len(m.right)] + d2[j, cell % len(m.right)]
            need = [min(full, 1 + int((np.add.outer(d1[a], d2[a]) < d).sum())) for a, d in zip(j, dist, strict=True)]
            # at most as many rows as vectors of the set and cells
            took, times = np.unique(np.array([j, need], dtype=np.int64).reshape(2, -1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(took[0]), pa.array(took[1]), pa.array(times)], names=["asks", "need", "n"])

    need = vectors.where(F.size("v") == dim).select("rep", "v").mapInArrow(ranks, "asks long, need long, n long").groupBy("asks", "need").agg(F.sum("n").alias("n")).toPandas()
    model.n_visits = max(c.least_visits, made_visits(model, x[: c.calibration], c))
    if len(need):
        weight = need["n"] / need.groupby("asks")["n"].transform("sum")
        model.n_visits = max(model.n_visits, _reach(need["need"].to_numpy(), weight.to_numpy(), c.target_recall))
    return model


def _verify(stored: tuple, asking: tuple, cell: int, visited: np.ndarray, threshold: float):
    """Links of one unit: gains of n_links by vector and a spanning forest of the links, never more than vectors.

    Each pair is looked at in the cell of either vector that the other visits; a pair that is looked at in both counts
    in the smaller cell only.
    """
    ids, x, weight, _ = stored
    q_ids, q, q_weight, q_cell = asking
    every, pos = np.unique(np.concatenate([ids, q_ids]), return_inverse=True)
    s_at, q_at = pos[: len(ids)], pos[len(ids) :]
    parent, gain = np.arange(len(every)), np.zeros(len(every), dtype=np.int64)
    for lo in range(0, len(q_ids), 512):
        near = q[lo : lo + 512] @ x.T >= threshold
        i, j = np.nonzero(near)
        i += lo
        both = (visited[j] == q_cell[i][:, None]).any(1)
        own = q_cell[i] == cell
        once = np.where(own, q_ids[i] < ids[j], ~both | (cell < q_cell[i])) & (q_ids[i] != ids[j])
        i, j = i[once], j[once]
        np.add.at(gain, q_at[i], weight[j])
        np.add.at(gain, s_at[j], q_weight[i])
        union(parent, q_at[i], s_at[j])
    root = find(parent, np.arange(len(every)))
    used = np.flatnonzero((gain > 0) | (root != np.arange(len(every))))
    return every[used], gain[used], every[root[used]]


def embedding_groups(embeddings: DataFrame, config: ImiConfig | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding).

    Links are pairs with cosine >= threshold in double precision. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, as do vectors of different lengths with each other. Equal vectors form one
    class: compared once, counted each. Rows with a null vec_id link with nothing and are not kept out. Other columns
    are ignored; an empty table gives none. Cells, classes and links stay distributed; a hot vector is one class, a
    large cell is dealt over tasks, and a unit hands on no more rows than it has vectors.
    """
    c = config or ImiConfig()
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    # single precision is shipped as it is; cosines are taken in double
    vector = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector).alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    alone = rows.where(~F.col("sound")).select(F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where("sound").select("vec_id", "v")
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vector-classes")
    dims = _dims(classes)
    found = None
    for dim, n in dims:
        part = _links(classes, fit(classes, c, n, dim), dim, c)
        found = part if found is None else found.unionByName(part)
    if found is None:
        out = alone
    else:
        found = materialize(found, "vector-links")
        labels = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        gains = found.groupBy(F.col("id").alias("g_id")).agg(F.sum("gain").alias("gain"))
        named = classes.join(gains, F.col("rep") == F.col("g_id"), "left").join(labels.withColumnRenamed("id", "l_id"), F.col("rep") == F.col("l_id"), "left")
        named = named.select(F.col("v").alias("key"), (F.coalesce("gain", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
        out = good.join(named, F.col("v") == F.col("key")).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("vec_id").cast(kind), F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _dims(classes: DataFrame) -> list[tuple[int, int]]:
    """Lengths of vectors that occur and how many there are: one index each. Tables have one, or a few by mistake."""
    return [(r["dim"], r["n"]) for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").toLocalIterator()]


def _links(classes: DataFrame, model: Imi, dim: int, c: ImiConfig) -> DataFrame:
    """(id, gain, root): what a unit adds to a class's links, and a link that spans its component in the unit."""
    sc = classes.sparkSession.sparkContext
    shown = sc.broadcast(model)
    rows = classes.where(F.size("v") == dim).select("rep", "m", F.col("v").alias("v"))

    def place(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                cells = shown.value.cells(unit(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("m"), part.column("v"), pa.array(list(cells), pa.list_(pa.int64()))], names=["rep", "m", "v", "visits"])

    placed = materialize(rows.mapInArrow(place, f"rep long, m long, v {classes.schema['v'].dataType.simpleString()}, visits array<long>"), "placed-vectors")
    home = F.element_at("visits", 1)
    sizes = placed.groupBy(home.alias("cell")).agg(F.ceil(F.count("*") / c.block).cast("int").alias("blocks"))
    stored = placed.select(home.alias("cell"), "rep", "m", "v", "visits").join(sizes, "cell")
    stored = stored.select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("stored"), "rep", "m", "v", "visits")
    # cells without a stored vector need no visit; every block of the others gets its own
    asking = placed.select(F.explode("visits").alias("cell"), "rep", "m", "v", home.alias("home")).join(sizes, "cell")
    asking = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("stored"), "rep", "m", "v", F.array("home").alias("visits"))
    units = stored.unionByName(asking).repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("stored").desc())

    def verify(batches):
        held, asked, key, out = None, [], None, []

        def flush():
            nonlocal asked
            if held is not None and asked:
                q = tuple(np.concatenate(x) for x in zip(*asked, strict=True))
                out.append(_verify(held[:4], q, key[0], held[4], c.threshold))
            asked = []

        for b in batches:
            k = np.column_stack([np.asarray(b.column(x)).astype(np.int64) for x in ("cell", "block", "stored")])
            rep, m, v = np.asarray(b.column("rep")), np.asarray(b.column("m")), unit(_matrix(b.column("v")))
            cut = np.append(np.append(0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)) if len(k) else np.zeros(1, int)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                visits_of = _matrix(b.column("visits").slice(lo, hi - lo)).astype(np.int64)
                if (k[lo, 0], k[lo, 1]) != key:
                    flush()
                    held, key = None, (int(k[lo, 0]), int(k[lo, 1]))
                if k[lo, 2]:
                    mine = (rep[lo:hi], v[lo:hi], m[lo:hi], None, visits_of)
                    held = mine if held is None else tuple(None if x is None else np.concatenate([x, y]) for x, y in zip(held, mine, strict=True))
                else:
                    asked.append((rep[lo:hi], v[lo:hi], m[lo:hi], visits_of[:, 0]))
                    if sum(len(x[0]) for x in asked) >= 4096:
                        flush()
            if sum(len(x[0]) for x in out) > 4096:
                yield _batch(out)
                out.clear()
        flush()
        yield _batch(out)

    return units.mapInArrow(verify, "id long, gain long, root long")


def _batch(out: list) -> pa.RecordBatch:
    empty = np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*(x[i] for x in out), empty]).astype(np.int64)) for i in range(3)], names=["id", "gain", "root"])
