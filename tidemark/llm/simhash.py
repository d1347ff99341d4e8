"""SimHash near-dedup with a Gray-order hierarchical index.

The distinct fingerprints are sorted by Gray rank over the cluster and cut into blocks of neighbours. Fingerprints that are
neighbours in this order share most bits, so each node of the tree factors out what all its fingerprints share: a node
keeps only the bits that they share and its parent's don't, and a query carries its differences down and adds to them.
As soon as they exceed the bound the whole group is left. The upper nodes, over the roots of the blocks, are broadcast;
they send each fingerprint to the blocks that may hold a near one, where the block's own tree is searched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordHashes, connected_components, discard, find, materialize, shingle_hashes, shuffles_freed, sifted, tokens, union

#: Children of a node.
FAN = 8
#: Fingerprints of a block, and the most blocks that there are: of more than BLOCK * MOST_BLOCKS fingerprints blocks grow.
BLOCK = 1 << 14
MOST_BLOCKS = 1 << 20

def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    w = tokens(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _gray_order(fp: Column) -> Column:
    """Longs in the order of the Gray ranks of fp: the rank's sign bit is turned, as Spark sorts longs by sign."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


@dataclass
class Tree:
    """Levels from the root's children down to the leaves: of every node the bits that it adds to its parent's, and their pattern."""

    bits: list[np.ndarray]
    pattern: list[np.ndarray]


def tree(ones: np.ndarray, zeros: np.ndarray) -> Tree:
    """Over leaves in Gray order: bits that are one, and zero, in all fingerprints of a leaf."""
    levels = [(ones, zeros)]
    while len(levels[-1][0]) > FAN:
        at = np.arange(0, len(levels[-1][0]), FAN)
        levels.append(tuple(np.bitwise_and.reduceat(x, at) for x in levels[-1]))
    out, above = Tree([], []), None
    for one, zero in reversed(levels):
        shared = one | zero
        out.bits.append(shared if above is None else shared & ~above[np.arange(len(one)) // FAN])
        out.pattern.append(one)
        above = shared
    return out


def search(index: Tree, queries: np.ndarray, most: int, step: int = 512):
    """Yields (query numbers, leaf numbers) of the leaves that differ in at most ``most`` of the bits that they share."""
    for lo in range(0, len(queries), step):
        q = np.repeat(np.arange(lo, min(lo + step, len(queries))), len(index.bits[0]))
        node = np.tile(np.arange(len(index.bits[0])), len(q) // max(1, len(index.bits[0])))
        apart = np.zeros(len(q), dtype=np.uint8)
        for depth, (bits, pattern) in enumerate(zip(index.bits, index.pattern, strict=True)):
            if depth:  # the children of the nodes that are left
                q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(bits)
                q, node, apart = q[there], node[there], apart[there]
            apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & bits[node])
            near = apart <= most
            q, node, apart = q[near], node[near], apart[near]
        yield q, node


def _blocks(distinct: DataFrame, block: int) -> DataFrame:
    """(block, fps, ones, zeros): neighbours in Gray order, numbered in that order, and the bits that they share."""

    def cut(batches):
        held = np.zeros(0, np.uint64)
        for b in batches:
            held = np.append(held, b.column("fp").to_numpy().view(np.uint64))
            whole = len(held) // block * block
            yield from map(out, held[:whole].reshape(-1, block))
            held = held[whole:]
        if len(held):
            yield out(held)

    def out(fps):
        one = lambda x: pa.array(np.array([x]).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([fps.tobytes()]), one(np.bitwise_and.reduce(fps)), one(np.bitwise_and.reduce(~fps))], names=["fps", "ones", "zeros"])

    ranked = distinct.select("fp", _gray_order(F.col("fp")).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank")
    made = ranked.select("fp").mapInArrow(cut, "fps binary, ones long, zeros long")
    return made.withColumn("block", F.monotonically_increasing_id())


def _forest(a: np.ndarray, b: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a[i] - b[j]: never more links than fingerprints. a and b may be the same."""
    every, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(every))
    for i, j in pairs:
        union(parent, number[i], number[len(a) + j])
    root = find(parent, np.arange(len(every)))
    tail = np.flatnonzero(root != np.arange(len(every)))
    return every[tail], every[root[tail]]


def link_edges(distinct: DataFrame, most: int = 2, block: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp long) that span all groups of fingerprints within ``most`` bits.

    Every fingerprint is looked for in its own block and in the later ones that the upper nodes don't rule out, so that a
    pair meets once. The upper nodes are built from one root a block, MOST_BLOCKS at most (16 bytes each), which pass
    through the driver; no fingerprint does. A block is searched by one task, from one other block at a time.
    """
    spark = distinct.sparkSession
    blocks = materialize(_blocks(distinct, block or max(BLOCK, -(-distinct.count() // MOST_BLOCKS))), "gray-blocks")
    roots = blocks.select("block", "ones", "zeros").toPandas().sort_values("block")
    if roots.empty:
        return spark.createDataFrame([], "a long, b long")
    number = roots["block"].to_numpy()
    upper = spark.sparkContext.broadcast((number, tree(*(roots[c].to_numpy().view(np.uint64) for c in ("ones", "zeros")))))

    def ask(batches):
        """For each block that may hold near ones of this block's: those fingerprints of this one. from is null for a block itself."""
        blocks, index = upper.value
        for b in batches:
            for me, held in zip(b.column("block").to_pylist(), b.column("fps"), strict=True):
                fps = np.frombuffer(held.as_py(), np.uint64)
                rows = [(me, None, fps.tobytes())]
                found = [(q[later], t[later]) for q, t in search(index, fps, most, 512) for later in [blocks[t] > me]]
                q, t = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(t, kind="stable")
                at, first = np.unique(t[order], return_index=True)
                rows += [(int(blocks[k]), me, fps[part].tobytes()) for k, part in zip(at, np.split(q[order], first[1:]), strict=False)]  # none: no block
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "asks", "fps"])

    asked = blocks.select("block", "fps").mapInArrow(ask, "block long, asks long, fps binary")
    # a block comes first, then those that ask
    asked = asked.repartition("block").sortWithinPartitions("block", F.col("asks").asc_nulls_first())

    def meet(batches):
        stored = index = None
        for b in batches:
            for asks, held in zip(b.column("asks").to_pylist(), b.column("fps"), strict=True):
                fps = np.frombuffer(held.as_py(), np.uint64)
                if asks is None:
                    stored, index = fps, tree(fps, ~fps)
                x, y = _forest(fps, stored, search(index, fps, most))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return asked.select("block", "asks", "fps").mapInArrow(meet, "a long, b long")


def _labelled(documents: DataFrame, most: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (key, component_id) of every fingerprint."""
    fps = materialize(fingerprints(documents, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = connected_components(link_edges(distinct.select("fp"), most))
    named = distinct.join(linked, distinct.fp == linked.id, "left").select("fp", "first_id", F.coalesce("component_id", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return fps, named.join(least, "label").select(F.col("fp").alias("key"), "component_id")


def simhash_groups(documents: DataFrame, most: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of ``most`` bits or fewer).

    Texts of no words have fingerprint zero, which links like any other; nulls count as empty. Repeated rows are kept
    and share a component; a null doc_id stays and is never the smallest of a component unless it has only nulls.
    Other columns are ignored; an empty table gives none.
    """
    fps, named = _labelled(documents, most, width)
    out = fps.join(named, fps.fp == named.key)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearConfig:
    """Near-duplicates by words: Jaccard similarity of the sets of ``width``-word shingles."""

    width: int = 5
    similarity: float = 0.8
    #: Fingerprints of 32 bits a text, 32 at most; the bits in which two may differ to make their texts candidates.
    sketches: int = 24
    most: int = 2
    #: Deviations by which the distance of all bits of a candidate of the sketches may exceed what the similarity lets expect.
    slack: float = 4.0
    #: Different texts, at most about, in which common shingles are counted, and how many of them are known as common. They only order shingles.
    sample: int = 50_000
    common: int = 1 << 18


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The different shingles' hashes, ascending; fewer words: the whole sequence; none: none."""
    w = tokens(text)
    h = np.fromiter((hashes[x] for x in w), np.uint64, len(w))
    return np.unique(shingle_hashes(h, min(width, len(w)))) if len(w) else h


def signature(shingles: np.ndarray, sketches: int) -> np.ndarray:
    """SimHash of 32 bits a sketch, two sketches a number, over a set of shingles; no shingles: zeros."""
    n = sketches // 2
    total = np.zeros(64 * n, dtype=np.int64)
    salt = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(shingles), 4096):
        x = shingles[lo : lo + 4096, None] ^ salt
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(shingles), bitorder="little").view(np.uint64)


def _code(t: int) -> int:
    """The t-th of 32 words of 32 bits that differ in 16 bits from each other, so that fingerprints of different sketches never link."""
    return sum((t & j).bit_count() % 2 << j for j in range(32))


def _bits_apart(similarity: float, bits: int, slack: float) -> int:
    """The most bits in which signatures of texts of the similarity differ, but for chance beyond ``slack`` deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + slack * np.sqrt(bits * p * (1 - p))))


def _common_shingles(held: DataFrame, c: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and in how many; drawn by the texts' hashes, so that reruns agree.

    They order the shingles of every text, and any one order of all shingles finds the same links: the sample decides how
    many candidates there are, never which links.
    """
    every = -(-held.count() // c.sample) or 1
    drawn = held.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).dropDuplicates(["text_md5"]).select("text")

    def hashes_of(batches):
        hashes = WordHashes()
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), c.width, hashes).view(np.int64))], names=["shingle"])

    counts = drawn.mapInArrow(hashes_of, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # hashes are even, so the most common of each class of them are about the most common of all: no task or driver merges all classes
    classes = min(1024, c.common)
    first = Window.partitionBy(F.pmod("shingle", F.lit(classes))).orderBy(F.desc("n"), "shingle")
    top = counts.withColumn("at", F.row_number().over(first)).where(F.col("at") <= c.common // classes)
    # Arrow, as rows of Python objects take many times the 16 bytes of each
    top = top.select("shingle", "n").toArrow()
    known, often = (top.column(x).to_numpy() for x in ("shingle", "n"))
    known = known.view(np.uint64)
    order = np.argsort(known)
    return known[order], often[order]


def rare_prefix(shingles: np.ndarray, known: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the shingles, uncommon ones first, that two sets of the similarity share one of them. An empty set has the shingle 0."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)
    count = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        count = np.where(known[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, count))][: n - int(np.ceil(similarity * n - 1e-6)) + 1]


def _may_share(similarity: float, x: str, y: str) -> Column:
    """Whether the texts of x and y (columns n_x, at_x, ...) can be of the similarity if no shingle before the places at_x and at_y is in both.

    They share at most n_x - at_x and n_y - at_y shingles, and must share similarity / (1 + similarity) of n_x + n_y.
    """
    return (_left(similarity, f"n_{x}", f"at_{x}") >= _asks(similarity, f"n_{y}")) & (_left(similarity, f"n_{y}", f"at_{y}") >= _asks(similarity, f"n_{x}"))


def _left(similarity: float, n: str, at: str) -> Column:
    """What a text can share beyond what its own length asks for: at least as much as the other's length asks for, or they aren't alike."""
    return F.col(n) / (1 + similarity) - F.col(at) + 1e-6


def _asks(similarity: float, n: str) -> Column:
    return F.col(n) * (similarity / (1 + similarity))


def _shared(rows: DataFrame, similarity: float) -> DataFrame:
    """Of (shingle, class, label, n, at) the rows whose shingle is in texts of several groups, and that lengths and positions let meet one of them."""
    w = Window.partitionBy("shingle")
    mixed = F.col("lo") != F.col("hi")
    over = {"lo": F.min("label").over(w), "hi": F.max("label").over(w)}
    meets = (_left(similarity, "n", "at") >= F.col("asks")) & (_asks(similarity, "n") <= F.col("left"))
    rows = rows.withColumns(over | {"asks": F.min(_asks(similarity, "n")).over(w), "left": F.max(_left(similarity, "n", "at")).over(w)}).where(mixed & meets)
    return rows.withColumns(over).where(mixed).select("shingle", "class", "label", "n", "at")


def _uncommon_rows(classes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(shingle, class, label, n, at) of the uncommon shingles that different groups share. labels (id, component_id) are the groups so far."""
    named = classes.select("class", F.col("n").cast("int").alias("n"), "rare").join(labels, F.col("class") == F.col("id"), "left")
    return _shared(named.select(F.posexplode("rare").alias("at", "shingle"), "class", "n", F.coalesce("component_id", "class").alias("label")), similarity)


def _relabelled(rows: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """The rows that are left when groups have grown to the labels (id, component_id)."""
    named = rows.drop("label").join(labels, F.col("class") == F.col("id"), "left")
    return _shared(named.select("shingle", "class", F.coalesce("component_id", "class").alias("label"), "n", "at"), similarity)


def _hub_candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes of different groups: each text of a shingle with that one of its texts that has fewest shingles before it.

    A star for each shingle, so never more pairs than rows. That text has least of its own, so the others are likeliest to be near it.
    """
    hub = F.struct((F.col("at") / F.greatest("n", F.lit(1))).alias("before"), F.col("class").alias("class_b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    hubs = rows.groupBy("shingle").agg(F.min(hub).alias("hub")).select("shingle", "hub.*").drop("before")
    side = rows.select("shingle", *(F.col(k).alias(f"{k}_a") for k in ("class", "label", "n", "at")))
    met = side.join(hubs, "shingle").where((F.col("label_a") != F.col("label_b")) & _may_share(similarity, "a", "b"))
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _other_candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes of different groups, every pair of the similarity among them: prefix filter, then lengths and positions.

    Texts of one group never meet: a shingle's groups meet if the best of their texts may, then the texts of two groups, so that a
    large group makes pairs only with texts that may join it.
    """
    groups = rows.groupBy("shingle", "label").agg(F.max(_left(similarity, "n", "at")).alias("left"), F.min(_asks(similarity, "n")).alias("asks"))
    group = lambda x: groups.select("shingle", *(F.col(k).alias(f"{k}_{x}") for k in ("label", "left", "asks")))
    side = lambda x: rows.select("shingle", *(F.col(k).alias(f"{k}_{x}") for k in ("label", "class", "n", "at")))
    may = (F.col("label_a") < F.col("label_b")) & (F.col("left_a") >= F.col("asks_b")) & (F.col("left_b") >= F.col("asks_a"))
    two = group("a").join(group("b"), "shingle").where(may)
    some = (_left(similarity, "n_a", "at_a") >= F.col("asks_b")) & (_asks(similarity, "n_a") <= F.col("left_b"))
    met = two.join(side("a"), ["shingle", "label_a"]).where(some).join(side("b"), ["shingle", "label_b"]).where(_may_share(similarity, "a", "b"))
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _alike_so_far(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can be of the similarity by how many of their uncommon shingles they share, with both texts' MD5.

    All shingles of a text up to its last uncommon one are uncommon. Of two texts take the one whose last comes first: what the other has of
    its uncommon ones is uncommon there too. So they share no more than uncommon ones that both have and the common ones of one of them.
    """
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "asked-classes")
    few = sifted(classes, "class", ends, "class")
    side = lambda x: few.select(F.col("class").alias(x), F.col("text_md5").alias(f"md5_{x}"), F.col("n").alias(f"n_{x}"), F.col("rare").alias(f"r_{x}"))
    most = F.size(F.array_intersect("r_a", "r_b")) + F.greatest(*(F.col(f"n_{x}") - F.size(f"r_{x}") for x in "ab"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(most * F.lit(1 + similarity) + 1e-6 >= (F.col("n_a") + F.col("n_b")) * F.lit(similarity)).select("a", "b", "md5_a", "md5_b")


def _near_links(documents: DataFrame, c: NearConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classes, links of the sketches' candidates, the groups that these make (id, component_id), and links between these groups."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    held = documents.select(text.alias("text"), F.md5(text).alias("text_md5"), F.col("doc_id").alias("doc_id"))
    common = documents.sparkSession.sparkContext.broadcast(_common_shingles(held, c))
    least_similar = c.similarity - 1e-9

    def sign(batches):
        hashes, (known, often) = WordHashes(), common.value
        for b in batches:
            sets = [shingle_set(t.as_py(), c.width, hashes) for t in b.column("text")]
            made = np.array([signature(x, c.sketches) for x in sets], dtype=np.uint64).reshape(-1, c.sketches // 2)
            rare = [rare_prefix(x, known, often, least_similar).view(np.int64) for x in sets]
            longs = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("text_md5"), longs(list(made.view(np.int64))), pa.array([len(x) for x in sets], pa.int64()), longs(rare), b.column("doc_id")], names=["text_md5", "signature", "n", "rare", "doc_id"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    signed = held.mapInArrow(sign, f"text_md5 string, signature array<long>, n long, rare array<long>, doc_id {kind}")
    classes = signed.groupBy("text_md5").agg(F.min("doc_id").alias("first_id"), *(F.first(x).alias(x) for x in ("signature", "n", "rare")))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "text-classes")
    part = lambda t: F.get("signature", t // 2) if t % 2 == 0 else F.shiftrightunsigned(F.get("signature", t // 2), 32)
    code = lambda t: F.lit((_code(t) << 32) - (_code(t) >> 31 << 64))
    sketches = F.array(*(part(t).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(code(t)) for t in range(c.sketches)))
    keys = classes.select("class", F.explode(sketches).alias("key"))
    first = materialize(keys.groupBy("key").agg(F.min("class").alias("rep"), F.count("*").alias("n")), "sketches")
    many = first.where("n > 1").select(F.col("key").alias("k"), "rep")
    star = keys.join(many, F.col("key") == F.col("k")).select(F.col("class").alias("a"), F.col("rep").alias("b"))
    linked = link_edges(first.select(F.col("key").alias("fp")), c.most)
    ends = [first.select(F.col("key").alias(f"k_{x}"), F.col("rep").alias(f"r_{x}")) for x in "ab"]
    linked = linked.join(ends[0], F.col("a") == F.col("k_a")).join(ends[1], F.col("b") == F.col("k_b")).select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
    pairs = star.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: classes.select(F.col("class").alias(f"c_{x}"), F.col("signature").alias(f"s_{x}"))
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(side("a"), F.col("a") == F.col("c_a")).join(side("b"), F.col("b") == F.col("c_b"))
    pairs = materialize(pairs.where(apart <= _bits_apart(c.similarity, 32 * c.sketches, c.slack)).select("a", "b"), "near-candidates")
    discard(first)

    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            made = [shingle_set(t.as_py(), c.width, hashes).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(made, pa.list_(pa.int64()))], names=["class", "shingles"])

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        likely = materialize(_alike_so_far(pairs, classes, least_similar), "likely-pairs")
        ends = F.explode(F.array(*(F.struct(F.col(x).alias("class"), F.col(f"md5_{x}").alias("md5")) for x in "ab")))
        asked = materialize(likely.select(ends.alias("end")).select("end.*").distinct(), "asked-texts")
        # one text of each class that is asked for; the others aren't moved
        texts = sifted(held.select("text", "text_md5"), "text_md5", asked, "md5").join(asked, F.col("text_md5") == F.col("md5"))
        texts = texts.groupBy("text_md5").agg(F.first("class").alias("class"), F.first("text").alias("text"))
        whole = materialize(texts.select("class", "text").mapInArrow(sets, "class long, shingles array<long>"), "shingle-sets")
        side = lambda x: whole.select(F.col("class").alias(f"c_{x}"), F.col("shingles").alias(f"s_{x}"))
        both = F.size(F.array_intersect("s_a", "s_b"))
        alike = F.when(F.size("s_a") + F.size("s_b") == 0, True).otherwise(both >= F.lit(least_similar) * (F.size("s_a") + F.size("s_b") - both))
        met = likely.join(side("a"), F.col("a") == F.col("c_a")).join(side("b"), F.col("b") == F.col("c_b"))
        links = materialize(met.where(alike).select("a", "b"), tag)
        discard(likely, asked, whole)
        return links

    near = verified(pairs, "near-links")
    labels = connected_components(near)
    rows = materialize(_uncommon_rows(classes, labels, least_similar), "shared-shingles")
    # groups grow by links to the hubs first, so that few are left to meet in pairs
    found = verified(materialize(_hub_candidates(rows, least_similar), "hub-candidates"), "hub-links")
    labels = connected_components(_stars(labels).unionByName(found))
    left = materialize(_relabelled(rows, labels, least_similar), "shared-shingles")
    discard(rows)
    rest = verified(materialize(_other_candidates(left, least_similar), "other-candidates"), "other-links")
    discard(left)
    return classes, near.unionByName(found), labels, rest


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias("a"), F.col("component_id").alias("b"))


def near_duplicate_links(documents: DataFrame, config: NearConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(class, text_md5, first_id) of every different text, and (a, b): links between classes that span all groups of at least the similarity.

    Candidates come from the Gray-order index: all sketches are searched at once, each under a code of its own. Texts with
    one fingerprint in common are compared with the first of them, those of linked fingerprints first with first. Pairs
    whose whole signatures are too far apart go; the shingles of the rest are compared. Pairs of equal sketches meet in
    a star, so that a group of any size makes as many pairs as it has texts. What the sketches didn't bring together is found by an
    exact join of the groups so far: two texts of the similarity share one of their uncommon shingles, and those that do and
    are of different groups are compared too, first with one text for each shingle and, as groups have grown, then with each other. So the groups are those of all pairs, in every run; pairs within a group aren't all listed.
    """
    classes, near, _, rest = _near_links(documents, config or NearConfig())
    return classes.select("class", "text_md5", "first_id"), near.unionByName(rest)


def drop_near_duplicates(documents: DataFrame, config: NearConfig | None = None) -> DataFrame:
    """The documents, one row of each group of near-duplicates: the one with the smallest doc_id.

    Groups are what links of near_duplicate_links connect. Of several rows with that id, or of rows without any id where a
    group has no other, the one with the least text stays. Texts without words are alike. Where ids are unique, as they
    should be, texts are not moved but by the one anti join with the ids that go; rows whose id is null or repeated are
    few, and are ranked within their group. Other columns are kept; an empty table gives none.
    """
    with shuffles_freed(documents.sparkSession):
        classes, _, labels, rest = _near_links(documents, config or NearConfig())
        # groups of the sketches as stars, and the links between them
        labels = connected_components(_stars(labels).unionByName(rest))
        named = classes.join(labels, F.col("class") == F.col("id"), "left").select("text_md5", "first_id", F.coalesce("component_id", "class").alias("label"))
        least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        named = materialize(named.join(least, "label").select(F.col("text_md5").alias("key"), "label", "component_id"), "near-groups")
        discard(classes)

    md5 = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(documents.select("doc_id", md5.alias("text_md5")), "text-digests")
    plain = documents.where("doc_id IS NOT NULL")
    gone = rows.join(named, F.col("text_md5") == F.col("key")).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    repeated = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    gone = materialize(gone.join(repeated, F.col("gone") == F.col("again"), "left_anti"), "near-duplicates")
    has_repeated = not repeated.isEmpty()
    if has_repeated:
        plain = plain.join(repeated, plain.doc_id == repeated.again, "left_anti")
    kept = plain.join(gone, plain.doc_id == gone.gone, "left_anti").select(*documents.columns)
    if not has_repeated and rows.where("doc_id IS NULL").isEmpty():
        return kept
    odd = documents.where("doc_id IS NULL").unionByName(documents.join(repeated, documents.doc_id == repeated.again, "left_semi"))
    odd = odd.select(F.struct(*documents.columns).alias("doc"), F.col("doc_id").alias("id"), md5.alias("text_md5"))
    odd = odd.join(named, F.col("text_md5") == F.col("key")).where(F.col("id").eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("label").orderBy("text_md5")
    odd = odd.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("doc.*")
    return kept.unionByName(odd)
