"""Alignment of two tokenizers over the same texts, by an event sweep.

Each text is encoded by both tokenizers. What comes out are events, the ends of tokens: rows of one side's next ids from a byte
offset on, some thousands a row. The events of both sides are united, dealt by document and sorted by offset within a
partition; a task streams through them with a state of bounded size, the ids since the last place where both sides end. It emits groups (what lies
between two such places) and links (pairs of ids whose bytes overlap). Links are counted by document over the corpus, and every
document's links are looked up in those counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import materialize
from .token_files import TOKENIZERS

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Between two units neither tokenizer joins anything: a space with no other blank beside it.
CUT, ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s|\s |^ | $")
#: Different units whose ids a task keeps; ids of an event row; ids that the sweep takes at once; pairs whose counts a task keeps, or that are looked up from memory.
KEPT_UNITS, ROW_IDS, SWEEP_IDS, MOST_PAIRS = 1 << 19, 1 << 12, 1 << 19, 1 << 22


def byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """One tokenizer: the bytes for which each id stands."""

    token_bytes: list[bytes]

    @property
    def lengths(self) -> np.ndarray:
        return np.array(list(map(len, self.token_bytes)), dtype=np.int64)


def byte_level_side(vocabulary: bytes) -> Side:
    """Bytes of the ids of a byte-level vocabulary file; added tokens, which plain text never gives, stand for their own text."""
    found, to = json.loads(vocabulary), byte_of()
    ids = {i: bytes(to[c] for c in token) if all(c in to for c in token) else token.encode() for token, i in found["model"]["vocab"].items()}
    ids |= {x["id"]: x["content"].encode() for x in found.get("added_tokens", [])}
    return Side([ids.get(i, b"") for i in range(max(ids) + 1)])


def piece_side(model) -> Side:
    """Bytes of the ids of a piece model: U+2581 is a space, <0xHH> a byte, control pieces stand for nothing."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return Side(out)


class Encoder:
    """Both tokenizers, by unit: ids are kept for the units that a worker meets again and again, up to a bound."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = _pieces(b)
        self.sides, self.kind = sides(a, b), id_kind(*sides(a, b))
        # a piece that goes on after a space would make units depend on each other
        self.cut = not any("\u2581" in self.b.id_to_piece(i).lstrip("\u2581") for i in range(self.b.get_piece_size()))
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def units(self, text: str, most: int = 1 << 20) -> Iterator[list[str]]:
        """The units of a text, in lists of those in about ``most`` characters each."""
        at = 0
        while self.cut and len(text) - at > most and (cut := CUT.search(text, at + most)):
            yield self._split(text[at : cut.start()])
            at = cut.end()
        if at < len(text):
            yield self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not self.cut:
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def learn(self, units: set[str]) -> None:
        """Encodes units that aren't known: ids of both sides, or None where a side's bytes aren't the text's."""
        new = [u for u in units if u not in self.kept]
        if len(self.kept) + len(new) > KEPT_UNITS:
            self.kept.clear()
            new = list(units)
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1) if new else []
        for u, a, b in zip(new, ids_a, ids_b, strict=True):
            whole = (" " + u).encode("utf-8", "surrogatepass")
            same = all(b"".join(map(s.token_bytes.__getitem__, x)) == whole for s, x in zip(self.sides, (a, b), strict=True))
            self.kept[u] = (np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None

    def found(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        return list(map(self.kept.__getitem__, units))


def _pieces(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(1)
def sides(a: bytes, b: bytes) -> tuple[Side, Side]:
    return byte_level_side(a), piece_side(_pieces(b))


@lru_cache(1)
def encoder(a: bytes, b: bytes) -> Encoder:
    """One for a worker, with the units that it has met."""
    return Encoder(a, b)


def id_kind(*found: Side) -> type:
    return np.uint16 if max(len(s.token_bytes) for s in found) <= 1 << 16 else np.uint32


def events(documents: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(doc_id, text_md5, offset, side, ids): from a byte offset on, the next tokens of side 0 or 1. A text without tokens has one row of side 2.

    Units are encoded once for many texts; a long text is taken in parts of a million characters, cut between units.
    """
    shown = documents.sparkSession.sparkContext.broadcast((a, b))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(*shown.value)
        lengths, step = [s.lengths for s in enc.sides], ROW_IDS * np.dtype(enc.kind).itemsize
        for batch in batches:
            rows, size, lo, text = [], 0, 0, batch.column("text")
            while lo < batch.num_rows:
                # short texts some hundred at a time, a long one by itself
                some, chars = [], 0
                while lo + len(some) < batch.num_rows and chars < 1 << 20:
                    some.append(text[lo + len(some)].as_py() or "")
                    chars += len(some[-1])
                short = [list(enc.units(t)) if len(t) <= 1 << 20 else None for t in some]
                enc.learn({u for x in short if x for part in x for u in part})
                for i, (t, parts) in enumerate(zip(some, short, strict=True)):
                    if parts is None:  # twice: its events count only if every unit does
                        bad = any(enc.learn(set(part)) or None in enc.found(part) for part in enc.units(t))
                        if not bad:
                            enc_parts = (enc.learn(set(part)) or enc.found(part) for part in enc.units(t))
                    else:
                        known = [enc.found(part) for part in parts]
                        bad, enc_parts = not known or None in known[0], known
                    if bad:
                        rows.append((lo + i, 0, 2, b""))
                        continue
                    at = [0, 0]
                    for part in enc_parts:
                        for side in (0, 1):
                            ids = b"".join([x[side] for x in part])
                            for k in range(0, len(ids), step):
                                rows.append((lo + i, at[side], side, ids[k : k + step]))
                                at[side] += int(lengths[side][np.frombuffer(rows[-1][3], enc.kind)].sum())
                            size += len(ids)
                        if size > 1 << 24:
                            yield out(batch, rows)
                            rows, size = [], 0
                lo += len(some)
            yield out(batch, rows)

    def out(batch, rows):
        at, offset, side, ids = zip(*rows, strict=True) if rows else ((),) * 4
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_md5").take(at), pa.array(offset, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "text_md5", "offset", "side", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_md5 string, offset long, side int, ids binary")


class Sweep:
    """The state between two runs of events: ids of both sides since the last place where both end, and the document that is open."""

    def __init__(self, a: Side, b: Side):
        self.lengths = (a.lengths, b.lengths)
        n, m = len(a.token_bytes), len(b.token_bytes)
        self.width = m
        # ids as they are written: in a group, and as the last of their side in it
        written = [b"%d," % i for i in range(n)] + [b"%d|" % i for i in range(n)] + [b"%d," % i for i in range(m)] + [b"%d;" % i for i in range(m)]
        self.written, self.sizes, self.n = pa.array(written, pa.large_binary()), np.array(list(map(len, written)), np.int64), n
        self.left = [(np.zeros(0, id_kind(a, b)), np.zeros(0, np.int64)) for _ in range(2)]

    def run(self, ids: list[np.ndarray], docs: list[np.ndarray]):
        """Takes more ids of both sides, with the numbers of their documents. Returns what is complete: per group and per link.

        (documents of groups, bytes of their text, the text; documents of links, their pairs as a * width + b; numbers of documents of the ids taken, by side)
        """
        ids = [np.concatenate([self.left[s][0], ids[s]]) for s in (0, 1)]
        docs = [np.concatenate([self.left[s][1], docs[s]]) for s in (0, 1)]
        ends = [np.cumsum(self.lengths[s][ids[s]]) for s in (0, 1)]
        where = np.searchsorted(ends[1], ends[0])
        both = where < len(ends[1])
        both[both] = ends[1][where[both]] == ends[0][both]
        cut = [np.flatnonzero(both), where[both]]
        n = [int(c[-1]) + 1 if len(c) else 0 for c in cut]
        self.left = [(ids[s][n[s] :], docs[s][n[s] :]) for s in (0, 1)]
        ids, docs, ends = ([x[s][: n[s]] for s in (0, 1)] for x in (ids, docs, ends))
        last, group = [], []
        for s in (0, 1):
            mark = np.zeros(n[s], bool)
            mark[cut[s]] = True
            last.append(mark)
            group.append(np.cumsum(mark) - mark)
        # a group's ids of side 0 come before its ids of side 1
        before = [np.concatenate([[0], c + 1]) for c in cut]
        codes = np.empty(n[0] + n[1], np.int64)
        codes[np.arange(n[0]) + before[1][group[0]]] = ids[0].astype(np.int64) + self.n * last[0]
        codes[np.arange(n[1]) + before[0][group[1] + 1]] = ids[1].astype(np.int64) + 2 * self.n + self.width * last[1]
        text = self.written.take(pa.array(codes)).buffers()[2] if len(codes) else b""
        sizes = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        stop = sizes[(cut[0] + cut[1] + 2)] if len(cut[0]) else np.zeros(0, np.int64)
        every = np.union1d(*ends)
        first, second = (np.searchsorted(e, every) for e in ends)
        pairs = ids[0][first].astype(np.int64) * self.width + ids[1][second]
        return docs[0][cut[0]], stop, text, docs[0][first], pairs, docs


ALIGNED = ("copies long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", "whole boolean", "pairs binary", "times binary")


def aligned(found: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Groups and links of every different (doc_id, text): counts, the digest of the groups, and the different pairs with how often each is linked.

    A document too long for one run of the sweep has a row for each, whole false; the last has the digest. copies counts
    equal rows, whose events stand beside each other. pairs: 64-bit a * (ids of B) + b, ascending; times: 32 bits.
    """
    shown = found.sparkSession.sparkContext.broadcast((a, b))
    kind = found.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text_md5", *(c.split()[0] for c in ALIGNED)]
    types = [to_arrow_type(found.schema["doc_id"].dataType), pa.string(), *[pa.int64()] * 5, pa.string(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches):
        both = sides(*shown.value)
        sweep, of_id = Sweep(*both), id_kind(*both)
        ids, numbers, held = ([], []), ([], []), 0
        docs, first = [], 0  # the documents that are held, and the number of the first

        def swept(more: bool) -> list[tuple]:
            """Rows of the documents held; with ``more`` the last goes on."""
            nonlocal ids, numbers, held, docs, first
            join = lambda x, t: np.concatenate([*x, np.zeros(0, t)])
            of_groups, stop, text, of_links, pairs, taken = sweep.run([join(x, of_id) for x in ids], [join(x, np.int64) for x in numbers])
            every = np.arange(first, first + len(docs) + 1)
            g, k, n_a, n_b = (np.searchsorted(x, every).tolist() for x in (of_groups, of_links, *taken))
            view, start, rows = memoryview(text), 0, []
            for i, x in enumerate(docs):
                goes_on = more and i == len(docs) - 1
                if g[i + 1] > g[i]:
                    end = int(stop[g[i + 1] - 1])
                    if x["sha"] is None:
                        x["sha"] = hashlib.sha256()
                    else:
                        x["sha"].update(b";")
                    x["sha"].update(view[start : end - 1])
                    start = end
                codes, times = np.unique(pairs[k[i] : k[i + 1]], return_counts=True)
                sha = None if goes_on else x["sha"].hexdigest() if x["sha"] else ""
                rows.append((*x["name"], x["copies"], n_a[i + 1] - n_a[i], n_b[i + 1] - n_b[i], g[i + 1] - g[i], k[i + 1] - k[i], sha, not goes_on and not x["parts"], codes.tobytes(), times.astype(np.int32).tobytes()))
                x["parts"] = True
            kept = docs[-1:] if more else []
            first += len(docs) - len(kept)
            ids, numbers, held, docs = ([], []), ([], []), 0, kept
            return rows

        seen = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_md5", "offset", "side")), batch.column("ids"), strict=True)
            for doc_id, text_md5, offset, side, part in rows:
                if not docs or docs[-1]["name"] != (doc_id, text_md5):
                    if held >= SWEEP_IDS:
                        yield out(swept(False))
                    docs.append({"name": (doc_id, text_md5), "copies": 0, "sha": None, "parts": False})
                    seen = None
                docs[-1]["copies"] += offset == 0 and side != 1
                if (offset, side) == seen or side == 2:  # an equal row's event, or none
                    continue
                seen = offset, side
                part = np.frombuffer(part.as_py(), of_id)
                ids[side].append(part)
                numbers[side].append(np.full(len(part), first + len(docs) - 1))
                held += len(part)
                if held >= 4 * SWEEP_IDS:
                    yield out(swept(True))
        yield out(swept(False))

    def out(rows):
        at = zip(*rows, strict=True) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(at, types, strict=True)], names=columns)

    dealt = found.repartition("doc_id", "text_md5").sortWithinPartitions("doc_id", "text_md5", "offset", "side")
    return dealt.select("doc_id", "text_md5", "offset", "side", "ids").mapInArrow(run, ", ".join([f"doc_id {kind}", "text_md5 string", *ALIGNED]))


def flat_pairs(links: DataFrame) -> DataFrame:
    """(doc_id, text_md5, copies, pair, times): a row for every different pair of a row of ``aligned``."""
    kind = links.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                codes = [np.frombuffer(x.as_py(), np.int64) for x in part.column("pairs")]
                times = np.frombuffer(b"".join(x.as_py() for x in part.column("times")), np.int32).astype(np.int64)
                at = pa.array(np.repeat(np.arange(len(codes)), list(map(len, codes))))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "text_md5", "copies")), pa.array(np.concatenate([np.zeros(0, np.int64), *codes])), pa.array(times)], names=["doc_id", "text_md5", "copies", "pair", "times"])

    return links.select("doc_id", "text_md5", "copies", "pairs", "times").mapInArrow(run, f"doc_id {kind}, text_md5 string, copies long, pair long, times long")


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more.

    Sums are taken where the pairs are, up to some millions at once, before they are shuffled.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            for codes, copies in zip(b.column("pairs"), b.column("copies").to_pylist(), strict=True):
                codes = np.frombuffer(codes.as_py(), np.int64)
                held.append((codes, np.full(len(codes), copies)))
                size += len(codes)
                if size >= MOST_PAIRS:
                    codes, n = summed(held)
                    held, size = [(codes, n)], len(codes)
                    if size >= MOST_PAIRS // 2:
                        yield out(codes, n)
                        held, size = [], 0
        yield out(*summed(held))

    def summed(held):
        codes, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        return codes[start], np.add.reduceat(n, start) if len(codes) else n

    def out(codes, n):
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    whole = links.where("whole").select("copies", "pairs").mapInArrow(run, "pair long, n long")
    parts = flat_pairs(links.where("NOT whole")).groupBy("doc_id", "text_md5", "pair").agg(F.max("copies").alias("n")).select("pair", "n")
    counts = whole.unionByName(parts).groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has as many pairs as B has ids, at most
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def _scored(links: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``links`` with n_best and count_sum in place of pairs and times."""
    keep = [c for c in links.columns if c not in ("pairs", "times")]
    if counts.count() <= most:
        table = counts.toPandas().sort_values("pair")
        shown = links.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

        def run(batches):
            pair, n, best = shown.value
            for b in batches:
                made = np.zeros((2, b.num_rows), np.int64)
                for i, (codes, times) in enumerate(zip(b.column("pairs"), b.column("times"), strict=True)):
                    at, times = np.searchsorted(pair, np.frombuffer(codes.as_py(), np.int64)), np.frombuffer(times.as_py(), np.int32).astype(np.int64)
                    made[:, i] = times[best[at]].sum(), times @ n[at]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, made)], names=[*keep, "n_best", "count_sum"])

        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields if f.name in keep)
        return links.mapInArrow(run, types + ", n_best long, count_sum long")
    # too many pairs for a broadcast: they meet their counts in a join
    flat = flat_pairs(links).join(counts, "pair").groupBy(F.col("doc_id").alias("d"), F.col("text_md5").alias("t"))
    sums = flat.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = links.select(*keep).join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_md5") == F.col("t")), "left")
    first = F.col("groups_sha256").isNotNull()  # a document's sums stand in its last row
    return out.select(*keep, *(F.when(first, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("n_best", "count_sum")))


def align_tokenizers(documents: DataFrame, folder: str = TOKENIZERS, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of documents.

    A is a byte-level vocabulary, B a piece model; A encodes a space and the text, B the text, to which it adds the space itself. Texts
    that are null or empty, or whose tokens' bytes on either side aren't the space and the text, have no tokens: zeros and an
    empty digest. Repeated rows are documents of their own, with equal results; a null doc_id is like any other; other
    columns are ignored; an empty table gives none.

    Texts are read once and not shuffled, ids are, 16 bits each. A text of any length is encoded in parts, cut where neither
    tokenizer can join anything, and swept in runs; what a task holds of it is a run, and one group at a cut. A text
    without such places is one part. Counts of pairs are broadcast up to ``most_pairs`` (17 bytes each), beyond that joined.
    """
    a, b = (_read(f"{folder}/{name}") for name in (a_vocabulary, b_vocabulary))
    links = materialize(aligned(events(documents, a, b), a, b), "token-links", "zstd")
    counts = materialize(pair_counts(links, len(sides(a, b)[1].token_bytes)), "pair-counts")
    scored = _scored(links, counts, most_pairs)
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    parts = scored.where("NOT whole").groupBy("doc_id", "text_md5").agg(F.max("copies").alias("copies"), *(F.sum(c).alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256"))
    columns = ["doc_id", *sums, "groups_sha256"]
    out = scored.where("whole").select("copies", *columns).unionByName(parts.select("copies", *columns))
    # equal rows come back one by one, from arrays of bounded size
    out = out.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 4096))))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096), F.col("copies") - 4096 * F.col("lot"))))).select(*columns)


def _read(path: str) -> bytes:
    """A vocabulary, some megabytes, read on the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()
