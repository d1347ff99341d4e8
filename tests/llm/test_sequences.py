"""Line dedup, the conversation trie and the tokenizer alignment against brute force, and their edge cases."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F
from test_llm import ODD, SCHEMA, low

from tidemark.llm import align, lines, queries, trie

DATA = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS n_lines", "'x' AS lost", "2 AS id", "'y' AS lost_id", "3 AS pair", "4 AS copies", "5 AS side")


# 11


def lines_brute(rows, least=20, most=3):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    rank = lambda i: (i is not None, i)
    gone = {k: max(v, key=rank) for k, v in held.items() if len(k) >= least and len(v) >= most}
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if not (key(y) in gone and gone[key(y)] != i)]
        out.append((i, "\n".join(kept), len(x), len(x) - len(kept)))
    return Counter(out)


def dedup(df, *a):
    return Counter(tuple(r) for r in lines.dedup_lines(df, *a).select("doc_id", "text", "n_lines", "n_dropped").collect())


def test_lines_of_the_tables(docs):
    found = dedup(docs)
    assert found == lines_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(x[3] for x in found) > 0


def test_lines_edges(spark, odd):
    common = "A  common line of some length\t"
    rows = [(1, f"{common}\none\n{common.upper()}"), (2, f"\x0b{common}\r\n\n"), (3, f"{common}\n{common}\nlast"), (4, common), (4, common), (5, None), (6, ""), (None, common), (None, f"x\n{common}"), (7, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ1"), (8, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ1"), (9, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ1"), (10, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ123"), (11, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ123"), (12, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ123"), (13, "àÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ123")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup(df)
    assert found == lines_brute(rows)
    assert (3, "last", 3, 2) in found and (4, common, 1, 0) in found and found[(4, common, 1, 0)] == 2
    assert (11, "", 1, 1) in found and (12, rows[14][1], 1, 0) in found and (8, rows[10][1], 1, 0) in found
    assert lines.dedup_lines(df.limit(0)).collect() == []
    assert dedup(odd) == lines_brute([(r[0], r[1]) for r in ODD])
    kept = lines.dedup_lines(odd)
    assert set(kept.columns) == set(odd.columns) | {"n_dropped"} and kept.where("id = 2 AND pair = 3").count() == len(ODD)


def test_lines_of_one_group(spark):
    """A third of all documents hold one line; parts of a text are cut at line feeds."""
    rows = [(i, f"the very same line in many documents\nown {i}" if i % 3 == 0 else f"another one of its kind number {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup(df) == lines_brute(rows)
    text = b"a\nbb\n\nccc\n" * 50
    assert [x for most in (1, 3, 7) for x in [b"\n".join(y for part in lines._lines(text, most) for y in part)]] == [text] * 3


# 12


def rebuilt_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def trie_brute(convs):
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))
        ends[tuple(t)].append(c)
    out = []

    def walk(k):
        below = [walk(x) for x in children[k]]
        leaves = sum(x[0] for x in below) or 1
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(x[1] for x in below)
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves, saved, sha(",".join(map(str, sorted(ends[k]))))))
        return leaves, saved

    if convs:
        sys.setrecursionlimit(10_000)
        walk(())
    return Counter(out)


def found_trie(df, **sizes):
    return Counter(tuple(r) for r in trie.prefix_trie(trie.grafted(df), **sizes).collect())


def test_trie_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_conversation_trie(spark, DATA).collect()) == trie_brute(rebuilt_brute(rows))


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_edges(spark):
    rows = [(5, None, None, None), (5, 1, "user", "é"), (6, 0, "user", "x"), (12, 3, "a", "b"), (-3, 0, "a", ""), (20, 0, "", ""), (21, 1, None, None), (None, 1, "user", "none")]
    rows += [(c, k, "user", "same" if k < 300 else f"tail {c}") for c in (100, 101, 102) for k in range(302)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS pos", "'x' AS token", "2 AS key", "3 AS id")
    assert found_trie(df) == trie_brute(rebuilt_brute([r for r in rows if r[0] is not None]))
    assert found_trie(df.limit(0)) == Counter()


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 20_000, "run_bytes": 3_000}, {"range_bytes": 5_000, "run_bytes": 1_000, "held_bytes": 2_000}])
def test_trie_over_ranges_and_runs(spark, sizes):
    """A third are copies of one conversation, another third begin alike; ranges, runs and runs in files change nothing."""
    rng = random.Random(7)
    rows = []
    for c in range(900):
        n = rng.randrange(1, 9)
        if c % 3 == 0:
            turns = [f"copy {k}" for k in range(4)]
        elif c % 3 == 1:
            turns = ["hello", "how are you", *(f"{rng.randrange(3)}" for _ in range(n))]
        else:
            turns = [f"{rng.randrange(5)}" for _ in range(n)]
        rows += [(c, k, "user" if k % 2 == 0 else "bot", t) for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS)
    plain = {c: [(r[2], r[3]) for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    tokens = trie.turn_tokens(df).withColumnRenamed("turn", "pos")
    assert Counter(tuple(r) for r in trie.prefix_trie(tokens, **sizes).collect()) == trie_brute(plain)


def test_merged_runs_are_in_order_and_carry_lcps():
    rng = random.Random(3)
    token = lambda x: bytes([x]) * trie.TURN
    pairs = [(b"".join(token(rng.randrange(2)) for _ in range(rng.randrange(7))), c) for c in range(500)]
    for n in (1, 2, 3, 7):
        runs = [list(trie.sorted_run(pairs[k::n])) for k in range(n)]
        out = list(trie.merged([iter(r) for r in runs]))
        assert [(k, c) for _, k, c in out] == sorted(pairs)
        assert [h for h, _, _ in out[1:]] == [trie.shared_turns(a[1], b[1]) for a, b in pairwise(out)]
    assert all(trie.shared_turns(a, b) == next((i for i in range(min(len(a), len(b)) // trie.TURN) if a[i * trie.TURN] != b[i * trie.TURN]), min(len(a), len(b)) // trie.TURN) for a, _ in pairs[:40] for b, _ in pairs[:40])


# 13


def align_brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    to = align.byte_of()

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, t in rows:
        a = ta.encode(" " + (t or ""), add_special_tokens=False) if t else None
        ids = [a.ids, tb.encode(t)] if t else [[], []]
        parts = [[bytes(to[c] for c in x) for x in (a.tokens if t else [])], [bytes_b(x) for x in ids[1]]]
        if t and any(b"".join(p) != (" " + t).encode() for p in parts):
            ids, parts = [[], []], [[], []]
        ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] if len(p) < 300 else list(__import__("itertools").accumulate(map(len, p))) for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], Counter(), [0, 0]
        for c in cuts:
            g = []
            for s in (0, 1):
                k = at[s]
                while ends[s][at[s]] != c:
                    at[s] += 1
                at[s] += 1
                g.append(range(k, at[s]))
            groups.append("|".join(",".join(str(ids[s][k]) for k in g[s]) for s in (0, 1)))
            for x in g[0]:
                for y in g[1]:
                    if ends[0][x] - len(parts[0][x]) < ends[1][y] and ends[1][y] - len(parts[1][y]) < ends[0][x]:
                        links[ids[0][x], ids[1][y]] += 1
        docs.append((i, len(ids[0]), len(ids[1]), len(groups), links, sha(";".join(groups)) if groups else ""))
        counts.update(set(links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((i, a, b, g, sum(k.values()), sum(n for p, n in k.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in k.items()), s) for i, a, b, g, k, s in docs)


def found_alignment(df, **x):
    return Counter(tuple(r) for r in align.align_tokenizers(df, **x).collect())


def test_alignment_of_the_tables(docs):
    found = found_alignment(docs)
    assert found == align_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


WILD = [(20, "  two  spaces \n and\tblanks  "), (21, "日本語のテキスト 🙂 é́ \x00 \x7f"), (22, "<|endoftext|> <s> </s> <0x41> ▁x"), (23, " "), (24, "\n"), (25, "it's don't 3,141.59 nbsp em\x85nel"), (26, "x 　 y"), (27, "ﬁ ﬀ Å"), (None, "no id"), (None, "no id")]


def test_alignment_edges(spark, odd):
    assert found_alignment(odd) == align_brute([(r[0], r[1]) for r in ODD])
    df = spark.createDataFrame(WILD, "doc_id long, text string")
    assert found_alignment(df) == align_brute(WILD)
    assert found_alignment(df.limit(0)) == Counter()


def test_alignment_in_small_runs_and_by_join(spark, docs, monkeypatch):
    """Documents that cross runs of the sweep, and counts that are joined, give the same."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()] + WILD
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    expected = align_brute(rows)
    assert found_alignment(df, most_pairs=10) == expected
    a, b = (align._read(f"{align.TOKENIZERS}/{x}") for x in (align.A_VOCABULARY, align.B_VOCABULARY))
    sweep = align.Sweep(*align.sides(a, b))
    enc = align.encoder(a, b)
    text = rows[0][1] * 20
    units = [u for part in enc.units(text, 500) for u in part]
    enc.learn(set(units))
    import numpy as np

    ids = [np.frombuffer(b"".join(x[s] for x in enc.found(units)), np.uint16) for s in (0, 1)]
    out, at = [], [0, 0]
    for k in range(0, 2 * max(map(len, ids)), 37):
        cut = [ids[0][at[0] : k + 37], ids[1][at[1] : k + 20]]
        at = [k + 37, k + 20]
        out.append(sweep.run(cut, [np.zeros(len(x), np.int64) for x in cut]))
    whole = align.Sweep(*align.sides(a, b)).run(ids, [np.zeros(len(x), np.int64) for x in ids])
    assert b"".join(bytes(memoryview(x[2])) for x in out) == bytes(memoryview(whole[2]))
    assert sorted(np.concatenate([x[4] for x in out]).tolist()) == sorted(whole[4].tolist())
    assert [i for x in units for i in enc.a.encode(" " + x, add_special_tokens=False).ids] == enc.a.encode(" " + text, add_special_tokens=False).ids


def test_long_documents_are_swept_in_runs(spark):
    rows = [(1, "Some words of a text, " * 120_000), (2, "short text"), (1, "Some words of a text, " * 120_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = found_alignment(df)
    assert found == align_brute(rows) and found.total() == 3
