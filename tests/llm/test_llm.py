"""The training-data operators against brute force, and their edge cases."""

import glob
import hashlib
import math
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embeddings, labelled, licenses, lm, mixing, pii, quality, shared, simhash, token_files, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "a" * 50_000 + " end"
#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, LONG, "en", "b", len(LONG)), (4, "same text here", None, None, 14), (4, "same text here", None, None, 14), (5, "\n\n \t\n", "de", "b", 5), (6, "Ünï cödé ÀÉ", "fr", "a", 11)]
WORDS, TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS score", "'x' AS fp", "2 AS n_words", "'y' AS spans", "3 AS row", "4 AS base", "5 AS size", "6 AS gram", "7 AS y")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_words_agree_with_their_patterns():
    for t in ["A-b c9 É_x z\x7f!", "", "  ", "ÀB{C}D|e~f@g[h`i"]:
        assert [w.decode() for w in shared.words(t.encode())] == WORDS.findall(low(t))
        assert [w.decode() for w in shared.tokens(t.encode())] == TOKENS.findall(low(t))


# 1


def lm_brute(rows, c):
    d = [(i, WORDS.findall(low(t))) for i, t in rows]
    gram = lambda x, k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    every = [Counter(g for _, x in d for g in gram(x, k).elements()) for k in (1, 2, 3)]
    words, out = sum(every[0].values()), []
    for i, x in d:
        own = [gram(x, k) if c.leave_out else Counter() for k in (1, 2, 3)]
        left = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]
        n, s = max(1, words - sum(own[0].values())), 0.0
        for at in range(len(x)):
            factor = 0.0
            for k in (3, 2, 1):
                g = tuple(x[at - k + 1 : at + 1])
                if at + 1 < k:
                    continue
                if left(g):
                    s += factor + math.log(left(g) / (left(g[:-1]) if k > 1 else n))
                    break
                factor += math.log(c.backoff)
            else:
                s += factor - math.log(n)
        out.append((-1 if i is None else i, len(x), s))
    return sorted(out)


def lm_close(df, config):
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_score) for r in lm.score_lm(df, config).collect())
    want = lm_brute(texts(df), config)
    assert [m[:2] for m in mine] == [w[:2] for w in want] and np.allclose([m[2] for m in mine], [w[2] for w in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("config", [lm.LmConfig(), lm.LmConfig(leave_out=False, backoff=0.1), lm.LmConfig(batch_words=9000, bucket_grams=20_000)])
def test_lm(spark, docs, odd, config):
    for df in (docs, odd, spark.createDataFrame([(1, "a foo foo foo b"), (2, "foo foo a b a"), (3, "a foo"), (4, "lone")], "doc_id long, text string")):
        lm_close(df, config)


def test_lm_alone(spark):
    """One document: no other has a word of it."""
    lm_close(spark.createDataFrame([("x", "a b a b c")], "doc_id string, text string").withColumn("doc_id", F.lit(7).cast("long")), lm.LmConfig())
    assert lm.score_lm(spark.createDataFrame([("x", "a b")], "doc_id string, text string")).first().doc_id == "x"


def test_lm_rare_words_keep_their_counts(spark):
    """A word seen once or twice among very many is told apart from others as rare."""
    many = " ".join(f"w{i % 1000}" for i in range(600_000))
    lm_close(spark.createDataFrame([(1, many), (2, "rare rare pair"), (3, "rare pair lone")], "doc_id long, text string"), lm.LmConfig())


def test_lm_documents_that_occur_twice_stand_out(spark):
    """Every word and pair of them is common; only the order tells."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 80))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:30]]
    got = {r.doc_id: r.mean_log_score for r in lm.score_lm(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 300)) + 1


def test_word_pieces():
    t = ("aB c-d " * 40 + "x" * 100).encode()
    assert [w for piece in shared.word_pieces(t, 16) for w in piece] == shared.words(t)
    assert list(shared.word_pieces(None)) == [] and [w for p in shared.word_pieces(b" - ", 1) for w in p] == []


def test_lm_empty(none):
    assert lm.score_lm(none).count() == 0


# 2

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii_brute(t):
    out = []
    for rank, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or k == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), k))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


HARD = [
    "a@b.c_d@e.f g@h i@@j.k x@y.z.", "é\U0001f600 mail: q.r+s@t-u.v.w, 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 0000000300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 +1 (499) 555-6503 +12345 +1234567890123456",
    "1" * 20_000 + " " + "a" * 20_000 + "@" + "b." * 5_000 + "c", "+4111111111111111", "", None, "...@@@+++", "x@y.z" * 300,
]


def test_pii_base(spark, docs, odd):
    hard = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for df in (docs, odd, hard):
        want = Counter((i, hashlib.sha256(pii_brute(t).encode()).hexdigest()) for i, t in texts(df))
        assert Counter((r.doc_id, r.base_sha256) for r in pii.pii_digest(df).collect()) == want


def test_pii_terms(spark):
    rng = np.random.default_rng(0)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    rows = [(i, f"{filler(5)} Zorblax of Quux writes from zed@q.example.com {filler(5)}") for i in range(6)] + [(i, filler(40)) for i in range(6, 300)] + [(i, f"{filler(5)} quux {filler(5)}") for i in range(300, 312)]
    rows.append((400, "Zorblax alone"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    assert all("term:" in out[i].spans and out[i].n_email == 1 for i in range(6))
    assert all(out[i].n_terms == 0 for i in range(6, 300)) and out[400].n_terms == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6)) and clean[400] == "Zorblax alone" and all(clean[i] == dict(rows)[i] for i in range(6, 300))
    # copies of one passage are one witness
    same = spark.createDataFrame([(i, "Zorblax of Quux writes from zed@q.example.com now") for i in range(20)] + [(i, filler(9)) for i in range(20, 60)], "doc_id long, text string")
    assert pii.pii_digest(same).agg(F.sum("n_terms")).first()[0] == 0


def test_pii_counts_documents(spark):
    """Five documents hold an address; one of them says a word five times beside it, and is one document all the same."""
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(f"w{x}" for x in rng.integers(0, 50, 9))
    rows = [(i, f"{filler()} a@b.example.com {filler()}") for i in range(4)] + [(4, " ".join(f"{filler()} zorblax a@b.example.com {filler()}" for _ in range(5)))] + [(i, filler()) for i in range(5, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._with_row(df.withColumn("base", pii.base_spans(F.col("text"))), pii.PiiConfig()).where(F.size("base") > 0)
    told = {(r.entity, r.term): r.disclosed for r in pii.disclosing_terms(found, df, 1, 1.0, -9.0).collect()}
    assert told["email:a@b.example.com", "zorblax"] == pytest.approx(math.log2((1 + 5 / 80) / 2 / (5 / 80)) / math.log2(80 / 5))
    assert max(told.values()) <= 1
    assert pii.pii_digest(df).where("doc_id = 4").first().n_terms == 0


def test_pii_finds_terms_on_the_tables(spark):
    out = pii.pii_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert out.agg(F.sum("n_terms")).first()[0] > 0


def test_pii_agrees_with_sql(spark, docs):
    """The method's own spans too: the fixture has terms that disclose an address and terms that don't."""
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL

    rng = np.random.default_rng(1)
    names = ["zorblax", "quux", "flim", "the", "of"]
    rows = []
    for i in range(500):
        text = " ".join(f"w{x}" for x in rng.integers(0, 150, 25))
        if i % 5 == 0:
            k = int(rng.integers(0, 4))
            text += f" {names[k].title()} the {names[rng.integers(0, 5)]} p{k}@h.example.com {names[rng.integers(3, 5)]} " + " ".join(f"w{x}" for x in rng.integers(0, 150, 5)) + f" {names[k]}!"
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    want = Counter(tuple(r) for r in duckdb.sql(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms FROM ({ORACLE_SQL['op2_pii']})").fetchall())
    got = Counter(tuple(r) for r in pii.pii_digest(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms").collect())
    assert got == want and sum(r[-1] for r in got) > 50


def test_pii_sanitise(spark, odd, none):
    df = spark.createDataFrame([(1, "to +4111111111111111 and a@b.cd!", "en", "s", 9)], SCHEMA)
    r = pii.sanitise(df).first()
    assert r.text == "to [CARD] and [EMAIL]!" or r.text == "to [PHONE] and [EMAIL]!" or "[EMAIL]!" in r.text
    assert "4111" not in r.text and r.n_chars == len(r.text)
    assert pii.sanitise(none).count() == 0 and pii.pii_digest(none).count() == 0
    assert Counter(tuple(r) for r in pii.sanitise(odd).collect()) == Counter(tuple(r) for r in odd.collect())


# 3


def license_brute(t):
    w = WORDS.findall(low(t))
    at, base, own, best = [], set(), set(), 0.0
    for p, label in licenses.PHRASES.items():
        q = p.split()
        hits = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        at += hits
        base |= {label} if hits else set()
    for k, v in licenses.TEMPLATES.items():
        notice = WORDS.findall(low(v))
        size, held = 8, set(notice)
        while size < len(notice):
            size *= 2
        need = len(held) if len(held) < 16 else math.ceil(0.8 * len(held) - 1e-9)
        for lo in range(0, max(1, len(w)), size):
            common = len(held & set(w[lo : lo + 2 * size]))
            if common >= need and (lo == 0 or lo + size < len(w)):
                own.add(k)
                best = max(best, common / len(held))
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if at else best)


def test_licenses(spark, docs, odd, none):
    hard = [(1, "MIT License mit license, mit  LICENSE x GNU General Public License"), (2, "the mitt license"), (3, "conditions the following that provided permitted are modification without or with forms binary and source in use and redistribution"), (4, "mit\nlicense")]
    rng = np.random.default_rng(3)
    notices = [WORDS.findall(v) for v in licenses.TEMPLATES.values()]
    for i in range(200):  # notices with words lost and put in, in the midst of others
        n = notices[rng.integers(len(notices))]
        kept = [x for x in n if rng.random() > i / 500] + ["word"] * int(rng.integers(0, 20))
        hard.append((10 + i, " ".join(["filler"] * int(rng.integers(0, 90)) + kept + ["more"] * int(rng.integers(0, 90)))))
    hard = spark.createDataFrame(hard, "doc_id long, text string")
    for df in (docs, odd, hard):
        want = Counter((i, *license_brute(t)) for i, t in texts(df))
        assert Counter(tuple(r)[:8] for r in licenses.scan_licenses(df).collect()) == want
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(hard, {}, {}).where("labels <> ''").count() == 0


def test_licenses_in_running_text(spark):
    """Wrapped notices, a text without line breaks, and near misses."""
    filler = "so it goes on and on " * 400
    mit = "\n".join(re.findall(r".{1,40}(?:\s|$)", re.sub(r"\s+", " ", licenses.TEMPLATES["mit-grant"])))
    rows = [
        (1, filler + mit + filler), (2, filler + re.sub(r"\s+", " ", licenses.TEMPLATES["bsd-conditions"]) + filler), (3, "Released under the BSD License"),
        (4, "Licensed under CC BY 4.0"), (5, "licensed under the GNU General Public License, version 2"), (6, "# Released under\n# the MIT\n# License"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit-grant", "bsd-conditions", "", "", "gpl", "mit"]
    place = len(WORDS.findall(low(filler)))
    assert all(m.start <= place and m.start + m.n_words >= place + 60 for m in got[1].matches if m.containment == 1)


# 4 and 8


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_cases(spark, odd, none, labels, score):
    out = score(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1
    assert score(none, labels).count() == 0
    blank = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in score(odd, blank).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(odd, nulls).count() == len(ODD)


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity.score_toxicity, "toxic", 0.97), (quality.score_quality, "quality", 0.98)])
def test_classifier_accuracy(spark, score, label, least):
    big = "/root/testdata/sf0.1"
    out = score(spark.read.parquet(f"{big}/documents.parquet"), lab := spark.read.parquet(f"{big}/labels.parquet"))
    p = out.where("held_out").join(lab.select("doc_id", F.col(label).alias("y")), "doc_id").toPandas()
    assert len(p) > 500 and (p.predicted == p.y).mean() > least
    pos, neg = p.score[p.y == 1].to_numpy(), p.score[p.y == 0].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.95


def test_drop_toxic_keeps_columns(spark, odd, none, labels):
    kept = toxicity.drop_toxic(odd, labels)
    rejected = toxicity.score_toxicity(odd, labels).where("rejected").count()
    assert kept.columns == odd.columns and kept.count() == len(ODD) - rejected
    assert toxicity.drop_toxic(odd.drop("lang"), labels).columns == odd.drop("lang").columns and toxicity.drop_toxic(none, labels).count() == 0
    assert toxicity.drop_toxic(odd.drop("lang"), labels).count() <= len(ODD)


def test_held_out_rows_are_not_learned(docs, labels):
    import zlib

    drawn = labelled.labelled_sample(docs, labels, "toxic", 5, 0, 1000, 11)
    assert len(drawn) and all(zlib.crc32(str(i).encode()) % 5 != 0 for i in drawn.doc_id)


def test_convolution_against_a_plain_one():
    """Every text by itself, every window by itself, every filter by itself."""
    rng = np.random.default_rng(1)
    c = toxicity.CnnConfig(buckets=500, dim=5, filters=3)
    total = sum(c.widths) * c.filters
    model = toxicity.Cnn(c, rng.normal(size=(c.buckets, c.dim)), rng.normal(size=(c.dim, total)), rng.normal(size=9), rng.normal(size=9), np.array([0.3, 1.0, 0.0]))
    model.embed[0] = 0
    given = [b"one two three four five", b"", None, b"One", b"a b", b"x " * 50 + b"end"]
    want = []
    for t in given:
        v = [sum(model.embed[p] for p in toxicity.parts(w, c.buckets)) for w in shared.words(t)]
        v += [np.zeros(c.dim)] * (3 - len(v))
        found, at = [], 0
        for width in c.widths:
            for f in range(c.filters):
                found.append(max(sum(v[i + k] @ model.conv[:, at + k * c.filters + f] for k in range(width)) for i in range(len(v) - width + 1)))
            at += width * c.filters
        want.append(sum(max(x + b, 0) * o for x, b, o in zip(found, model.bias, model.out, strict=True)) + 0.3)
    assert np.allclose(toxicity.logits(model, given), want)


def test_lines_are_labelled_anew():
    own, good = np.array([1.0, 1, 1, 0, 0, 0]), np.array([0.9, 0.05, 0.02, 0.5, 0.99, 0.2])
    length, at = np.array([50.0, 9, 9, 10, 10, 100]), np.array([0, 0, 0, 1, 1, 1])
    assert quality.relabelled(own, good, length, at).tolist() == [1, 0, 0, 0, 1, 0]
    # half a document's length at most
    assert quality.relabelled(np.ones(2), np.array([0.01, 0.02]), np.array([9.0, 9]), np.zeros(2, int)).tolist() == [0, 1]


def test_repeated_ids_give_one_text(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "z" * 100_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert [bytes(x) for x in labelled.labelled_sample(df, lab, "toxic", 5, 9, 10, 1).text] == [b"a"]


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    per = np.array([1, 4, 3])
    score, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, joint = quality.marginals(score, moves, per)
    at, expected = 0, np.zeros((2, 2))
    for n in per:
        weights = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = math.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                expected[a, b] += w / z
        at += n
    assert np.allclose(joint, expected)


# 5


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [list(map(float, v)) for v in base]
    rows += [list(map(float, v + rng.normal(0, 0.05, 8))) for v in base[:20] for _ in range(3)]
    rows += [rows[0]] * 5 + [[x * 3 for x in rows[1]], [0.0] * 8, None, [], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, rows[2][:4], rows[2][:4]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)] + [(None, rows[0], 0)], "vec_id long, embedding array<float>, label int").withColumn("gain", F.lit(1))
    c = embeddings.ImiConfig(cell_rows=4, block=8, calibration=60, target_recall=1.0)
    out = {r.vec_id: r for r in embeddings.embedding_groups(df, c).collect()}
    ok = [i for i, v in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i], np.float32).astype(float) for i in ok}
    links = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.95:
                links[i].add(j)
    parent = np.arange(len(rows))
    a, b = np.array([(i, j) for i in links for j in links[i]]).T
    shared.union(parent, a, b)
    root = shared.find(parent, np.arange(len(rows)))
    assert len(out) == len(rows) + 1 and out[None].n_links == 0
    for i in range(len(rows)):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (len(links[i]), root[i], root[i] == i), i


@pytest.mark.parametrize("planted", [0.951, 0.956, 0.97])
def test_embeddings_recall(spark, planted):
    """Pairs at a cosine, among many others, in a grid of many cells; the calibration set holds hardly any of them."""
    rng = np.random.default_rng(int(planted * 1000))
    x = embeddings.unit(rng.normal(size=(5000, 64)))
    u = rng.normal(size=(400, 64))
    u -= (u * x[:400]).sum(1, keepdims=True) * x[:400]
    y = planted * x[:400] + np.sqrt(1 - planted**2) * embeddings.unit(u)
    e = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>")
    out = embeddings.embedding_groups(df, embeddings.ImiConfig(cell_rows=16, calibration=128)).toPandas()
    d = embeddings.unit(e)
    true = (d @ d.T >= 0.95).sum() - len(d)
    assert true >= 700 and 0.95 * true <= out.n_links.sum() <= true


def test_embeddings_rare_links_are_found(spark):
    """Few links among many vectors, so that the calibration set holds next to none of them."""
    rng = np.random.default_rng(8)
    x = embeddings.unit(rng.normal(size=(6000, 64)))
    u = rng.normal(size=(200, 64))
    u -= (u * x[:200]).sum(1, keepdims=True) * x[:200]
    y = 0.952 * x[:200] + np.sqrt(1 - 0.952**2) * embeddings.unit(u)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    c = embeddings.ImiConfig(cell_rows=16, calibration=128)
    out = {r.vec_id: r for r in embeddings.embedding_groups(df, c).collect()}
    assert sum(out[6000 + i].component_id == i for i in range(200)) >= 196


def test_embeddings_empty(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    d1, d2 = rng.random((50, 7)), rng.random((50, 5))
    for most in (1, 2, 9, 34, 35):
        for a, b, order in zip(d1, d2, embeddings.visits(d1, d2, most), strict=True):
            cost = np.add.outer(a, b).ravel()
            assert len(set(order)) == most and np.array_equal(cost[order], np.sort(cost)[:most])


def test_embeddings_of_any_magnitude(spark):
    """Squares that leave the range of doubles neither make links nor lose them."""
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.05]), (3, [1e200, 1e200]), (4, [1.0, 1.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 8e306]), (7, [-1e-310, -1e-310])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 3: (2, 1), 4: (2, 1), 2: (2, 2), 5: (2, 2), 6: (2, 2), 7: (0, 7)}


def test_sanitise_keeps_columns_of_any_name(spark):
    names = ["_base", "base", "spans", "row", "terms", "entities", "acts", "at", "_doc", "name"]
    df = spark.createDataFrame([(1, "write to a.b@c.de now", 25), (2, "nothing here", 12), (None, None, None)], "doc_id long, text string, n_chars long").select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "write to [EMAIL] now" and rows[1].n_chars == 20 and rows[2].text == "nothing here" and rows[None].text is None
    assert all(r[n] == f"own {n}" for r in rows.values() for n in names)


def test_targets_of_many_sources_in_ranges(spark):
    """Ranks and caps by prefix sums over ranges are those of one pass over all sources in order."""
    rng = np.random.default_rng(2)
    sizes = {f"s{i:04d}": int(rng.integers(0, 50) ** 3) for i in range(700)} | {None: 77}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, share=0.8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, want = 0.8 * sum(sizes.values()), set(sizes), {}
    while full := {s for s in open_ if 3 * sizes[s] <= left / sum(weight[t] for t in open_) * weight[s]}:
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= full
        if not open_:
            break
    want |= {s: left / sum(weight[t] for t in open_) * weight[s] for s in open_}
    assert got == pytest.approx(want)


# 6


def fp_brute(t):
    w = TOKENS.findall(low(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_brute(fps, most=2):
    """fps: id -> fingerprint; smallest id of each component."""
    ids = sorted(fps)
    parent = np.arange(len(ids))
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= most)
    shared.union(parent, a, b)
    return {i: ids[r] for i, r in zip(ids, shared.find(parent, np.arange(len(ids))), strict=True)}


def test_simhash(spark, docs):
    rows = texts(docs)
    out = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    fps = {i: fp_brute(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in out.items()} == groups_brute(fps)


@pytest.mark.parametrize(("block", "most"), [(50, 2), (7, 3), (1 << 14, 2), (1 << 14, 0)])
def test_simhash_links(spark, block, most):
    """Dense and thin places of the Gray order, blocks that cut them, and bounds."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    near = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(120)}
    near |= {0, 1, 3, 7, 2**63, *map(int, rng.integers(0, 2**64, 300, dtype=np.uint64))}
    fps = dict(enumerate(sorted(near)))
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in fps.values()], "fp long")
    edges = simhash.link_edges(df, most, block).collect()
    at = {v: i for i, v in fps.items()}
    parent = np.arange(len(fps))
    pairs = np.array([(at[e.a % 2**64], at[e.b % 2**64]) for e in edges], dtype=np.int64).reshape(-1, 2)
    shared.union(parent, *pairs.T)
    assert {i: int(r) for i, r in enumerate(shared.find(parent, np.arange(len(fps))))} == groups_brute(fps, most)
    assert len(edges) < 3 * len(fps)


def test_gray_tree_finds_all():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    x[1500:] = x[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    x = np.unique(x)
    x = x[np.argsort(simhash.gray_rank(x))]
    index = simhash.tree(x, ~x)
    found = [(int(a), int(b)) for i, j in simhash.search(index, x, 2) for a, b in zip(i, j, strict=True)]
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    assert len(found) == len(set(found)) and set(found) == set(zip(i.tolist(), j.tolist(), strict=True))
    assert simhash.gray_rank(np.array([0, 1, 3, 2], dtype=np.uint64)).tolist() == [0, 1, 2, 3]
    # every bit of a leaf stands in one node on its way: differences add up to the whole distance
    for leaf in (0, 777, len(x) - 1):
        ways = [leaf // simhash.FAN ** (len(index.bits) - 1 - d) for d in range(len(index.bits))]
        assert sum(int(b[n]) for b, n in zip(index.bits, ways, strict=True)) == 2**64 - 1


def test_gray_tree_prunes(spark, monkeypatch):
    """On a real table the tree decides: of the leaves only a small part is compared."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = np.array(sorted({r.fp for r in simhash.fingerprints(d).select("fp").collect()})).view(np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    seen, index = [], simhash.tree(x, ~x)
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda y: seen.append(len(y)) or count(y))
    list(simhash.search(index, x, 2))
    assert len(index.bits) >= 4 and sum(seen) < 0.6 * len(x) ** 2


def near_brute(rows, width=5, similarity=0.8):
    """Ids that stay: the smallest of each group of texts whose shingle sets are alike."""
    sets = []
    for _, t in rows:
        w = TOKENS.findall(low(t))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = np.arange(len(rows))
    at = defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            at[g].append(i)
    near = {(0, 0)} | {(min(i, j), max(i, j)) for who in at.values() for i in who for j in who[:50]}
    blank = [i for i, x in enumerate(sets) if not x]
    near |= {(blank[0], i) for i in blank}
    pairs = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    shared.union(parent, *np.array(pairs, dtype=np.int64).T)
    root = shared.find(parent, np.arange(len(rows)))
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def test_near_duplicates_against_brute_force(spark, docs):
    """Links are exact: what goes is near what stays. Nearly all links are found."""
    want = near_brute(texts(docs))
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert set(want) <= set(kept) and len(kept) <= len(want) + 1 and len(want) < docs.count()


def test_near_duplicates_recall(spark):
    """Copies with words replaced, by their similarity: all at 0.9, nine of ten or more in every band from 0.8 on, none below."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, similar = [], {}
    gram = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(1200):
        a = word(300)
        b = list(a)
        for k in rng.choice(300, int(rng.integers(1, 12)), replace=False):
            b[k] = "changed"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        similar[2 * i + 1] = len(gram(a) & gram(b)) / len(gram(a) | gram(b))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    gone = lambda lo, hi: np.mean([i not in kept for i, s in similar.items() if lo <= s < hi])
    assert all(i in kept for i, s in similar.items() if s < 0.8) and all(2 * i in kept for i in range(1200))
    assert gone(0.9, 1) == 1 and gone(0.85, 0.9) > 0.98 and gone(0.82, 0.85) > 0.95 and gone(0.8, 0.82) >= 0.9


def test_near_duplicates_lose_no_group(spark):
    """Groups are those of all pairs, even where few sketches find few of them: pairs just above 0.8, chains, short texts, texts of common words."""
    rng = np.random.default_rng(3)
    word = lambda n, of=4000: [f"w{x}" for x in rng.integers(0, of, n)]
    rows, common = [], word(40)
    for _ in range(150):
        a = word(int(rng.integers(1, 200))) + (common if rng.random() < 0.3 else [])
        rows.append(a)
        for _ in range(2):
            a = list(a)
            for k in rng.choice(len(a), min(len(a), int(rng.integers(0, 1 + len(a) // 30))), replace=False):
                a[k] = "changed"
            rows.append(a)
    rows += [word(30, 2) for _ in range(60)]
    rows = [(int(i), " ".join(rows[k])) for k, i in enumerate(rng.permutation(len(rows)))] + [(1000, ""), (1001, "  "), (1002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_brute([(i, t or "") for i, t in rows])
    few = simhash.NearConfig(sketches=2)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, few).collect()) == want
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df.repartition(7)).collect()) == want
    classes, links = (x.collect() for x in simhash.near_duplicate_links(df, simhash.NearConfig(sketches=2, sample=100, common=50)))
    parent = {r["class"]: r["class"] for r in classes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[max(top(r.a), top(r.b))] = min(top(r.a), top(r.b))
    assert len({top(x) for x in parent}) == len(want)


def test_near_duplicates_of_a_large_family_make_few_pairs(spark, monkeypatch):
    """Copies of one text with one to three words changed, which few sketches leave in many groups: the groups of all pairs, from about as many candidates as texts."""
    rng = np.random.default_rng(17)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(600):
        a = list(base)
        for k in rng.choice(150, int(rng.integers(1, 4)) if i else 0, replace=False):
            a[k] = f"x{i}y{k}"
        rows.append((i, " ".join(a)))
    made, write = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag, *more: made.setdefault(tag, []).append(write(df, tag, *more)) or made[tag][-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df, simhash.NearConfig(sketches=2)).collect())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    parent = np.arange(len(rows))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    shared.union(parent, *np.array(pairs, dtype=np.int64).T)
    assert kept == sorted(set(shared.find(parent, np.arange(len(rows))).tolist()))
    few = {tag: made[tag][-1].count() for tag in made if tag in ("hub-candidates", "other-candidates")}
    assert sum(few.values()) <= 4 * len(rows), few


def test_near_duplicates_take_little_disk(spark, monkeypatch):
    """Texts that share a passage become candidates, but their shingles are written only if they may be alike; large tables go when they were read."""
    rng = np.random.default_rng(23)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for i in range(200):
        passage, a = word(30), word(150)
        rows += [a + passage, passage + word(150)] + ([[*a[:60], f"changed{i}", *a[61:], *passage]] if i < 20 else [])
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    made, write = [], simhash.materialize

    def noted(df, tag, *more):
        made.append((tag, out := write(df, tag, *more), out.count(), out.inputFiles()[0]))
        return made[-1][1]

    monkeypatch.setattr(simhash, "materialize", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # hardly any shingle is known as common, so that passages are uncommon
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df, simhash.NearConfig(common=1)).collect())
    assert kept == near_brute(rows) and len(kept) == 400
    rows_of = lambda *tags: sum(n for tag, _, n, _ in made if tag in tags)
    assert rows_of("hub-candidates", "other-candidates") > 100 and 40 <= rows_of("shingle-sets") <= 60
    there = {tag for tag, _, _, file in made if os.path.exists(file.removeprefix("file://"))}
    assert not there & {"text-classes", "sketches", "shingle-sets", "shared-shingles"} and "near-groups" in there


def test_shuffles_freed(spark):
    """What a write has shuffled is gone after it, and only within; the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    top = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in top for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, held = spark.conf.get(key, None), files()
    rows = spark.range(1000).repartition(7, "id")
    with shared.shuffles_freed(spark):
        assert shared.materialize(rows, "freed").count() == 1000
        for _ in range(100):
            if not files() - held:
                break
            time.sleep(0.1)
        assert not files() - held
    assert spark.conf.get(key, None) == before


def test_sifted(spark):
    """Every row of a key passes, and few others; nulls don't."""
    rows = spark.range(20000).select(F.col("id"), F.md5(F.col("id").cast("string").cast("binary")).alias("k")).unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    keys = shared.materialize(rows.where("id % 10 = 3").select(F.col("k").alias("key")), "keys")
    got = shared.sifted(rows, "k", keys, "key")
    ids = {r.id for r in got.collect()}
    assert got.columns == rows.columns and {i for i in range(20000) if i % 10 == 3} <= ids and len(ids) < 2000 + 0.06 * 18000 and -1 not in ids
    assert shared.sifted(rows, "k", keys.limit(0), "key").count() == 0


def test_common_shingles_are_not_merged_in_one_place(spark, monkeypatch):
    """Those of the sample come in right numbers, in Arrow, a quota of each class of hashes; no task or driver sorts what all tasks propose."""
    plans, arrow = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), arrow(df))[1])
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda df: pytest.fail("rows as Python objects"))
    often = [f"a b c d {'e' * k}" for k in range(1, 60)]
    rows = [(f"{x} {i}",) for k, x in enumerate(often) for i in range(2 + k % 3)]
    held = spark.createDataFrame(rows, "text string").select(F.col("text").cast("binary").alias("text"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    want = {int(simhash.shingle_set(x.encode(), 5, shared.WordHashes())[0]): 2 + k % 3 for k, x in enumerate(often)}
    known, n = simhash._common_shingles(held, simhash.NearConfig())
    assert dict(zip(known.tolist(), n.tolist(), strict=True)) == want and (np.diff(known.astype(object)) > 0).all()
    known, n = simhash._common_shingles(held, simhash.NearConfig(common=8))
    assert 0 < len(known) <= 8 and all(want[k] == x for k, x in zip(known.tolist(), n.tolist(), strict=True))
    assert len(plans) == 2 and not any("TakeOrdered" in p or "GlobalLimit" in p or "SinglePartition" in p for p in plans)


def test_rare_prefix_meets():
    """Sets of the similarity share one of their uncommon shingles, whatever is known as common."""
    rng = np.random.default_rng(5)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 500, n)).astype(np.uint64)
        b = np.unique(np.append(rng.permutation(a)[: max(1, len(a) - int(rng.integers(0, 8)))], rng.integers(0, 500, int(rng.integers(0, 5))).astype(np.uint64)))
        known = np.unique(rng.integers(0, 500, int(rng.integers(0, 200)))).astype(np.uint64)
        often = rng.integers(2, 9, len(known))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert np.intersect1d(*(simhash.rare_prefix(x, known, often, 0.8) for x in (a, b))).size


def test_sketch_codes_are_far_apart():
    codes = [simhash._code(t) for t in range(32)]
    assert min((a ^ b).bit_count() for i, a in enumerate(codes) for b in codes[:i]) == 16


def test_simhash_odd(odd, none):
    out = simhash.simhash_groups(odd).collect()
    assert len(out) == len(ODD)
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(odd).collect()]
    assert sorted(kept) == [1, 3, 4, 6]
    assert simhash.simhash_groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Ids that are null or repeated, alone in a group and together with others."""
    rows = [(None, "x y z"), (None, "x y z"), (None, "p q r s"), (7, "p q r s"), (8, "a b c"), (8, "a b c"), (8, "d e f"), (9, "a b c"), (10, "k l m"), (11, "n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("id", F.lit(2))
    kept = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [(-1, "x y z"), (7, "p q r s"), (8, "a b c"), (8, "d e f"), (10, "k l m"), (11, "n o p")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    out = {r.id: r.component_id for r in shared.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


# 7


def test_token_counts(spark, docs, odd, none, tmp_path):
    enc = token_files.encoder(*token_files.vocabulary_of(token_files.TOKENIZERS, token_files.VOCABULARY))
    out = {r.doc_id: r.n_tokens for r in token_files.token_counts(docs).collect()}
    assert out == {i: len(enc.encode_ordinary(t)) for i, t in texts(docs)}
    # a shuffled input too
    assert {r.doc_id: r.n_tokens for r in token_files.token_counts(docs.repartition(7)).collect()} == out
    assert Counter((r.doc_id, r.n_tokens) for r in token_files.token_counts(odd).collect()) == Counter((i, len(enc.encode_ordinary(t or ""))) for i, t, *_ in ODD)
    assert token_files.token_counts(none).count() == 0
    # the files hold the ids and nothing else
    path = f"file://{tmp_path}/flat"
    token_files.write_token_files(docs.coalesce(1), path)
    (file,) = (tmp_path / "flat").iterdir()
    want = b"".join(np.array([*enc.encode_ordinary(r.text), token_files.EOD], dtype="<u2").tobytes() for r in docs.coalesce(1).collect())
    assert file.read_bytes() == want


@pytest.mark.parametrize("block", [2, 4, 6, 15, 2000])
def test_ranges_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for f in range(4):
        lengths = [int(x) for x in rng.choice([0, 0, 1, 2, 5, 40], 30)] if f else []
        ids = np.concatenate([np.zeros(0, np.int64), *(np.append(rng.integers(0, 999, n), token_files.EOD) for n in lengths)])
        (tmp_path / f"f{f}").write_bytes(np.append(ids, [5, 6] if f == 3 else []).astype("<u2").tobytes() + b"x" * (f == 2))
        want |= {(f"f{f}", i): n for i, n in enumerate(lengths)}
    out = token_files.scan_token_files(spark, f"file://{tmp_path}", block=block).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in out} == want


# 9


def test_mixing(spark, docs, odd, none):
    for df in (docs, odd):
        out = mixing.mix(df).collect()
        size = lambda t: len(TOKENS.findall(t or ""))
        assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t in texts(df))
        by = defaultdict(list)
        for r in out:
            by[r.source].append(r)
        total = sum(r.size for r in out)
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
        left, share = {s: (i % 3) + 1.0 for i, s in enumerate(names)}, {}
        pot = float(total)
        while left:
            full = [s for s, w in left.items() if pot * w / sum(left.values()) >= 3 * by[s][0].source_size]
            if not full:
                share |= {s: pot * w / sum(left.values()) for s, w in left.items()}
                break
            for s in full:
                share[s] = 3.0 * by[s][0].source_size
                del left[s]
            pot = total - sum(share.values())
        for s, rows in by.items():
            assert rows[0].source_size == sum(r.size for r in rows)
            assert rows[0].target == pytest.approx(share[s], abs=1e-3)
            assert abs(sum(r.taken for r in rows) - rows[0].target) < 1.001
            assert all(0 <= r.taken <= 3 * r.size for r in rows)
        assert Counter(tuple(r) for r in mixing.mix(df).collect()) == Counter(tuple(r) for r in out)
    # rows without an id are spread over the ranges of their source
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    assert mixing.mix(many).agg(F.sum("taken")).first()[0] == 20_000
    assert mixing.mix(none).count() == 0


# 10


def hits_brute(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])] |= {i} - {None}
    out = []
    for d, t in rows:
        w = WORDS.findall(low(t))
        hit, who = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    who |= windows[tuple(w[j : j + k])]
                    hit[j : j + k] = [True] * k
        out.append((d, len(w), sum(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), any(hit)))
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, docs, odd, none, monkeypatch, small):
    """With the prefixes broadcast, and shuffled; with a sieve that lets much pass."""
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(decontaminate, "SIEVE", 16)
    real = spark.read.parquet(f"{DATA}/benchmark.parquet")
    more = [(900, "same text here"), (901, "same text"), (902, "Word"), (903, None), (904, ""), (None, "Ünï CÖDÉ"), (905, "word " * 12), (906, "same text here")]
    more = spark.createDataFrame(more, "item_id long, text string").withColumn("window", F.lit("x"))
    for df in (docs, odd):
        bench = real.unionByName(more.drop("window"))
        got = Counter(tuple(r) for r in decontaminate.contamination(df, bench).collect())
        assert got == hits_brute(texts(df), texts(bench.withColumnRenamed("item_id", "doc_id")))
    assert decontaminate.contamination(none, real).count() == 0
    assert decontaminate.contamination(odd, real.limit(0)).where("contaminated").count() == 0
    kept = Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, real).collect())
    assert kept == Counter(d for d, *_, bad in hits_brute(texts(docs), texts(real.withColumnRenamed("item_id", "doc_id"))) if not bad)
    # a clean row stays though its null or repeated id is also that of a bad one
    mixed = spark.createDataFrame([(None, "same text here"), (None, "clean"), (4, "same text here"), (4, None)], "doc_id long, text string").withColumn("digest", F.lit(1))
    assert Counter(r.text for r in decontaminate.drop_contaminated(mixed, more).collect()) == Counter({"clean": 1, None: 1})


def test_contamination_ids_of_any_type(spark):
    bench = spark.createDataFrame([("k", "one two three"), ("b", "two three four"), (None, "nine ten")], "item_id string, text string")
    docs = spark.createDataFrame([("d", "One, two THREE four nine"), (None, "nine ten")], "doc_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got["d"].n_hit, got["d"].n_items, got["d"].items_sha256) == (4, 2, hashlib.sha256(b"b,k").hexdigest())
    assert (got[None].n_hit, got[None].n_items, got[None].contaminated) == (2, 0, True)


def test_words_decide_not_hashes(spark):
    """Candidates of one hash: only the window whose words stand there is left."""
    prefix = spark.createDataFrame([(7, 1, "b c d", 3, ["1"]), (7, 0, "c d e", 3, ["2"]), (7, 1, "b x d", 3, ["3"]), (7, 2, "a b c d e f", 6, ["4"]), (7, 0, "c d e f g", 5, ["5"])], "shingle long, offset int, window string, length int, items array<string>")
    found = spark.createDataFrame([("k", 6, (2, 7, 2, "a b c d e f"))], "doc string, n_words long, p struct<pos:int,shingle:long,at:int,near:string>")
    got = {(r["items"][0], r.start, r.end) for r in decontaminate._verified(found, prefix).collect()}
    assert got == {("1", 1, 4), ("2", 2, 5), ("4", 0, 6)}
