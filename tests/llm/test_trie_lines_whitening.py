"""Conversation trie, line dedup and whitening on small messy tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import convtrie, linededup, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, a string, b string, load string, depth string"


def brute_trie(rows, family=5, most=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    nodes, bytes_of = defaultdict(list), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        seq = tuple(convs.get(c - int(math.fmod(c, family)), [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq) == d))
    children, out = Counter(k[:-1] for k in nodes if k), {}
    for k, who in nodes.items():
        below = [n for n in nodes if n[: len(k)] == k]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c, e in who if e)))
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        leaves = sum(not children[n] for n in below)
        out[min(c for c, _ in who), len(k)] = (parent, len(who), children[k], leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(df):
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}
    return got


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 1000, 7003, -4, -10]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é日", "same same", f"own {c}"])))
    for c in (200, 201, 202, 203, 205, 206, 300):  # one deep and common conversation, in parts with and without its family head
        rows += [(c, t, "user", f"deep {t}") for t in range(40 + c % 3)]
    rows += [(206, 90, "user", "end"), (None, 1, "user", "nobody"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (9, 2, "user\x01x", "y"), (8, 2, "user", "x\x01y"), (400, 0, "u", "word " * 20000)]
    return rows


def test_trie(spark, turns, monkeypatch):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in turns], TURNS).repartition(5)
    want = brute_trie(turns)
    assert trie_rows(convtrie.conversation_trie(df)) == want
    monkeypatch.setattr(convtrie, "SLICE", 4)
    monkeypatch.setattr(convtrie, "JOINED", 4)
    monkeypatch.setattr(convtrie, "BATCH", 3)
    assert trie_rows(convtrie.conversation_trie(df, piece=40)) == want  # components split over several levels by Spark
    assert convtrie.conversation_trie(df.where("false")).count() == 0
    assert convtrie.conversation_trie(df.where("conv_id IS NULL")).count() == 0


def test_centroid_sums():
    rng = random.Random(1)
    for n in (1, 2, 7, 60, 300):
        for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: max(-1, i - rng.randint(1, 9))):
            up = [-1] + [shape(i) for i in range(1, n)]
            w = [[rng.randint(-5, 5) for _ in up], [1] * n]
            want = [list(x) for x in w]
            for i in range(n - 1, 0, -1):
                if up[i] >= 0:
                    for s in want:
                        s[up[i]] += s[i]
            assert convtrie.centroid_sums(up, w) == want


DOCS = "doc_id bigint, text string, h string, t string, pos string, kept string, n_lines string, text_hash string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    common = ["The common line of many documents", "  the COMMON line of many documents\t", "exactly twenty chars", "nineteen characters", "İstanbul ÉCOLE licence line", "istanbul école licence line", "é" * 20]
    rows = []
    for i in range(60):
        lines = [rng.choice([*common, f"a line of document {i} alone", "short", "", " \x0b\x0c\r "]) for _ in range(rng.choice([1, 3, 9, 40]))]
        rows.append((i * 700, "\n".join(lines)))
    rows += [(1, None), (2, ""), (3, "\n"), (4, "\n\n" + common[0]), rows[3], rows[3], (700, "another text of one id\n" + common[0]), (None, common[0] + "\n" + common[2]), (None, common[0]), (None, "no id has this long line"), (None, "x\nno id has this long line"), (8, "no id has this long line")]
    rows += [(90000, "\n".join(rng.choice([common[0], common[2], "only here, but here very often"]) for _ in range(20000)))]
    rows += [(90001, "\n".join(rng.choice(common[:3]) + rng.choice(["", " "]) for _ in range(20000))), (90002, "two hold this rather long line"), (90003, "two hold this rather long line")]
    return rows


def brute_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    stays = {k: max(ids, key=lambda d: (d is not None, d or 0)) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        keep = [key(x) not in stays or stays[key(x)] == d for x in lines]
        out.append((d, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k), tuple(keep)))
    return out


def unpacked(bitmap):
    runs, n = [], 0
    for b in bitmap:
        n = n * 128 + (b & 127)
        if b < 128:
            runs.append(n)
            n = 0
    return tuple(i % 2 == 0 for i, r in enumerate(runs) for _ in range(r))


def test_line_dedup(spark, texts, monkeypatch):
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in texts], DOCS).repartition(5)
    want = Counter(brute_lines(texts))
    for block in (linededup.BLOCK, 700):
        monkeypatch.setattr(linededup, "BLOCK", block)
        got = linededup.drop_lines(df, carry=("h", "pos"))
        rows = got.collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"], unpacked(r["keep_bitmap"])) for r in rows) == want
        assert {(r["h"], r["pos"]) for r in rows} == {("clash", "clash")}
    packed = {r["doc_id"]: r["keep_bitmap"] for r in rows}
    assert len(packed[90000]) < 20000
    assert linededup.drop_lines(df.where("false")).count() == 0
    back = df.sparkSession.createDataFrame([(bytes([3, 129, 0, 1]),)], "b binary").select(linededup.runs_in(F.col("b"))).first()[0]
    assert back == [3, 128, 1]


def test_whitening(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (101, None), (102, []), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5), (106, [0.0] * 6), (107, [-0.0] * 6)]
    rows += [(200 + i, [float(i), float(2 * i)]) for i in range(5)] + [(300, [1.0, 2.0, 3.0])] + [(400, [1e300, -1e300, 0.0, 1.0]), (401, [1e18, 5.0, 0.0, 2.0]), (402, [1e5, 7.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, x string, dims int").repartition(4)
    got = defaultdict(list)
    for r in sorted(whitening.whiten(df).collect(), key=lambda r: r["component"]):
        got[r["vec_id"], r["n"], r["deviation"]].append(r)
    seen = Counter()
    for dims in (2, 3, 6):
        mine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
        x = {k: np.array([math.floor(256 * c) for c in v]) for k, (_, v) in enumerate(mine)}
        fit = np.unique(np.array(list(x.values())), axis=0)
        n, s = len(fit), fit.sum(0)
        cov = np.cov(fit.T, bias=True).reshape(dims, dims)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
        for k, (i, _) in enumerate(mine):
            deviation = sum(int(v) ** 2 for v in n * x[k] - s)
            group = got[i, n, deviation]
            seen[dims] += 1
            assert [r["component"] for r in group][: min(4, dims)] == sorted({r["component"] for r in group}) or len(group) > min(4, dims)
            for r in group:
                c = r["component"] - 1
                assert r["identity_error"] < 1e-9
                if values[c] > 1e-9:
                    want = float((x[k] - s / n) @ vectors[:, c] / math.sqrt(values[c]))
                    assert math.isclose(abs(r["whitened"]), abs(want), rel_tol=1e-9, abs_tol=1e-9)
                    assert math.isclose(r["explained"], values[c] / np.trace(cov), rel_tol=1e-9)
                else:
                    assert r["whitened"] is None
    assert sum(seen.values()) * 4 - 2 * 5 - 1 == sum(len(v) for (_, n, _), v in got.items() if n != 3)
    big = [r for (i, _, _), v in got.items() if i in (400, 401, 402) for r in v]
    assert len(big) == 12 and {r["n"] for r in big} == {3} and all(r["deviation"] is None for r in big if r["vec_id"] != 402)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 101")).count() == 0


def test_sums_are_exact(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice([0, 1, -3, 10**6, 2**40, -(2**62)]) + rng.randint(-9, 9) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame([(3, list(r)) for r in rows], "dims bigint, x array<bigint>").repartition(3)
    model = whitening.fit(df)[3]
    n = len(rows)
    mean = [Fraction(sum(r[i] for r in rows), n) for i in range(3)]
    for i in range(3):
        for j in range(3):
            want = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / n
            assert model.cov[i, j] == float(want)
