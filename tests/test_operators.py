"""Operators against hand results or brute force on small fixtures."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import chat, citations, containment, corpus, fuzzy, inverted, navigation, pagemap, retrieval
from marginalia.functions import text as T
from marginalia.operators import context as X
from marginalia.operators import corrections as K
from marginalia.operators.ranking import longest_runs, positions


def test_positions_and_runs_across_slices(spark):
    rng = random.Random(1)
    values = {k: sorted(rng.sample(range(400), 250)) for k in ("a", "b")}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k STRING, v BIGINT")
    got = {(r.k, r.v): r.p for r in positions(df, ["k"], "v", "p", width=16).collect()}
    assert got == {(k, v): i + 1 for k, vs in values.items() for i, v in enumerate(vs)}

    def longest(vs):
        best = run = 1
        for x, y in zip(vs, vs[1:]):
            run = run + 1 if y == x + 1 else 1
            best = max(best, run)
        return best

    for width in (4, 16, 1024):
        runs = {r.k: r.longest_run for r in longest_runs(df, ["k"], "v", width=width).collect()}
        assert runs == {k: longest(vs) for k, vs in values.items()}


def test_confidence_rules(spark):
    rows = [("few", 1, 9, 0, 0.9, 9, None), ("close", 1, 29, 0, 0.9, 9, 10), ("ratio", 1, 30, 0, 0.7, 1, 10), ("mid", 1, 30, 0, 0.4, 1, None),
            ("run", 1, 30, 0, 0.1, 20, None), ("run10", 1, 30, 0, 0.1, 10, None), ("low", 1, 30, 0, 0.1, 1, None), ("none", None, None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "book STRING, offset BIGINT, match_count BIGINT, candidate_page_count BIGINT, match_ratio DOUBLE, longest_run BIGINT, second_count BIGINT")
    got = {r.book: r.status for r in pagemap.offset_confidence(df).collect()}
    assert got == {"few": "MANUAL_REQUIRED", "close": "WARNING", "ratio": "AUTO_OK", "mid": "WARNING", "run": "AUTO_OK", "run10": "WARNING",
                   "low": "MANUAL_REQUIRED", "none": "MANUAL_REQUIRED"}


def test_lexical_search_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    docs = [("b", i, 0, " ".join(rng.choices(words, k=12))) for i in range(30)]
    asks = [(q, 1, " ".join(rng.choices(words, k=3))) for q in range(4)]

    def grams(t):
        return Counter(t[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))

    tf = {d[1]: grams(d[3]) for d in docs}
    df = Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    want = {}
    for q, _, text in asks:
        qv = unit(grams(text))
        scored = sorted(((-round(sum(w * unit(tf[d]).get(g, 0.0) for g, w in qv.items()), 6), d) for d in tf))
        want[q] = [(d, -s) for s, d in scored if s < 0][:5]
    out = retrieval.lexical_search(
        spark.createDataFrame(docs, "book STRING, pdf_page INT, chunk INT, text STRING"),
        spark.createDataFrame(asks, "query_id BIGINT, variant_no BIGINT, query STRING"), 5)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.pdf_page, r.score))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q]))


def test_inverted_index_skips_nothing(spark, monkeypatch):
    rng = random.Random(11)
    words = ["alpha", "beta", "gam\0ma", "日本", "索引語", "a", "😀", "  "]
    docs = [(f"b{i % 3}", i, 0, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(90)] + [("b9", 900, 0, None), ("b9", 901, 0, "alpha beta"), ("b9", 902, 0, "alpha beta")]
    asks = [(q, 1, " ".join(rng.choices(words, k=6)), rng.choice([None, [], ["b1"], ["b0", "b9"]])) for q in range(30)] + [(50, 1, "zzzz", None), (51, 1, "", None)]
    d = spark.createDataFrame(docs, "book STRING, pdf_page INT, chunk INT, text STRING").repartition(3)
    a = spark.createDataFrame(asks, "query_id BIGINT, variant_no BIGINT, query STRING, books ARRAY<STRING>")

    def found(k):
        return sorted(map(tuple, retrieval.lexical_search(d, a, k).collect()))

    whole = found(1000)
    for limit, rows in ((200, 4096), (50, 7)):
        monkeypatch.setattr(inverted, "SEGMENT_CHARS", limit)
        monkeypatch.setattr(inverted, "QUERY_ROWS", rows)
        assert found(1000) == whole
        assert found(4) == [r for r in whole if r[-1] <= 4]
    assert retrieval.lexical_search(d.where("false"), a, 3).count() == 0 == retrieval.lexical_search(d, a.where("false"), 3).count()
    index = inverted.postings(d, retrieval.KEY)
    df = Counter(g for *_, text in docs for t in [re.sub(r"\s{2,}", " ", (text or "").lower())] for g in {t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)})
    assert {r["gram"]: r["df"] for r in inverted.frequencies(index).collect()} == df


def test_lexical_search_of_large_vocabularies(spark, monkeypatch):
    """Norms by parts of the vocabulary, ranks instead of many characters, blocks and counts of a few rows: the same result."""
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)] + list("abc \0😀")
    docs = [(f"b{i % 3}", i, 0, "".join(rng.choices(letters[-400:], k=rng.choice([0, 1, 3, 60, 300])))) for i in range(60)]
    asks = [(q, 1, rng.choice(docs)[3][:50]) for q in range(12)]
    d = spark.createDataFrame(docs, "book STRING, pdf_page INT, chunk INT, text STRING")
    a = spark.createDataFrame(asks, "query_id BIGINT, variant_no BIGINT, query STRING")

    def found():
        return sorted(map(tuple, retrieval.lexical_search(d, a, 5).collect()))

    whole = found()
    assert whole
    for name, value in (("IDF_ROWS", 3_000), ("CELLS", 500), ("COUNT_ROWS", 1_000)):
        monkeypatch.setattr(inverted, name, value)
    assert found() == whole
    grams = ["ab", "a\0c", "😀x日本", "\0\0", "abcdef"]
    assert inverted._strings(*inverted._numbers(grams)) == grams
    many = "".join(chr(0x4E00 + i) for i in range(20_000)) + "".join(rng.choices(letters, k=3_000))
    low, high, lengths, owners, tfs = inverted._segment([many, many[:9_000]], (2, 3, 4))
    want = [Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in (many, many[:9_000])]
    names = np.repeat(np.array(inverted._strings(low, high), object), lengths).tolist()
    assert {(g, o): n for g, o, n in zip(names, owners.tolist(), tfs.tolist())} == {(g, o): n for o, c in enumerate(want) for g, n in c.items()}


def test_lexical_search_writes_no_lists_of_grams(spark):
    from pathlib import Path

    from marginalia.session import scratch_folders

    rng = random.Random(13)
    docs = [("b", i, 0, "".join(rng.choices("abcdefghij ", k=2_000))) for i in range(200)]
    a = spark.createDataFrame([(1, 1, docs[0][3][:80])], "query_id BIGINT, variant_no BIGINT, query STRING")
    before = set(scratch_folders())
    retrieval.lexical_search(spark.createDataFrame(docs, "book STRING, pdf_page INT, chunk INT, text STRING"), a, 5).collect()
    held = {f: sum(x.stat().st_size for x in Path(f).rglob("*.parquet")) for f in set(scratch_folders()) - before}
    texts = [n for f, n in held.items() if "/idf-" not in f]
    assert sum(texts) < 2 * 200 * 2_000, held


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(50, 8)).astype("float32"), rng.normal(size=(5, 8)).astype("float32")
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    ask = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id BIGINT, embedding ARRAY<FLOAT>")
    got = {}
    for r in retrieval.vector_search(vec, ask, 7, block_rows=9, query_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    d = ((q[:, None, :].astype("float64") - v[None]) ** 2).sum(2)
    assert got == {i: list(np.argsort(d[i], kind="stable")[:7]) for i in range(5)}


def test_vector_search_prefilter(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 3, size=(40, 4)).astype("float32")
    rows = [(i, x.tolist(), f"b{i % 3}") for i, x in enumerate(v)] + [(90, None, "b1"), (91, v[0].tolist(), None)]
    vec = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, book STRING").repartition(3)
    asks = [(0, v[3].tolist(), ["b1"]), (1, v[4].tolist(), None), (2, v[5].tolist(), []), (3, v[6].tolist(), ["b0", "b2"]), (4, v[7].tolist(), ["none"])]
    ask = spark.createDataFrame(asks, "query_id BIGINT, embedding ARRAY<FLOAT>, books ARRAY<STRING>")
    for allow in (False, True):
        got = {}
        for r in retrieval.vector_search(vec, ask, 6, prefilter=allow, block_rows=5, query_rows=2).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {}
        for q, x, books in asks:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y, book in rows if y and (not allow or not books or book in books))
            if near:
                want[q] = [i for _, i in near[:6]]
        assert got == want


def test_fuzzy_pairs_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda: "".join(rng.choices("abcdef", k=rng.choice([1, 2, 3, 5, 9, 14, 40])))
    left, right = sorted({make() for _ in range(60)} | {"", "日本語索引", "x" * 300}), sorted({make() for _ in range(60)} | {"", "日本索引", "x" * 260 + "y"})
    monkeypatch.setattr(fuzzy, "SHARD_CHARS", 300)
    monkeypatch.setattr(fuzzy, "ROWS", 3)
    for threshold in (0.55, 0.60, 0.72):
        want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in left for b in right if a and b}
        want = {k: r for k, r in want.items() if r >= threshold}
        out = navigation.fuzzy_pairs(spark.createDataFrame([(x,) for x in left], "q STRING"), spark.createDataFrame([(x,) for x in right], "e STRING"), threshold)
        assert sorted((r.q, r.e, r.ratio) for r in out.collect()) == sorted((*k, r) for k, r in want.items())


def test_contained_terms_match_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choices("abc", k=20))) for i in range(20)]
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(40)})
    out = containment.contained_terms(spark.createDataFrame(docs, "d INT, text STRING"), spark.createDataFrame([(t,) for t in terms], "t STRING"), "t", ("d",))
    assert {(r.d, r.t) for r in out.collect()} == {(d, t) for d, text in docs for t in terms if t in text}


def test_contained_terms_in_shards(spark, monkeypatch):
    monkeypatch.setattr(containment, "SHARD_CHARS", 9)
    monkeypatch.setattr(containment, "ROWS", 2)
    docs = [(1, "a (b) c (a) x(b)", None), (2, None, None), (3, "", None), (4, "日本語と日本", None), (5, "(b", "k")]
    terms = ["a", "b", "", None, "日本", "本語", "c (a", "never", "x"]
    d = spark.createDataFrame(docs, "d INT, text STRING, term STRING").repartition(3)
    out = containment.contained_terms(d, spark.createDataFrame([(t,) for t in [*terms, "a"]], "t STRING"), "t", ("d",), ("(", ")"))
    want = {(i, t): text.find(f"({t})") for i, text, _ in docs if text for t in terms if t and t in text}
    assert {(r.d, r.t): r.place for r in out.collect()} == want and out.count() == len(want)
    assert containment.contained_terms(d, out.where("false").select("t"), "t", ("d",)).count() == 0


def test_stripes_shrink_as_shards_grow(spark, monkeypatch):
    """Each stripe takes all shards: with many shards, indexes are not built once more for every task of the session."""
    monkeypatch.setattr(containment, "SHARD_CHARS", 9)
    monkeypatch.setattr(fuzzy, "SHARD_CHARS", 9)
    words = ["".join(c) for c in zip("abcdefghijkl", "bcdefghijklm", "cdefghijklmn")]  # 36 characters: 4 shards
    d = spark.createDataFrame([(i, w * 2) for i, w in enumerate(words)], "d INT, text STRING")
    out = containment.contained_terms(d, spark.createDataFrame([(w,) for w in words], "t STRING"), "t", ("d",))
    assert {(r.d, r.t) for r in out.collect()} == set(enumerate(words)) and out.rdd.getNumPartitions() == 4
    pairs = navigation.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "q STRING"), spark.createDataFrame([(w,) for w in words], "e STRING"), 0.9)
    assert {(r.q, r.e) for r in pairs.collect()} == {(w, w) for w in words} and pairs.rdd.getNumPartitions() == 4


def test_collapse_seeds_and_stop_rule(spark):
    seeds = spark.createDataFrame([("b", s) for s in (5, 8, 11, 20)], "book STRING, seed INT")
    assert sorted(r.seed for r in navigation.collapse_seeds(seeds).collect()) == [5, 20]
    flags = {"p": [1, 1, 0, 1], "m": [0, 1, 0], "n": [0, 0, 1], "e": [1, None, 1, 0, 1]}
    res = spark.createDataFrame([(b, i, None if f is None else bool(f)) for b, fs in flags.items() for i, f in enumerate(fs)], "book STRING, pdf_page INT, positive BOOLEAN")
    start = spark.createDataFrame([(b, 0) for b in flags], "book STRING, seed INT")
    got = Counter(r.book for r in navigation.sequence_stop_rule(start, res, 10).collect())
    assert got == {"p": 3, "m": 3, "n": 2, "e": 4}


def test_reference_edges(spark):
    p = spark.createDataFrame([("b", 10, 7, "⇒161頁 12頁を参照 161頁 次頁")], "book STRING, pdf_page INT, logical_page INT, page_text STRING")
    assert [r.target for r in X.reference_edges(p).orderBy("pos").collect()] == [161, 12, 8]


def test_context_pack_quotas(spark):
    rows = [("m", i, True, 1000.0 - i, "index") for i in range(40)] + [("o", i, False, 500.0 - i, "toc") for i in range(5)]
    rows += [("m", i, False, 200.0 - i, "hybrid") for i in range(6)] + [("h", i, False, 100.0 - i, "hybrid") for i in range(24)]
    items = spark.createDataFrame([(1, b, i, 0, m, s, "r", src) for b, i, m, s, src in rows],
                                  "query_id INT, book STRING, pdf_page INT, chunk INT, mandatory BOOLEAN, context_score DOUBLE, reason STRING, source STRING")
    out = X.context_pack(items).orderBy("position").collect()
    keys = [(r.book, r.pdf_page) for r in out]
    assert keys == [("m", i) for i in range(20)] + [("h", i) for i in range(8)]


def test_collapse_citations(spark):
    a = spark.createDataFrame([(1, "a [C1]\nb [C1][C2]\n\nc [C1]")], "query_id INT, answer STRING")
    assert citations.collapse_citations(a).first().answer == "a\nb [C1][C2]\n\nc [C1]"


def test_errata_classify_branches(spark):
    rows = [
        ("table", None, "x", "y", True), ("replace", None, "x", "y※注", False), ("note_only", None, "x", "※アイコン化", False), ("append_loc", "追記", "本文", None, False),
        ("item", "特技「縮地」", "項目ごと削除", None, False), ("quoted", None, "※以下の２文を削除「甲乙」", None, False), ("del_note", None, "※〈赤鉄〉を削除※同項目が直上にあるため", None, False),
        ("listed", None, "以下の項目を『A』から削除 甲※注", None, False), ("full", None, "効果全文を以下に差し替え新しい本文", None, False), ("tail", None, None, "※末尾に（第二）を追記", False),
        ("tail_quoted", None, None, "末尾に「X」を追加", False), ("plain", None, None, "以下の一文を追加。X", False), ("none", None, "x", None, False)]
    df = spark.createDataFrame(rows, "k STRING, location STRING, before STRING, after STRING, internal_table_detected BOOLEAN")
    got = {r.k: r for r in K.classify(df).collect()}
    assert {k: r.operation for k, r in got.items()} == {
        "table": "complex", "replace": "replace", "note_only": "complex", "append_loc": "append", "item": "delete", "quoted": "delete", "del_note": "delete",
        "listed": "delete", "full": "replace", "tail": "append", "tail_quoted": "append", "plain": "append", "none": "complex"}
    assert (got["replace"].after, got["replace"].note) == ("y", "※注")
    assert got["item"].delete_text == "縮地" and got["quoted"].delete_text == "「甲乙」"
    assert (got["del_note"].delete_text, got["del_note"].note) == ("〈赤鉄〉", "※同項目が直上にあるため")
    assert (got["listed"].delete_text, got["listed"].note) == ("甲", "※注")
    assert (got["full"].after, got["full"].note) == ("新しい本文", "全文を以下に差し替え")
    assert (got["tail"].append_instruction, got["tail"].append_text) == ("末尾に追記", "（第二）")
    assert (got["tail_quoted"].append_instruction, got["tail_quoted"].append_text) == ("末尾に追加", "「X」")
    assert got["plain"].append_text == "X"
    parsed = {r.k: (r.parse_status, r.operation) for r in K.quality(K.classify(df)).collect()}
    assert parsed["quoted"] == ("LAYOUT_PARSED", "delete") and parsed["tail"] == ("LAYOUT_PARSED", "append") and parsed["none"][0] == "LAYOUT_COMPLEX"


def test_y_bands(spark):
    df = spark.createDataFrame([("d", 1, "t", float(i), y) for i, y in enumerate((10.0, 12.0, 13.9, 20.0))], "doc STRING, pdf_page INT, text STRING, x_min DOUBLE, y_min DOUBLE")
    assert [r.band for r in K.y_bands(df).orderBy("y_min").collect()] == [0, 0, 1, 2]


def test_rescue(spark):
    texts = ["a | b | c", "a | b | c | d", "a | b", "a | b | c | d | e", "a | b | b"]
    df = spark.createDataFrame([("d", 1, i, "UNASSIGNED_ROW", t) for i, t in enumerate(texts)], "doc STRING, pdf_page INT, band INT, type STRING, text STRING")
    assert sorted((r.location, r.before, r.after) for r in K.rescue(df).collect()) == [("a", "b", "c"), ("a b", "c", "d")]


def test_contextual_question(spark):
    turns = [(1, 0, "user", "q0"), (2, 0, "user", "a"), (2, 1, "user", "b")]
    turns += [(3, 2 * i, "user", f"u{i}" if i != 4 else "L" * 3000) for i in range(7)] + [(3, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id INT, turn INT, role STRING, text STRING")
    got = {(r.conv_id, r.turn): r.search_question for r in chat.contextual_question(df).collect()}
    assert got[(1, 0)] == "q0" and got[(2, 1)] == "a\nb" and got[(3, 12)] == "u0\nu2\nu3\nu5\nu6"


def test_scan_json_files(spark, tmp_path):
    from marginalia.sources import files
    (tmp_path / "a.json").write_text('[{"book": "B", "page": 1, "text": "x"}, {"book": null, "page": 2, "text": "y"}, {"book": "B", "page": "x", "text": "z"}, {"book": "B", "page": "3", "text": " "}]')
    (tmp_path / "bad.json").write_text("{not json")
    rows = corpus.clean_pages(files.read_page_files(spark, str(tmp_path))).collect()
    assert [(r.book, r.pdf_page, r.text) for r in rows] == [("B", 1, "x")]
    cat = tmp_path / "cat" / "c.json"
    cat.parent.mkdir()
    cat.write_text('{"core": {"weight": 1.5, "books": [{"name": "B"}]}, "extra": {"books": [{"name": "B"}, {"name": "C", "display_name": "c"}]}}')
    c = files.read_catalogue(spark, str(cat))
    assert {(r.book, r.category) for r in corpus.catalogue_by_file(c).collect()} == {("B", "extra"), ("C", "extra")}
    assert {(r.book, r.category) for r in corpus.catalogue_by_weight(c).collect()} == {("B", "extra"), ("C", "extra")}


def test_correction_lines(spark, tmp_path):
    from marginalia.sources import files
    meta = '{"source_class": "official_correction", "operation": "%s", "rag_eligible": %s, "target_page": 3}'
    lines = ['{"id": "%d", "text": "t", "metadata": %s}' % (i, meta % m) for i, m in enumerate((("replace", "true"), ("delete", "false"), ("move", "true")))]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = corpus.correction_verdict(files.read_correction_lines(spark, str(tmp_path / "c.jsonl")))
    assert [r.verdict for r in rows.orderBy("id").collect()] == ["valid", "skipped", "invalid"]


def test_correction_resolve_statuses(spark):
    from marginalia.operators import correction_search as Q
    page = "戦士は毎朝はやくに剣を磨いて長い訓練をする"
    chunks = spark.createDataFrame([("Book One", 9, 5, 0, page)], "book STRING, pdf_page BIGINT, logical_page BIGINT, chunk BIGINT, text STRING")
    cols = "chunk_id STRING, source_key STRING, target_page BIGINT, operation STRING, location STRING, before STRING, after STRING, delete_text STRING, text STRING"
    rows = [("nomap", "zz", 5, "replace", None, "x", "y", None, "t"), ("nopage", "k", None, "replace", None, "x", "y", None, "t"), ("missing", "k", 6, "replace", None, "x", "y", None, "t"),
            ("applied", "k", 5, "replace", None, "ＱＷＥＲ", "剣を磨いて", None, "t"), ("strong", "k", 5, "replace", "戦士", "剣を磨いて", "ＱＷＥＲ", None, "t"),
            ("page_only", "k", 5, "append", "ＱＷＥＲ", None, None, None, "t"), ("deleted", "k", 5, "delete", "戦士", None, None, "長い訓練をする", "t")]
    targets = spark.createDataFrame([("k", "Book One")], "source_key STRING, target_book STRING")
    got = {r.chunk_id: r.match_status for r in Q.resolve(spark.createDataFrame(rows, cols), targets, chunks).collect()}
    assert got == {"nomap": "NO_BOOK_MAPPING", "nopage": "NO_TARGET_PAGE", "missing": "TARGET_PAGE_NOT_INDEXED", "applied": "ALREADY_APPLIED",
                   "strong": "MATCHED_STRONG", "page_only": "PAGE_ONLY", "deleted": "MATCHED_STRONG"}


def test_index_type_rules(spark):
    exp = spark.createDataFrame([("b", 1, ["A索引"]), ("b", 2, ["A索引", "戦闘特技索引"])], "book STRING, pdf_page INT, expected ARRAY<STRING>")
    det = spark.createDataFrame([("b", 1, "x"), ("b", 2, "A索引"), ("b", 2, "索引"), ("b", 2, "闘特技索引"), ("b", 3, "魔法索引")], "book STRING, pdf_page INT, detected STRING")
    got = {(r.pdf_page, r.detected): (r.index_type, r.candidate_index_types) for r in navigation.index_type_join(det, exp).collect()}
    assert got == {(1, "x"): ("A索引", []), (2, "A索引"): ("A索引", []), (2, "索引"): ("索引", ["A索引", "戦闘特技索引"]),
                   (2, "闘特技索引"): ("戦闘特技索引", []), (3, "魔法索引"): ("魔法索引", [])}


def test_catalogue_skips_only_the_bad_entries(spark, tmp_path):
    from marginalia.sources import files

    (tmp_path / "c.json").write_text('{"a": {"weight": 2, "books": [{"name": "x"}, 5, {"no": 1}, {"name": ""}, {"name": "y", "display_name": "Y"}]}, "b": "no object",'
                                     ' "c": {"books": "none"}, "d": {"weight": "z", "books": [{"name": "x"}]}}')
    got = [tuple(r) for r in files.read_catalogue(spark, str(tmp_path / "c.json")).select("category", "weight", "book", "display_name", "book_pos").orderBy("category_pos", "book_pos").collect()]
    assert got == [("a", 2.0, "x", None, 0), ("a", 2.0, "y", "Y", 4), ("d", 1.0, "x", None, 0)]


def test_snapshots_survive_a_crash_at_every_step(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from marginalia.sources import snapshots

    path = str(tmp_path / "t")
    rows = lambda: snapshots.read(spark, path, "id BIGINT").count()
    assert rows() == 0
    assert snapshots.publish(spark.range(5), path) == 1 and rows() == 5

    def stop(*_):
        raise OSError("stop")

    with pytest.raises(Exception):  # while data are written
        snapshots.publish(spark.range(9).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id")), path)
    assert rows() == 5
    for step, after in (("_commit", 5), ("_tidy", 7)):
        with monkeypatch.context() as m:
            m.setattr(snapshots, step, stop)
            with pytest.raises(OSError):
                snapshots.publish(spark.range(7), path)
        assert rows() == after
    held = snapshots.read(spark, path, "id BIGINT")
    snapshots.publish(spark.range(3), path)
    assert rows() == 3 and held.count() == 7  # a reader of the one before goes on
    snapshots.publish(spark.range(4), path)
    assert rows() == 4 and len(snapshots.children(spark, f"{path}/data")) == snapshots.KEEP == len(snapshots.entries(spark, path))


def test_streams_without_rows_restarts_and_crashes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from marginalia.streaming import tables

    root = str(tmp_path / "s")
    land = lambda rows, parts=1: tables.landed(spark.createDataFrame(rows, "k BIGINT, v BIGINT"), root, "v", parts)
    total = lambda s: s.groupBy("k").agg(F.sum("v").alias("total"))
    run = lambda: dict(map(tuple, tables.run_aggregate(tables.table_stream(spark, f"{root}/landing.parquet"), total, ["k"], f"{root}/job").collect()))
    land([])
    assert run() == {} and run() == {}
    monkeypatch.setattr(tables, "FOLD", 2)
    land([(i % 3, i) for i in range(30)], 12)  # batches 9 and 10 differ in length, and the table is folded on the way
    want = {k: sum(i for i in range(30) if i % 3 == k) for k in range(3)}
    assert run() == want
    land([(1, 100), (7, 1)])
    with monkeypatch.context() as m:  # a crash while a snapshot is published, and one before batches are dropped
        m.setattr(tables.snapshots, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError):
            run()
    with monkeypatch.context() as m:
        m.setattr(tables.snapshots, "remove", lambda *_: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError):
            run()
    assert run() == {**want, 1: want[1] + 100, 7: 1}
    assert tables._deltas(spark, f"{root}/job") == []


def test_activity_expires(spark, tmp_path):
    import datetime as dt

    from marginalia.streaming import activity, tables

    root = str(tmp_path / "a")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    land = lambda rows: tables.landed(spark.createDataFrame([(k, at(s)) if s is not None else (k, None) for k, s in rows], "k STRING, ts TIMESTAMP"), root, "ts", 1)

    def run():
        out = activity.run_activity(tables.table_stream(spark, f"{root}/landing.parquet"), ["k"], f"{root}/job", 100)
        return {r["k"]: ((r["first_seen_at"] - at(0)).total_seconds(), (r["last_used_at"] - at(0)).total_seconds(), r["n"]) for r in out.collect()}

    land([])
    assert run() == {}
    land([("old", 0), ("a", 10), ("a", 60), (None, 5), ("x", None)])
    assert run() == {"old": (0, 0, 1), "a": (10, 60, 2)}
    land([("b", 130), ("a", 100)])  # after a restart; the watermark passes 100 seconds after "old"
    assert run() == {"a": (10, 100, 3), "b": (130, 130, 1)}
    land([("old", 140)])
    assert run() == {"a": (10, 100, 3), "b": (130, 130, 1), "old": (140, 140, 1)}  # begins anew
    land([("c", 1000)])
    assert run() == {"c": (1000, 1000, 1)}


def test_links_of_real_markup(spark):
    from marginalia.operators import crawl

    page = ('<!-- <a href="/no"> --><script>"<a href=/js>"</script><a title="x>y" href="/p">1</a><A data-href="/d" HREF=\'/q?x=1&#38;y=2\'>2</a>'
            '<a class=x href=/caf&eacute;?a=1&amp;b=2 href="/second">3</a><abbr href="/abbr"></abbr><a name="href=/fake">4</a><!-- <a href="/open">')
    got = [tuple(r) for r in crawl.link_graph(spark.createDataFrame([("http://h.com/", page)], "url string, html string")).orderBy("pos").collect()]
    assert got == [("http://h.com/", 0, "http://h.com/p"), ("http://h.com/", 1, "http://h.com/q?x=1&y=2"), ("http://h.com/", 2, "http://h.com/café?a=1&b=2")]


def test_frontier_is_breadth_first_in_queue_order(spark):
    import random

    from marginalia.operators import crawl

    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(40)}", rng.randrange(6), f"n{rng.randrange(40)}") for _ in range(110)})
    edges = [(s, i, d) for i, (s, _, d) in enumerate(edges)]
    seen, queue, order = {"n0": (0, None)}, ["n0"], {s: [] for s, _, _ in edges}
    for s, p, d in edges:
        order[s].append(d)
    for u in queue:
        for d in order.get(u, []):
            if d not in seen and seen[u][0] < 4:
                seen[d] = (seen[u][0] + 1, u)
                queue.append(d)
    got = crawl.crawl_frontier(spark.createDataFrame([("s", "n0")], "source_id string, url string"), spark.createDataFrame(edges, "src string, pos int, dst string"), 4)
    assert {r["url"]: (r["depth"], r["discovered_from"]) for r in got.collect()} == seen


def test_manifest_diff_has_one_row_per_url(spark):
    from marginalia.operators import crawl

    rows = lambda *r: spark.createDataFrame(r, "url STRING, sha256 STRING, page_id BIGINT")
    current = rows(("a", "1", 1), ("a", "2", 5), ("b", "1", 2), ("c", None, 3), (None, "9", 4))
    previous = rows(("a", "2", 2), ("b", "1", 1), ("b", "0", 7), ("d", "1", 1), ("d", "2", 2))
    got = sorted(map(tuple, crawl.manifest_diff(current, previous, "page_id").collect()))
    assert got == [("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "removed")]


def test_manifest_stream_keeps_the_last_version_and_resumes(spark, tmp_path):
    from marginalia.streaming import tables

    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "url string, sha256 string, n bigint")
    tables.landed(rows(("u", "zz", 1), ("u", "aa", 2), ("v", "b", 3)), root, "n", 1)
    run = lambda: {r["url"]: r["sha256"] for r in tables.run_manifest(tables.table_stream(spark, f"{root}/landing.parquet"), f"{root}/job", "n").collect()}
    assert run() == {"u": "aa", "v": "b"}
    assert run() == {"u": "aa", "v": "b"}
    tables.landed(rows(("u", "aa", 4), ("w", "c", 5)), root, "n", 2)
    assert run() == {"u": "aa", "v": "b", "w": "c"}


def test_gates_stop_the_job(spark):
    from marginalia.operators import corpus

    maps = spark.createDataFrame([("a", [("1", "2", "x")]), ("a", [("1", "2", "x")])], "book string, mappings array<struct<pdf_page: string, logical_page: string, source: string>>")
    with pytest.raises(ValueError):
        corpus.checked_page_maps(maps)
    assert corpus.checked_page_maps(maps.limit(1)).count() == 1
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "book string, pdf_page int")
    known = spark.createDataFrame([("a", 1, None)], "book string, pdf_page int, logical_page int")
    assert corpus.join_logical_page(pages, known).count() == 2
    with pytest.raises(Exception, match="no mapping"):
        corpus.join_logical_page(pages, known, strict=True).collect()
    row = "id string, text string, metadata struct<rag_eligible: boolean, source_class: string, operation: string, source_key: string, target_page: string>"
    good, bad = ("1", "t", (True, "official_correction", "replace", "k", "3")), ("2", "", (True, "official_correction", "replace", "k", "3"))
    assert corpus.correction_documents(spark.createDataFrame([good], row)).count() == 1
    with pytest.raises(Exception, match="invalid correction row: 2"):
        corpus.correction_documents(spark.createDataFrame([good, bad], row)).collect()


def test_answer_context_brings_every_kind_of_item(spark):
    from marginalia.operators import answer

    docs = spark.createDataFrame(
        [(b, "cat", p, p + 10, c, f"{b} page {p} part {c} about dragons") for b in ("red", "blue") for p in range(1, 7) for c in (0, 1)],
        "book string, category string, pdf_page bigint, logical_page bigint, chunk bigint, text string")
    questions = spark.createDataFrame([(1, "dragons", None), (2, "nothing", None)], "query_id bigint, question string, books array<string>")
    weights = spark.createDataFrame([("red", 1.0), ("blue", 1.2)], "book string, authority double")
    hybrid = spark.createDataFrame([(q, "red", 1, 0, 0.5, 1, "r") for q in (1, 2)], "query_id bigint, book string, pdf_page bigint, chunk bigint, score double, rank bigint, reason string")
    navigation = spark.createDataFrame([(1, "blue", 2, "toc", 5.0, "目次: dragons")], "query_id bigint, book string, pdf_page bigint, source string, score double, label string")
    structured = spark.createDataFrame([(1, 1, "blue", 3, "structured", 9.0, "表・一覧検索: dragons")], "query_id bigint, rank bigint, book string, pdf_page bigint, source string, score double, label string")
    edges = spark.createDataFrame([("blue", 2, 12, 1, 14, "⇒14頁"), ("red", 1, 11, 1, 15, "⇒15頁")], "book string, pdf_page bigint, logical_page bigint, pos bigint, target bigint, label string")
    memory = spark.createDataFrame([(1, "red", 6), (2, "blue", 6)], "query_id bigint, book string, pdf_page bigint")
    a = answer.answer_context(docs, questions, weights, hybrid, navigation, structured, edges, memory)
    items = {(r["query_id"], r["source"], r["book"], r["pdf_page"]) for r in a.items.collect()}
    assert {(1, "hybrid", "red", 1), (1, "toc", "blue", 2), (1, "structured", "blue", 3), (1, "reference", "blue", 4), (1, "reference", "red", 5), (1, "chat_memory", "red", 6),
            (2, "hybrid", "red", 1), (2, "reference", "red", 5), (2, "chat_memory", "blue", 6)} <= items
    whole = [r["context_text"] for r in a.items.where("source = 'structured' AND context_text IS NOT NULL").collect()]
    assert whole and all("part 0" in t and "part 1" in t for t in whole)
    cited = {}
    for r in a.citations.collect():
        cited.setdefault(r["query_id"], []).append((r["id"], r["book"], r["pdf_page"]))
    for rows in cited.values():
        assert sorted(i for i, _, _ in rows) == list(range(1, len(rows) + 1)) and len({(b, p) for _, b, p in rows}) == len(rows)
    prompt = {r["query_id"]: r["context"] for r in a.prompt.collect()}
    assert prompt.keys() == {1, 2} and "blue page 3 part 0 about dragons\nblue page 3 part 1" in prompt[1]
    usage = {r["query_id"]: r for r in a.usage.collect()}
    assert usage[1]["structured"] >= 1 and usage[1]["reference"] >= 2 and usage[2]["navigation"] == 0


def test_listed_assets(spark, tmp_path):
    from marginalia.sources import files

    for name, size in (("P0012.jpg", 3), ("p7.JPEG", 2), ("P9.jpg", 0), ("P01.png", 1), ("xP1.jpg", 1), ("notes.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {(r["page_key"], r["name"], r["size"]) for r in files.list_assets(spark, str(tmp_path)).collect()}
    assert got == {("12", "P0012.jpg", 3), ("7", "p7.JPEG", 2)}


def test_search_over_stored_texts_writes_them_once(spark):
    from marginalia.session import scratch_folders

    docs = spark.createDataFrame([("a", 1, 0, "Alpha  beta gamma"), ("a", 2, 0, "beta delta"), ("b", 1, 0, None)], "book string, pdf_page bigint, chunk bigint, text string")
    asked = spark.createDataFrame([(1, 1, "beta gamma"), (2, 1, "delta")], "query_id bigint, variant_no bigint, query string")
    want = sorted(map(tuple, retrieval.lexical_search(docs, asked, 5).collect()))
    before = len([f for f in scratch_folders() if "/postings-" in f])
    index = retrieval.postings(docs, stored=True)
    assert sorted(map(tuple, retrieval.lexical_search(docs, asked, 5, index=index).collect())) == want
    assert len([f for f in scratch_folders() if "/postings-" in f]) == before


def test_normalization_report_is_computed_once(spark):
    def item(doc, page, line, text, x):
        return (doc, page, 595.32, "layout", text, float(x), float(x + 20), 120.0 + 12 * line)

    rows = [item("a", 1, 0, "x", 150), item("a", 1, 0, "y", 300), item("a", 1, 0, "z", 450), item("a", 1, 1, "7", 50), item("a", 1, 1, "old", 300), item("a", 1, 1, "new", 450),
            item("a", 2, 0, "loose", 300), item("a", 2, 1, "8", 50), item("a", 2, 1, "only", 300), item(None, 1, 0, "9", 50), item(None, 1, 0, "old", 300), item(None, 1, 0, "new", 450)]
    items = spark.createDataFrame(rows, "doc STRING, pdf_page BIGINT, page_width DOUBLE, extract_method STRING, text STRING, x_min DOUBLE, x_max DOUBLE, y_min DOUBLE")
    report = K.normalization_report(*K.errata_status(items))
    assert all("/report-" in f for f in report.inputFiles())  # not the records again for either review list
    got = {r.doc: (r.record_count, r.parsed_count, r.complex_count, r.diagnostic_count) for r in report.collect()}
    assert got == {"a": (3, 2, 1, 1), None: (1, 1, 0, 0)}
    numbered, left = K.errata_records(items)
    assert [(r.record_index, r.pdf_page, r.operation) for r in numbered.orderBy("record_index").collect()] == [(1, 1, "replace"), (2, 2, "complex"), (3, 1, "replace")]
    assert [(r.doc, r.text) for r in left.collect()] == [("a", "loose")]
    spaces = spark.sql("SELECT concat(unhex('c2a0e38080090a'), 'a　 b', unhex('e280a8c2850d1f')) AS c").select(F.col("c").cast("string").alias("c"))
    assert spaces.select(T.strip(F.col("c")), F.regexp_replace("c", f"^{T.WS}+|{T.WS}+$", "")).first()[:] == ("a　 b", "a　 b")


def test_stripes_do_not_grow_with_shuffle_partitions(spark):
    docs = spark.createDataFrame([("b", 1, i, t) for i, t in enumerate(("night rain", "rain on tin", "tin roof"))], "book STRING, pdf_page BIGINT, chunk BIGINT, text STRING")
    asked = spark.createDataFrame([(1, 1, "rain roof")], "query_id BIGINT, variant_no BIGINT, query STRING")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = retrieval.lexical_search(docs, asked, 3)
    want = sorted(map(tuple, found.collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500")
        index = retrieval.postings(docs)
        idf = retrieval.tfidf_fit(index).select("gram", "idf")
        queries = spark.createDataFrame([(1, 1, [], ["ra"], [1.0])], "query_id BIGINT, variant_no BIGINT, books array<string>, grams array<string>, ws array<double>")
        near = inverted.best_documents(index, idf, queries, retrieval.KEY, retrieval.ASK, 3)
        assert near.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[2:5] for r in want] == [("b", 1, 0), ("b", 1, 1), ("b", 1, 2)]
