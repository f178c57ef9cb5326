"""The operators on small messy tables: nulls, empty texts, ties, repeated rows, clashing columns, empty tables; against brute force."""

import hashlib

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chatformat, hilbert, htmlcrf, mixing, packing, perplexity, queries, simhash, substrings, tokenfile, tokens, urlrules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, length string, fp string, h string, kept string, _data string, row string"
SYLLABLES = "the an re ti on er st ou le qu en da mi é ß ".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([3, 20, 80, 200])) for _ in range(25)]
    passage = sentence(rng, 30)
    texts = [*base, *base[:6], None, "", "   ", "one", " a  b\n c\t", "x" * 300, "x" * 200, passage, base[3] + passage, passage + base[4], base[5].replace("an", "AN"), "naïve 日本 😀 " * 20]
    texts += [base[7] + " extra", "tail " + base[7], sentence(rng, 9000)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", None, "C", ""]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base[1], "en", "a", 3), (7, base[9], "fr", "b", 1)]
    return [(*r, "clash", "clash", "clash", "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_encoder_equals_library(rows):
    for name in (tokens.BYTE_VOCABULARY, tokens.WORD_VOCABULARY):
        e = tokens.encoder(name)
        for t in [*(r[1] or "" for r in rows), "a  b", "a \n b", " x  ", "a\n \tb", "It's DON'T 12a#$%\x7f", "é́ ẞİ ΣΑΣ", "<|endoftext|> a", "a\0b"]:
            assert e.encode(t) == (e.whole(t) if t else b"")


def test_fill_windows_is_tight_and_complete():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 64) for _ in range(3000))
    plan = packing.fill_windows(dict(counts), 64)
    fills, used = defaultdict(int), Counter()
    for n, first, last, times, sequence, offset in plan:
        assert first == used[n]
        used[n] = last
        for k in range(last - first):
            fills[sequence + k // times] += n
    assert used == counts and max(fills.values()) <= 64
    assert len(fills) <= 1.02 * sum(n * c for n, c in counts.items()) / 64


def test_packing(docs, rows, none):
    got = packing.pack(docs, window=64).collect()
    seen = Counter()
    encode = tokens.encoder(tokens.BYTE_VOCABULARY).encode
    want = Counter()
    for r in rows:
        ids = encode(r[1] or "") + (1).to_bytes(4, "little")
        for s in range(0, len(ids) // 4, 64):
            part = ids[4 * s : 4 * s + 256]
            want[r[0], s, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    places = defaultdict(list)
    for p in got:
        seen[p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]] += 1
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert seen == want
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        rest, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest / w * weight[s] > 3 * size[s]]
        if not over:
            target |= {s: rest / w * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.discard(s)
    source_of = {(r[0], len(words(r[1]))): r[3] for r in rows}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert {s: taken[s] for s in order} == {s: round(target[s]) for s in order}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0


def brute_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, none, spark):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = closure(fps)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    assert got == Counter((r[0], f, least.get(root)) for r, f, root in zip(rows, fps, roots))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [4, 512])
def test_links_connect_all_near_fingerprints(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # small: buckets are cut again and again
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(60, 64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    where = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(where[a]), find(where[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == closure(fps)


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.com/en/x", "https://www.example.com/en/?q", "http://a.b.NET/fr/", "http://net/es/a#b", "http://xnet/es/", "http://example.com", "http://com/", "x://y://com/", "http://examplexcom/en/", "http://www.example.com/en", "a\n://b.com/z", "http://a.b.NET/fr/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    bare = (*queries.URL_RULES, ("block", "", "/e"), ("block", "", "/z"), ("allow", "", "/fr/"))  # no whole token, or no host
    for rules, (i, u) in [(r, e) for r in (queries.URL_RULES, bare) for e in enumerate(urls)]:
        if i == 0:
            got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, rules).collect()}
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(-len(h + p), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(min(fit)[1:] if fit else (None, "allow")))
    assert urlrules.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in urlrules.judge(df, []).collect()} == {"allow"}


def test_perplexity_counts(docs, rows, none):
    got = Counter((r["doc_id"], *(r[c] for c in perplexity.COUNTS), r["base_failed"]) for r in perplexity.judge(docs).collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    assert perplexity.judge(none).count() == 0


def brute_model(texts):
    """Modified Kneser-Ney over code points by plain dictionaries: a function of the n-gram, whether or not it was seen."""
    order, start = perplexity.ORDER, perplexity.START
    levels = {order: Counter()}
    for t in texts:
        padded = start * (order - 1) + t
        levels[order].update(padded[i : i + order] for i in range(len(t)))
    for o in range(order - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    cuts = {}
    for o, grams in levels.items():
        n = Counter(grams.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        cuts[o] = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y, 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(gram):
        if not gram:
            return 1 / perplexity.CODE_POINTS
        grams, cut = levels[len(gram)], cuts[len(gram)]
        after = [n for g, n in grams.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        n = grams[gram]
        seen = n - cut[min(n, 3) - 1] if n else 0
        return (seen + sum(cut[min(m, 3) - 1] for m in after) * p(gram[1:])) / sum(after)

    def alone(gram):
        if not gram:
            return 1 / perplexity.CODE_POINTS
        if len(gram) < order and levels[len(gram)][gram] > 1:
            return p(gram)
        after, cut = [n for g, n in levels[len(gram)].items() if g[:-1] == gram[:-1]], cuts[len(gram)]
        return sum(cut[min(m, 3) - 1] for m in after) / sum(after) * alone(gram[1:])

    return p, alone, levels[order]


def test_model_equals_brute_force(spark):
    rng = random.Random(2)
    langs = {"en": [sentence(rng, 40) for _ in range(4)] + ["", "日本 a"], None: ["мир и труд " * 3, "a\0b", "x"]}
    df = spark.createDataFrame([(t, l) for l, ts in langs.items() for t in ts] + [(None, "de")], "text string, lang string")
    fitted = perplexity.fit(perplexity.hashed(perplexity.count_ngrams(df))).collect()
    assert len(fitted) == len({(r["lang"], r["gram"]) for r in fitted}) == len({r["h"] for r in fitted})
    for lang, texts in langs.items():
        p, alone, counts = brute_model([t.replace("\0", "\1") for t in texts])
        got = {r["gram"]: r for r in fitted if r["lang"] == lang}
        assert {g: r["n"] for g, r in got.items()} == counts
        assert all(abs(p(g) / r["p"] - 1) < 1e-9 and abs(alone(g) / r["alone"] - 1) < 1e-9 for g, r in got.items())
        symbols = {g[-1] for g in got}
        for context in [next(iter(got))[:-1], "qqq"]:
            assert abs(sum(p(context + c) for c in symbols) + (perplexity.CODE_POINTS - len(symbols)) * p(context + "\u4e00\u4e01"[-1]) - 1) < 1e-9
    rows = perplexity.judge(df.withColumn("doc_id", F.xxhash64("text")), carry=("text", "lang")).collect()
    for r in rows:
        t = (r["text"] or "").replace("\0", "\1")
        letters = sum(c.isalnum() for c in t)
        assert (r["perplexity"] is None) == (letters == 0)
        if letters:
            (p, alone, counts), padded = brute_model([x.replace("\0", "\1") for x in langs[r["lang"]]]), perplexity.START * 3 + t
            own = Counter(padded[i : i + 4] for i in range(len(t)))
            bits = -sum(n * math.log2((alone if n == counts[g] else p)(g)) for g, n in own.items()) / letters
            assert abs(math.log2(r["perplexity"]) - bits) < 1e-5


def test_bands_reject_noise_in_any_script_and_shuffled_words(spark, monkeypatch):
    rng = random.Random(2)
    cyrillic = "по не ро ка та ст ов ени при ал я го ми де".split()
    small, large = "the of in was by at not had been when for with".split(), [sentence(rng, 1) + "ed" for _ in range(150)]

    def russian():
        return " ".join("".join(rng.choice(cyrillic) for _ in range(rng.randint(1, 4))) for _ in range(120))

    def english():
        return " ".join(f"{rng.choice(small)} {rng.choice(large)}" for _ in range(100))

    def shuffled(t):
        w = t.split()
        rng.shuffle(w)
        return " ".join(w)

    def noise(alphabet):
        return " ".join("".join(rng.choice(alphabet) for _ in range(6)) for _ in range(120))

    texts = [(russian(), "ru") for _ in range(60)] + [(english(), "en") for _ in range(60)]
    bad = [(noise(sorted({*"".join(cyrillic)})), "ru"), (noise("theanrtioslqumd"), "en"), (shuffled(english()), "en")]
    monkeypatch.setattr(perplexity, "HELD", 50)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*texts, *bad])], "doc_id bigint, text string, lang string")
    judged = {r["doc_id"]: r for r in perplexity.judge(df).collect()}
    assert not any(r["base_failed"] for r in judged.values())
    assert {d for d, r in judged.items() if r["kept"]} == set(range(120))


def test_html_blocks_and_field(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a><li>b</ul></nav><article><h1> A &amp;\n b</h1><p>One <b>two</b>three<br>four<p>&copy;x</article><script>p</p></script><footer>end"
    assert [t for _, t, _ in htmlcrf.blocks(page)] == ["Home", "b", "A & b", "One twothree four", "©x", "end"]
    vocabulary = [sentence(random.Random(i), 1) for i in range(300)]
    field = htmlcrf.train(htmlcrf.labelled_pages(vocabulary))
    right = total = 0
    for p, y in htmlcrf.labelled_pages(vocabulary, 150, seed=77):
        d = field.decode(htmlcrf.blocks(p))
        right, total = right + sum(a == b for a, b in zip(d, y)), total + len(y)
    assert right / total > 0.97
    long = "<article>" + "".join(f"<p>{'word ' * 50}{i}.</p>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame([(0, None, "t"), (1, "", "t"), (2, page, "t"), (3, long, "t"), (4, "<p", "t"), (4, "<!-- x", None)], "page_id bigint, html string, text string")
    got = [(r["page_id"], r["text"]) for r in htmlcrf.extract(df, field).collect()]
    texts = dict(got)
    assert len(got) == 6 and texts[0] == texts[1] == "" and texts[2] == "A & b\n\nOne twothree four\n\n©x"
    assert texts[3].count("\n\n") == 2999
    assert htmlcrf.extract(df.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    field = htmlcrf.Field({}, [[0.4, -0.9], [-1.1, 0.3]], [0.2, -0.1])
    scores = [0.5, -1.0, 2.0, -0.3, 0.1]
    field.scores = lambda page: scores
    best = max(range(32), key=lambda m: sum(scores[i] for i in range(5) if m >> i & 1) + field.start[m & 1] + sum(field.transitions[m >> i & 1][m >> (i + 1) & 1] for i in range(4)))
    assert field.decode([None] * 5) == [bool(best >> i & 1) for i in range(5)]


def test_chat_format(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 5, None, None), (2, None, "assistant", "<s<s>s>␛<␛/s>␛"), (2, 5, "system<s>", ""), (3, 0, "assistant", ""), (None, 0, "assistant", "x" * 40000), (3, 0, "assistant", "é日😀\n<|endoftext|><|turn|>"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*t, "m") for t in turns], "conv_id bigint, turn bigint, role string, text string, mask string")
    got = {r["conv_id"]: r for r in chatformat.format_and_read(df).collect()}
    by = defaultdict(list)
    for t in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or "")):
        by[t[0]].append((t[2] or "", t[3] or ""))
    assert got.keys() == by.keys()
    for conv, parts in by.items():
        loss = "".join(t for r, t in parts if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(parts)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in parts).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == 3 + sum(len(chatformat.escape(x)) for p in parts for x in p) + 20 * len(parts)
    for text in ("", said, "<s>", "␛␛<␛s>", "[[INST]INST]", "<|body|>" * 3):
        assert chatformat.unescape(chatformat.escape(text)) == text and not any(c in chatformat.escape(text) for c in chatformat.CONTROL)
    assert chatformat.format_and_read(df.limit(0)).count() == 0


def brute_removed(pairs):
    first = {}
    for d, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = Counter()
    for d, t in pairs:
        b, gone = t.encode(), set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] is not None and (d is None or first[b[i : i + 50]] < d):
                gone.update(range(i, i + 50))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[d, len(b), len(gone), spans, bytes(c for i, c in enumerate(b) if i not in gone)] += 1
    return out


def test_substrings(docs, rows, none):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs).collect())
    assert got == brute_removed([(r[0], r[1] or "") for r in rows])
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_few_letters(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 90))) * rng.randint(1, 5) for _ in range(60)]
    texts += [t[rng.randint(0, 30) :] + rng.choice("ab") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(df).collect())
    assert got == brute_removed(list(enumerate(texts)))


def test_substrings_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(21)
    seen, pair = {}, None
    for passage in (sentence(rng, 40) for _ in range(100_000)):  # two texts without an id whose 64-bit hashes share their upper 24 bits
        mate = seen.setdefault(xxhash.xxh64_intdigest(passage.encode(), 42) >> 40, passage)
        if mate != passage:
            pair = mate, passage
            break
    a, b = pair
    rows = [(None, a), (None, b), (1, "x" + a[20:140]), (2, "y" + a[60:120] + b[100:180]), (2, sentence(rng, 30) + a[30:100])]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == brute_removed(rows)


def test_suffix_order_sorts_within_groups():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 500)
    group = np.sort(rng.integers(0, 9, 500))
    order = substrings.suffix_order(substrings.prefix_hashes(data), data, starts, group)
    keys = [(int(g), data[s : s + 50].tobytes()) for g, s in zip(group[order], starts[order])]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


def test_hilbert_curve_visits_neighbours():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    walk = cells[np.argsort(hilbert.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9100, [0.0] * 12), (9200, [1.0, None] + [0.0] * 10), (9300, [float("nan")] * 12), (9400, [float("inf")] + [0.0] * 11), (9500, []), (9600, [1.0, 2.0]), (9700, [1.5, 2.0]), (None, [1.0] * 12), rows[100], rows[100]]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id bigint, embedding array<float>, score string").repartition(4)
    got = defaultdict(list)
    for r in hilbert.search(df, F.col("vec_id") % 100 == 0, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 1500, 100), 9600, 9700}
    assert [v for v, _ in got[9600]] == [9700] and math.isclose(got[9600][0][1], 0.5)
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        assert all(math.isclose(d[v], s, abs_tol=1e-12) for v, s in got[q])
        hit += len({v for v, _ in got[q]} & set(best.tolist()))
    assert [v for v, _ in got[200]] == list(range(201, 211))
    assert hit >= 0.9 * 150
    assert hilbert.search(df.limit(0), F.lit(True)).count() == 0


def test_block_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, int), np.array([5]), np.zeros(5000, int), rng.integers(0, 49000, 3000), rng.zipf(1.3, 40000) % 40000, np.array([2**20 - 1, 0] * 50), np.tile(rng.integers(0, 49000, 64), 900)):
        block = tokenfile.encode_block(ids.astype(np.uint32))
        assert (tokenfile.decode_block(block) == ids).all()
    assert len(block) < 3 * len(ids)
    with pytest.raises(ValueError):
        tokenfile.decode_block(block[:-1])
    with pytest.raises(ValueError):
        tokenfile.decode_block(block[:-4] + bytes(4 * [255 ^ block[-5]]))


def test_texts_encoded_together():
    odd = [None, "", " ", "\n", "a\nb  c\n", "<|endoftext|> a b", "x\0y z", " lead", "Éa İx Σας ΣΑΣ, don't e.g. 3.14 a-b... 中文 字", "\t tab\x0b a b", "é,", "..", "A.", "word Word WORD, word***"]
    for name in (tokens.WORD_VOCABULARY, tokens.BYTE_VOCABULARY):
        encoder = tokens.Encoder(tokens.vocabulary(name))
        for texts in (odd, odd[3:8], odd[-2:], ["İx aÉ b."], [], [None]):
            want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            assert encoder.encode_all(pa.array(["-", *texts], pa.string())[1:]) == want
    encoder = tokens.Encoder(tokens.vocabulary(tokens.WORD_VOCABULARY))
    asked = []
    encoder.cache = encoder.lowered = type("Asked", (dict,), {"__missing__": lambda self, key: asked.append(key) or b"\1\0\0\0"})()
    assert encoder.encode_all(pa.array(["one two one"] * 50)) == [b"\1\0\0\0" * 3] * 50 and sorted(asked) == ["one", "two"]


def test_forgotten_chunks():
    encoder = tokens.encoder(tokens.BYTE_VOCABULARY)
    encoder.encode("a cache of words, all new")
    assert encoder.cache and encoder.parts
    tokens.forget()
    assert not (encoder.cache or encoder.parts or encoder.lowered or encoder.cache.old)
    assert encoder.encode("a cache") == np.array(encoder.tokenizer.encode("a cache", add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(docs, rows, none):
    got = tokenfile.write_and_read(docs).collect()
    encode = tokens.encoder(tokens.WORD_VOCABULARY).encode
    want = Counter((r[0], len(x) // 4, zlib.crc32(x)) for r in rows for x in [encode(r[1] or "") + (2).to_bytes(4, "little")])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert tokenfile.write_and_read(none).count() == 0


def test_pipeline_stages(spark, docs, none):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = spark.createDataFrame(stage(spark, before, "").collect(), before.schema)
        assert now.columns == docs.columns
        if name == "quality_rules":
            kept = {(r["doc_id"], r["text"]) for r in perplexity.judge(before, carry=("doc_id", "text", "lang")).where("kept").collect()}
            assert {(r["doc_id"], r["text"]) for r in now.collect()} == kept and kept
        elif name == "near_dedup":
            stay = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert sorted(map(str, stay)) == sorted(str(r["doc_id"]) for r in now.collect())
        elif name == "suffix_dedup":
            want = {(d, b.decode("utf-8", "ignore")) for (d, _, _, _, b), _ in brute_removed([(r["doc_id"], r["text"]) for r in before.collect()]).items()}
            assert {(r["doc_id"], r["text"]) for r in now.collect()} == want
        elif name == "mix_sources":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]}
            count = Counter()
            for r in now.collect():
                count[r["doc_id"]] += len(words(r["text"]))
            assert count == taken
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= now.count()
    left = none
    for _, stage in corpus_pipeline.STAGES:
        left = spark.createDataFrame(stage(spark, left, "").collect(), stage(spark, left, "").schema)
    assert left.count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = random.Random(12)
    a, b, c, d, e = (sentence(rng, 90) for _ in range(5))
    # 1 names two texts and 2 copies one of them; 3 and a null id share one; copies without any id; one alone
    rows = [(1, a), (1, b), (2, b), (3, c), (None, c), (None, d), (None, "  " + d), (None, d), (None, e), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert len({simhash.fingerprint(t) for t in (a, b, c, d, e)}) == 5 and simhash.fingerprint(d) == simhash.fingerprint("  " + d)
    got = Counter((r["doc_id"], r["text"].strip()) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == Counter([(1, a), (1, b), (3, c), (None, d), (None, e)])


def test_pipeline_keeps_clashing_columns(spark):
    rng = random.Random(13)
    a, b = sentence(rng, 90), sentence(rng, 90)
    more = ["_h", "_id", "_n", "_root", "_first", "_m", "fp", "row"]
    rows = [(1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (3, b, "en", "s", len(b))]
    df = spark.createDataFrame([(*r, *[f"{c} of {r[0]}" for c in more]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in more))
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.where("doc_id <> 2").collect()}


def test_perplexity_texts_travel_compressed(spark):
    texts = ["", None, "aä中\U0001f600\n" * 9, "word " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, _text string")
    rows = {r.doc_id: r for r in perplexity._packed(df, "_text", "_size").collect()}
    assert {k: r._size for k, r in rows.items()} == {k: len((t or "").encode()) for k, t in enumerate(texts)}
    assert len(rows[3]._text) < 1000
    part = pa.RecordBatch.from_pylist([{"_text": bytes(rows[k]._text), "_size": rows[k]._size} for k in range(4)])
    assert perplexity._unpacked(part) == [t or "" for t in texts]


def test_words_at_line_ends_are_one_chunk():
    encoder = tokens.Encoder(tokens.vocabulary(tokens.WORD_VOCABULARY))
    text = "One two.\nthree\ńfour \n\n five\r\nsix\n"
    assert encoder.encode(text) == encoder.whole(text)
    assert "two." in encoder.cache and "two.\nthree" not in encoder.cache
