"""Hand-made cases of the text rules."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.splitter import split_text
from marginalia.operators import corrections as K
from marginalia.operators import crawl as W


def values(spark, items, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i INT, v STRING")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_norm_query(spark):
    got = values(spark, ["経験点テーブルについて教えて。", "とはありますか", "とは", "槍を使った流派はありますか？"], T.norm_query)
    assert got == ["経験点テーブル", "と", "とは", "槍を使った流派"]


def test_terms_and_variants(spark):
    assert values(spark, ["槍を使った流派はありますか？"], T.query_terms) == [["槍", "流派"]]
    assert values(spark, ["槍を使った流派はありますか？"], T.query_variants)[0] == [
        "槍を使った流派", "槍 流派", "スピア 流派", "〈スピア〉 流派", "槍 秘伝", "槍 流派秘伝"]


def test_structured_and_guidance(spark):
    assert values(spark, ["経験点テーブル", "両手持ちに関する情報を教えて", "マルチアクション"], T.answer_guidance) == ["table", "survey", "direct"]


def test_citation_markers(spark):
    assert values(spark, ["[CITATION:C1]［C2］[Ｃ3]"], T.citation_markers) == ["[C1][C2][C3]"]
    assert values(spark, ["a [C2][C1][C2]"], T.citation_ids) == [[2, 1]]


def test_page_numbers(spark):
    assert values(spark, ["5\nx\n5\n9\n1001\n٣"], T.page_number_candidates) == [[5, 9]]


def test_notes_and_truncation(spark):
    got = values(spark, ["〇蛇の身体※アイコンを追記", "※のみ", "なし"], K.split_note)
    assert [(r.main, r.note) for r in got] == [("〇蛇の身体", "※アイコンを追記"), ("※のみ", None), ("なし", None)]
    assert values(spark, ["剣の", "「開く", "「閉」", "a"], K.truncated) == [True, True, False, False]


def test_canonical_url(spark):
    assert values(spark, ["HTTP://Ex.com:80/a#f", "mailto:x", "https://Ex.com", "http://ex.com:81/?q=1"], W.canonical_url) == [
        "http://ex.com/a", None, "https://ex.com/", "http://ex.com:81/?q=1"]
    base = F.lit("http://ex.com/d/e/f.html?x#y")
    assert values(spark, ["../b", "/c", "g", "?z", "//o.org/p", "./h/../i"], lambda c: W.canonical_url(c, base)) == [
        "http://ex.com/d/b", "http://ex.com/c", "http://ex.com/d/e/g", "http://ex.com/d/e/f.html?z", "http://o.org/p", "http://ex.com/d/e/i"]


def test_excerpt(spark):
    long = "x" * 500 + "needle" + "y" * 500
    got = values(spark, [long], lambda c: T.excerpt(c, F.array(F.lit("needle")), 100))[0]
    assert "needle" in got and got.startswith("…") and got.endswith("…") and len(got) == 102


def test_splitter():
    seps = ["\n\n", "\n", "。", "、", " ", ""]
    assert split_text("短い", 500, 100, seps) == ["短い"]
    pieces = split_text("x" * 1200, 500, 100, seps)
    assert pieces == ["x" * 500, "x" * 500, "x" * 400]
    pieces = split_text(" ".join(f"w{i}" for i in range(400)), 100, 20, seps)
    assert all(len(p) <= 100 for p in pieces)
    assert pieces[1].split()[0] in pieces[0].split()
