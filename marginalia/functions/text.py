"""Text, query and scoring expressions. Everything here is a native Column expression."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------
# Unicode white space, spelled out because the regex class \s is ASCII-only on the JVM.
WS = (
    "[\\t\\n\\u000b\\f\\r\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
#: The characters of ``WS``.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Polite endings removed from a question.
QUERY_SUFFIXES = (
    "について詳しく教えてください", "について詳しく教えて", "について教えてください", "について教えて",
    "を詳しく教えてください", "を詳しく教えて", "を教えてください", "を教えて",
    "について説明してください", "について説明して", "を説明してください", "を説明して",
    "に関する情報を教えてください", "に関する情報を教えて", "に関する情報",
    "のルールについて", "のルール",
    "はありますでしょうか", "はありますか", "がありますでしょうか", "がありますか",
    "はあるでしょうか", "はあるか", "ありますでしょうか", "ありますか",
    "とは何ですか", "とは何", "って何ですか", "って何", "とは",
)

# Connecting phrases that separate query terms.
CONNECTORS = (
    "を使った", "を使う", "を使用した", "を使用する", "に関する", "について", "という", "として",
)

# One-character particles that are not terms of their own.
PARTICLES = ("は", "が", "を", "に", "で", "と")

# Words that mark a question about a table, list or chart.
STRUCTURED_TERMS = ("表", "一覧", "テーブル", "チャート", "早見表", "リスト")

# Words that mark a table body.
TABLE_MARKERS = ("レベル", "必要経験点", "テーブルA", "テーブルB", "合計", "経験点")

# Phrases that ask for coverage across several books.
BROAD_MARKERS = (
    "に関する情報", "関連する情報", "関連情報", "ルールを教えて", "ルールについて", "規定を教えて", "扱いを教えて",
)

# Words that mark a definition paragraph.
DEFINITION_MARKERS = ("前提", "適用", "使用", "リスク", "概要", "効果")

# Labels in front of the matched entry in a retrieval reason.
REASON_PREFIXES = ("索引: ", "目次: ", "目次セクション続き: ", "表・一覧検索: ")

# Domain vocabulary: term -> other spellings to search for.
DOMAIN_ALIASES: dict[str, tuple[str, ...]] = {
    "槍": ("スピア", "〈スピア〉"),
    "スピア": ("槍", "〈スピア〉"),
    "剣": ("ソード", "〈ソード〉"),
    "ソード": ("剣", "〈ソード〉"),
    "斧": ("アックス", "〈アックス〉"),
    "アックス": ("斧", "〈アックス〉"),
    "杖": ("スタッフ", "〈スタッフ〉"),
    "スタッフ": ("杖", "〈スタッフ〉"),
    "投擲": ("投擲武器", "〈投擲〉"),
    "流派": ("秘伝", "流派秘伝"),
    "秘伝": ("流派", "流派秘伝"),
    "両手持ち": ("2H", "1H両", "用法"),
    "両手": ("2H", "1H両"),
    "経験点テーブル": ("経験点表", "経験点", "テーブルA", "テーブルB"),
    "経験点表": ("経験点テーブル", "経験点"),
}

# Punctuation ignored by navigation matching, and the wave dashes ignored on top of it
# by correction matching.
NAV_PUNCT = "[《》〈〉「」『』\\(\\)（）\\[\\]【】・･/／：:。．,.，!?！？\\-―—]"
OVERRIDE_PUNCT = "[《》〈〉「」『』\\(\\)（）\\[\\]【】・･/／：:。．,.，!?！？\\-―—～〜~]"
SENTENCE_END = "[。．.!！?？]+$"

# Caps and weights of the ranking formulas.
MAX_VARIANTS = 6
EXCERPT_CHARS = 360
STRUCTURED_CHARS = 6000
AUTHORITY_STRENGTH = 0.20
AUTHORITY_MAX = 1.35
# -----------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and strip."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def any_contains(c: Column, words: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[c.contains(w) for w in words])


def count_contains(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))


def norm_query(q: Column, suffixes: Sequence[str] = QUERY_SUFFIXES) -> Column:
    """Question without closing punctuation and polite endings; the original if nothing is left.

    One ending is peeled per step. The longest run of endings bounds the number of
    steps, so ordinary text costs a single step.
    """
    one = "|".join(re.escape(s) for s in suffixes)
    shortest = min(len(s) for s in suffixes)

    def peel(base: Column) -> Column:
        steps = F.floor(F.length(F.regexp_extract(base, f"((?:{WS}|{one})+)$", 1)) / shortest)
        return F.aggregate(
            F.sequence(F.lit(0).cast("bigint"), steps),
            base,
            lambda s, _: strip(F.regexp_replace(s, f"(?:{one})$", "")),
        )

    peeled = let(strip(F.regexp_replace(strip(q), SENTENCE_END, "")), peel)
    return F.coalesce(F.nullif(peeled, F.lit("")), strip(q))


def norm_nav(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", ""), NAV_PUNCT, ""))


def norm_override(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", ""), OVERRIDE_PUNCT, ""))


def is_structured(q: Column, terms: Sequence[str] = STRUCTURED_TERMS) -> Column:
    return any_contains(norm_query(q), terms)


def is_broad(q: Column, markers: Sequence[str] = BROAD_MARKERS) -> Column:
    return any_contains(strip(q), markers)


def answer_guidance(
    q: Column,
    structured: Sequence[str] = STRUCTURED_TERMS,
    broad: Sequence[str] = BROAD_MARKERS,
) -> Column:
    """Which of the three instructions applies: ``table``, ``survey`` or ``direct``."""
    return F.when(is_structured(q, structured), "table").when(is_broad(q, broad), "survey").otherwise("direct")


def query_terms(q: Column, normalized: Column | None = None) -> Column:
    """Ordered distinct search terms of a question."""
    text = norm_query(q) if normalized is None else normalized
    for phrase in CONNECTORS:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.regexp_replace(text, "[、，,。]+", " ")
    words = F.filter(F.split(text, f"{WS}+"), lambda w: F.length(w) > 0)

    def parts(w: Column) -> Column:
        return let(
            F.filter(F.split(w, "の"), lambda p: F.length(p) > 0),
            lambda pieces: F.when(F.size(pieces) > 0, pieces).otherwise(F.array(w)),
        )

    flat = F.flatten(F.transform(words, parts))
    return F.array_distinct(F.filter(flat, lambda w: ~w.isin(*PARTICLES)))


def query_variants(
    q: Column,
    aliases: Mapping[str, Sequence[str]] = DOMAIN_ALIASES,
    limit: int = MAX_VARIANTS,
) -> Column:
    """The question, its joined terms and its alias replacements; ordered, distinct, at most ``limit``."""
    amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    none = F.array().cast("array<string>")

    def with_terms(base: Column, terms: Column) -> Column:
        def replace_at(t: Column, i: Column) -> Column:
            return F.transform(
                F.coalesce(F.try_element_at(amap, t), none),
                lambda a: F.array_join(F.transform(terms, lambda u, j: F.when(j == i, a).otherwise(u)), " "),
            )

        in_text = [
            F.when(base.contains(k), F.array(*[F.replace(base, F.lit(k), F.lit(a)) for a in v])).otherwise(none)
            for k, v in aliases.items()
        ]
        joined = F.when(F.size(terms) >= 2, F.array(F.array_join(terms, " "))).otherwise(none)
        everything = F.concat(F.array(base), joined, F.flatten(F.transform(terms, replace_at)), *in_text)
        clean = F.filter(F.transform(everything, squeeze), lambda v: F.length(v) > 0)
        return F.slice(F.array_distinct(clean), 1, limit)

    picked = let(norm_query(q), lambda base: let(query_terms(q, base), lambda terms: with_terms(base, terms)))
    return let(picked, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(q))))


def ngrams(q: Column, n: int) -> Column:
    """Distinct character n-grams of a string of at least ``n`` characters."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(q) - (n - 1)), lambda i: F.substring(q, i, F.lit(n)))
    )


def ngram_coverage(q: Column, text: Column, n: int = 2) -> Column:
    """Share of the distinct n-grams of ``q`` that occur in ``text``."""
    share = let(ngrams(q, n), lambda grams: F.size(F.filter(grams, lambda g: F.contains(text, g))) / F.size(grams))
    return (
        F.when((F.length(q) == 0) | (F.length(text) == 0), F.lit(0.0))
        .when(F.length(q) < n, F.contains(text, q).cast("double"))
        .otherwise(share)
    )


def reason_terms(reason: Column) -> Column:
    """The matched entry named by a retrieval reason, as a list of at most one term."""
    pattern = "(?s)^(?:" + "|".join(re.escape(p) for p in REASON_PREFIXES) + ")(.*)$"
    value = strip(F.element_at(F.split(F.regexp_extract(reason, pattern, 1), " /"), 1))
    return F.filter(F.array(value), lambda v: F.length(v) > 0)


def chunk_relevance(
    text: Column,
    q_norm: Column,
    terms_norm: Column,
    authority: Column,
    chunk: Column,
    prefer_page_start: Column | None = None,
) -> Column:
    """Closeness of a chunk to a question. All text arguments are already ``norm_nav``-ed."""
    whole = F.when(F.length(q_norm) == 0, F.lit(0.0)).otherwise(
        F.when(F.contains(text, q_norm), F.lit(25.0) + F.least(F.lit(8.0), occurrences(text, q_norm) * 2.0)).otherwise(0.0)
        + ngram_coverage(q_norm, text, 2) * 12.0
        + F.when(F.length(q_norm) >= 4, ngram_coverage(q_norm, text, 3) * 8.0).otherwise(0.0)
    )

    def term_score(t: Column) -> Column:
        return (
            F.when(F.length(t) == 0, F.lit(0.0))
            .when(F.contains(text, t), F.lit(18.0) + F.least(F.lit(6.0), occurrences(text, t) * 1.5))
            .otherwise(ngram_coverage(t, text, 2) * 6.0)
        )

    by_terms = F.aggregate(terms_norm, F.lit(0.0), lambda acc, t: acc + term_score(t))
    start = F.lit(0.0)
    if prefer_page_start is not None:
        start = F.when(prefer_page_start & (chunk == 0), 5.0).otherwise(0.0)
    return (whole + by_terms + start) * authority


def excerpt(raw: Column, terms: Column, max_chars: int = EXCERPT_CHARS) -> Column:
    """A window of ``max_chars`` characters centred on the earliest term hit, with ellipses.

    At the same position the longest term decides the centre.
    """

    def wanted(text: Column) -> Column:
        hits = F.filter(
            F.transform(
                F.filter(terms, lambda t: F.length(t) > 0),
                lambda t: F.struct(F.instr(text, t).alias("p"), (-F.length(t)).alias("l")),
            ),
            lambda h: h["p"] > 0,
        )
        return let(F.array_min(hits), lambda h: h["p"] - 1 + F.floor(-h["l"] / 2) - max_chars // 2)

    return let(squeeze(F.coalesce(raw, F.lit(""))), lambda text: _window(text, wanted(text), max_chars))


def _window(text: Column, wanted: Column, size: int) -> Column:
    """The text, or ``size`` characters of it from ``wanted`` on, marked with ellipses where it was cut."""

    def cut(start: Column) -> Column:
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            F.substring(text, (start + 1).cast("int"), F.lit(size)),
            F.when(start + size < F.length(text), "…").otherwise(""),
        )

    start = F.greatest(F.lit(0), F.least(F.coalesce(wanted, F.lit(0)), F.length(text) - size))
    return F.when(F.length(text) <= size, text).otherwise(let(start, cut))


def structured_excerpt(raw: Column, terms: Column, max_chars: int = STRUCTURED_CHARS) -> Column:
    """The whole page text, or a window that starts a fifth before the earliest term hit."""

    def wanted(text: Column) -> Column:
        found = F.transform(F.filter(terms, lambda t: F.length(t) > 0), lambda t: F.instr(text, t))
        return F.array_min(F.filter(found, lambda p: p > 0)) - 1 - max_chars // 5

    return let(strip(F.coalesce(raw, F.lit(""))), lambda text: _window(text, wanted(text), max_chars))


def authority(weight: Column) -> Column:
    """Source weight to score factor."""
    return F.least(F.lit(AUTHORITY_MAX), F.lit(1.0) + F.greatest(F.lit(0.0), weight - 1.0) * AUTHORITY_STRENGTH)


def citation_markers(answer: Column) -> Column:
    """Rewrite full-width and long citation marks to ``[Cn]``."""
    long_form = F.regexp_replace(answer, "(?i)\\[CITATION[\\\\]?:C(\\d+)\\]", "[C$1]")
    return F.regexp_replace(long_form, "(?i)[\\[［][CcＣｃ](\\d+)[\\]］]", "[C$1]")


def citation_ids(answer: Column) -> Column:
    """Ordered distinct citation numbers used in an answer."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("\\[C(\\d+)\\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: v.cast("bigint")))


def norm_heading(c: Column) -> Column:
    """Heading without white space and leader dots."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", ""), "^[・･.…⋯\\-―ー]+|[・･.…⋯\\-―ー]+$", "")


def norm_term_key(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def norm_index_type(c: Column, suffix: str = "索引") -> Column:
    h = norm_heading(c)
    return F.when(h.endswith(suffix), h).otherwise(F.lit(suffix))


def page_number_candidates(text: Column, tail: int = 10, low: int = 1, high: int = 1000) -> Column:
    """Numbers that stand alone on one of the last non-empty lines; ordered, distinct."""
    lines = F.filter(F.transform(F.split(text, "\\r\\n|[\\n\\r\\u000b\\f\\u001c-\\u001e\\u0085\\u2028\\u2029]"), strip),
                     lambda s: F.length(s) > 0)
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (tail - 1)), F.lit(tail))
    numbers = F.transform(F.filter(last, lambda s: s.rlike("^[0-9]{1,4}$")), lambda s: s.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= low) & (n <= high)))


def auto_title(question: Column, width: int = 40, default: str = "新しいチャット") -> Column:
    compact = squeeze(F.coalesce(question, F.lit("")))
    short = F.concat(F.substring(compact, 1, width), F.when(F.length(compact) > width, "…").otherwise(""))
    return F.when(F.length(compact) == 0, F.lit(default)).otherwise(short)


def page_label(page: Column, unit: str = "頁", none: str = "ページ指定なし") -> Column:
    return F.coalesce(F.concat(page.cast("string"), F.lit(unit)), F.lit(none))


def source_title(key: Column, titles: Mapping[str, str] | None = None, default: str = "") -> Column:
    """Title of a source key: the given title map, else the key with blanks for underscores."""
    out = F.replace(key, F.lit("_"), F.lit(" "))
    if titles:
        tmap = F.create_map(*[x for k, v in titles.items() for x in (F.lit(k), F.lit(v))])
        out = F.coalesce(F.try_element_at(tmap, key), out)
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, F.lit(default)).otherwise(out)
