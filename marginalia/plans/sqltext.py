"""SQL spellings of the text expressions, for the DuckDB side of a check."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

NAV = "[《》〈〉「」『』\\(\\)（）\\[\\]【】・･/／：:。．,.，!?！？\\-―—]"
OVERRIDE = "[《》〈〉「」『』\\(\\)（）\\[\\]【】・･/／：:。．,.，!?！？\\-―—～〜~]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def nav(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '\\s+', '', 'g'), '{NAV}', '', 'g'))"


def override(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '\\s+', '', 'g'), '{OVERRIDE}', '', 'g'))"


def norm_query(x: str, suffixes: Sequence[str] = ()) -> str:
    base = strip(f"regexp_replace({strip(x)}, '[。．.!！?？]+$', '')")
    if not suffixes:
        return f"coalesce(nullif({base}, ''), {strip(x)})"
    one = "|".join(re.escape(s) for s in suffixes)
    step = strip(f"regexp_replace(acc, '(?:{one})$', '')")
    peeled = f"list_reduce(list_prepend({base}, list_transform(generate_series(1, 60), lambda i: '')), lambda acc, i: {step})"
    return f"coalesce(nullif({peeled}, ''), {strip(x)})"


def distinct(xs: str) -> str:
    """Ordered distinct of a list expression."""
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


def terms_list(normalized: str) -> str:
    """All terms in order, repeats included; ``normalized`` is a norm_query result."""
    return (f"list_filter(string_split_regex(regexp_replace({normalized}, '[、，,。]+', ' ', 'g'), '\\s+'), "
            "lambda w: w <> '')")


def any_of(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def count_of(x: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INT)" for w in words) + ")"


def coverage(q: str, t: str, n: int = 2) -> str:
    """q and t should be column names: they are repeated."""
    grams = f"list_distinct(list_transform(generate_series(1, length({q}) - {n - 1}), lambda i: substring({q}, CAST(i AS BIGINT), {n})))"
    return (f"(CASE WHEN length({q}) = 0 OR length({t}) = 0 THEN 0.0::DOUBLE WHEN length({q}) < {n} THEN CAST(contains({t}, {q}) AS DOUBLE) "
            f"ELSE len(list_filter({grams}, lambda g: contains({t}, g)))::DOUBLE / len({grams}) END)")


def occurrences(t: str, w: str) -> str:
    return f"((length({t}) - length(replace({t}, {w}, ''))) // length({w}))"


def relevance(t: str, q: str, terms: str, authority: str, start: str = "0.0") -> str:
    """t, q: column names of norm_nav texts; terms: column with a list of norm_nav terms."""
    term = (f"CASE WHEN length(w) = 0 THEN 0.0::DOUBLE WHEN contains({t}, w) THEN 18.0 + least(6.0, {occurrences(t, 'w')} * 1.5) "
            f"ELSE {coverage('w', t)} * 6.0 END")
    return (f"((CASE WHEN length({q}) = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN contains({t}, {q}) THEN 25.0 + least(8.0, {occurrences(t, q)} * 2.0) ELSE 0.0 END) "
            f"+ {coverage(q, t)} * 12.0 + (CASE WHEN length({q}) >= 4 THEN {coverage(q, t, 3)} * 8.0 ELSE 0.0 END) END "
            f"+ coalesce(list_sum(list_transform({terms}, lambda w: {term})), 0.0) + {start}) * {authority})")


def excerpt(raw: str, terms: str, size: int = 360) -> str:
    """raw: column with squeezed text; terms: list expression."""
    hits = (f"list_sort(list_filter(list_transform(list_filter({terms}, lambda t: length(t) > 0), "
            f"lambda t: {{'p': instr({raw}, t), 'l': -length(t)}}), lambda h: h.p > 0))")
    center = f"({hits}[1].p - 1 + (-({hits}[1].l)) // 2)"
    start = f"greatest(0, least(greatest(0, coalesce({center} - {size // 2}, 0)), length({raw}) - {size}))"
    return (f"CASE WHEN length({raw}) <= {size} THEN {raw} ELSE (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || "
            f"substring({raw}, CAST({start} + 1 AS BIGINT), {size}) || (CASE WHEN {start} + {size} < length({raw}) THEN '…' ELSE '' END) END")


def structured_excerpt(raw: str, terms: str, size: int) -> str:
    first = f"list_min(list_filter(list_transform(list_filter({terms}, lambda t: length(t) > 0), lambda t: instr({raw}, t)), lambda p: p > 0))"
    start = f"greatest(0, least(greatest(0, coalesce({first} - 1 - {size // 5}, 0)), length({raw}) - {size}))"
    return (f"CASE WHEN length({raw}) <= {size} THEN {raw} ELSE (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || "
            f"substring({raw}, CAST({start} + 1 AS BIGINT), {size}) || (CASE WHEN {start} + {size} < length({raw}) THEN '…' ELSE '' END) END")


def variants(normalized: str, terms: str, aliases: Mapping[str, Sequence[str]], limit: int = 6) -> str:
    """normalized, terms: column names."""
    parts = [f"[{normalized}]", f"CASE WHEN len({terms}) >= 2 THEN [array_to_string({terms}, ' ')] ELSE [] END"]
    branches = " ".join(
        f"WHEN t = '{k}' THEN [" + ", ".join(
            f"array_to_string(list_transform({terms}, lambda u, j: CASE WHEN j = i THEN '{a}' ELSE u END), ' ')" for a in v) + "]"
        for k, v in aliases.items())
    if branches:
        parts.append(f"flatten(list_transform({terms}, lambda t, i: CASE {branches} ELSE CAST([] AS VARCHAR[]) END))")
    for k, v in aliases.items():
        parts.append(f"CASE WHEN contains({normalized}, '{k}') THEN [" + ", ".join(f"replace({normalized}, '{k}', '{a}')" for a in v)
                     + "] ELSE CAST([] AS VARCHAR[]) END")
    clean = f"list_transform(list_concat({', '.join(parts)}), lambda v: {squeeze('v')})"
    return f"list_slice({distinct(clean)}, 1, {limit})"
