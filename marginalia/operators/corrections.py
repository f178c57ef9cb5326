"""Layout rows to typed correction records, their quality, chunks and reports."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marginalia.functions import text as T
from marginalia.operators.ranking import positions_in
from marginalia.session import written

# --- Fixed values: layout ratios, tolerances and marker lists (order matters) ---
COLUMN_CUTS = (125.0 / 595.32, 270.0 / 595.32, 415.0 / 595.32)
BAND_TOLERANCE, TABLE_GAP, HEADER_Y = 2.2, 6.0, 100.0
COLUMN_TITLES = ("ページ", "場所", "誤", "正")
DELETE_MARKERS = ("を削除", "以下の２文を削除", "以下の文を削除", "一文を削除", "以下の項目を", "項目ごと削除")
FULLTEXT_MARKERS = ("全文を以下に差し替え", "効果全文を以下に差し替え", "表を以下に差し替え")
APPEND_MARKERS = (
    "※末尾に以下の一文を追記", "末尾に以下の一文を追記", "以下の文を追記", "以下の一文を追記", "※末尾に", "※追記", "を追記", "末尾に",
    "冒頭に以下を追加", "以下の一文を追加", "以下の文を追加", "の後に以下の一文を追加", "の後に以下の１文を追加", "を追加",
)
EDITORIAL_MARKERS = (
    "再修正で", "再度の修正になります", "度重なる修正において", "ご迷惑をおかけし", "お詫び申し上げます", "以下は同一誤字の修正になります",
)
OPEN_ENDINGS = ("修", "の", "に", "を", "へ", "が", "は", "で", "と", "（", "「", "〈", "《", "【")
BRACKETS = (("（", "）"), ("「", "」"), ("〈", "〉"), ("《", "》"), ("【", "】"))
# ----------------------------------------------------------------------------------

RESCUED = "rescued_from_diagnostic"


def _s(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _filled(c: Column) -> Column:
    return F.length(T.strip(F.coalesce(c, F.lit("")))) > 0


# ---- layout -------------------------------------------------------------------

def classify_source(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(low.contains("faq"), "FAQ").when(low.contains("additional"), "ADDITIONAL_DATA")
            .when(low.contains("_eratta") | low.contains("-eratta"), "ERRATA").otherwise("OTHER"))


def source_key(name: Column) -> Column:
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    return F.regexp_replace(stem, "(?i)(?:_eratta|_faq|_additional(?:_20)?data)$", "")


def cell(c: Column) -> Column:
    """Text of one layout item: wide blanks become blanks, ends are stripped."""
    return T.strip(F.translate(F.coalesce(c, F.lit("")), "　 ", "  "))


def errata_sources(files: DataFrame, name: str, excluded: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Files that are errata by their name, with their source ``key``: without the excluded keys and, if ``only`` is given, with its keys alone."""
    keyed = files.where(classify_source(F.col(name)) == "ERRATA").withColumn("key", source_key(F.col(name)))
    kept = keyed.join(excluded.select("key"), "key", "left_anti")
    return kept if only is None else kept.join(only.select("key"), "key", "left_semi")


def column_by_x(x: Column, width: Column) -> Column:
    r = x / width
    return F.when(r < COLUMN_CUTS[0], "page").when(r < COLUMN_CUTS[1], "location").when(r < COLUMN_CUTS[2], "before").otherwise("after")


def is_header(item_text: Column, y_min: Column, width: Column) -> Column:
    t = cell(item_text)
    return (t == "") | t.rlike("(?i)^p\\.\\s*[0-9]+$") | t.isin(*COLUMN_TITLES) | ((y_min < HEADER_Y) & (width > 100))


def page_token(item_text: Column) -> Column:
    """Digits of an optional-star page number, or an empty string."""
    return F.regexp_extract(F.replace(cell(item_text), F.lit(" "), F.lit("")), "^[★☆]?([0-9]{1,4})$", 1)


def starred(item_text: Column) -> Column:
    return F.replace(cell(item_text), F.lit(" "), F.lit("")).rlike("^[★☆]")


@F.pandas_udf(ArrayType(LongType()))
def _bands(pages: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Band number of every y of a page, given in order."""
    def one(ys, limit):
        band, total, n, out = -1, 0.0, 0, []
        for y in ys:
            if n and abs(y - total / n) <= limit:
                total, n = total + y, n + 1
            else:
                band, total, n = band + 1, y, 1
            out.append(band)
        return out

    return pd.Series([one(ys, limit) for ys, limit in zip(pages, tolerance)])


def y_bands(items: DataFrame, tolerance: float = BAND_TOLERANCE) -> DataFrame:
    """Adds ``band``: greedy rows by the running mean of y, top to bottom.

    The running mean depends on earlier choices, which no window frame expresses. A page is
    packed into one sorted array, so Arrow batches carry many pages at a time.
    """
    rest = [c for c in items.columns if c not in ("doc", "pdf_page", "y_min", "x_min", "text")]
    pages = items.groupBy("doc", "pdf_page").agg(
        F.array_sort(F.collect_list(F.struct("y_min", "x_min", "text", *rest))).alias("_i"))
    banded = pages.withColumn("_b", _bands(F.col("_i.y_min"), F.lit(tolerance)))
    return banded.select("doc", "pdf_page", F.inline(F.arrays_zip(F.col("_i").alias("item"), F.col("_b").alias("band")))).select(
        "doc", "pdf_page", "item.*", "band")


def banded_items(items: DataFrame) -> DataFrame:
    """Content items with band, column, page number and the running record number of their page; ``tokens``, the page numbers in the band;
    ``gap``, the space to the item before it in its band and column.

    Pages are shuffled once: every window is on a page or a part of one.
    """
    body = y_bands(items.where(~is_header(F.col("text"), F.col("y_min"), F.col("page_width")))).repartition("doc", "pdf_page")
    token = F.when(F.col("column") == "page", page_token(F.col("text"))).otherwise("")
    marked = body.withColumn("column", column_by_x(F.col("x_min"), F.col("page_width"))).withColumn("_token", token)
    row = Window.partitionBy("doc", "pdf_page").orderBy("band")
    upto = row.rangeBetween(Window.unboundedPreceding, 0)
    in_band = Window.partitionBy("doc", "pdf_page", "band").orderBy("x_min", "text")
    first = (F.col("_token") != "") & (F.sum((F.col("_token") != "").cast("int")).over(in_band.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    done = marked.withColumn("_first", first.cast("int")).withColumn("record", F.sum("_first").over(upto)).withColumn("at", F.row_number().over(in_band))
    of_column = Window.partitionBy("doc", "pdf_page", "band", "column").orderBy("x_min", "text")
    return done.withColumn("tokens", F.sum((F.col("_token") != "").cast("int")).over(in_band.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "gap", F.col("x_min") - F.lag("x_max").over(of_column))


def _table_gap() -> Column:
    return F.coalesce(F.max(F.col("column").isin("location", "before", "after") & (F.col("gap") >= TABLE_GAP)), F.lit(False)).alias("internal_table_detected")


def internal_table(banded: DataFrame) -> DataFrame:
    """Records with two separate items of one column in one row, at least ``TABLE_GAP`` apart."""
    return banded.where(F.col("column").isin("location", "before", "after")).groupBy("doc", "pdf_page", "record").agg(_table_gap())


def carry_forward(banded: DataFrame, tables: bool = False) -> DataFrame:
    """Cells and raw text of every record: rows belong to the latest page number above them. A group is one record.

    ``tables`` adds what ``internal_table`` says of it, from the same groups.
    """
    rank = F.when(F.col("column") == "location", 0).when(F.col("column") == "before", 1).otherwise(2)
    used = banded.where(F.col("record") > 0).withColumn("_rank", rank).withColumn("_cell", cell(F.col("text")))
    content = F.col("column").isin("location", "before", "after") & (F.col("_cell") != "")
    entry = F.struct("band", "_rank", "at", "column", "_cell")
    rows = used.groupBy("doc", "pdf_page", "record").agg(
        F.max_by("_token", "_first").alias("_page"), F.max_by("text", "_first").alias("_mark"),
        F.array_sort(F.collect_list(F.when(content, entry))).alias("_cells"), F.max("extract_method").alias("extract_method"), *([_table_gap()] if tables else []))
    joined = lambda name: F.nullif(T.strip(F.array_join(
        F.transform(F.filter("_cells", lambda c: c["column"] == name), lambda c: c["_cell"]), "")), F.lit(""))
    raw = F.aggregate(
        "_cells", F.struct(_s("").alias("t"), F.lit(-1).cast("bigint").alias("b")),
        lambda acc, c: F.struct(
            F.concat(acc["t"], F.when(acc["b"] < 0, "").when(acc["b"] == c["band"], " | ").otherwise("\n"), c["column"], F.lit(":"), c["_cell"]).alias("t"),
            c["band"].cast("bigint").alias("b")))
    return rows.select(
        "doc", "pdf_page", "record", F.col("_page").cast("bigint").alias("target_page"), starred(F.col("_mark")).alias("starred"),
        joined("location").alias("location"), joined("before").alias("before"), joined("after").alias("after"),
        raw["t"].alias("raw_text"), "extract_method", *(["internal_table_detected"] if tables else []))


def diagnostics(banded: DataFrame) -> DataFrame:
    """Rows above the first page number of a page, and rows with several page numbers."""
    rows = banded.where((F.col("record") == 0) | (F.col("tokens") > 1)).groupBy("doc", "pdf_page", "band").agg(
        F.max("record").alias("_r"), F.max("tokens").alias("_n"), F.min("y_min").alias("y_min"),
        F.array_sort(F.collect_list(F.struct("at", cell(F.col("text")).alias("t"), "_token"))).alias("_i"))
    text = F.array_join(F.transform(F.filter("_i", lambda i: i["t"] != ""), lambda i: i["t"]), " | ")
    tokens = F.array_join(F.transform(F.filter("_i", lambda i: i["_token"] != ""), lambda i: i["t"]), " | ")
    loose = rows.where("_r = 0").select("doc", "pdf_page", "band", F.lit("UNASSIGNED_ROW").alias("type"), "y_min", text.alias("text"))
    several = rows.where("_n > 1").select("doc", "pdf_page", "band", F.lit("MULTIPLE_PAGE_TOKENS_SAME_Y").alias("type"), "y_min", tokens.alias("text"))
    return loose.where("text <> ''").unionByName(several)


# ---- classification --------------------------------------------------------------

def split_note(c: Column) -> Column:
    """(main, note) cut at the first ※ that does not open the text."""
    return T.let(T.strip(c), lambda v: F.when(F.instr(v, "※") > 1, F.struct(
        F.nullif(F.regexp_replace(F.substring_index(v, "※", 1), f"{T.WS}+$", ""), F.lit("")).alias("main"),
        F.substring(v, F.instr(v, "※"), F.length(v)).alias("note"))).otherwise(F.struct(v.alias("main"), _s().alias("note"))))


def split_editorial(c: Column) -> Column:
    """(main, note) cut at the earliest editorial apology."""
    def cut(v: Column) -> Column:
        at = F.array_min(F.filter(F.array(*[F.instr(v, m) for m in EDITORIAL_MARKERS]), lambda p: p > 0))
        return F.when(at.isNotNull(), F.struct(
            F.nullif(F.regexp_replace(F.substring(v, F.lit(1), at - 1), f"{T.WS}+$", ""), F.lit("")).alias("main"),
            F.substring(v, at, F.length(v)).alias("note"))).otherwise(F.struct(v.alias("main"), _s().alias("note")))

    return T.let(T.strip(c), cut)


def truncated(c: Column) -> Column:
    """The text ends in a particle or opening bracket, or leaves a bracket open."""
    def test(v: Column) -> Column:
        out = F.right(v, F.lit(1)).isin(*OPEN_ENDINGS)
        count = lambda b: F.length(v) - F.length(F.replace(v, F.lit(b), F.lit("")))
        for opening, closing in BRACKETS:
            out = out | (v.contains(opening) & (count(opening) > count(closing)))
        return (F.length(v) >= 2) & out

    return F.coalesce(T.let(T.strip(c), test), F.lit(False))


def first_marker(c: Column, markers) -> Column:
    """First marker of the list that occurs in the text, or null."""
    return F.coalesce(*[F.when(c.contains(m), F.lit(m)) for m in markers], _s())


def _after(c: Column, marker: Column) -> Column:
    return F.substring(c, F.instr(c, marker) + F.length(marker), F.length(c))


def _before(c: Column, marker: Column) -> Column:
    return F.substring(c, F.lit(1), F.instr(c, marker) - 1)


_RESULT = ("operation", "append_instruction", "append_text", "append_location", "delete_instruction", "delete_text", "delete_location", "note", "normalized_after")


def _outcome(**fields: Column) -> Column:
    return F.struct(*[(fields[n] if n in fields else _s()).cast("string").alias(n) for n in _RESULT])


def classify(records: DataFrame) -> DataFrame:
    """Operation and payload of every record by ordered rules; unknown shapes become ``complex``."""
    r = records.withColumn("_loc", split_editorial(F.col("location")))
    r = r.withColumn("location", F.coalesce("_loc.main", "location"))
    before, after, location = F.col("before"), F.col("after"), F.col("location")
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    one = F.when(F.length(b) > 0, b).otherwise(a)
    quoted = lambda c, marks: F.regexp_extract(c, f"(?s)([{marks[0]}].+[{marks[1]}])", 1)
    strip_star = lambda c: T.strip(F.regexp_replace(c, "^※+", ""))

    r = r.withColumn("_n", split_note(after)).withColumn("_e", split_editorial(F.col("_n.main")))
    joined_note = F.nullif(F.concat_ws(" ", "_n.note", "_e.note"), F.lit(""))
    main = F.coalesce("_e.main", F.lit(""))
    replaced = F.when(main.startswith("※"), _outcome(operation=F.lit("complex"), note=main)).otherwise(
        _outcome(operation=F.lit("replace"), normalized_after=F.col("_e.main"), note=joined_note))

    item_delete = _outcome(
        operation=F.lit("delete"), delete_instruction=F.lit("項目ごと削除"), delete_location=location,
        delete_text=F.nullif(F.regexp_extract(F.coalesce(location, F.lit("")), f"「([^」]+)」{T.WS}*$", 1), F.lit("")))

    r = r.withColumn("_src", one).withColumn("_dm", first_marker(one, DELETE_MARKERS))
    src, dm = F.col("_src"), F.col("_dm")
    listed = F.regexp_extract(src, "(?s)から削除(.+)$", 1)
    r = r.withColumn("_listed", F.when(dm == "以下の項目を", T.strip(listed)).otherwise("")).withColumn("_has_list", (dm == "以下の項目を") & (F.length(listed) > 0)) \
        .withColumn("_q", quoted(src, "「『 」』".split())).withColumn("_prefix", T.strip(_before(src, dm))).withColumn("_suffix", T.strip(_after(src, dm)))
    r = r.withColumn("_tail_note", T.strip(F.substring("_listed", F.instr("_listed", "※") + 1, F.length("_listed"))))
    deleted = F.when(F.col("_has_list"), _outcome(
        operation=F.lit("delete"), delete_location=location,
        delete_instruction=F.nullif(T.strip(F.concat(F.substring_index(src, "から削除", 1), F.lit("から削除"))), F.lit("")),
        delete_text=F.nullif(T.strip(F.substring_index("_listed", "※", 1)), F.lit("")),
        note=F.when(F.col("_listed").contains("※") & (F.length("_tail_note") > 0), F.concat(F.lit("※"), "_tail_note")),
    )).when(F.col("_q") != "", _outcome(
        operation=F.lit("delete"), delete_location=location, delete_text=F.col("_q"),
        delete_instruction=F.coalesce(F.nullif(T.strip(_before(src, F.col("_q"))), F.lit("")), dm),
    )).otherwise(_outcome(
        operation=F.lit("delete"), delete_location=location, delete_instruction=dm,
        delete_text=F.nullif(F.when(F.col("_suffix").contains("※") | (F.col("_suffix") == ""), strip_star(F.col("_prefix"))).otherwise(F.col("_suffix")), F.lit("")),
        note=F.when(F.col("_suffix").contains("※"), F.substring("_suffix", F.instr("_suffix", "※"), F.length("_suffix"))),
    ))

    rest = lambda m: T.strip(_after(src, F.lit(m)))
    full = F.coalesce(*[F.when(src.contains(m) & (F.length(rest(m)) > 0), F.struct(F.lit(m).alias("m"), rest(m).alias("t"))) for m in FULLTEXT_MARKERS])
    r = r.withColumn("_full", full)

    found = F.coalesce(*[F.when(b.contains(m), F.struct(F.lit(m).alias("m"), b.alias("s"))).when(a.contains(m), F.struct(F.lit(m).alias("m"), a.alias("s"))) for m in APPEND_MARKERS])
    r = r.withColumn("_am", found)
    am, asrc = F.col("_am.m"), F.col("_am.s")
    r = r.withColumn("_head", _before(asrc, am))
    blank_head = ~_filled(F.col("_head"))
    r = r.withColumn("_instr", F.when(blank_head, am).otherwise(T.strip(F.concat("_head", am)))).withColumn(
        "_t0", T.strip(F.when(blank_head, F.substring(asrc, F.length(am) + 1, F.length(asrc))).otherwise(_after(asrc, am))))
    r = r.withColumn("_aq", quoted(asrc, "「『【 」』】".split()))
    r = r.withColumn("_t1", F.when(F.col("_t0") != "", F.col("_t0")).when(F.col("_aq") != "", F.col("_aq")).when(
        asrc.contains("追加。"), T.strip(_after(asrc, F.lit("追加。")))).otherwise(""))
    tail_item = F.regexp_extract(asrc, "(?s)※末尾に(.+?)を追記", 1)
    shaped = (
        F.when((am == "末尾に") & (F.col("_aq") != ""), F.struct(F.lit("末尾に追加").alias("i"), F.col("_aq").alias("t")))
        .when((am == "※末尾に") & (tail_item != ""), F.struct(F.lit("末尾に追記").alias("i"), T.strip(tail_item).alias("t")))
        .otherwise(F.struct(F.col("_instr").alias("i"), F.regexp_replace("_t1", "^[。．.、 ]+", "").alias("t")))
    )
    r = r.withColumn("_shape", shaped).withColumn("_at", T.strip(F.regexp_replace("_shape.t", "を追加[。．.]?$", "")))
    appended = _outcome(operation=F.lit("append"), append_location=location, append_text=F.col("_at"), append_instruction=F.coalesce(F.nullif("_shape.i", F.lit("")), am))

    rule = (
        F.when(F.col("internal_table_detected"), _outcome(operation=F.lit("complex")))
        .when(before.isNotNull() & after.isNotNull(), replaced)
        .when((T.strip(F.coalesce(location, F.lit(""))) == "追記") & _filled(b) & ~_filled(a),
              _outcome(operation=F.lit("append"), append_instruction=F.lit("追記"), append_text=T.strip(b), append_location=location))
        .when(b.contains("項目ごと削除") & ~_filled(a), item_delete)
        .when(dm.isNotNull(), deleted)
        .when(F.col("_full").isNotNull(), _outcome(operation=F.lit("replace"), normalized_after=F.col("_full.t"), note=F.col("_full.m")))
        .when(am.isNotNull() & (F.col("_t1") != "") & (F.col("_at") != ""), appended)
        .otherwise(_outcome(operation=F.lit("complex")))
    )
    done = r.withColumn("_o", rule)
    keep = [c for c in records.columns if c not in ("after", "location")]
    return done.select(
        *keep, "location",
        F.when(F.col("_o.operation") == "replace", F.coalesce("_o.normalized_after", "after")).otherwise(F.col("after")).alias("after"),
        *[F.col(f"_o.{n}").alias(n) for n in _RESULT if n not in ("note", "normalized_after")],
        F.nullif(F.concat_ws(" ", "_o.note", "_loc.note"), F.lit("")).alias("note"))


def quality(records: DataFrame) -> DataFrame:
    """Adds quality reasons and status; completed one-sided operations are excused, ``complex`` is forced through."""
    before, after = F.col("before"), F.col("after")
    text = F.concat_ws("\n", F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))
    op = F.col("operation")
    why = F.array_compact(F.array(
        F.when(before.isNull() | after.isNull(), "MISSING_BEFORE_OR_AFTER"),
        F.when(T.any_contains(text, APPEND_MARKERS), "APPEND_INSTRUCTION_PATTERN"),
        F.when(F.col("internal_table_detected"), "INTERNAL_TABLE_PATTERN"),
        F.when((op != "replace") & truncated(before), "BEFORE_LOOKS_TRUNCATED"),
        F.when((op != "replace") & truncated(after), "AFTER_LOOKS_TRUNCATED"),
    ))
    one_sided = F.array(F.lit("MISSING_BEFORE_OR_AFTER"))
    has = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    excused = (
        F.when((op == "append") & has("append_text"), F.array_except("_why", F.array(F.lit("MISSING_BEFORE_OR_AFTER"), F.lit("APPEND_INSTRUCTION_PATTERN"))))
        .when((op == "delete") & has("delete_text"), F.array_except("_why", one_sided))
        .when((op == "replace") & has("after") & ~has("before"), F.array_except("_why", one_sided))
        .otherwise(F.col("_why"))
    )
    rated = records.withColumn("_why", why).withColumn("_left", excused)
    rated = rated.withColumn("quality_reasons", F.when((op == "complex") & (F.size("_left") == 0), F.array(F.lit("COMPLEX_OPERATION"))).otherwise(F.col("_left")))
    status = F.when((op == "complex") | (F.size("quality_reasons") > 0), "LAYOUT_COMPLEX").otherwise("LAYOUT_PARSED")
    return rated.withColumn("parse_status", status).withColumn(
        "operation", F.when(F.col("parse_status") == "LAYOUT_COMPLEX", "complex").otherwise(op)).drop("_why", "_left")


def _parts() -> Column:
    return F.transform(F.split("text", "\\|"), T.strip)


def _rescuable() -> Column:
    at = lambda p, i: F.get(p, F.size(p) - i)
    good = T.let(_parts(), lambda p: F.size(p).isin(3, 4) & F.forall(p, lambda v: F.length(v) > 0) & (at(p, 2) != at(p, 1)))
    return (F.col("type") == "UNASSIGNED_ROW") & F.coalesce(good, F.lit(False))


def rescue(diags: DataFrame) -> DataFrame:
    """Loose rows of three or four filled parts whose last two differ, as replace records."""
    p = diags.withColumn("_p", _parts())
    n = F.size("_p")
    at = lambda i: F.get("_p", n - i)
    good = p.where(_rescuable())
    location = F.array_join(F.slice("_p", F.lit(1), n - 2), " ")
    raw = F.concat(F.lit("location:"), location, F.lit(" | before:"), at(2), F.lit(" | after:"), at(1))
    nothing = {c: _s().alias(c) for c in _RESULT if c not in ("operation", "note", "normalized_after")}
    return good.select(
        "doc", "pdf_page", "band", F.lit(None).cast("bigint").alias("target_page"), F.lit(False).alias("starred"), location.alias("location"),
        at(2).alias("before"), at(1).alias("after"), raw.alias("raw_text"), F.lit(False).alias("internal_table_detected"),
        F.lit("replace").alias("operation"), *nothing.values(), F.lit(RESCUED).alias("note"),
        F.array().cast("array<string>").alias("quality_reasons"), F.lit("LAYOUT_PARSED").alias("parse_status"))


def _rated(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rated records, rescued rows, remaining diagnostics) of all documents: banding, carry-forward, rules, quality, rescue."""
    banded = written(banded_items(items), "banded")  # read by records and diagnostics
    diags = diagnostics(banded)
    return quality(classify(carry_forward(banded, tables=True))), rescue(diags), diags.where(~_rescuable())


def errata_status(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, pdf_page, operation, parse_status, quality_reasons) of every record, and the remaining diagnostics: what reports count, without numbers."""
    rated, saved, left = _rated(items)
    cols = ("doc", "pdf_page", "operation", "parse_status", "quality_reasons")
    return rated.select(*cols).unionByName(saved.select(*cols)), left


def errata_records(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, remaining diagnostics) of all documents, numbered.

    Numbers run over a whole document, rescued rows last; numbering works in slices of pages.
    """
    rated, saved, left = _rated(items)
    methods = items.groupBy("doc").agg(F.count_distinct("extract_method").alias("_n"), F.max("extract_method").alias("_m")).select(
        "doc", F.when(F.col("_n") == 1, F.col("_m")).otherwise("mixed").alias("extract_method"))
    everything = rated.withColumn("_rescued", F.lit(False)).withColumnRenamed("record", "_o").unionByName(
        saved.join(methods, "doc").withColumn("_rescued", F.lit(True)).withColumnRenamed("band", "_o"))
    everything = written(everything, "records")  # read by the counts of the slices and by the numbering
    return positions_in(everything, ["doc"], ["_rescued", "pdf_page"], ["_o"], "record_index").drop("_o", "_rescued"), left


# ---- chunks -----------------------------------------------------------------------

def skip_reason(records: DataFrame) -> DataFrame:
    """Adds ``skip_reason``: null for records that become chunks."""
    return records.withColumn(
        "skip_reason",
        F.when(F.col("parse_status") != "LAYOUT_PARSED", "not_layout_parsed")
        .when(~F.coalesce("operation", F.lit("")).isin("replace", "append", "delete"), F.concat(F.lit("unsupported_operation:"), F.coalesce("operation", F.lit("None")))))


def correction_chunks(records: DataFrame, titles: Mapping[str, str] | None = None) -> DataFrame:
    """One search chunk per eligible record: natural-language text, stable id, override and supplement flags."""
    ok = skip_reason(records).where(F.col("skip_reason").isNull())
    op = F.col("operation")
    kind = F.when(op == "replace", "の公式エラッタ。").when(op == "append", "の公式追加・追記。").otherwise("の公式削除エラッタ。")
    line = lambda head, c, tail="": F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(head), F.col(c), F.lit(tail)))
    own = F.when(F.col("note") != RESCUED, F.col("note"))
    text = F.concat_ws(
        "\n",
        F.concat(T.source_title(F.col("doc"), titles), F.lit(" "), T.page_label(F.col("target_page")), kind),
        line("対象箇所は「", "location", "」。"),
        F.when(op == "replace", line("訂正前は「", "before", "」。")), F.when(op == "replace", line("訂正後は「", "after", "」。")),
        F.when(op == "append", line("追記指示: ", "append_instruction")), F.when(op == "append", line("追記内容: ", "append_text")),
        F.when(op == "delete", line("削除指示: ", "delete_instruction")), F.when(op == "delete", line("削除対象: ", "delete_text")),
        line("注記: ", "_note"))
    return ok.withColumn("_note", own).select(
        F.concat(F.col("doc"), F.lit(":errata:"), F.col("record_index").cast("string")).alias("chunk_id"), F.col("doc").alias("source_key"),
        "record_index", "target_page", "location", "before", "after", "operation", "append_instruction", "append_text", "delete_instruction", "delete_text",
        F.col("_note").alias("note"), F.when(F.col("note") == RESCUED, "diagnostic_rescue").alias("recovery_method"), "extract_method",
        op.isin("replace", "delete").alias("override_candidate"), (op == "append").alias("supplement_candidate"), text.alias("text"))


# ---- reports --------------------------------------------------------------------------

def document_counts(records: DataFrame) -> DataFrame:
    """Counts per document by status, operation and extraction method, as (doc, kind, name, n)."""
    kinds = F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("parse_status", "operation", "extract_method")]), F.array("parse_status", "operation", "extract_method")))
    return records.select("doc", kinds.alias("kind", "name")).groupBy("doc", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def normalization_report(records: DataFrame, left: DataFrame, top: int = 10) -> DataFrame:
    """Totals per document with complexity ratio and diagnostics, ranked for review."""
    per_doc = records.groupBy("doc").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("parse_status") == "LAYOUT_PARSED").alias("parsed_count"),
        F.count_if(F.col("parse_status") == "LAYOUT_COMPLEX").alias("complex_count"))
    lost = left.groupBy("doc").agg(F.count(F.lit(1)).alias("diagnostic_count"))
    report = per_doc.join(lost, "doc", "left").withColumn("diagnostic_count", F.coalesce("diagnostic_count", F.lit(0))).withColumn(
        "complex_ratio", F.round(F.col("complex_count") / F.col("record_count"), 4))
    report = written(report, "report")  # one row per document, read three times
    by_ratio = report.orderBy(F.col("complex_ratio").desc(), F.col("complex_count").desc(), "doc").limit(top).select("doc", F.lit(True).alias("review_ratio"))
    by_lost = report.orderBy(F.col("diagnostic_count").desc(), "doc").limit(top).select("doc", F.lit(True).alias("review_diagnostics"))
    return report.join(by_ratio, "doc", "left").join(by_lost, "doc", "left").fillna(False, ["review_ratio", "review_diagnostics"])


def normalization_totals(records: DataFrame, left: DataFrame, fallback: str = "tesseract_tsv") -> DataFrame:
    """Counts of all records, by operation, by extraction method and by document: (kind, name, ...), ``kind`` total, operation, extract_method or doc.

    One pass of grouping sets over the records. ``fallback_count`` counts records of the fallback extraction: documents with any are the list to
    look at again. Diagnostics belong to documents, so operations and methods have none.
    """
    kind = F.when(F.grouping("doc") == 0, "doc").when(F.grouping("operation") == 0, "operation").when(F.grouping("extract_method") == 0, "extract_method").otherwise("total")
    sets = [["doc"], ["operation"], ["extract_method"], []]
    counts = records.groupingSets(sets, "doc", "operation", "extract_method").agg(
        kind.alias("kind"), F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("parse_status") == "LAYOUT_PARSED").alias("parsed_count"),
        F.count_if(F.col("parse_status") == "LAYOUT_COMPLEX").alias("complex_count"), F.count_if(F.col("extract_method") == fallback).alias("fallback_count"))
    named = counts.select("kind", F.coalesce("doc", "operation", "extract_method", F.lit("")).alias("name"), "record_count", "parsed_count", "complex_count", "fallback_count")
    lost = left.groupingSets([["doc"], []], "doc").agg(F.when(F.grouping("doc") == 0, "doc").otherwise("total").alias("kind"), F.count(F.lit(1)).alias("diagnostic_count"))
    lost = lost.select("kind", F.coalesce("doc", F.lit("")).alias("name"), "diagnostic_count")
    return named.join(lost, ["kind", "name"], "left").where("record_count > 0").withColumn("diagnostic_count", F.coalesce("diagnostic_count", F.lit(0))).withColumn(
        "complex_ratio", F.round(F.col("complex_count") / F.col("record_count"), 4))


def chunk_totals(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Chunks of all documents that are not excluded, in all, by operation and by source: (kind, name, chunk_count), in one pass of grouping sets."""
    built = skip_reason(records).join(excluded.select("doc"), "doc", "left_anti")
    counts = built.groupingSets([["doc"], ["operation"], []], "doc", "operation").agg(
        F.when(F.grouping("doc") == 0, "source").when(F.grouping("operation") == 0, "operation").otherwise("total").alias("kind"),
        F.count_if(F.col("skip_reason").isNull()).alias("chunk_count")).where("chunk_count > 0")
    return counts.select("kind", F.coalesce("doc", "operation", F.lit("")).alias("name"), "chunk_count")


def correction_manifest(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per document: built or excluded, records, chunks and skipped records by reason."""
    rows = skip_reason(records).join(excluded.select("doc", F.lit(True).alias("_x")), "doc", "left")
    counts = rows.groupBy("doc", "_x", "skip_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc").agg(
        F.when(F.bool_or(F.col("_x")), "EXCLUDED").otherwise("BUILT").alias("status"), F.sum("n").alias("record_count"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull() & F.col("_x").isNull(), F.col("n"))), F.lit(0)).alias("chunk_count"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("skip_reason", "n")))))).alias("skipped_counts"))
