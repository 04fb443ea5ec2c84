"""Readers of fact sheets: captions with their data, cells of a grid, lines of a text, and ranked sets of patterns.

A page or text is one row; what a reader finds stays in arrays of that row, so nothing is shuffled. Facts are arrays of
(caption, value, asof) in the order of their first captions, with the value of the last of equal ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import objective_hints
from .ranks import settled

FACT = "struct<caption:string,value:string,asof:string>"
FACTS = f"array<{FACT}>"


def first(items: Column, test=None) -> Column:
    """The first item of an array that passes a test."""
    return F.get(F.filter(items, test) if test else items, F.lit(0))


def folded(c: Column) -> Column:
    """White space as single spaces, trimmed; NULL becomes empty."""
    return F.coalesce(T.squeeze(c), F.lit(""))


def plain(c: Column) -> Column:
    """Markup as spaces, folded."""
    return folded(F.regexp_replace(c, r"<[^>]*>?", " "))


def merged(found: Column) -> Column:
    """Facts with each caption once: the place of its first, the value of its last, the last date that it has."""
    names = F.array_distinct(F.transform(found, lambda x: x["caption"]))

    def one(name):
        mine = F.filter(found, lambda x: x["caption"] == name)
        dated = F.filter(mine, lambda x: x["asof"].isNotNull())
        return F.struct(name.alias("caption"), F.try_element_at(mine, F.lit(-1))["value"].alias("value"), F.try_element_at(dated, F.lit(-1))["asof"].alias("asof"))

    return F.transform(names, one)


# --- captions and data ---------------------------------------------------------------------------------------------

#: Classes of the elements that hold a caption, its data and its date.
CAPTION, DATA, ASOF = "caption", "data", "as-of-date"


def caption_facts(pages: DataFrame, key: str, html: str, keep: Sequence[str] = (), caption: str = CAPTION, data: str = DATA, asof: str = ASOF) -> DataFrame:
    """key, kept columns, facts: each data element with the nearest caption before it, and the date within that caption.

    Only the first data element after a caption is its own. Buttons and inner blocks of a caption are left out; an
    element that is not closed reaches to the next of the three kinds. Empty captions and empty data make no fact.
    """
    kinds = "|".join(map(re.escape, (caption, data, asof)))
    opened = rf"<[a-z][a-z0-9]*\b[^>]*\bclass\s*=\s*[\"'](?:[^\"'>]*\s)?(?:{kinds})(?=[\s\"'])"
    parts = F.split(F.coalesce(html, F.lit("")), rf"(?i)(?={opened})")
    kind = lambda p: F.lower(F.regexp_extract(p, rf"(?i)^<[a-z][a-z0-9]*\b[^>]*\bclass\s*=\s*[\"'](?:[^\"'>]*\s)?({kinds})(?=[\s\"'])", 1))
    own = lambda p: F.regexp_extract(p, r"(?is)^<([a-z][a-z0-9]*)\b[^>]*>(.*?)(?:</\1\s*>|$)", 2)
    inner = lambda p: F.regexp_replace(F.regexp_replace(p, r"^<[^>]*>", ""), r"(?is)<(button|div)\b[^>]*>.*?(?:</\1\s*>|$)", " ")
    read = F.transform(parts, lambda p: T.let(kind(p), lambda k: F.struct(k.alias("kind"), F.when(k != "", plain(F.when(k == caption, inner(p)).otherwise(own(p)))).alias("text"))))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("caption"), none.alias("asof"), F.array().cast(FACTS).alias("found"))

    def step(state, x):
        fact = F.struct(state["caption"].alias("caption"), x["text"].alias("value"), state["asof"].alias("asof"))
        taken = (x["kind"] == data) & state["caption"].isNotNull()
        made = taken & (state["caption"] != "") & (x["text"] != "")
        return F.struct(
            F.when(x["kind"] == caption, x["text"]).when(~taken, state["caption"]).alias("caption"),
            F.when(x["kind"] == caption, none).when(x["kind"] == asof, page_date(x["text"])).otherwise(state["asof"]).alias("asof"),
            F.when(made, F.concat(state["found"], F.array(fact))).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(F.filter(read, lambda x: x["kind"] != ""), start, step, lambda s: s["found"])
    return settled(settled(pages, _found=found).select(key, *keep, "_found"), facts=merged(F.col("_found"))).drop("_found")


def page_date(c: Column) -> Column:
    """The first date of a text as an ISO date, else NULL."""
    said = T.null_if_blank(F.regexp_extract(c, r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/[A-Za-z]{3}/\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} [A-Z][a-z]{2,8} \d{4}|[A-Z][a-z]{2} \d{1,2},? \d{4})\b", 1))
    return T.to_iso_date(F.replace(said, F.lit(","), F.lit("")), ("yyyy-MM-dd", "d/MMM/yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy"), keep=False)


def lookup(facts: Column, exact: Sequence[str], contains: Sequence[str] = (), prefix: str | None = None) -> Column:
    """The value of the first fact with one of the captions, else of one that contains a word or begins with a prefix."""
    has = F.filter(facts, lambda x: x["value"] != "")
    named = lambda x: F.upper(x["caption"])
    found = [first(has, lambda x: named(x).isin([e.upper() for e in exact]))["value"]]
    if contains:
        found.append(first(has, lambda x: F.exists(F.array(*map(F.lit, contains)), lambda w: F.contains(named(x), w)))["value"])
    if prefix:
        found.append(first(has, lambda x: named(x).startswith(prefix.upper()))["value"])
    return F.coalesce(*found)


def money(c: Column) -> dict[str, Column]:
    """value and currency of an amount without a scale."""
    return {"value": T.to_number_loc(T.null_if_blank(F.regexp_extract(c, r"([0-9][0-9.,]*)", 1))), "currency": T.null_if_blank(F.regexp_extract(c, r"\b([A-Z]{3})\b", 1))}


def hedge(c: Column) -> dict[str, Column]:
    """hedged_flag and hedged_target of a field that says whether a currency is hedged."""
    text = F.upper(T.squeeze(c))
    target = T.null_if_blank(F.regexp_extract(text, r"\b(USD|EUR|GBP|JPY|CHF)\b", 1))
    no = text.isin("NO", "FALSE") | F.contains(text, F.lit("UNHEDGED"))
    flag = F.when(no, 0).when(text.isin("YES", "TRUE") | F.contains(text, F.lit("HEDG")) | target.isNotNull(), 1)
    return {"hedged_flag": flag, "hedged_target": F.when(flag == 1, target)}


def product_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The facts of product pages: fee, income, compliance, benchmark, class, domicile, size with its date, hedge.

    The fund's size comes before the share class's. Without a captioned fee the first per cent after its name counts.
    """
    rows = caption_facts(pages.withColumn("_text", plain(F.col(html))), key, html, ["_text"])
    facts, pick = F.col("facts"), lambda *a: lookup(F.col("facts"), *a)
    named = lambda x: F.upper(x["caption"])
    fees = F.transform(F.filter(facts, lambda x: F.contains(named(x), F.lit("TOTAL EXPENSE RATIO")) | (named(x) == "TER (%)")), lambda x: T.to_percent(x["value"]))
    income = F.col("_income")
    income = F.when(income.startswith("Accumulating"), "Accumulating").when(income.startswith("Distributing"), "Distributing").otherwise(T.null_if_blank(income))
    yes = F.transform(F.filter(facts, lambda x: F.contains(named(x), F.lit("UCITS COMPLIANT")) | (named(x) == "UCITS")), lambda x: F.when(F.lower(F.trim(x["value"])).isin("yes", "true", "y"), 1).when(F.lower(F.trim(x["value"])).isin("no", "false", "n"), 0))
    sized = lambda name: first(facts, lambda x: (x["caption"] == name) & money(x["value"])["value"].isNotNull())
    sizes = F.array_compact(F.array(*[sized(name) for name, _ in SIZE_CAPTIONS]))
    said = F.initcap(first(facts, lambda x: F.contains(named(x), F.lit("USE OF INCOME")))["value"])
    rows = settled(rows, _size=first(sizes), _income=said, _hedge=pick(("Currency Hedged", "Hedged"), ("HEDGED",)), _way=pick(("Replication Method",), ("REPLICATION",)))
    size, hedged = F.col("_size"), hedge(F.col("_hedge"))
    return rows.select(
        key,
        F.coalesce(first(F.array_compact(fees)), share(F.regexp_extract("_text", rf"(?i)Total Expense Ratio.{{0,120}}?{PERCENT}", 1))).alias("ter"),
        income.alias("use_of_income"),
        first(F.array_compact(yes)).alias("ucits_compliant"),
        pick(("Benchmark Index", "Index", "Reference Index", "Underlying Index")).alias("benchmark_name"),
        pick(("Asset Class",), ("ASSET CLASS",)).alias("asset_class_hint"),
        pick(("Fund Domicile", "Domicile"), ("DOMICILE",)).alias("domicile_country"),
        money(size["value"])["value"].alias("fund_size_value"),
        money(size["value"])["currency"].alias("fund_size_currency"),
        size["asof"].alias("fund_size_asof"),
        T.first_match([(size["caption"] == n, s) for n, s in SIZE_CAPTIONS]).alias("fund_size_scope"),
        T.norm_replication(F.col("_way")).alias("replication_method"),
        hedged["hedged_flag"].alias("hedged_flag"),
        hedged["hedged_target"].alias("hedged_target"),
    )


#: Captions of a size and whose size it is, in order.
SIZE_CAPTIONS = (("Net Assets of Fund", "fund"), ("Net Assets", "share_class"))


# --- cells of a grid -----------------------------------------------------------------------------------------------

CELL = "struct<table_no:int,row_no:int,col_no:int,row_header:string,col_header:string,text:string,lead:boolean>"


class Grid(HTMLParser):
    """The cells of a page's tables: (table, row, column, kind, lines, rows and columns that it spans).

    Tables may lie in cells: what stands in an inner table is not the outer cell's. Rows and cells that are not closed
    end with the next one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = None
        elif self.open and tag in ("td", "th"):
            top, named = self.open[-1], dict(attrs)
            if not top["rows"]:
                top["rows"].append([])
            top["cell"] = [tag, [], *(span(named.get(n)) for n in ("rowspan", "colspan"))]
            top["rows"][-1].append(top["cell"])

    def handle_endtag(self, tag):
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][1].append(text)


def span(value: str | None) -> int:
    """How many rows or columns a cell takes: 1 to 1000, as browsers have it; 1 where it is no number."""
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() else 1


def grid_cells(html: str | None) -> list[dict]:
    """The data cells of all tables with the headers of their row and column; a spanning cell stands at its first place.

    The header of a row is the nearest th to the left, that of a column the nearest one above; lead marks the first data
    cell of a row.
    """
    page = Grid()
    page.feed(html or "")
    page.close()
    out = []
    for t, rows in enumerate(page.tables):
        taken: dict[int, dict[int, tuple]] = {}
        above: dict[int, str] = {}
        for r, cells in enumerate(rows):
            line, c = taken.setdefault(r, {}), 0
            for cell in cells:
                while c in line:
                    c += 1
                kind, lines, down, across = cell
                for k in range(down):
                    place = taken.setdefault(r + k, {}) if r + k < len(rows) else {}
                    for x in range(c, c + across):
                        place.setdefault(x, (kind, "\n".join(lines), k == 0 and x == c))
                c += across
            left, lead = None, True
            for c in sorted(line):
                kind, text, is_first = line[c]
                if kind == "th":
                    left = text
                elif is_first:
                    out.append({"table_no": t, "row_no": r, "col_no": c, "row_header": left, "col_header": above.get(c), "text": text, "lead": lead})
                    lead = False
            above |= {c: text for c, (kind, text, _) in line.items() if kind == "th"}
            taken.pop(r)
    return out


def cell_grid(pages: DataFrame, key: str, html: str, keep: Sequence[str] = ()) -> DataFrame:
    """key, kept columns, cells: the data cells of a page's tables, with their places and headers; lines of a text are kept apart."""
    kind = pa.struct([("table_no", pa.int32()), ("row_no", pa.int32()), ("col_no", pa.int32()), *((n, pa.string()) for n in ("row_header", "col_header", "text")), ("lead", pa.bool_())])

    def run(batches):
        for b in batches:
            cells = [grid_cells(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(cells, pa.list_(kind))], [key, *keep, "cells"])

    rows = pages.select(key, F.col(html).cast("string").alias("_html"), *keep)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, f"{schema}, cells array<{CELL}>")


def grid_facts(cells: Column) -> Column:
    """Facts of a grid: of each row with a header its first data cell."""
    own = F.filter(cells, lambda x: x["lead"] & (x["row_header"] != ""))
    none = F.lit(None).cast("string")
    return merged(F.transform(own, lambda x: F.struct(folded(x["row_header"]).alias("caption"), x["text"].alias("value"), none.alias("asof"))))


def tearsheet_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The facts of tear sheets from their grids: id, fee, income, domicile, size, and style of shares.

    Size and style come from the lines of the style cell, then from the whole cell, then from the objective's prose; the
    fund's size from its own cell, else from the share class's.
    """
    objective = plain(F.regexp_extract(F.col(html), r"(?is)<div\b[^>]*\bmod-aside__module\b[^>]*>\s*<h[23][^>]*>\s*(objective\s*</h[23]>.*?)</div>", 1))
    rows = settled(cell_grid(pages.withColumn("_objective", objective), key, html, ["_objective"]), facts=grid_facts(F.col("cells")))
    pick = lambda *a, **k: lookup(F.col("facts"), *a, **k)
    flat = lambda c: T.squeeze(c)
    named = {"_fund": "Fund size", "_share": "Share class size", "_income": "Income treatment"}
    cells = {c: flat(pick((n, "Use of income") if c == "_income" else (n,), prefix="Income" if c == "_income" else n)) for c, n in named.items()}
    rows = settled(rows, _style=pick(("Investment style (stocks)",), prefix="Investment style"), **cells)
    rows = settled(rows, _fund_size=amount(F.col("_fund")), _share_size=amount(F.col("_share")))
    style = F.col("_style")
    line = lambda label: T.null_if_blank(F.regexp_extract(style, rf"(?im)^{label}:(.*)$", 1))
    said = {"equity_size_hint": F.coalesce(T.norm_equity_size(line("market cap")), T.norm_equity_size(flat(style))), "equity_style_hint": F.coalesce(T.norm_equity_style(line("investment style")), T.norm_equity_style(flat(style)))}
    hints = objective_hints(F.col("_objective"))
    fund, share = F.col("_fund_size"), F.col("_share_size")
    date = lambda c: page_date(F.regexp_extract(c, r"(?i)as of (.*)$", 1))
    is_fund = fund["value"].isNotNull()
    size = lambda field: F.when(is_fund, fund[field]).otherwise(share[field])
    income = F.upper("_income")
    return rows.select(
        key,
        flat(pick(("ISIN",), prefix="ISIN")).alias("isin"),
        T.to_percent(flat(pick(("Ongoing charge",), prefix="Ongoing charge"))).alias("ter"),
        F.when(F.contains(income, F.lit("ACCUM")), "Accumulating").when(F.contains(income, F.lit("DIST")) | F.contains(income, F.lit("INCOME")), "Distributing").otherwise(F.when(income != "--", F.col("_income"))).alias("use_of_income"),
        flat(pick(("Domicile",), prefix="Domicile")).alias("domicile_country"),
        size("value").alias("fund_size_value"),
        size("currency").alias("fund_size_currency"),
        F.when(is_fund, date("_fund")).when(share["value"].isNotNull(), date("_share")).alias("fund_size_asof"),
        F.when(is_fund, "fund").when(share["value"].isNotNull(), "share_class").alias("fund_size_scope"),
        *[F.coalesce(c, hints[n]).alias(n) for n, c in said.items()],
    )


# --- amounts and lines ---------------------------------------------------------------------------------------------

#: What scales an amount.
SCALES = {"tn": 1e12, "trn": 1e12, "trillion": 1e12, "bn": 1e9, "billion": 1e9, "b": 1e9, "mn": 1e6, "million": 1e6, "m": 1e6, "k": 1e3, "thousand": 1e3}
SIGNS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
AMOUNT = (
    r"(?i)(?:\b((?-i:[A-Z]{3}))\b|([" + "".join(SIGNS) + r"]))?\s*([-−+])?\s*(\d(?:[\d.,'\x20\u00a0\u202f]*\d)?)"
    r"\s*\(?\s*(?:\b|(?<=\d))(" + "|".join(SCALES) + r")?\b\s*(?:((?-i:[A-Z]{3}))\b|([" + "".join(SIGNS) + r"]))?"
)


def amount(c: Column) -> Column:
    """(value, currency) of the first amount of a text: sign, grouping, a word of scale, a currency on either side.

    The last separator is the decimal one, but a lone comma before three digits groups; spaces and apostrophes group.
    """
    part = lambda n: T.null_if_blank(F.regexp_extract(c, AMOUNT, n))
    number = T.to_number_loc(F.regexp_replace(part(4), r"['\x20\u00a0\u202f]", ""))
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.lower(part(5))), F.lit(1.0))
    sign = F.when(part(3).isin("-", "−"), -1.0).otherwise(1.0)
    named = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])
    currency = F.coalesce(part(1), F.try_element_at(named, part(2)), part(6), F.try_element_at(named, part(7)))
    return F.struct((number * scale * sign).alias("value"), F.when(number.isNotNull(), currency).alias("currency"))


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[\r\n]+"), T.squeeze), lambda x: x.isNotNull())


def by_line(lines: Column, whole: Column, in_line, in_text) -> Column:
    """The first line's value that there is, else that of the whole text on one line."""
    return F.coalesce(first(F.filter(F.transform(lines, in_line), lambda x: x.isNotNull())), in_text(whole))


#: Labels of a fee and of a distribution, and what may stand after them.
FEE_LABEL = "Management fees and other administrative or operating costs"
PERCENT = r"([0-9]+(?:[.,][0-9]+)?)\s*%"
TER = r"(?i)Total\s+Expense\s+Ratio(?:\s*\(TER\))?\s*(?:p\.?\s*a\.?)?\s*([0-9]+(?:[.,][0-9]+)?)\s*%?"
INCOME = r"(?i)(?:Type of shares|Income treatment).{0,100}?(Accumulation|Distribution|Accumulating|Distributing|Capitalisation|Capitalization)"
CLASS_LINES = ("EQUITY", "BOND", "COMMODITY", "MULTI ASSET", "MONEY MARKET")
#: Fields of a fact sheet's running text, one group each.
LINE_FIELDS = {
    "benchmark_name": r"(?i)\bBenchmark\s*:\s*(.+?)(?:Date of the\s+(?:first|rst)\s+NAV|First NAV|Key Information|Objective and Investment Policy|$)",
    "asset_class_hint": r"(?i)\bAsset class\s*:\s*(.+?)(?:Exposure\s*:|Information\s*\(|Fund structure\b|$)",
    "domicile_country": r"(?i)\bFund structure\b.*?\bunder\s+([A-Za-z ]+?)\s+law\b",
    "replication_method": r"(?i)\bReplication type\s*:\s*(.+?)(?:Benchmark\s*:|Date of the\s+(?:first|rst)\s+NAV|First NAV|Asset class\s*:|$)",
}
#: What a fund's size follows, with a scale and a currency or with a currency alone.
SIZES = (
    r"(?i)Assets?\s+Under\s+Management(?:\s*\(AUM\))?\s*:?\s*([0-9][0-9., ]*\s*\(\s*(?:million|billion|bn|m)\s+[A-Z]{3}\s*\))",
    r"(?i)(?:Total Fund Assets|Fund Net asset Value|Total asset)\s*:?\s*([0-9][0-9., ]*\s*\(\s*(?:million|billion|bn|m)\s+[A-Z]{3}\s*\))",
    r"(?i)(?:Total Fund Assets|Fund Net asset Value|Total asset)\s*:?\s*([0-9][0-9., ]*\s*\(\s*[A-Z]{3}\s*\))",
)


def share(token: Column) -> Column:
    """A number of 0 to 100 with either decimal sign."""
    value = F.replace(T.null_if_blank(token), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 100), value)


def line_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The facts of a fact sheet's text: fee, income and compliance by line and then by text, and labelled fields.

    The first line that gives a value wins. A line about compliance decides, whatever comes later.
    """
    rows = settled(docs.select(key, F.col(text).alias("_text")), _lines=lines_of(F.coalesce(F.col("_text"), F.lit(""))), _whole=folded(F.col("_text")))
    lines, whole = F.col("_lines"), F.col("_whole")
    labelled = lambda s: F.when(F.contains(F.upper(s), F.lit(FEE_LABEL.upper())), share(F.regexp_extract(s, PERCENT, 1)))
    ter = lambda s: share(F.regexp_extract(s, TER, 1))
    fee = by_line(lines, whole, lambda s: F.coalesce(labelled(s), ter(s)), lambda s: F.coalesce(share(F.regexp_extract(s, rf"(?i){FEE_LABEL}.{{0,180}}?{PERCENT}", 1)), ter(s)))
    word = lambda s: F.lower(F.regexp_extract(s, INCOME, 1))
    income = lambda s: F.when(word(s).rlike("^(?:accumulat|capitali[sz])"), "Accumulating").when(word(s).startswith("distribut"), "Distributing")
    says = lambda s: F.when(F.upper(s).rlike(r"\bNO\b"), 0).otherwise(1)
    named = lambda s: F.when(F.contains(F.upper(s), F.lit("UCITS COMPLIANT")), says(s))
    after = lambda s: F.when(s.rlike("(?i)UCITS compliant"), says(F.regexp_extract(s, "(?i)UCITS compliant.{0,80}", 0)))
    field = {n: T.squeeze(F.regexp_extract(whole, e, 1)) for n, e in LINE_FIELDS.items()}
    head = first(lines)
    target = T.null_if_blank(F.regexp_extract(F.upper(whole), r"\b(USD|EUR|GBP|JPY|CHF)\s+(?:HDG|HEDGED)\b", 1))
    unhedged = F.contains(F.upper(whole), F.lit("UNHEDGED"))
    flag = F.when(whole == "", None).when(unhedged, 0).when(target.isNotNull() | F.upper(whole).rlike(r"HEDGED|(?<!\S)HDG(?!\S)"), 1)
    size = F.coalesce(*[T.null_if_blank(F.regexp_extract(whole, e, 1)) for e in SIZES])
    return rows.select(
        key,
        fee.alias("ter"),
        by_line(lines, whole, income, income).alias("use_of_income"),
        by_line(lines, whole, named, after).alias("ucits_compliant"),
        T.squeeze(F.regexp_replace(field["benchmark_name"], r"^[0-9]+(?:[.,][0-9]+)?%\s*", "")).alias("benchmark_name"),
        F.coalesce(field["asset_class_hint"], F.when(F.upper(head).isin(*CLASS_LINES), F.initcap(head))).alias("asset_class_hint"),
        F.initcap(field["domicile_country"]).alias("domicile_country"),
        amount(size)["value"].alias("fund_size_value"),
        F.upper(F.regexp_extract(size, r"([A-Za-z]{3})\s*\)$", 1)).alias("fund_size_currency"),
        F.when(size.isNotNull(), "fund").alias("fund_size_scope"),
        T.to_iso_date(T.null_if_blank(F.regexp_extract(whole, r"(?i)\bAUM\s+as\s+of\s*:\s*(\d{2}/\d{2}/\d{4})", 1)), ("dd/MM/yyyy",), keep=False).alias("fund_size_asof"),
        T.norm_replication(field["replication_method"]).alias("replication_method"),
        flag.alias("hedged_flag"),
        F.when(flag == 1, target).alias("hedged_target"),
    )


# --- ranked sets of patterns ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A pattern of a field: where it looks (characters from the start, 0 for all), what it gives and what it must pass.

    Without a value the first group counts. A rule whose value fails the guard does not match.
    """

    pattern: str
    value: str | None = None
    within: int = 0
    of: str | None = None
    guard: str | None = None


def ranked(rules: Sequence[Rule], texts: dict[str, Column], default: str) -> Column:
    """(rank, place, value) of the first rule that matches, from 1; NULL if none does."""
    tried = []
    for rank, rule in enumerate(rules, 1):
        text = texts[rule.of or default]
        text = F.substring(text, 1, rule.within) if rule.within else text
        said = F.lit(rule.value) if rule.value else T.squeeze(F.regexp_extract(text, rule.pattern, 1))
        holds = text.rlike(rule.pattern)
        if rule.guard:
            holds = holds & F.coalesce(said.rlike(rule.guard), F.lit(False))
        place = F.length(F.regexp_extract(text, rf"(?s)^(.*?)(?:{rule.pattern})", 1)) + 1
        tried.append(F.when(holds, F.struct(F.lit(rank).alias("rank"), place.alias("place"), said.alias("value"))))
    return F.coalesce(*tried)


#: How prose names a benchmark, in order, and the names of which one is an index.
BENCHMARKS = (
    r"reflect the performance, before fees and expenses, of (?:the )?(.+?) \(index\)",
    r"track the performance(?:, before fees and expenses,)? of (?:the )?(.+?)(?:\.|,)",
    r"seek(?:s)? to track(?: as closely as possible)? the performance of (?:the )?(.+?)(?:\.|,)",
    r"reference index(?: is| shall be)?\s*(.+?)(?:\.|,| objective| investment policy| what is this product\?)",
    r"underlying index(?: is| shall be)? (.+?)(?:\.|,)",
    r"benchmark(?: index)?\s*[:\-]\s*(.+?)(?:\.|,| objective| investment policy| what is this product\?)",
)
INDEX_WORDS = ("INDEX", "MSCI", "FTSE", "STOXX", "S&P", "NASDAQ", "RUSSELL", "SOLACTIVE", "BLOOMBERG", "MARKIT", "MORNINGSTAR", "NIKKEI", "TOPIX", "ICE", "JP MORGAN")
#: The countries whose law prose names, and further phrases of some.
LAW_COUNTRIES = ("Ireland", "Luxembourg", "France", "Germany", "the United Kingdom", "Jersey", "Switzerland", "the Netherlands")
LAW_PHRASES = {"Ireland": (r"\bIRISH BASED UCITS\b",), "Luxembourg": (r"\bregulated by the Commission de Surveillance du Secteur Financier\b",)}
#: Steps to an asset class: words, the class, and how far into the text (0: the benchmark's name).
CLASS_STEPS = (
    ("COMMODITY|GOLD|SILVER|BULLION", "Commodity", 0),
    ("BOND|TREASURY|GILT|FIXED INCOME|CREDIT|AGGREGATE", "Bond", 0),
    ("MSCI|FTSE|STOXX|S&P|NASDAQ|RUSSELL|NIKKEI|TOPIX", "Equity", 0),
    ("EQUITY|SMALL CAP|MID CAP|LARGE CAP|MSCI|FTSE|STOXX|S&P|NASDAQ|RUSSELL|NIKKEI|TOPIX", "Equity", 800),
    ("BOND|TREASURY|GILT|FLOATING RATE|FIXED INCOME|CREDIT|AGGREGATE", "Bond", 800),
    ("COMMODITY|GOLD|SILVER|BULLION", "Commodity", 3000),
    ("MONEY MARKET|CASH EQUIVALENT", "Cash", 3000),
    ("SHARES?|EQUITY|STOCKS?|LISTED COMPANIES", "Equity", 3000),
    ("BONDS?|TREASURY|GILT|FIXED INCOME|CREDIT", "Bond", 3000),
    ("MULTI[- ]ASSET|BALANCED|PORTFOLIO", "Multi", 800),
)
#: What says how an index is followed.
REPLICATION = (
    (r"\b(?:SWAP|SYNTHETIC)\b", "synthetic"),
    (r"attempt to replicate the index.*?by buying all or a substantial number of the securities", "physical"),
    (r"\b(?:PHYSICAL REPLICATION|DIRECT REPLICATION)\b", "physical"),
    (r"\b(?:by holding|holds?|invests? directly in)\b.{0,120}\b(?:securities|constituents|underlying assets?)\b", "physical"),
)
HEDGED = r"(?i)\b(USD|EUR|GBP|JPY|CHF)\s+(?:CURRENCY\s+)?HEDGED\b|\bHEDGED\b.*?\b(USD|EUR|GBP|JPY|CHF)\b"


def law_rules() -> list[Rule]:
    """A rule a country: its own phrases, and being authorised there or under its law."""
    out = []
    for place in LAW_COUNTRIES:
        country = place.removeprefix("the ")
        phrases = (*LAW_PHRASES.get(country, ()), rf"\bauthori[sz]ed in {place}\b", rf"\bunder the laws of {place}\b")
        out.append(Rule("(?i)" + "|".join(phrases), country))
    return out


def prose_metadata(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Benchmark, domicile, asset class, replication and hedge of prose, by the first rule of each ranked set.

    The first benchmark pattern that matches decides; what it gives is kept if it names an index. The ranks of the
    rules that won come along, NULL where none did.
    """
    rows = settled(docs.select(key, F.col(text).alias("_t")), _t=folded(F.col("_t")))
    rows = settled(rows, _bench=ranked([Rule("(?i)" + p) for p in BENCHMARKS], {"t": F.col("_t")}, "t"))
    is_index = F.upper(F.col("_bench.value")).rlike(r"\b(?:" + "|".join(INDEX_WORDS) + r")\b")
    rows = rows.withColumn("_b", F.when(is_index, F.col("_bench.value")))
    texts = {"t": F.col("_t"), "b": F.coalesce("_b", F.lit(""))}
    steps = [Rule(rf"(?i)\b(?:{words})\b", label, within, "t" if within else "b") for words, label, within in CLASS_STEPS]
    kind, law, way = ranked(steps, texts, "t"), ranked(law_rules(), texts, "t"), ranked([Rule(f"(?i){p}", v) for p, v in REPLICATION], texts, "t")
    target = F.upper(F.coalesce(*[T.null_if_blank(F.regexp_extract("_t", HEDGED, n)) for n in (1, 2)]))
    flag = F.when(F.contains(F.upper("_t"), F.lit("UNHEDGED")), 0).when(target.isNotNull(), 1)
    return rows.select(
        key,
        F.col("_b").alias("benchmark_name"),
        F.when(is_index, F.col("_bench.rank")).alias("benchmark_rank"),
        law["value"].alias("domicile_country"),
        kind["value"].alias("asset_class_hint"),
        kind["rank"].alias("asset_class_rank"),
        way["value"].alias("replication_method"),
        flag.alias("hedged_flag"),
        F.when(flag == 1, target).alias("hedged_target"),
    )


#: Labels of a fee in a page's text, in order, and how far its number may stand.
FEE_LABELS = ((r"\bTER\b", 80), (r"\bOngoing(?:\s+charges?)?\b", 120), (r"\bTotal expense ratio\b", 120))


def page_fee(html: Column) -> Column:
    """(rank, place, value) of the first label whose number is 0 to 100; markup counts as text, as pages are searched whole."""
    number = r"(?:100(?:[.,]0+)?|[0-9]{1,2}(?:[.,][0-9]+)?)"
    rules = [Rule(rf"(?i){label}.{{0,{width}}}?([0-9]+(?:[.,][0-9]+)?)\s*%", guard=f"^0*{number}$") for label, width in FEE_LABELS]
    found = T.let(folded(html), lambda t: ranked(rules, {"t": t}, "t"))
    return T.let(found, lambda x: F.struct(x["rank"].alias("rank"), x["place"].alias("place"), share(x["value"]).alias("value")))


# --- discovery terms -----------------------------------------------------------------------------------------------

#: What is opened in a name before it is searched, in order, and what tells nothing of its index.
DISCOVERY_OPENED = (
    (r"\bISHRS\b", "ISHARES"),
    (r"\bISHS\b", "ISHARES"),
    (r"\bU\.?ETF\b", "UCITS ETF"),
    (r"\bUCT\b", "UCITS"),
    (r"\bUCTS\b", "UCITS"),
    (r"\bUC\.?E\.?ACC\b", "UCITS ETF ACC"),
    (r"\bUC\.?E\.?DIST\b", "UCITS ETF DIST"),
    (r"\bUC\.?E\.?DIS\b", "UCITS ETF DIST"),
    (r"\bC\.BD\b", "CORP BOND"),
    (r"\bCORP BD\b", "CORP BOND"),
    (r"\bGOV BD\b", "GOV BOND"),
    (r"\bTRSY\b", "TREASURY"),
    (r"\bN\.AMERICA\b", "NORTH AMERICA"),
    (r"\bLGE CAP\b", "LARGE CAP"),
    (r"\bS\+P\b", "S&P"),
)
DISCOVERY_WORDS = ("ISHARES", "CORE", "EDGE", "UCITS", "ETF", "USD", "EUR", "GBP", "JPY", "CHF", "ACC", "DIST", "DIS", "HEDGED", "HDG")
MOST_TERMS = 6


def discovery_terms(isin: Column, ticker: Column, name: Column, house: str = "ISHARES") -> Column:
    """At most six different search terms: id, ticker, name as it is, opened and bare, and bare with the house before it."""
    opened = F.replace(F.upper(folded(name)), F.lit("&"), F.lit(" AND "))
    for pattern, by in DISCOVERY_OPENED:
        opened = F.regexp_replace(opened, pattern, by)
    opened = folded(F.regexp_replace(opened, r"[^A-Z0-9$&+()/-]+", " "))
    bare = lambda o: folded(F.regexp_replace(o, r"\b(?:" + "|".join(DISCOVERY_WORDS) + r")\b", " "))

    def terms(o, b):
        with_house = F.when(b != "", F.concat(F.lit(f"{house} "), b))
        with_core = F.when((b != "") & ~F.contains(o, F.lit("CORE")), F.concat(F.lit(f"{house} CORE "), b))
        return F.array(F.upper(F.trim(isin)), F.upper(T.squeeze(ticker)), T.squeeze(name), o, b, with_house, with_core)

    found = T.let(opened, lambda o: T.let(bare(o), lambda b: terms(o, b)))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))), 1, MOST_TERMS)
