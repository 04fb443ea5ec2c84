"""Readers of fact sheets against plain computations, on well-formed and broken pages and texts."""

import pytest
from pyspark.sql import functions as F

from fundsieve.operators import readers as R


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first().x


AMOUNTS = [
    ("USD 1,234", 1234.0, "USD"), ("1,234.5 EUR", 1234.5, "EUR"), ("1.234,5 EUR", 1234.5, "EUR"), ("€ 5m", 5e6, "EUR"), ("5m €", 5e6, "EUR"),
    ("£1.5bn", 1.5e9, "GBP"), ("$2 trillion", 2e12, "USD"), ("102.95bn GBP As of Feb 28 2026", 102.95e9, "GBP"), ("12 million", 12e6, None),
    ("1 234 567 CHF", 1234567.0, "CHF"), ("1'234.50", 1234.5, None), ("-3.5m USD", -3.5e6, "USD"), ("USD −7", -7.0, "USD"), ("+9 k", 9e3, None),
    ("0,5", 0.5, None), ("1,234", 1234.0, None), ("12,34", 12.34, None), ("1.234", 1.234, None), ("500 thousand JPY", 5e5, "JPY"), ("3 tn", 3e12, None),
    ("4 trn EUR", 4e12, "EUR"), ("7 b", 7e9, None), ("8 mn USD", 8e6, "USD"), ("1,105.2 ( million EUR )", 1105.2e6, "EUR"), ("250 (USD)", 250.0, "USD"),
    ("Size: EUR 12.5 million", 12.5e6, "EUR"), ("none", None, None), ("", None, None), (None, None, None), ("5x", None, None),
    ("1.234.567,8", 1234567.8, None), ("1,234,567.8", 1234567.8, None), ("¥ 1000", 1000.0, "JPY"), ("1 000,25 €", 1000.25, "EUR"), ("9 M", 9e6, None),
    ("Total 10 Bn usd", 10e9, None), ("0", 0.0, None), ("00.50", 0.5, None), ("CHF 1'000'000", 1e6, "CHF"), ("2.5 billion USD", 2.5e9, "USD"),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(AMOUNTS)], "i int, c string").select("i", R.amount(F.col("c")).alias("x")).orderBy("i").collect()
    assert [(AMOUNTS[r.i][0], r.x.value, r.x.currency) for r in rows] == AMOUNTS and len(AMOUNTS) == 40


def facts_of(spark, html):
    row = R.caption_facts(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").first()
    return [tuple(x) for x in row.facts]


def test_captions_belong_to_the_data_after_them(spark):
    item = '<div class="product-data-item"><div class="caption">{}</div><div class="data">{}</div></div>'
    assert facts_of(spark, item.format("Index", "<b>MSCI</b> World") + item.format("Fee", " ")) == [("Index", "MSCI World", None)]
    dated = '<span class="caption x">Size <button>?</button><div class="tip">hint</div><span class=\'as-of-date\'>as of 03/Feb/2026</span></span><i class="data">5</i>'
    assert facts_of(spark, dated) == [("Size", "5", "2026-02-03")]
    # data without a caption, two data of one caption, captions in a row, an empty caption
    broken = '<p class="data">lost</p>' + item.format("A", "1") + '<div class="data">2</div><div class="caption">B</div><div class="caption">C</div><div class="data">3</div>' + item.format("", "x")
    assert facts_of(spark, broken) == [("A", "1", None), ("C", "3", None)]
    # not closed, other classes of similar names, one caption twice: the first's place and the last's value
    odd = '<td class="data-x">no</td><td class=\'caption\'>A<td class="col data">1 <b>x<td class="caption">B</td><td class="data">2</td>' + item.format("A", "9")
    assert facts_of(spark, odd) == [("A", "9", None), ("B", "2", None)]
    assert facts_of(spark, None) == facts_of(spark, "") == facts_of(spark, "<div class=") == []


def test_exact_captions_come_before_words_within(spark):
    rows = spark.createDataFrame([([("Fund Asset Class", "x", None), ("asset class", "", None), ("Asset Class", "Bond", None)],)], f"f {R.FACTS}")
    assert rows.select(R.lookup(F.col("f"), ("ASSET CLASS",), ("ASSET",))).first()[0] == "Bond"
    assert rows.select(R.lookup(F.col("f"), ("none",), ("ASSET",))).first()[0] == "x"
    assert rows.select(R.lookup(F.col("f"), ("none",), (), "fund")).first()[0] == "x"


def test_a_fee_without_a_caption_is_found_in_the_text(spark):
    got = R.product_facts(spark.createDataFrame([(1, "<p>Total Expense Ratio is <b>0,25</b> %</p>")], "k int, html string"), "k", "html").first()
    assert got.ter == 0.25 and got.fund_size_value is None and got.hedged_flag is None


def plain_grid(html):
    return [(c["table_no"], c["row_no"], c["col_no"], c["row_header"], c["col_header"], c["text"], c["lead"]) for c in R.grid_cells(html)]


def test_spanning_cells_keep_their_places():
    html = """<table><tr><th></th><th colspan=2>Both</th><th>One</th></tr>
    <tr><th rowspan="2">R</th><td>a</td><td rowspan=2>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>"""
    assert plain_grid(html) == [(0, 1, 1, "R", "Both", "a", True), (0, 1, 2, "R", "Both", "b", False), (0, 1, 3, "R", "One", "c", False), (0, 2, 1, "R", "Both", "d", True), (0, 2, 3, "R", "One", "e", False)]


@pytest.mark.parametrize("html", [None, "", "<td>x</td>", "<table>", "<table><tr></table>", "</table></td>"])
def test_pages_without_cells(html):
    assert plain_grid(html) == []


def test_broken_and_nested_tables():
    assert plain_grid("<table><th>H<td>1<td>2<tr><td>3") == [(0, 0, 1, "H", None, "1", True), (0, 0, 2, "H", None, "2", False), (0, 1, 0, None, "H", "3", True)]
    nested = "<table><tr><th>A</th><td>x<table><tr><th>B</th><td>y</td></tr></table>z</td></tr></table>"
    assert plain_grid(nested) == [(0, 0, 1, "A", None, "x\nz", True), (1, 0, 1, "B", None, "y", True)]
    assert plain_grid('<table><tr><td rowspan=0 colspan="-3">a</td><td rowspan=x>b</td></tr></table>') == [(0, 0, 0, None, None, "a", True), (0, 0, 1, None, None, "b", False)]
    assert len(plain_grid("<table><tr>" + '<td colspan="99999999">x</td>' * 3 + "</tr></table>")) == 3


def brute_grid(rows):
    """Placement by a dense matrix; rows of (kind, text, down, across)."""
    wide = sum(c[3] for r in rows for c in r) + 1
    grid = [[None] * wide for _ in rows]
    for r, cells in enumerate(rows):
        c = 0
        for kind, text, down, across in cells:
            while grid[r][c] is not None:
                c += 1
            for y in range(r, min(r + down, len(rows))):
                for x in range(c, c + across):
                    if grid[y][x] is None:
                        grid[y][x] = (kind, text, (y, x) == (r, c))
            c += across
    out = []
    for y, line in enumerate(grid):
        for x, cell in enumerate(line):
            if cell and cell[0] == "td" and cell[2]:
                left = [line[k][1] for k in range(x) if line[k] and line[k][0] == "th"]
                up = [grid[k][x][1] for k in range(y) if grid[k][x] and grid[k][x][0] == "th"]
                out.append((0, y, x, left[-1] if left else None, up[-1] if up else None, cell[1]))
    return out


def test_grids_equal_a_dense_matrix():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        rows = [[(rnd.choice(["td", "td", "th"]), f"t{rnd.randint(0, 99)}", rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 2])) for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(1, 5))]
        html = "<table>" + "".join("<tr>" + "".join(f"<{k} rowspan={d} colspan='{a}'>{t}</{k}>" for k, t, d, a in r) + "</tr>" for r in rows) + "</table>"
        assert [c[:6] for c in plain_grid(html)] == brute_grid(rows), html


def test_size_and_style_come_from_the_cell_before_the_prose(spark):
    cell = "<table><tr><th>Investment style (stocks)</th><td><span>Market Cap: Giant</span><br>Investment Style: Growth</td></tr></table>"
    prose = '<div class="mod-aside__module x"><h3>Objective</h3><p>Small cap companies of value</p></div>'
    pages = spark.createDataFrame([(1, cell + prose), (2, prose), (3, "<table><tr><th>Investment style</th><td>Mid core</td></tr></table>"), (4, None)], "k int, html string")
    got = {r.k: (r.equity_size_hint, r.equity_style_hint) for r in R.tearsheet_facts(pages, "k", "html").collect()}
    assert got == {1: ("large", "growth"), 2: ("small", "value"), 3: ("mid", "blend"), 4: (None, None)}


def lines(spark, text):
    return R.line_facts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()


def test_lines_come_before_the_whole_text(spark):
    got = lines(spark, "EQUITY\nTotal Expense Ratio (TER) p.a. 0.2 %\nManagement fees and other administrative or operating costs 0,35 %\nType of shares Distribution")
    assert (got.ter, got.use_of_income, got.asset_class_hint) == (0.2, "Distributing", "Equity")
    got = lines(spark, "Management fees and other administrative\nor operating costs\n0.15 % a year\nIncome treatment\nCapitalisation UCITS\ncompliant NO")
    assert (got.ter, got.use_of_income, got.ucits_compliant) == (0.15, "Accumulating", 0)
    assert lines(spark, "UCITS compliant: yes\nUCITS compliant: no").ucits_compliant == 1
    assert lines(spark, "Total Expense Ratio 250 %").ter is None and lines(spark, None).ter is None
    got = lines(spark, "Assets Under Management (AUM) : 1,105.2 ( million EUR ) AUM as of : 28/02/2026 Fund structure: fund under IRISH law Replication type : Physical Benchmark : 100% MSCI World First NAV")
    assert (got.fund_size_value, got.fund_size_currency, got.fund_size_asof, got.domicile_country, got.replication_method, got.benchmark_name) == (1105.2e6, "EUR", "2026-02-28", "Irish", "physical", "MSCI World")
    assert (lines(spark, "x EUR HDG y").hedged_flag, lines(spark, "x EUR HDG y").hedged_target, lines(spark, "unhedged").hedged_flag, lines(spark, "plain").hedged_flag) == (1, "EUR", 0, None)


PROSE = [
    ("aims to reflect the performance, before fees and expenses, of the MSCI World (Index).", "MSCI World", 1, "Equity"),
    ("will track the performance, before fees and expenses, of the FTSE 100, net.", "FTSE 100", 2, "Equity"),
    ("seeks to track as closely as possible the performance of the Bloomberg Treasury Bond. x", "Bloomberg Treasury Bond", 3, "Bond"),
    ("The reference index is STOXX 600. x", "STOXX 600", 4, "Equity"),
    ("The underlying index shall be Solactive Gold, in USD", "Solactive Gold", 5, "Commodity"),
    ("Benchmark index: Markit Credit. x", "Markit Credit", 6, "Bond"),
    ("Benchmark: a mix of things.", None, None, None),
    ("A money market fund", None, None, "Cash"),
    ("A balanced one", None, None, "Multi"),
    ("x" * 900 + " balanced equity stocks", None, None, "Equity"),
    (None, None, None, None),
]


def test_ranked_patterns_of_prose(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(PROSE)], "k int, t string")
    got = R.prose_metadata(docs, "k", "t").orderBy("k").collect()
    assert [(r.benchmark_name, r.benchmark_rank, r.asset_class_hint) for r in got] == [p[1:] for p in PROSE]
    said = spark.createDataFrame([(1, "authorised in the Netherlands; by holding all 50 securities, EUR hedged"), (2, "swap, HEDGED to USD, Irish based UCITS"), (3, "Unhedged")], "k int, t string")
    got = [(r.domicile_country, r.replication_method, r.hedged_flag, r.hedged_target) for r in R.prose_metadata(said, "k", "t").orderBy("k").collect()]
    assert got == [("Netherlands", "physical", 1, "EUR"), ("Ireland", "synthetic", 1, "USD"), (None, None, 0, None)]


def test_fees_of_pages_by_rank(spark):
    for html, want in (("Ongoing charge 0.5 % TER 0,3%", (1, 22, 0.3)), ("TER 300 % ongoing charges: 0.2 %", (2, 11, 0.2)), ("total expense ratio 1 %", (3, 1, 1.0)), ("fee 1 %", (None, None, None)), (None, (None, None, None))):
        assert tuple(one(spark, html, R.page_fee)) == want, html


def test_discovery_terms(spark):
    rows = spark.createDataFrame([("ie00", " ab ", "iShs Core S+P 500 UCT ETF (Acc)"), (None, None, None), ("ie1", None, "USD Corp BD")], "i string, t string, n string")
    got = [r[0] for r in rows.select(R.discovery_terms(F.col("i"), F.col("t"), F.col("n"))).collect()]
    bare = "S&P 500 ( )"
    assert got[0] == ["IE00", "AB", "iShs Core S+P 500 UCT ETF (Acc)", "ISHARES CORE S&P 500 UCITS ETF (ACC)", bare, f"ISHARES {bare}"]
    assert got[1] == [] and got[2] == ["IE1", "USD Corp BD", "USD CORP BOND", "CORP BOND", "ISHARES CORP BOND", "ISHARES CORE CORP BOND"]
