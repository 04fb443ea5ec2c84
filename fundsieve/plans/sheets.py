"""Registered queries of the readers, over fact sheets that are made from the columns of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import extract as X
from ..operators import latest as L
from ..operators import readers as R
from ..operators import serve as V
from ..operators.ranks import dealt, shared_dir
from ..sources.feeds import FeedSpec, read_feed
from .catalogue import query, t


def said(*parts):
    """Texts and columns one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def part(spark, sf_dir):
    return t(spark, sf_dir, "part")


def sheets(spark, sf_dir):
    """Parts, each of which stands for a sheet: reading one takes long, so they are dealt out to many tasks."""
    return dealt(part(spark, sf_dir), "p_partkey")


def size():
    return F.col("p_size")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 6 > 0 THEN p_size / 100.0 END::DOUBLE AS ter, CASE WHEN p_size % 2 = 1 THEN 'Accumulating' END AS use_of_income, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS ucits_compliant,
    p_brand AS benchmark_name, NULL::VARCHAR AS asset_class_hint, CASE WHEN p_size % 4 = 1 THEN 'Ireland' WHEN p_size % 4 = 2 THEN 'Jersey' END AS domicile_country,
    CASE WHEN p_size % 3 = 0 THEN p_size * 1000 + 250.75 ELSE p_size * 1000 + 500 END::DOUBLE AS fund_size_value, CASE WHEN p_size % 3 = 0 THEN 'USD' ELSE 'EUR' END AS fund_size_currency,
    CASE WHEN p_size % 3 = 0 THEN '2026-03-0' || (1 + p_size % 9) ELSE '2026-02-0' || (1 + p_size % 9) END AS fund_size_asof, CASE WHEN p_size % 3 = 0 THEN 'fund' ELSE 'share_class' END AS fund_size_scope,
    CASE WHEN p_size % 5 = 0 THEN 'synthetic' ELSE 'physical' END AS replication_method, (p_size % 4 IN (1, 2))::INT AS hedged_flag, CASE WHEN p_size % 4 = 2 THEN 'EUR' END AS hedged_target FROM part"""
)
def product_page_facts(spark, sf_dir):
    """Captioned facts of product pages, some of them broken: cells not closed, captions without data, repeated captions."""
    day = (1 + size() % 9).cast("string")
    percent = R.T.fixed(size() / 100, 2)
    html = said(
        F.when(size() % 6 > 0, said('<div class="product-data-item"><div class="caption">Total Expense Ratio <button>?</button></div><div class="data"><b>', percent, "</b> %</div></div>")).otherwise('<div class="caption">Total Expense Ratio</div><div class="data">n/a</div>'),
        "<div><span class='caption net'>Net Assets <div class=\"as-of-date x\">as of 0", day, '/Feb/2026</div></span><span class="data">EUR ', size().cast("string"), ",500</span></div>",
        F.when(size() % 3 == 0, said('<div class="caption">Net Assets of Fund<i class="as-of-date">as of 2026-03-0', day, '</i></div><td class="col data">USD ', size().cast("string"), ".250,75")).otherwise(""),
        '<p class="caption">Benchmark Index</p><p class="other">no</p><p class="data">first</p><p class="caption"></p><p class="data">lost</p>',
        '<p class="caption">Asset Class</p><p class="caption">Use of Income<div class="tip">why</div></p><p class="data">', F.when(size() % 2 == 1, "accumulating fund").otherwise(" "), "</p>",
        '<p class="caption">Benchmark Index</p><p class="data">', F.col("p_brand"), "</p>",
        '<p class="caption">UCITS Compliant</p><p class="data">', F.when(size() % 3 == 0, "Yes").when(size() % 3 == 1, "no").otherwise("maybe"), "</p>",
        F.when(size() % 4 == 1, '<p class="caption">Place of domicile</p><p class="data">Jersey</p><p class="caption">Domicile</p><p class="data">Ireland</p>').when(size() % 4 == 2, '<p class="caption">Place of domicile</p><p class="data">Jersey</p>').otherwise(""),
        '<p class="caption">Replication Method</p><p class="data">', F.when(size() % 5 == 0, "Swap based").otherwise("Physical, all"), "</p>",
        '<p class="caption">Currency Hedged</p><p class="data">', F.when(size() % 4 == 1, "Yes").when(size() % 4 == 2, "EUR hedged").when(size() % 4 == 3, "No").otherwise("Unhedged"), "</p>",
    )
    return R.product_facts(sheets(spark, sf_dir).select("p_partkey", html.alias("html")), "p_partkey", "html")


@query(
    """SELECT p_partkey, 'IE' || p_partkey AS isin, (p_size / 10.0)::DOUBLE AS ter, CASE p_size % 3 WHEN 0 THEN 'Accumulating' WHEN 1 THEN 'Distributing' END AS use_of_income, p_brand AS domicile_country,
    CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1e6 ELSE p_size * 1e9 END::DOUBLE AS fund_size_value, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'GBP' END AS fund_size_currency,
    CASE WHEN p_size % 4 > 1 THEN '2026-02-1' || (p_size % 9) END AS fund_size_asof, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'share_class' ELSE 'fund' END AS fund_size_scope,
    CASE p_size % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'mid' WHEN 2 THEN 'small' END AS equity_size_hint, CASE p_size % 4 WHEN 0 THEN 'growth' WHEN 1 THEN 'blend' WHEN 2 THEN 'value' END AS equity_style_hint FROM part"""
)
def tearsheet_page_facts(spark, sf_dir):
    """Facts of tear sheets by the grid of their tables, with cells that span rows and columns, and prose as fallback."""
    n = size().cast("string")
    row = lambda *p: said("<tr><th scope=row>", *p)
    html = said(
        '<table class="mod-ui-table"><tr><th colspan=3>Profile</th></tr>', row("ISIN</th><td colspan='2'>IE"), F.col("p_partkey").cast("string"), "</td><td>more</td></tr>",
        row("Ongoing charge</th><td>"), R.T.fixed(size() / 10, 1), " %</td>", row("Income treatment</th><td>"), F.when(size() % 3 == 0, "Accumulation").when(size() % 3 == 1, "Income").otherwise("--"), "</td></tr>",
        '<tr><th rowspan="2">Domicile</th><td>', F.col("p_brand"), "<td>x</td></tr><tr><th>Other</th><td>none</td></tr>",
        row("Fund size</th><td>"), F.when(size() % 4 > 1, said(n, "bn GBP<br>As of Feb 1", (size() % 9).cast("string"), " 2026")).otherwise("--"), "</td></tr>",
        row("Share class size</th><td>"), F.when(size() % 4 == 1, said(n, "m EUR")).when(size() % 4 > 1, "1 USD").otherwise(""), "</td></tr>",
        F.when(size() % 4 == 0, row("Investment style (stocks)</th><td><span>Market Cap: Giant</span><br>Investment Style: Growth</td></tr>")).when(size() % 4 == 1, row("Investment style</th><td>Medium core</td></tr>")).otherwise(""),
        "</table>", F.when(size() % 4 == 2, '<div class="mod-aside__module"><h3>Objective</h3> Small caps of good value.</div>').otherwise("<div><h3>Objective</h3> large</div>"),
    )
    return R.tearsheet_facts(sheets(spark, sf_dir).select("p_partkey", html.alias("html")), "p_partkey", "html")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 2 THEN p_size / 10.0 ELSE p_size / 100.0 END::DOUBLE AS ter, CASE p_size % 3 WHEN 0 THEN 'Accumulating' WHEN 1 THEN 'Distributing' END AS use_of_income,
    CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS ucits_compliant, p_brand || ' index' AS benchmark_name, CASE WHEN p_size % 2 = 0 THEN 'Bond' END AS asset_class_hint, 'Luxembourg' AS domicile_country,
    CASE p_size % 3 WHEN 0 THEN p_size * 1000000.0 WHEN 1 THEN p_size * 1000000000.0 ELSE p_size * 1000 + 5 END::DOUBLE AS fund_size_value, CASE p_size % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'CHF' END AS fund_size_currency, 'fund' AS fund_size_scope,
    CASE WHEN p_size % 3 = 0 THEN '2026-02-1' || (p_size % 9) END AS fund_size_asof, CASE WHEN p_size % 2 = 0 THEN 'physical' ELSE 'synthetic' END AS replication_method, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS hedged_flag, CASE WHEN p_size % 5 = 1 THEN 'GBP' END AS hedged_target FROM part"""
)
def text_sheet_facts(spark, sf_dir):
    """Facts of fact sheets' texts: values by line before the whole text, amounts with scales, labelled fields."""
    n, pct = size().cast("string"), F.replace(R.T.fixed(size() / 100, 2), F.lit("."), F.lit(","))
    text = said(
        F.when(size() % 2 == 0, "BOND\r\n").otherwise("Fund report\n"),
        F.when(size() % 4 < 2, said("Management fees and other administrative or operating costs ", pct, " % of the value\n")).when(size() % 4 == 2, said("Total Expense\nRatio (TER) p.a. ", R.T.fixed(size() / 10, 1), "\n")).otherwise("Total Expense Ratio 900 %\n"),
        F.when(size() % 3 == 0, "Type of shares: Capitalisation\n").when(size() % 3 == 1, "Income treatment\nDistribution\n").otherwise("Income treatment: other\n"),
        F.when(size() % 4 == 0, "UCITS compliant: NO\nUCITS compliant: YES\n").when(size() % 4 == 1, "UCITS\ncompliant Yes\n").otherwise("none\n"),
        "Fund structure : SICAV under LUXEMBOURG law\nReplication type : ", F.when(size() % 2 == 0, "Physical").otherwise("Synthétic swap"), "\nBenchmark : 100% ", F.col("p_brand"), " index\nFirst NAV 1 \n",
        F.when(size() % 3 == 0, said("AUM as of : 1", (size() % 9).cast("string"), "/02/2026 Assets Under Management (AUM) : ", n, ".0 ( million EUR )")).when(size() % 3 == 1, said("Total Fund Assets : ", n, " (bn USD)")).otherwise(said("Total asset ", n, ",005 (CHF)")),
        F.when(size() % 5 == 0, " Unhedged").when(size() % 5 == 1, " GBP Hedged").otherwise(""),
    )
    return R.line_facts(sheets(spark, sf_dir).select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 < 6 THEN 'MSCI ' || replace(p_brand, '#', ' ') END AS benchmark_name, CASE WHEN p_size % 7 < 6 THEN p_size % 7 + 1 END::INT AS benchmark_rank, CASE p_size % 5 WHEN 0 THEN 'Ireland' WHEN 1 THEN 'Luxembourg' WHEN 2 THEN 'Netherlands' END AS domicile_country,
    CASE WHEN p_size % 7 < 6 THEN 'Equity' WHEN p_size % 3 = 0 THEN 'Bond' WHEN p_size % 3 = 1 THEN 'Cash' ELSE 'Multi' END AS asset_class_hint, CASE WHEN p_size % 7 < 6 THEN 3 WHEN p_size % 3 = 0 THEN 5 WHEN p_size % 3 = 1 THEN 7 ELSE 10 END::INT AS asset_class_rank,
    CASE p_size % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'physical' WHEN 2 THEN 'physical' END AS replication_method, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS hedged_flag, CASE WHEN p_size % 3 = 1 THEN 'JPY' END AS hedged_target FROM part"""
)
def prose_facts(spark, sf_dir):
    """Facts of prose by ranked sets of patterns, with the ranks that won."""
    name = F.replace("p_brand", F.lit("#"), F.lit(" "))
    ways = ("It aims to reflect the performance, before fees and expenses, of the MSCI {} (Index).", "It will track the performance, before fees and expenses, of MSCI {}, net.", "It seeks to track as closely as possible the performance of the MSCI {}. ", "The reference index shall be MSCI {}. ", "The underlying index is MSCI {}, net. ", "Benchmark: MSCI {}. ")
    intro = F.when(F.lit(False), "")
    for k, way in enumerate(ways):
        before, after = way.split("{}")
        intro = intro.when(size() % 7 == k, said(before, name, after))
    text = said(
        intro.otherwise("Benchmark: a mix. "),
        F.when(size() % 3 == 0, "A floating rate one, unhedged. ").when(size() % 3 == 1, "A money market one, JPY currency hedged. ").otherwise("A balanced one. "),
        F.when(size() % 5 == 0, "This Irish based UCITS ").when(size() % 5 == 1, "regulated by the Commission de Surveillance du Secteur Financier ").when(size() % 5 == 2, "under the laws of the Netherlands ").otherwise("anywhere "),
        F.when(size() % 4 == 0, "by a swap").when(size() % 4 == 1, "with direct replication").when(size() % 4 == 2, "invests directly in many of its constituents").otherwise("somehow"),
    )
    return R.prose_metadata(sheets(spark, sf_dir).select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END::INT AS rank, CASE p_size % 4 WHEN 0 THEN length('p' || p_size) + 22 WHEN 1 THEN length('p' || p_size) + 12 WHEN 2 THEN length('p' || p_size) + 2 END::INT AS place, CASE WHEN p_size % 4 < 3 THEN p_size / 100.0 END::DOUBLE AS value FROM part"""
)
def fees_of_pages(spark, sf_dir):
    """The fee of pages by labels in order, with the place of the label that won."""
    pct = R.T.fixed(size() / 100, 2)
    text = said("p", size().cast("string"), " ", F.when(size() % 4 == 0, said("Ongoing charge 1 %, \n TER is  ", pct, " %")).when(size() % 4 == 1, said("TER 400 % Ongoing charges of ", pct, " %")).when(size() % 4 == 2, said("Total expense ratio <b>", pct, "</b> ", pct, "%")).otherwise("TER none"))
    rows = sheets(spark, sf_dir).select("p_partkey", R.page_fee(text).alias("f"))
    return rows.select("p_partkey", "f.rank", "f.place", "f.value")


@query(
    """WITH n AS (SELECT p_partkey, p_brand, p_name, upper(replace(p_brand, '#', ' ')) AS b, upper(p_name) AS name, p_size FROM part),
    o AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'iShs Core ' WHEN 1 THEN 'ISHRS ' ELSE '' END || p_name || ' & ' || p_brand || ' UCT ETF Acc' AS raw, CASE p_size % 3 WHEN 0 THEN 'ISHARES CORE ' WHEN 1 THEN 'ISHARES ' ELSE '' END || name || ' AND ' || b || ' UCITS ETF ACC' AS opened, name || ' AND ' || b AS bare FROM n)
    SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['IE' || p_partkey, 'T' || p_size, raw, opened, bare, 'ISHARES ' || bare] WHEN p_size % 3 = 0 THEN ['IE' || p_partkey, raw, opened, bare, 'ISHARES ' || bare] ELSE ['IE' || p_partkey, raw, opened, bare, 'ISHARES ' || bare, 'ISHARES CORE ' || bare] END, '|') AS terms FROM o"""
)
def search_terms(spark, sf_dir):
    """At most six search terms of each name."""
    name = said(F.when(size() % 3 == 0, "iShs Core ").when(size() % 3 == 1, "ISHRS ").otherwise(""), F.col("p_name"), " & ", F.col("p_brand"), " UCT ETF Acc")
    ticker = F.when(size() % 2 == 0, said(" t", size().cast("string"), " "))
    return sheets(spark, sf_dir).select("p_partkey", F.array_join(R.discovery_terms(said("ie", F.col("p_partkey").cast("string")), ticker, name), "|").alias("terms"))


@query(
    """WITH i AS (SELECT p_partkey, p_partkey % 4 = 2 AS d, p_partkey % 3 = 0 AS u, contains(upper(p_name), 'GREEN') AS n FROM part WHERE p_size % 5 = 0)
    SELECT unnest(['candidates', 'updated', 'document_host', 'url_map', 'name_rule']) AS what, unnest([count(*), count(*) FILTER (WHERE d OR u OR n), count(*) FILTER (WHERE d), count(*) FILTER (WHERE u AND NOT d), count(*) FILTER (WHERE n AND NOT d AND NOT u)]) AS n FROM i"""
)
def issuer_writes(spark, sf_dir):
    """What writing the issuers of instruments without one did, as observed in the write."""
    rows = part(spark, sf_dir).withColumn("instrument_id", F.col("p_partkey"))
    catalog = {
        "instrument": rows.select("instrument_id", F.col("p_name").alias("instrument_name"), F.when(size() % 5 > 0, 1).cast("long").alias("issuer_id")),
        "document": rows.where("p_partkey % 2 = 0").select("instrument_id", F.col("p_partkey").alias("document_id"), said("https://www.house-", (F.col("p_partkey") % 4).cast("string"), ".com/x.pdf").alias("url")),
        "instrument_url_map": rows.where("p_partkey % 3 = 0").select("instrument_id", F.lit("http://sub.house-1.com/y").alias("url")),
    }
    path = f"{shared_dir(spark)}/issuers-{uuid.uuid4().hex}"
    counts = K.normalize_unknown_issuers(spark, catalog, path, [("Green House", "GREEN")], [("House One", ["house-1.com"]), ("House Two", ["house-2.com"])])
    return spark.createDataFrame([(k, v) for k, v in counts.items()], "what string, n long")


@query(
    """SELECT 'P' || p_partkey AS isin, p_name || chr(10) || '"' || p_brand || '"; ' || p_type AS instrument_name, CASE WHEN p_size % 4 > 0 THEN 'T' || p_size END AS ticker, p_type AS venue_mic FROM part"""
)
def feed_records(spark, sf_dir):
    """A landed feed read back: late headers, quoted line ends, separators and quotes, columns by other names."""
    quoted = lambda c: said('"', F.replace(c, F.lit('"'), F.lit('""')), '"')
    name = said(F.col("p_name"), '\n"', F.col("p_brand"), '"; ', F.col("p_type"))
    line = F.concat_ws(";", said("P", F.col("p_partkey").cast("string")), quoted(name), F.when(size() % 4 > 0, said("T", size().cast("string"))).otherwise(" "), "p_type")
    # files of 500 records at most, each with its own header below a title
    files = part(spark, sf_dir).select(F.floor(F.col("p_partkey") / 500).alias("file"), line.alias("line")).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    files.select("file", said("All listings;\n\nISIN Code;Long  Name;Mnemonic;MIC\n", F.col("body")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    spec = FeedSpec(";", "isin", {"isin": ["ISIN", "ISIN Code"], "instrument_name": ["Name", "Long Name"], "ticker": ["Mnemonic"], "venue_mic": ["MIC Code", "MIC"]})
    return read_feed(spark, f"{path}/*/*.txt", spec).select("isin", "instrument_name", "ticker", "venue_mic")


@query(
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT p_brand, p_type, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY p_brand) AS weight, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM c)
    SELECT p_brand, string_agg(printf('%.0f', weight) || '% ' || lower(p_type), ' / ' ORDER BY place) AS line FROM w GROUP BY p_brand"""
)
def strategy_lines(spark, sf_dir):
    """The mix of each brand as one line: its types by weight."""
    counted = part(spark, sf_dir).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("p_brand").agg(F.sum("n").alias("all"))
    rows = counted.join(whole, "p_brand").withColumn("weight", F.lit(100.0) * F.col("n") / F.col("all")).withColumn("place", F.struct(-F.col("n"), "p_type"))
    return V.mix_lines(rows.withColumn("p_type", F.replace("p_type", F.lit(" "), F.lit("_"))), "p_brand", "place", "p_type", "weight")


@query(
    """WITH r AS (SELECT p_type, p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS place FROM part)
    SELECT p_type, count(*) AS n, string_agg(CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey ELSE 'T' || p_size END || CASE WHEN p_size % 4 > 0 THEN ' (' || printf('%.2f', p_size / 8.0) || '%)' ELSE '' END || CASE WHEN p_size % 5 > 0 THEN ' | ' || p_brand ELSE '' END, '; ' ORDER BY place) AS line FROM r WHERE place <= 3 GROUP BY p_type"""
)
def candidate_lines(spark, sf_dir):
    """The three candidates of each type as labels: ticker or id, fee, venue."""
    top = L.top_rows(part(spark, sf_dir), ["p_type"], [F.col("p_retailprice"), F.col("p_partkey")], 3, "place")
    ticker = F.when(size() % 3 == 0, F.lit(" unknown ")).otherwise(said("T", size().cast("string")))
    label = V.candidate_label(ticker, said("P", F.col("p_partkey").cast("string")), F.when(size() % 4 > 0, size() / 8), F.when(size() % 5 > 0, F.col("p_brand")).otherwise(""))
    return V.bucket_tables(top, "p_type", "place", label)


@query(
    """SELECT p_partkey, 'IE00' || lpad(p_partkey::VARCHAR, 7, '0') || '1' AS isin, 'T' || p_size AS symbol, p_brand AS name, CASE p_size % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency FROM part WHERE p_size % 7 > 0"""
)
def listings_of_tables(spark, sf_dir):
    """Listings from tables with a header that names the columns, in either order, beside rows and tables of other kinds."""
    isin = said("IE00", F.lpad(F.col("p_partkey").cast("string"), 7, "0"), "1")
    money = F.when(size() % 3 == 0, "EUR").when(size() % 3 == 1, "USD").otherwise("GBX")
    one = said("<table><tr><th>Instrument</th><th>ISIN code</th><th>Ticker</th><th>Currency</th></tr><tr><td>", F.col("p_brand"), "</td><td> ", F.lower(isin), " </td><td>T ", size().cast("string"), "</td><td>", money, "</td></tr><tr><td>short</td></tr><tr><td>x</td><td>none</td><td>Y</td><td>EUR</td></tr></table>")
    two = said("<table><tr><td>Mnemonic</td><td>ISIN</td><td>Trading currency</td><td>Name</td></tr><tr><td>T", size().cast("string"), "</td><td><b>", isin, "</b></td><td>", money, "</td><td>", F.col("p_brand"), "</td></tr></table>")
    other = said("<table><tr><td>Name</td><td>Symbol</td></tr><tr><td>", F.col("p_brand"), "</td><td>", isin, "</td></tr></table>")
    html = F.when(size() % 7 == 0, other).when(size() % 2 == 0, said(other, one)).otherwise(two)
    return X.listing_tables(sheets(spark, sf_dir).select("p_partkey", html.alias("html")), "p_partkey", "html")


@query(
    r"""WITH l AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1), lambda x: regexp_replace(regexp_replace(x, '[?#].*$', ''), '/+$', '')))) AS link FROM pages), h AS (SELECT *, regexp_replace(regexp_extract(lower(link), '^https?://([^/:?#]+)', 1), '^www\.', '') AS host, regexp_matches(lower(link), '^https?://') AS web FROM l WHERE link <> '')
    SELECT page_id, link, CASE WHEN NOT web THEN 'scheme' WHEN regexp_matches(host, '(^|\.)ads\.example$') THEN 'banned_domain' WHEN NOT regexp_matches(host, '(^|\.)example\.(com|org)$') THEN 'unknown_domain' WHEN NOT contains(lower(link), '.pdf') THEN 'not_a_document' WHEN NOT regexp_matches(lower(link), 'kid|factsheet') THEN 'no_keyword' END AS reason FROM h"""
)
def document_links(spark, sf_dir):
    """Why each link of every page is no candidate for a document, if it is none."""
    links = X.extract_links(t(spark, sf_dir, "pages"), "page_id", "html")
    return X.score_links(links, "link", ["example.com", "example.org"], ["ads.example"], ["kid", "factsheet"]).select("page_id", "link", "reason")
