"""State, screening, serving, extraction, feeds and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from fundsieve.operators import coverage, extract, latest, readers, screen, serve, state
from fundsieve.sources import feeds


def test_merge_is_sticky_and_repeatable(spark):
    cur = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "k int, x string, y double")
    new = spark.createDataFrame([(1, None, 5.0), (3, "c", None), (4, None, None)], "k int, x string, y double")
    once = state.merge_profile(cur, new, "k", ["x", "y"])
    twice = state.merge_profile(once, new, "k", ["x", "y"])
    want = [(1, "a", 5.0), (2, "b", 2.0), (3, "c", None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_ids_follow_the_existing_ones(spark):
    known = spark.createDataFrame([("a", 7)], "name string, id long")
    names = spark.createDataFrame([("c",), ("b",), ("a",), (None,), ("b",)], "name string")
    assert sorted(map(tuple, state.assign_ids(names, "name", "id", known).collect())) == [("a", 7), ("b", 8), ("c", 9)]


def test_primaries_are_unique_and_ties_are_ordered(spark):
    rows = spark.createDataFrame([(1, "XETR", "EUR", "B", 1), (1, "XLON", None, "A", 2), (1, "XLON", "USD", "C", 3), (2, None, "usd", "D", 4)], "k int, venue string, ccy string, ticker string, id int")
    got = latest.choose_primary(rows, "k", "venue", "ccy", ["ticker", "id"], ["XLON", "XETR"], ["USD", "EUR"]).where("primary_flag = 1").collect()
    assert sorted((r.k, r.id) for r in got) == [(1, 3), (2, 4)]


def test_precedence_mixes_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, "x"), (1, 1, 2.0, "y"), (2, 0, None, None)], "k int, o int, a double, b string")
    assert sorted(map(tuple, latest.coalesce_by_precedence(rows, "k", F.col("o"), ["a", "b"]).collect())) == [(1, 2.0, "x"), (2, None, None)]


FUND = "isin string, instrument_name string, instrument_type string, leverage_flag int, inverse_flag int, issuer_normalized string, primary_venue string, currency string, ongoing_charges double, asset_class string, geography_scope string, geography_region string, equity_size string, equity_style string, factor string, sector string, theme string, bond_type string, duration_bucket string, commodity_type string, cash_flag int, cash_proxy_flag int, govt_bond_flag int"


def fund(isin, name, **more):
    base = dict(isin=isin, instrument_name=name, instrument_type="ETF", leverage_flag=0, inverse_flag=0, issuer_normalized="X", primary_venue="XLON", currency="USD", ongoing_charges=0.2, asset_class="equity", geography_scope="global", geography_region="global", equity_size=None, equity_style=None, factor=None, sector=None, theme=None, bond_type=None, duration_bucket=None, commodity_type=None, cash_flag=0, cash_proxy_flag=0, govt_bond_flag=0)
    return tuple((base | more).values())


def test_shortlist_ranks_and_falls_back(spark):
    funds = spark.createDataFrame(
        [
            fund("IE1", "World A", ongoing_charges=0.3),
            fund("IE2", "World B", currency="EUR"),
            fund("IE3", "World Factor", factor="quality", primary_venue="XETR"),
            fund("IE4", "World ESG"),
            fund("IE5", "World Lev", leverage_flag=1),
            fund("XS6", "World note"),
            fund("IE7", "Gold bullion", instrument_type="ETC", asset_class="commodity", commodity_type="gold"),
            fund("IE8", "Gold Miners", asset_class="commodity", commodity_type="gold"),
            fund("IE9", "Short govt", asset_class="bond", bond_type="govt", duration_bucket="short", govt_bond_flag=1),
            fund("IE10", "Water World", theme="water"),
            fund("IE11", "No fee", ongoing_charges=None),
        ],
        FUND,
    )
    got = screen.shortlist(funds, selected=["XLON"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.bucket, []).append(r.isin)
    assert by["equity_global"] == ["IE2", "IE1", "IE3", "IE4"]  # the last attempt allows factors; ESG ranks last
    assert by["gold"] == ["IE7"] and by["cash"] == ["IE9"] and by["short_govt_bonds"] == ["IE9"]
    loose = screen.shortlist(funds, allow_missing_fees=True).where("isin = 'IE11'").select("bucket").collect()
    assert {r.bucket for r in loose} >= {"equity_global"}


def test_bucket_and_attempt_catalogues(spark):
    specs = screen.buckets()
    assert len({b["bucket"] for b in specs}) == len(specs) == 62
    ladder = screen.attempts(specs, True, ["XLON", "XETR"])
    assert [a["step"] for a in ladder if a["bucket"] == "short_bonds"] == ["strict", "fallback_allow_missing_fees"]
    with pytest.raises(ValueError):
        screen.custom_mix(spark, [("nowhere", 1.0)])
    with pytest.raises(ValueError):
        screen.custom_mix(spark, [("cash", -1.0)])
    mix = screen.custom_mix(spark, [("cash", 40.0), ("gold", 60.0)])
    picked = spark.createDataFrame([("cash", "a"), ("cash", "b")], "bucket string, isin string")
    assert screen.readiness(mix, picked).first().fewest == 0


def test_named_strategies_and_issuers(spark):
    from fundsieve.functions import presets

    mixes = screen.strategies(spark, presets.STRATEGIES)
    sums = {r.strategy: r.s for r in mixes.groupBy("strategy").agg(F.sum("weight").alias("s")).collect()}
    assert len(sums) == 20 and set(sums.values()) == {100.0}
    issuers = spark.createDataFrame([(5, "iShares VII plc"), (3, "BlackRock Fund AG"), (9, "Small House Ltd."), (1, None)], "issuer_id long, issuer_name string")
    got = {r.issuer_id: (r.normalized_name, r.domain, r.target_id) for r in state.normalize_issuers(issuers, presets.ISSUERS).collect()}
    assert got == {5: ("BlackRock / iShares", "ishares.com", 3), 3: ("BlackRock / iShares", "ishares.com", 3), 9: ("Small House", None, 9), 1: (None, None, 1)}


def test_universe_and_reasons(spark):
    inst = spark.createDataFrame([(1, "ETF", 1, 0, 0), (2, "ETC", 1, 0, 0), (3, "ETF", None, 0, 0), (4, "ETF", 1, 0, None)], "instrument_id long, instrument_type string, ucits_flag int, leverage_flag int, inverse_flag int")
    lst = spark.createDataFrame([(1, 1, None, "XLON", "A", None), (2, 1, "active", "XLON", "B", "USD"), (4, 1, "active", "XETR", "C", "JPY")], "instrument_id long, primary_flag int, status string, venue_mic string, ticker string, trading_currency string")
    assert [r.instrument_id for r in screen.eligible(inst, lst).collect()] == [1]


def test_serving_rules(spark):
    rows = spark.createDataFrame([(1, "Alpha_1", None), (2, "beta", " "), (3, "ALPHAX1", "tech")], "id int, name string, sector string")
    find = lambda q: sorted(r.id for r in rows.where(serve.everything(serve.search_test([F.col("name")], q))).collect())
    assert find(" alpha_1 ") == [1, 3] and find("") == [1, 2, 3]
    blank = serve.facet_tests({"sector": F.col("sector")}, {"sector": serve.BLANK})
    assert rows.where(serve.everything(blank)).count() == 2
    with pytest.raises(ValueError):
        serve.facet_tests({}, {"x": "1"})
    with pytest.raises(ValueError):
        serve.sort_columns({"id": F.col("id")}, "name", "asc", "id")
    with pytest.raises(ValueError):
        serve.tri_state("perhaps")
    assert serve.page(rows, [F.col("id")], 0, 1).count() == 1 and serve.page(rows, [F.col("id")], 1000).count() == 3
    assert [r.id for r in serve.page_after(rows, "id", "name", (1, "Alpha_1")).collect()] == [2, 3]
    log = spark.createDataFrame([(1, 1, "v1"), (1, 2, "v2"), (2, 1, "v1")], "id int, n int, v string")
    assert sorted(r.id for r in serve.pending(rows, log, "id", "n", F.col("v"), "v2").collect()) == [2, 3]


def test_weighted_mean_and_gaps(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.2), ("a", 3.0, None), ("b", 1.0, None)], "k string, w double, v double")
    got = {r.k: (r.weighted_value, r.covered_weight, r.total_weight) for r in coverage.weighted_mean(rows, ["k"], F.col("w"), F.col("v")).collect()}
    assert got == {"a": (0.2, 1.0, 4.0), "b": (None, 0.0, 1.0)}


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Ongoing charges are 9.5% now 0.20% later"), (2, "0.35% before ongoing charge only"), (3, "nothing"), (4, "IE00B4L5Y983 costs 0,17 and US0378331005 costs 0.25 IE00B4L5Y984")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hits, r.value) for r in extract.window_value(docs, "doc_id", "text", "ongoing charge", r"(\d+[.,]\d+)", 60, 0.0, 3.0).collect()}
    assert got == {1: (1, 0.2), 2: (1, 0.35)}
    assert [(r.pos, r.isin) for r in extract.extract_ids(docs.where("doc_id = 4"), "doc_id", "text").collect()] == [(0, "IE00B4L5Y983"), (1, "US0378331005")]
    keys = spark.createDataFrame([("US0378331005",), ("IE00B4L5Y983",)], "isin string")
    vals = extract.values_after_keys(docs, "doc_id", "text", keys, "isin", extract.ISIN, r"(\d+[.,]\d+)", 30, 0.0, 3.0)
    assert sorted((r.isin, r.value) for r in vals.collect()) == [("IE00B4L5Y983", 0.17), ("US0378331005", 0.25)]
    known = extract.choose_known(extract.extract_ids(docs, "doc_id", "text"), "doc_id", "isin", keys.where("isin like 'US%'"))
    assert [r.isin for r in known.collect()] == ["US0378331005"]
    page = spark.createDataFrame([(1, "<table><tr><th>Fee</th><td> 0.2 <b>%</b></td></tr><tr><th>Fund size</th><td>5m</td></tr><tr><th>fee</th><td>9</td></tr></table>")], "page_id long, html string")
    facts = extract.html_facts(page, "page_id", "html")
    assert tuple(facts.select(extract.fact(F.col("facts"), ["fee"]), extract.fact(F.col("facts"), ["x"], ["size"])).first()) == ("0.2 %", "5m")
    assert [r.cells for r in extract.extract_tables(page, "page_id", "html").orderBy("row_no").collect()][1] == ["Fund size", "5m"]
    tries = spark.createDataFrame([(1, 1, None, "no_source"), (1, 2, 0.3, "ok"), (2, 1, None, "parse_fail")], "k int, o int, v double, s string")
    assert sorted((r.k, r.v, r.outcome) for r in extract.first_success(tries, "k", "o", "v", "s").collect() if r.v) == [(1, 0.3, "ok")]


def test_prose_and_markup(spark):
    docs = spark.createDataFrame([(1, "The fund seeks to track the performance of the MSCI World Index, by holding all securities. It is authorised in Ireland. EUR hedged."), (2, "tracks the weather, no more"), (3, None)], "doc_id long, text string")
    a, b, c = readers.prose_metadata(docs, "doc_id", "text").orderBy("doc_id").collect()
    assert (a.benchmark_name, a.domicile_country, a.asset_class_hint, a.replication_method, a.hedged_flag) == ("MSCI World Index", "Ireland", "Equity", "physical", 1)
    assert set(tuple(b)[1:] + tuple(c)[1:]) == {None}
    page = spark.createDataFrame([(1, "<tr><td>London</td><td>AB C</td><td>USD</td></tr><tr><td>London</td><td>ABC</td> <td>USD</td></tr><tr><td>Moon</td><td>X</td><td>EUR</td></tr>")], "page_id long, html string")
    assert [tuple(r) for r in extract.page_listings(page, "page_id", "html", {"london": "XLON"}).collect()] == [(1, "XLON", "ABC", "USD")]


def test_feed_with_a_late_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Report;x\n\nProduct Status;ISIN;Long Name;Mnemonic;MIC;Currency\nActive;IE00B4L5Y983;\"Fund; \xe4\";AB C;XETR;EUR\nOld;IE00B4L5Y983;F;X;XETR;EUR\nActive;bad;F;X;XETR;EUR\n".encode("latin-1"))
    spec = feeds.FeedSpec(";", "product status", {"status": ["Product Status"], "isin": ["isin"], "instrument_name": ["Name", "Long Name"], "ticker": ["Mnemonic"], "venue_mic": ["MIC Code", "MIC"], "trading_currency": ["Currency"]}, 20, keep={"status": ["active"]})
    got = feeds.listings(feeds.read_feed(spark, str(tmp_path / "a.csv"), spec), "XETR").collect()
    assert [tuple(r) for r in got] == [("IE00B4L5Y983", "Fund; ä", "XETR", "ABC", "EUR")]


def test_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "a")], "id int, name string")
    feeds.write_csv_report(rows, f"{tmp_path}/csv", ["name", "id"], ["id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["name", "id"]
    feeds.write_json_report(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert feeds.table_or_empty(spark, "no_such_table", rows.schema).count() == 0


def test_records_may_span_lines(spark, tmp_path):
    text = 'report\nISIN;Name;Ticker\nIE1;"two\nlines; and a ""word""";A\r\nIE2;5" disk;"B"\nIE3;"";\n\nIE4;"open\n to the end'
    (tmp_path / "feed.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "none.csv").write_text("nothing\nhere")
    (tmp_path / "empty.csv").write_text("")
    spec = feeds.FeedSpec(";", "isin", {"isin": ["ISIN"], "name": ["x", "name"], "ticker": ["Ticker"]})
    got = [tuple(r)[1:] for r in feeds.read_feed(spark, str(tmp_path), spec).orderBy("line_no").collect()]
    assert got == [(2, "IE1", 'two\nlines; and a "word"', "A"), (3, "IE2", '5" disk', "B"), (4, "IE3", None, None), (6, "IE4", '"open\n to the end', None)]


def test_a_long_line_takes_seconds(spark, tmp_path):
    import time

    cell = '"' + "a;b\n" * 100_000 + '"'
    (tmp_path / "feed.csv").write_text("isin;name\nIE1;" + cell + "\nIE2;" + "x;" * 500_000 + "\n")
    began = time.time()
    rows = feeds.read_feed(spark, str(tmp_path / "feed.csv"), feeds.FeedSpec(";", "isin", {"isin": ["isin"], "name": ["name"]})).orderBy("line_no").collect()
    assert [(r.isin, len(r.name)) for r in rows] == [("IE1", 400_000), ("IE2", 1)] and time.time() - began < 30


def test_ids_equal_a_plain_sort_when_most_names_begin_alike(spark):
    names = [f"Fund{i:04}" for i in range(900)] + [chr(65 + i % 26) + str(i) for i in range(100)]
    got = state.assign_ids(spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(7), "name", "id", spark.createDataFrame([("old", 5)], "name string, id long"))
    assert sorted(map(tuple, got.collect())) == sorted([("old", 5)] + [(n, 6 + k) for k, n in enumerate(sorted(names))])


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.when(F.col("id") % 3 == 0, F.col("id")))
    got = feeds.write_counted(rows, f"{tmp_path}/out", where="x is not null", n=F.count(F.lit(1)), known=F.count("x"))
    assert got == {"n": 100, "known": 34} and spark.read.parquet(f"{tmp_path}/out").count() == 34
