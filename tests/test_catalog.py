"""The catalogue jobs on a mini-database of five funds, with an alias listing and a gold exception."""

import pytest

from fundsieve.operators import catalog as K
from fundsieve.operators import serve as V
from fundsieve.schemas import TABLES


@pytest.fixture(scope="module")
def catalog(spark):
    def rows(name, *data):
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(TABLES[name])
        return spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in data], schema)

    inst = lambda i, isin, name, **m: dict(instrument_id=i, isin=isin, instrument_name=name, instrument_type="ETF", issuer_id=i % 3, universe_mvp_flag=1, leverage_flag=0, inverse_flag=0, ucits_flag=1, status="active") | m
    tax = lambda i, c, **m: dict(instrument_id=i, asset_class=c, gold_flag=0, cash_flag=0, cash_proxy_flag=0, govt_bond_flag=0) | m
    return {
        "issuer": rows("issuer", *[dict(issuer_id=i, issuer_name=f"House {i}") for i in range(3)]),
        "instrument": rows("instrument", inst(1, "IE001", "World Hedged"), inst(2, "IE002", "World Small Value"), inst(3, "LU003", "Long Bond"), inst(4, "DE004", "Short Bond", issuer_id=None), inst(5, "JE005", "Physical Gold", universe_mvp_flag=0, instrument_type="ETC")),
        "listing": rows("listing", *[dict(listing_id=i, instrument_id=i, primary_flag=1, venue_mic="XLON", ticker=f"T{i}", trading_currency="USD") for i in range(1, 6)], dict(listing_id=9, instrument_id=1, primary_flag=0, status="active", venue_mic="XETR", ticker="ALIAS", trading_currency="EUR")),
        "product_profile": rows("product_profile", dict(instrument_id=1, ongoing_charges=0.2, hedged_flag=1, distribution_policy="Accumulating"), dict(instrument_id=3, ongoing_charges=0.1, hedged_flag=0)),
        "instrument_taxonomy": rows("instrument_taxonomy", tax(1, "equity", geography_region="global", geography_scope="global", sector=" "), tax(2, "equity", geography_region="global", equity_size="small", equity_style="value", hedged_flag=1), tax(3, "bond", bond_type="govt", duration_bucket="long", govt_bond_flag=1), tax(4, "bond", bond_type="corp", duration_bucket="short"), tax(5, "commodity", commodity_type="gold", gold_flag=1)),
        "cost_snapshot": rows("cost_snapshot", dict(cost_id=1, instrument_id=2, asof_date="2026-01-01", ongoing_charges=0.4, quality_flag="ok", raw_json="{}"), dict(cost_id=2, instrument_id=2, asof_date="2026-02-01", ongoing_charges=9.0, quality_flag="parse_fail", raw_json="{}"), dict(cost_id=3, instrument_id=4, asof_date="2026-01-01", ongoing_charges=0.3, quality_flag="ok", raw_json='{"parse_ongoing":{"fund_size_asof":"03/03/2026","replication_method":"Synthetic replication","hedged_target":"EUR"}}')),
        "issuer_metadata_snapshot": rows("issuer_metadata_snapshot", dict(id=1, instrument_id=4, asof_date="2026-01-01", ter=0.25, raw_json='{"parsed":{"benchmark_name":"Index A"}}'), dict(id=2, instrument_id=4, asof_date="2026-02-01", use_of_income="Distributing", raw_json="{}")),
        "document": rows("document", dict(document_id=1, instrument_id=4, doc_type="k", url="https://www.house-b.com/x.pdf")),
    }


def isins(df):
    return [r.isin for r in df.collect()]


def test_the_fund_list(spark, catalog):
    page, total = K.list_funds(spark, catalog, {"asset_class": "equity"}, limit=1)
    assert isins(page) == ["IE001"] and total.first().total == 2
    assert isins(K.list_funds(spark, catalog, {"sector": V.BLANK})[0]) == ["DE004", "IE001", "IE002", "LU003"]
    assert isins(K.list_funds(spark, catalog, fee_min=0.1, fee_max=0.4, sort="fee")[0]) == ["LU003", "IE001", "DE004", "IE002"]
    found = K.list_funds(spark, catalog, q="alias")[0].collect()
    assert [(r.isin, r.ticker) for r in found] == [("IE001", "T1")]
    assert isins(K.list_funds(spark, catalog, hedged="true")[0]) == ["IE001", "IE002"]
    assert isins(K.list_funds(spark, catalog, hedged="no")[0]) == ["LU003"]
    with pytest.raises(ValueError):
        K.list_funds(spark, catalog, sort="size")


def test_detail_and_options(spark, catalog):
    assert K.fund_detail(spark, catalog, " je005 ").count() == 1
    options = K.filter_options(spark, catalog)
    facets = {(r.facet, r.value): r.n for r in options["facets"].collect()}
    assert facets["asset_class", "equity"] == 2 and facets["issuer", "House 1"] == 1 and ("distribution_policy", "Unknown") not in facets
    assert tuple(options["fees"].first()) == (0.1, 0.4) and options["blank_sector"].first().n == 4
    shown = {r.isin: r for r in K.explorer(K.fund_view(spark, catalog)).collect()}
    assert shown["IE001"].ter == "0.20%" and shown["IE001"].bond_type == "N.A." and shown["DE004"].bond_type == "Corporate"
    assert shown["LU003"].size == "Unknown" and shown["LU003"].duration == "Long" and len(shown["LU003"]) == 17


def test_profile_precedence(spark, catalog):
    got = {r.instrument_id: r for r in K.refresh_profile(spark, catalog).collect()}
    four = got[4]
    assert (four.ongoing_charges, four.distribution_policy, four.benchmark_name) == (0.25, "Distributing", "Index A")
    assert (four.fund_size_asof, four.replication_method, four.hedged_flag, four.domicile_country) == ("2026-03-03", "synthetic", 1, "Germany")
    assert got[1].distribution_policy == "Accumulating"


def test_universe_issuers_and_aliases(spark, catalog):
    assert K.build_universe(spark, catalog).count() == 4
    found = K.unknown_issuers(spark, catalog, [("Bond House", "BOND")], [("House B", ["house-b.com"])]).collect()
    assert [(r.instrument_id, r.issuer_name, r.issuer_source) for r in found] == [(4, "House B", "document_host")]
    rows = spark.createDataFrame([(1, "XLON", "T1", "GBP"), (1, "XPAR", "NEW", "EUR")], "instrument_id long, venue_mic string, ticker string, trading_currency string")
    merged = {(r.venue_mic, r.ticker): r for r in K.fill_listing_aliases(catalog["listing"], rows).where("instrument_id = 1").collect()}
    assert merged["XLON", "T1"].primary_flag == 1 and merged["XLON", "T1"].trading_currency == "USD"
    assert merged["XPAR", "NEW"].primary_flag == 0


def test_completeness_and_bundle(spark, catalog):
    report = K.completeness(spark, catalog)
    gaps = {r.isin: r.missing_fields for r in report["gaps"].collect()}
    assert gaps["IE001"] == "benchmark_name,fund_size,domicile_country,replication_method,equity_size,equity_style,sector"
    assert {r.isin: r.latest_metadata_source for r in report["gaps"].collect()}["DE004"] is not None
    assert tuple(report["universe"].first()) == (4, 4, 4)
    assert {r.field: r.known for r in report["taxonomy"].collect()}["bond_type"] == 2
    bundle = K.export_bundle(spark, catalog)
    counts = {r.table_name: r.n for r in V.bundle_counts(bundle).collect()}
    assert counts == {"instrument": 5, "listing": 6, "product_profile": 2, "instrument_taxonomy": 5, "cost_snapshot": 2, "issuer": 3}
    ask = lambda c: K.list_funds(spark, c, q="alias")[0].select("isin", "ongoing_charges")
    assert V.parity(ask(catalog), ask(bundle)).count() == 0


def test_a_bundle_is_checked_and_a_bare_one_fails(spark, catalog):
    checks = lambda c: {r.check: r.ok for r in K.smoke_check(spark, c, (("gold", 100.0),)).collect()}
    good = checks(K.export_bundle(spark, catalog))
    assert set(good) == {"list", "total", "facets", "shortlist", "gold", "custom", "strict"}
    assert {k for k, ok in good.items() if ok} >= {"list", "facets", "total"}
    bare = checks({k: v.limit(0) for k, v in catalog.items()})
    assert set(bare) == set(good) and not any(bare.values())
