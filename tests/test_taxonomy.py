"""The taxonomy on abbreviated names as exchanges print them, with the fields that each of them must give."""

import json

import pytest

from fundsieve.functions import rules as R
from fundsieve.operators import classify

EQ, GOVT = {"asset_class": "equity"}, {"asset_class": "bond", "bond_type": "govt"}
#: name; extra inputs; expected fields.
CASES = [
    ("EXPAT BULGARIA SOFIX UCITS ETF", {}, EQ | {"geography_country": "Bulgaria", "geography_region": "europe", "equity_region": "europe"}),
    ("ISHARES PFANDBRIEFE U.ETF", {"distribution_policy": "Distributing"}, GOVT | {"distribution_policy": "Distributing"}),
    ("AMC.AV.GLSMCV DLA", {}, EQ | {"geography_region": "global", "equity_size": "small", "equity_style": "value"}),
    ("AMUNDI US TREASURY BOND 7-10Y UCITS ETF", {}, GOVT | {"duration_bucket": "intermediate"}),
    ("AMUNDI US TREASURY BOND 7–10yr", {}, GOVT | {"duration_bucket": "intermediate", "duration_years_low": 7.0, "duration_years_high": 10.0}),
    ("JPM-GLB REI EQ UE EOAH", {}, EQ | {"geography_region": "global"}),
    ("AMUNDI S&P 500", {}, EQ | {"geography_country": "United States", "geography_region": "us"}),
    ("FRK U.S. EQUITY UCITS ETF", {}, EQ | {"geography_country": "United States", "geography_region": "us"}),
    ("AMC.AV.GL.EQ. DLA", {}, EQ | {"geography_scope": "global", "geography_region": "global"}),
    ("ISH $ ST DUR HY CRP BND ETF USD ACC", {}, {"asset_class": "bond", "bond_type": "corp", "duration_bucket": "short"}),
    ("AMUNDI ETF-GOV.0-6M EO IG", {}, GOVT | {"duration_bucket": "short", "duration_years_low": 0.0, "duration_years_high": 0.5}),
    ("VANGUARD U.S. TSY 0-1 YR BOND UCITS ETF", {}, GOVT | {"duration_bucket": "short", "cash_proxy_flag": 1}),
    ("JPM US TREASURY BOND 0-3MTH UCITS ETF", {}, GOVT | {"duration_bucket": "short", "duration_years_low": 0.0, "duration_years_high": 0.25}),
    ("JPM-EUR HY BD UE EOA", {}, {"asset_class": "bond", "bond_type": "corp"}),
    ("BPPE-JTEGBI10+ U.ETFEOA", {}, GOVT | {"duration_bucket": "long"}),
    ("ISHARES PHYSICAL GOLD ETC", {"instrument_type": "ETC"}, {"asset_class": "commodity", "commodity_type": "gold", "gold_flag": 1}),
    ("ISHRS GOLD PRODUCERS ETF USD (ACC)", {}, EQ | {"gold_flag": 0, "rule": "commodity:gold_proxy_equity_excluded"}),
    ("AIS-ACMSCIWS U.ETFDLA", {"benchmark_name": "MSCI World SRI Screened Index", "asset_class_hint": "Equity"}, EQ | {"geography_region": "global"}),
    (
        "AMUNDI PRIME US TREAS UCITS ETF DR (D)",
        {"benchmark_name": "Solactive US Treasury Bond 1-3 Year Index", "asset_class_hint": "Bond", "domicile_country": "Luxembourg", "hedged_flag": 1, "hedged_target": "GBP"},
        GOVT | {"duration_bucket": "short", "domicile_country": "Luxembourg", "hedged_flag": 1, "hedged_target": "GBP"},
    ),
    ("I.EB.R.G.G.1.5-2.5Y UEEOD", {}, GOVT | {"duration_bucket": "short", "duration_years_low": 1.5, "duration_years_high": 2.5}),
    ("I.EB.R.GOV.GE.10.5+ U.ETF", {}, GOVT | {"duration_bucket": "long", "duration_years_low": 10.5, "duration_years_high": None}),
    ("GLOBAL X S&P 500 COVERED CALL UCITS ETF", {}, EQ | {"geography_country": "United States", "factor": "dividend_income"}),
    ("ISH.S.EUR.LARGE 200 U.ETF", {}, EQ | {"geography_region": "europe", "equity_size": "large"}),
    ("HSBC APAC EX JP SUS EQ UC ETF USD (DIST)", {}, EQ | {"geography_region": "asia"}),
    ("HSBC MSCI PAC EX JP UCITS ETF USD (ACC)", {}, EQ | {"geography_region": "asia"}),
    ("HSBC FTSE EPRA/NAREIT DEV. UCITS ETF $", {}, EQ | {"sector": "real_estate", "geography_scope": "sector", "geography_region": "global"}),
    ("FIRSTTRUST USEQUITYOPPORTUNITIESUCITS A", {}, EQ | {"geography_country": "United States", "geography_region": "us"}),
    ("VANECK HYDROGEN ECONOMY UCITS ETF", {}, EQ | {"theme": "hydrogen", "geography_scope": "thematic", "geography_region": "global"}),
    ("HSBC MULTI FACTOR WORLDWIDE EQ UCITS ETF", {}, EQ | {"geography_region": "global", "factor": "multi_factor"}),
    ("FIRSTTRUSTNASDAQCYBERSECURITYUCITS", {}, EQ | {"geography_country": "United States", "theme": "digital"}),
    ("ISHRS S&P SMLL CAP 600 ETF USD (DIST)", {}, EQ | {"geography_country": "United States", "equity_size": "small"}),
    ("MUL-AMUN ST600 INSU ETF A", {}, EQ | {"geography_region": "europe", "sector": "financials"}),
    ("OSS E.G.B.7-10Y U.ETF 1CE", {}, GOVT | {"duration_bucket": "intermediate"}),
    ("ISHRS MSCI CANADA UCITS ETF USD (ACC)", {"benchmark_name": "MSCI Developed - Canada in USD - NET TR", "asset_class_hint": "Equity"}, EQ | {"geography_country": "Canada", "geography_region": "north_america"}),
    ("ISHARES MSCI TURKEY UCITS ETF USD (DIST)", {"benchmark_name": "MSCI Turkey - Net Returns", "asset_class_hint": "Equity"}, EQ | {"geography_country": "Turkey", "geography_region": "em"}),
    ("AMUNDI GLOBAL EMERGING BOND", {"benchmark_name": "J.P. Morgan EMBI Global Diversified Index", "asset_class_hint": "Bond"}, GOVT | {"geography_region": "em"}),
    ("AMUNDI ETF", {"benchmark_name": "MSCI Europe Banks Index", "asset_class_hint": "Equity"}, EQ | {"geography_region": "europe", "sector": "financials"}),
    ("AMUNDI JAPAN ETF", {"benchmark_name": "MSCI Japan SRI PAB Index", "asset_class_hint": "Equity"}, EQ | {"geography_country": "Japan", "theme": "esg"}),
    ("EUROSTOXX50 ACC", {}, EQ | {"geography_region": "europe", "equity_size": "large"}),
    ("CORP BOND SEPT 2029 TERM", {}, {"asset_class": "bond", "duration_years_low": 0.0, "duration_years_high": 2.75}),
    ("", {"instrument_type": "NOTE"}, {"asset_class": "unknown", "geography_scope": None, "hedged_flag": 0}),
]


@pytest.fixture(scope="module")
def found(spark):
    inputs = classify.INPUTS
    data = [tuple({"isin": "XX0", "instrument_type": "ETF", "instrument_name": n, **more}.get(c) for c in inputs) + (i,) for i, (n, more, _) in enumerate(CASES)]
    frame = spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in inputs.items()) + ", i int")
    tax = classify.classify(frame, "2026-12-15", ("i",))
    old = {r.i: r.equity_region for r in classify.legacy(tax, ("i",)).collect()}
    return {r.i: r.asDict() | {"equity_region": old[r.i]} for r in tax.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] or "empty" for c in CASES])
def test_name(found, i):
    got, want = found[i], dict(CASES[i][2])
    rule = want.pop("rule", None)
    assert {k: got[k] for k in want} == want
    if rule:
        assert rule in json.loads(got["evidence_json"])["rules"]


def test_the_tables_are_complete():
    assert len(R.abbreviations()) == 85 and len(R.COUNTRY) == 34
    assert [len(x) for x in (R.COMMODITY, R.SECTOR, R.THEME, R.FACTOR, R.REGION, R.BOND_TYPE)] == [6, 11, 13, 5, 5, 4]
