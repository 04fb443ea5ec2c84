"""Single expressions and rules: one input, one expected value."""

import pytest
from pyspark.sql import functions as F

from fundsieve.functions import text as T
from fundsieve.operators import classify


def one(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in frame.select("i", make(F.col("c")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "make, cases",
    [
        (T.squeeze, {"  a  b ": "a b", " ": None, None: None}),
        (T.isin_norm, {" ie00b4l5y983": "IE00B4L5Y983", "IE00B4L5Y98": None}),
        (T.isin_ok, {"IE00B4L5Y983": True, "IE00B4L5Y984": False, "US0378331005": True, "x": False}),
        (T.currency_norm, {"GBp": None, "GBX": None, "usd": "USD", "E UR": "EUR", "EURO": None}),
        (T.clean_issuer, {"Acme Funds plc": "Acme Funds", "Acme SA, Ltd.": "Acme", "Acme Co. Limited": "Acme", "plc": "plc"}),
        (T.to_flag, {"Yes": 1, "0": 0, "maybe": None}),
        (T.to_number_loc, {"1.234,5": 1234.5, "1,234.5": 1234.5, "1,234": 1234.0, "0,5": 0.5, "7": 7.0, "x": None}),
        (T.to_iso_date, {"03/03/2026": "2026-03-03", "2026-01-02": "2026-01-02", "soon": "soon"}),
        (T.to_percent, {"0.20%": 0.2, "0,07 %": 0.07, "120%": None, "none": None}),
        (T.income_policy, {"Accumulating": "Accumulating", "Income": "Distributing", "x": None}),
        (T.hedge_text, {"Unhedged": 0, "EUR Hedged": 1, "plain": None}),
        (T.url_host, {"https://www.wisdomtree.eu/x": "wisdomtree.eu", "http://a.B.com:80/": "a.b.com", "nonsense": None}),
        (T.url_canonical, {"https://a.b/c/?q=1#x": "https://a.b/c"}),
        (T.url_lang, {"https://a.b/en-gb/x": "en", "https://a.b/zz/": None}),
        (T.first_date, {"on 03.02.2026 and": "03.02.2026", "no": None}),
        (lambda c: T.by_prefix(c, T.DOMICILES), {"DE000": "Germany", "XX0": None}),
        (T.compliant_by_name, {"World UCITS ETF": 1, "World U.ETF": 1, "World UE ACC": 1, "World ETF": None}),
        (lambda c: T.type_flags(c)["instrument_type"], {"Gold ETC": "ETC", "World": "ETF", "": "UNKNOWN"}),
        (lambda c: T.type_flags(c)["inverse_flag"], {"S&P 2x Daily": 1, "S&P Short": 1, "S&P": 0}),
        (lambda c: T.to_amount(c)["value"], {"102.95bn GBP As of Feb 28 2026": 102.95e9, "5m EUR": 5e6}),
        (lambda c: T.to_amount(c)["asof"], {"102.95bn GBP As of Feb 28 2026": "2026-02-28"}),
        (lambda c: T.flatten_payload(c, "x"), {'{"x":1,"parse":{"x":2},"metadata":{"x":null}}': None, '{"x":1,"parse":{"x":2}}': "2", '{"x":1}': "1"}),
        (lambda c: T.show_amount(c.cast("double"), F.lit("USD")), {"1500000000": "USD 1.5bn", "20": "USD 20"}),
    ],
)
def test_expression(spark, make, cases):
    assert one(spark, list(cases), make) == list(cases.values())


FUNDS = [
    ("MSCI World UCITS ETF", None, {"asset_class": "equity", "geography_region": "global", "geography_scope": "global"}),
    ("MSCI USA Small Cap Value", None, {"geography_country": "United States", "geography_region": "us", "equity_size": "small", "equity_style": "value"}),
    ("Euro GOVT Bond 7-10yr", None, {"asset_class": "bond", "bond_type": "govt", "duration_bucket": "intermediate", "duration_years_low": 7.0, "govt_bond_flag": 1}),
    ("US Treasury 20+ Year Bond", None, {"asset_class": "bond", "duration_bucket": "long", "duration_years_high": None}),
    ("T-Bill 0-3 Month", None, {"duration_bucket": "short", "duration_years_high": 0.25}),
    ("Physical Gold", "ETC", {"asset_class": "commodity", "commodity_type": "gold", "gold_flag": 1}),
    ("Gold Miners", None, {"asset_class": "equity", "gold_flag": 0}),
    ("Global Corp Bond EUR Hedged", None, {"bond_type": "corp", "hedged_flag": 1, "hedged_target": "EUR"}),
    ("Robotics and AI", None, {"theme": "robotics", "geography_scope": "thematic", "geography_region": "global"}),
    ("Dec 2030 Term Corp Bond", None, {"duration_years_high": 4.0, "bond_type": "corp"}),
    ("World Energy", None, {"asset_class": "commodity", "commodity_type": "energy"}),
]


def test_classification_of_single_names(spark):
    frame = spark.createDataFrame([("IE0000000000", n, k or "ETF") for n, k, _ in FUNDS], "isin string, instrument_name string, instrument_type string")
    got = {r.instrument_name: r for r in classify.classify(frame, "2026-12-15", ("isin", "instrument_name")).collect()}
    for name, _, want in FUNDS:
        assert {k: got[name][k] for k in want} == want, name
    assert got["MSCI World UCITS ETF"].domicile_country == "Ireland"
    assert classify.legacy(classify.classify(frame, "2026-12-15")).where("asset_bucket = 'equity'").count() == 4


def test_profile_hints_come_first(spark):
    frame = spark.createDataFrame([("DE0", "Fund A", "bond", 1, "USD", "large", "technology", 85.0), ("DE1", "Tech Fund", "equity", None, None, None, "energy", 20.0)], "isin string, instrument_name string, asset_class_hint string, hedged_flag int, hedged_target string, equity_size_hint string, sector_hint string, sector_weight double")
    a, b = classify.classify(frame, "2026-01-01").orderBy("isin").collect()
    assert (a.asset_class, a.hedged_flag, a.hedged_target, a.equity_size, a.sector) == ("bond", 1, "USD", "large", "technology")
    assert (b.asset_class, b.sector) == ("equity", "technology")


def test_numbers_are_rounded_from_their_exact_value(spark):
    import random

    from fundsieve.functions import text as X

    rnd = random.Random(1)
    values = [0.945, 0.985, 1.005, 0.125, 0.375, 2.675, -1.005, -0.001, 0.0, 0.5, 1.5, 2.5, 999.5, 1e-20, 0.005, 0.015, 123456789.125, 1e15 + 0.5, 99.995, 0.004999999999999999, None]
    values += [round(rnd.uniform(0, 100), 3) for _ in range(300)] + [rnd.randint(0, 10**6) / 1000 for _ in range(300)] + [rnd.randint(0, 10**4) / 8 for _ in range(100)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", X.fixed(F.col("x"), 2), X.fixed(F.col("x"), 0), X.show_percent(F.col("x"))).collect()
    for x, two, none, shown in rows:
        assert (two, none, shown) == ((None, None, None) if x is None else (f"{x:.2f}", f"{x:.0f}", f"{x:.2f}%")), x
    amounts = [(1.005e9, "1bn"), (1.015e9, "1.01bn"), (2.5e6, "2.5m"), (1234.5, "1.23k"), (2.5, "2"), (0.0, "0"), (-1e6, "-1m")]
    got = spark.createDataFrame(amounts, "x double, want string").select("want", X.show_amount(F.col("x"), F.lit("usd"))).collect()
    assert all(shown == f"USD {want}" for want, shown in got)


def test_compliant_names_say_so_in_one_of_seven_ways(spark):
    from fundsieve.functions import text as X

    said = {"X UCITS": 1, "X U.ETF": 1, "X UC.ETF": 1, "X UE.ACC": 1, "X U.E.DIS": 1, "X UE  EOA": 1, "X UEDLA": 1, "X UC.E.A": 1, "x ucits etf": 1, "UCE.ACC fund": None, "Fund": None, "UEBER": None}
    rows = spark.createDataFrame([(k,) for k in said], "x string").select("x", X.compliant_by_name(F.col("x"))).collect()
    assert dict(map(tuple, rows)) == said
