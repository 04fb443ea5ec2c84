"""Named strategies and canonical issuers, as the catalogue knows them."""

#: strategy: buckets with their weights in percent.
STRATEGIES = {
    "all_country_world_stocks": [("equity_global", 100.0)],
    "warren_buffett": [("equity_global", 90.0), ("short_bonds", 10.0)],
    "jl_collins_simple_path": [("equity_global", 75.0), ("intermediate_govt_bonds", 25.0)],
    "all_country_world_80_20": [("equity_global", 80.0), ("intermediate_govt_bonds", 20.0)],
    "all_country_world_60_40": [("equity_global", 60.0), ("intermediate_govt_bonds", 40.0)],
    "bogleheads_three_funds": [("equity_global", 80.0), ("intermediate_govt_bonds", 20.0)],
    "bogleheads_four_funds": [("equity_global", 80.0), ("intermediate_govt_bonds", 10.0), ("short_bonds", 10.0)],
    "all_country_world_40_60": [("equity_global", 40.0), ("intermediate_govt_bonds", 60.0)],
    "all_country_world_20_80": [("equity_global", 20.0), ("intermediate_govt_bonds", 80.0)],
    "bill_bernstein_no_brainer": [("equity_global", 50.0), ("equity_small_cap_value", 25.0), ("short_bonds", 25.0)],
    "rick_ferri_core_four": [("equity_global", 80.0), ("intermediate_govt_bonds", 20.0)],
    "david_swensen_lazy": [("equity_global", 70.0), ("intermediate_govt_bonds", 15.0), ("short_bonds", 15.0)],
    "jp_morgan_balanced": [("equity_global", 55.0), ("equity_small_cap_value", 10.0), ("intermediate_govt_bonds", 20.0), ("short_bonds", 10.0), ("gold", 5.0)],
    "charles_schwab_conservative_income": [("equity_global", 5.0), ("cash", 25.0), ("intermediate_govt_bonds", 50.0), ("short_bonds", 20.0)],
    "all_country_world_bonds": [("intermediate_govt_bonds", 70.0), ("short_bonds", 30.0)],
    "ten_year_treasury": [("intermediate_govt_bonds", 100.0)],
    "harry_browne_permanent": [("equity_global", 25.0), ("cash", 25.0), ("long_govt_bonds", 25.0), ("gold", 25.0)],
    "ray_dalio_all_weather": [("equity_global", 30.0), ("long_govt_bonds", 40.0), ("intermediate_govt_bonds", 15.0), ("gold", 15.0)],
    "golden_butterfly": [("equity_global", 20.0), ("equity_small_cap_value", 20.0), ("long_govt_bonds", 20.0), ("short_bonds", 20.0), ("gold", 20.0)],
    "golden_ratio": [("equity_global", 31.0), ("equity_small_cap_value", 21.0), ("long_govt_bonds", 26.0), ("cash", 6.0), ("gold", 16.0)],
}
#: canonical name, domain, words of names, in order.
ISSUERS = (
    ("BlackRock / iShares", "ishares.com", "ISHARES|BLACKROCK"),
    ("Vanguard", "vanguard.com", "VANGUARD"),
    ("Invesco", "invesco.com", "INVESCO"),
    ("State Street / SPDR", "ssga.com", "SSGA|SPDR|STATE STREET"),
    ("Lyxor", "amundietf.com", "LYXOR"),
    ("Amundi", "amundietf.com", "AMUNDI"),
    ("HSBC", "assetmanagement.hsbc.com", "HSBC"),
    ("UBS", "ubs.com", "UBS"),
    ("Xtrackers / DWS", "xtrackers.com", "XTRACKERS|DB ETC"),
    ("WisdomTree", "wisdomtree.eu", "WISDOMTREE"),
    ("VanEck", "vaneck.com", "VANECK"),
    ("Legal & General", "lgim.com", "LEGAL & GENERAL"),
    ("JPMorgan", "am.jpmorgan.com", "JPMORGAN"),
    ("PIMCO", "pimco.com", "PIMCO"),
    ("Franklin Templeton", "franklintempleton.com", "FRANKLIN"),
    ("First Trust", "ftglobalportfolios.com", "FIRST TRUST"),
    ("BNP Paribas", "bnpparibas-am.com", "BNP"),
    ("Global X", "globalxetfs.com", "GLOBAL X"),
    ("Fidelity", "fidelity.com", "FIDELITY"),
    ("Goldman Sachs", "gsam.com", "GOLDMAN SACHS"),
    ("Leverage Shares", "leverageshares.com", "LEVERAGE SHARES"),
    ("GraniteShares", "graniteshares.com", "GRANITESHARES"),
    ("Tabula", "tabulaim.com", "TABULA"),
)
VENUE_ORDER, CURRENCY_ORDER = ("XLON", "XETR", "CBOE_EU"), ("USD", "EUR", "GBP")
