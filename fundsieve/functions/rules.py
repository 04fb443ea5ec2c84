"""Rule tables as columns: one alternation for each class, one flat chain for each attribute.

The tables are stated as text, a class a line, and made into alternations when the module is read. The text they are
applied to is computed in a column of its own and used many times, so Spark evaluates it once a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def classify(text: Column, rules: Rules) -> Column:
    """The class of the first rule whose expression is found in the text, else NULL."""
    out = None
    for label, expression in rules:
        test = text.rlike(expression)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def first_rule(df: DataFrame, rules: Rules, column: str, name: str) -> DataFrame:
    return df.withColumn(name, classify(F.col(column), rules))


def whole_words(entries: str) -> str:
    """One expression for a line of entries between commas, each a whole word or phrase."""
    return r"\b(?:" + "|".join(e.strip() for e in entries.split(",")) + r")\b"


def word_rules(table: str) -> Rules:
    """(label, expression) for each line `label: entry, entry, ...` of a table, in order."""
    lines = [line.split(":", 1) for line in table.strip().splitlines()]
    return [(label.strip(), whole_words(entries)) for label, entries in lines]


# Classes of fund names. The first line that matches wins; an entry is a whole word or phrase of the
# normalised name, with the notation of regular expressions.

COMMODITY = word_rules(r"""
silver: SILVER
energy: CRUDE, WTI, BRENT, NATURAL GAS, ENERGY
agriculture: WHEAT, SOY, CORN, SUGAR, COTTON, AGRICULTURE
industrial_metals: COPPER, ALUMIN(?:IUM|UM), NICKEL, ZINC
precious_metals: PLATINUM, PALLADIUM
broad_commodities: COMMOD(?:ITY|ITIES)?, CMCI
""")

GOLD = whole_words("PHYSICAL GOLD, GOLD, BULLION")
GOLD_EQUITY = whole_words("MINERS?, MINING, PRODUCERS?, BUGS, ROYALT(?:Y|IES)")
CASH = whole_words(r"MONEY MARKET, TREASURY BILL, T[\s-]?BILL, ULTRA SHORT, OVERNIGHT, 0[\s/-]?1, CASH")
MULTI = whole_words("MULTI ASSET, BALANCED, PORTFOLIO, LIFECYCLE")
BOND = whole_words(
    "BOND(?:S)?, TREAS(?:URY)?, GOV(?:ERNMENT)?, GOVT, GILT(?:S)?, CORP(?:ORATE)?, CREDIT, SOVEREIGN, AGG(?:REGATE)?, "
    "LINK(?:ED|ERS?)?, TIPS, REXX, PFANDBRIEFE, COVERED BOND(?:S)?, FLOAT(?:ING)? RATE, FLOT RATE"
)
#: Looked for in the name as it stands, before signs become spaces.
BOND_SPECIAL = r"I\.EB\.R\.|" + whole_words(r"T[\s-]?BOND, T[\s-]?BND, TR BOND, TR BND")

BOND_TYPE = word_rules(r"""
linkers: INFLATION, LINK(?:ED|ERS?)?, TIPS
govt: TREAS(?:URY)?, TRSY, TSY, GOV(?:ERNMENT)?, GOVT, GILT(?:S)?, SOVEREIGN, EMBI, UST, JGB, BUND, OAT, BTP, TREASURY BILL, T[\s-]?BILL, PFANDBRIEFE, REXX, TR BOND, TR BND
aggregate: AGG(?:REGATE)?, TOTAL BOND, AGG BOND, MBS, MORTGAGE BACKED
corp: CORP(?:ORATE)?, CREDIT, HIGH YIELD, INVESTMENT GRADE, CORP BOND, FLOAT(?:ING)? RATE, FRN
""")

EQUITY_HINT = whole_words(
    "MSCI, FTSE, STOXX, EURO STOXX, S P, NASDAQ, RUSSELL, NIKKEI, TOPIX, DAX, DAX[0-9A-Z]*, MDAX, SDAX, TECDAX, DIVDAX, "
    "ATX, SLI, SMI, SOFIX, CROBEX, PX, ASE, BUX, MBI10, WIG20, SAX, SBI, BELEX, MIB, EMU, BRAZIL, SPAIN, UK, EU S 50, "
    "DOW JONES, DJIA, EQUITY, EQ, SHARES?, STOCK, WORLD, GLOBAL, EMERGING, SMALL CAP, MID CAP, LARGE CAP, VALUE, GROWTH, "
    "QUALITY, MOMENTUM, DIVIDEND, EPI"
)

REGION = word_rules(r"""
em: EMERGING, EMERGING MARKETS?, LATIN AMERICA, EM IMI, EM MARKETS?, MSCI EM, EM EQ, EMBI
global: WORLD, GLOBAL, WORLDWIDE, ACWI, ALL COUNTRY, ALL WORLD
north_america: NORTH AMERICA
europe: EUROPE, EU, EURO STOXX\w*, EUROZONE, STOXX EUROPE, EURO ST, EU 600, S E 600, EU S 50, EMU, MIB, EURO PRIME, SPAIN, UK, EUR LARGE 200, EUR SMALL 200
asia: ASIA, PACIFIC, ASIA PACIFIC, APAC, FAR EAST EX JAPAN, ASIA PACIFIC EX JAPAN
""")

SECTOR = word_rules(r"""
technology: TECH(?:NOLOGY)?, TECDAX, SEMICONDUCTOR
health_care: HEALTH(?: CARE|CARE)?, BIOTECH, PHARMA
financials: FINANCIAL(?:S)?, BANK(?:S)?, INSUR(?:ANCE|ER|ERS)
energy: ENERGY, ENGY
utilities: UTILIT(?:Y|IES)
industrials: INDUSTRIAL(?:S)?
real_estate: REAL ESTATE, PROPERTY, REIT(?:S)?, NAREIT, EPRA
materials: MATERIALS, CHEM(?:ICALS?)?, RESOURCE(?:S)?
communication: COMMUNICATION, TELECOM, MEDIA
consumer_cyclical: CONSUMER DISCRETIONARY, CONSUMER CYCLICAL
consumer_defensive: CONSUMER STAPLES, CONSUMER DEFENSIVE
""")

THEME = word_rules(r"""
robotics: ROBOTICS
ai: AI, ARTIFICIAL INTELLIGENCE
water: WATER
hydrogen: HYDROGEN
blockchain: BLOCKCHAIN, CRYPTO
digital: DIGITAL(?:ISATION|IZATION)?, DIG ENT, DIGITAL PAYMENTS, ENTERTAINMENT, EDUCATION, CYBER ?SEC(?:URITY)?, CLOUD, ECOM(?:MERCE)?, INTERNET, NEXTG, METAVERSE
circular_economy: CIRCULAR ECONOMY
rare_earths: RARE EARTH, SCARCE RESOURCES, ECON(?:OMY)? METALS
bionics: BIONIC
megatrends: MEGATRENDS?, SPACE, TRAVEL, FUTURE FOOD, FUTURE OF FOOD
green_deal: GREEN DEAL, BATTERY, EV CHARGING, SMART GRID, DECARB, ENABLERS?, CLEAN EDGE
brands: BRANDS
esg: ESG, SUSTAIN(?:ABLE|ABILITY)?, PARIS ALIGNED, SCR(?:EENED)?, SRI, PAB, CTB, CLIMATE, RESPONSIBLE, LOW CARBON
""")

FACTOR = word_rules(r"""
quality: QUALITY
momentum: MOMENTUM
dividend_income: DIVIDEND, INCOME, EPI, SELECT DIV, SUPERDIVIDEND, COVERED CALL, PREMIUM INCOME, EQUITY INCOME
multi_factor: MULTI FACTOR
minimum_volatility: MIN(?:IMUM)? VOL(?:ATILITY)?, LOW VOL(?:ATILITY)?
""")

SIZE = word_rules(r"""
small: SMALL CAP, SMALL, SDAX, SMALL 200, EUR SMALL 200
mid: MID CAP, MDAX, MID 200
large: LARGE CAP, DAX, S P 500, EURO STOXX 50, TOP 20, EUR LARGE 200
""")

STYLE = word_rules(r"""
value: VALUE, VAL
growth: GROWTH
""")

DURATION = word_rules(r"""
long: 10\+, 15\+, 20\+, 30\+, LONG, LONG DATED
short: 0[\s/-]?1, 1[\s/-]?3, 0[\s/-]?6M(?:TH)?, 3[\s/-]?6M(?:TH)?, 0[\s/-]?3M(?:TH)?, SHORT, ULTRA SHORT, T[\s-]?BILL, FLOAT(?:ING)? RATE, FLOT RATE, FRN
intermediate: 3[\s/-]?7, 5[\s/-]?10, 7[\s/-]?10, INTERMEDIATE
""")

HEDGED = word_rules(r"""
USD: USD HEDGED, USDH
EUR: EUR HEDGED, EURH, EUR-?H
GBP: GBP HEDGED, GBPH, GBP-?H
JPY: JPY HEDGED, JPYH
CHF: CHF HEDGED, CHFH
""")

#: Labels are country|region.
COUNTRY = word_rules(r"""
United States|us: USA, US, U S, UNITED STATES, S P 500, SP 500, S P 600, S P SMALLCAP 600, S AND P 500, S AND P 600, SMALLCAP 600, SMALL CAP 600, NASDAQ, RUSSELL, DOW JONES, DJIA
Canada|north_america: CANADA
Mexico|em: MEXICO
Germany|europe: DAX, DAX[0-9A-Z]*, MDAX, SDAX, TECDAX, DIVDAX, PFANDBRIEFE, REXX
Austria|europe: ATX
France|europe: FRANCE
Switzerland|europe: SLI, SMI, SWITZERLAND, SWISS
Luxembourg|europe: LUX(?:EMBOURG)?
Netherlands|europe: AEX
Italy|europe: MIB
Bulgaria|europe: SOFIX, BULGARIA
Croatia|europe: CROBEX, CROAT(?:IA)?
Czech Republic|europe: CZECH, PX
Greece|europe: GREECE, ASE
Hungary|europe: HUNG(?:ARY)?, BUX
North Macedonia|europe: MAC(?:EDONIA)?, MBI10
Poland|europe: POLAND, WIG20
Slovakia|europe: SLOVAK(?:IA)?, SAX
Slovenia|europe: SLOV\., SBI TOP, SLOVENIA
Serbia|europe: SERB(?:IA)?, BELEX
Spain|europe: SPAIN, IBEX
United Kingdom|europe: UK, U K, UNITED KINGDOM, FTSE 100, FTSE 250
Brazil|em: BRAZIL
Australia|asia: AUSTRALIA, AUST
Japan|asia: JAPAN, NIKKEI, TOPIX
South Africa|em: SOUTH AFRICA, MSCI SA
China|asia: CHINA, CSI, HANG SENG
India|asia: INDIA
Indonesia|em: INDONESIA
Saudi Arabia|em: SAUDI(?: ARABIA)?
South Korea|asia: KOREA, KOSPI
Kuwait|em: KUWAIT
Taiwan|asia: TAIWAN
Turkey|em: TURKEY
""")

# Abbreviations in names and what they stand for, applied in this order: later ones see what earlier ones
# wrote. `expression => replacement`; _ is a blank at an end.
ABBREVIATIONS = r"""
\bAM\.CE\.I-AV\.AM\.E\b => US EQUITY
\bAM\.CE\.I-AV\.EU\.E\b => EUROPE EQUITY
\bAM\.CE\.I-AV\.PA\.E\b => PACIFIC EQUITY
\bEM[\.\s-]+SOV[\.\s-]*BD\b => EMERGING SOVEREIGN BOND
\bEM[\.\s-]+LOC[\.\s-]*BD\b => EMERGING LOCAL BOND
\bHY[\.\s-]*BD\b => HIGH YIELD BOND
\bAG[\.\s-]*BD\b => AGGREGATE BOND
\bGO[\.\s-]*BD\b => GOVT BOND
\bSOV[\.\s-]*BD\b => SOVEREIGN BOND
\bLOC[\.\s-]*BD\b => LOCAL BOND
\bCBD\b => COVERED BOND
\bU[\.\s-]*TR\b => US TREASURY
\bJTEGBI(?=\d|\b) => JAPAN TREASURY GOVERNMENT BOND INDEX_
\bAPAC\b => ASIA PACIFIC
\bPAC[\.\s-]+EX[\.\s-]+JP\b => PACIFIC EX JAPAN
\bEM[\.\s-]+SUS\b => EMERGING SUSTAINABLE
\bEM[\.\s-]+QUAL\b => EMERGING QUALITY
\bEM[\.\s-]+QUALITY\b => EMERGING QUALITY
\bEXJAPAN\b => EX JAPAN
USEQUITY => US EQUITY_
\bGLOBL\b => GLOBAL
\bEUROPEAN\b => EUROPE
\bEUROZ\b => EUROZONE
\bDECRB\b => DECARB
\bSMLL CAP\b => SMALL CAP
\bSEMICONDUCTR\b => SEMICONDUCTOR
\bMSCI WO\b => MSCI WORLD
\bE[\.\s-]*G[\.\s-]*B\b => EURO GOVERNMENT BOND
NASDAQCYBERSECURITY => _NASDAQ CYBER SECURITY_
NYSEARCABIOTECH => _NYSE ARCA BIOTECH_
\bGLSMCV\b => GLOBAL SMALL CAP VALUE
\bGLOBALQUALDIVGROWTH\b => GLOBAL QUALITY DIVIDEND GROWTH
\bGLOBALEQUITY\b => GLOBAL EQUITY
\bGLBL\b => GLOBAL
\bGLB\b => GLOBAL
\bGL[\.\s]EQ\b => GLOBAL EQUITY
\bEM[\.\s]EQ\b => EMERGING MARKETS EQUITY
\bMSCI AUST\b => MSCI AUSTRALIA
\bMSCI IND\b => MSCI INDIA
\bMSCI EUR\b => MSCI EUROPE
\bMSCI JP\b => MSCI JAPAN
\bMSCIEMU\b => MSCI EMU
\bMSCIUSAESGSEL\b => MSCI USA ESG SELECT
\bMSCIWEWS\b => MSCI WORLD ESG SCREENED
\bMSCI W\.?2\b => MSCI WORLD
\bCIRECLDRS\b => CIRCULAR LEADERS
\bFAEXJP\b => FAR EAST EX JAPAN
\bMULTIFACTOR\b => MULTI FACTOR
\bGEM\b => EMERGING
\bWRLD\b => WORLD
\bWLD\b => WORLD
\bSP500\b => S P 500
\bS&P500\b => S P 500
\bS P500\b => S P 500
\bNIK400\b => NIKKEI 400
\bTBILLS\b => TREASURY BILLS
\bTRES\b => TREASURY
\bBND\b => BOND
\bCRP\b => CORP
\bHY\b => HIGH YIELD
\bSHRT\b => SHORT
\bST[\.\s]DUR\b => SHORT DURATION
\bGVT\b => GOVT
\bEPE\b => EUROPE
\bERPE\b => EUROPE
\bSWITIT[0-9A-Z]*\b => SWITZERLAND
S\+P => S P
S&P => S P
\bEUROSTOXX([0-9]+)\b => EURO STOXX $1
\bEOSTXX([0-9]+)\b => EURO STOXX $1
\bEOSTXX\b => EURO STOXX
\bFTSE EPRAEORE\b => FTSE EPRA EUROPE REAL ESTATE
\bESTX\b => EURO STOXX
\bESTRAUTO\b => EUROPEAN STRATEGIC AUTONOMY
\bSTOX\b => STOXX
\bST600 INSU\b => STOXX EUROPE 600 INSURANCE
\bST600 RESOU\b => STOXX EUROPE 600 RESOURCES
\bDIVDAX2\b => DIVDAX
\bDJ\b => DOW JONES
\bEO\b => EURO
\bEUROP\b => EUROPE
\bMSCIWS\b => MSCI WORLD SCREENED
\bSPWLDCONDISSCR\b => S P WORLD CONSUMER DISCRETIONARY SCREENED
\bSPWLDHLTHCARESCR\b => S P WORLD HEALTH CARE SCREENED
\bSPWLDINF\.?TECHSCR\b => S P WORLD INFORMATION TECHNOLOGY SCREENED
"""


def abbreviations() -> list[tuple[str, str]]:
    pairs = [line.split(" => ") for line in ABBREVIATIONS.strip().splitlines()]
    return [(f"(?U){e}", by.replace("_", " ")) for e, by in pairs]


def analysis_text(c: Column) -> Column:
    """A name for classification: upper case, & as AND, abbreviations opened, other signs as spaces.

    Most names hold no abbreviation, so the chain of replacements runs only where one alternation of all finds one.
    """
    text = F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" AND "))
    pairs = abbreviations()
    opened = text
    for expression, by in pairs:
        opened = F.regexp_replace(opened, expression, by)
    opened = F.when(text.rlike("|".join(e for e, _ in pairs)), opened).otherwise(text)
    return F.trim(F.regexp_replace(opened, r"[^A-Z0-9+]+", " "))


def source_text(c: Column) -> Column:
    """A name as it stands for terms and ranges: upper case, all dashes as hyphens, single spaces."""
    plain = F.translate(F.upper(F.coalesce(c, F.lit(""))), "–—−", "---")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
