"""Fund taxonomy from names, benchmarks and profile hints: ordered cascades with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

#: Inputs that may be missing from a table; they are read as NULL.
INPUTS = {
    "isin": "string",
    "instrument_name": "string",
    "instrument_type": "string",
    "benchmark_name": "string",
    "asset_class_hint": "string",
    "replication_method": "string",
    "hedged_flag": "int",
    "hedged_target": "string",
    "domicile_country": "string",
    "distribution_policy": "string",
    "equity_size_hint": "string",
    "equity_style_hint": "string",
    "sector_hint": "string",
    "sector_weight": "double",
}
#: Share of one sector, in percent, from which a fund is a sector fund.
SECTOR_WEIGHT = 80.0

# How terms are written, and the words of hints in the order in which they are tried.
MONTH_RANGE = r"\b(0|1|3|6|9|12)\s*[-/]\s*(1|3|6|9|12)\s*M(?:ONTHS?|THS?)?\b"
YEAR_RANGE = r"(?<!\d)(\d+(?:\.\d+)?)\s*[-/]\s*(\d+(?:\.\d+)?)\s*(?:Y(?:EARS?)?|YR|Y)?\b"
OPEN_RANGE = r"(?<!\d)(\d+(?:\.\d+)?)\s*\+\s*(?:Y(?:EARS?)?|YR|Y)?\b"
MATURITY = r"\b(?:(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC|DECEMBER)\s+)?(20\d{2})\s+(?:MATURITY|TERM)\b"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
SHORT_WORDS, SHORT_RANGES = r"\b(ULTRASHORT|ULTRA SHORT|SHORT)\b", r"\b(0\s*[-/]\s*1|1\s*[-/]\s*3)\b"
LONG_WORDS = "LONG DATED|LONG DURATION"
ASSET_HINTS = (
    ("BOND|FIXED INCOME|TREASURY|CREDIT|GILT", "bond"),
    ("COMMODITY|ETC|BULLION|PRECIOUS METAL", "commodity"),
    ("MONEY MARKET|CASH", "cash"),
    ("MULTI|BALANCED|PORTFOLIO", "multi"),
    ("EQUITY|SHARE|STOCK", "equity"),
)
SIZE_HINTS = (("all_cap|all cap", "all_cap"), ("large|giant", "large"), ("mid|medium", "mid"), ("small|micro", "small"))
STYLE_HINTS = (("value", "value"), ("growth", "growth"), ("blend|core", "blend"))
SECTOR_HINTS = {
    "financial_services": "financials",
    "healthcare": "health_care",
    "health_care": "health_care",
    "basic_materials": "materials",
    "communication_services": "communication",
}
ASIA = ("Australia", "China", "India", "Japan", "South Korea", "Taiwan")
EUROPE = (
    "Austria", "Bulgaria", "Croatia", "Czech Republic", "France", "Germany", "Greece", "Hungary", "Ireland",
    "Luxembourg", "North Macedonia", "Poland", "Serbia", "Slovakia", "Slovenia", "Switzerland", "United Kingdom",
)


def with_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in df.columns})


def hint(c: Column, words: tuple[tuple[str, str], ...], own: bool = False) -> Column:
    """The label of the first words found in a hint; a hint of other words is NULL, or itself if `own`."""
    text = T.null_if_blank(c)
    cases = [(text.rlike(w), label) for w, label in words]
    return T.first_match([*cases, (text.isNotNull(), text)] if own else cases)


def asset_hint(c: Column) -> Column:
    return hint(F.upper(c), ASSET_HINTS)


def size_hint(c: Column) -> Column:
    return hint(F.lower(c), SIZE_HINTS, own=True)


def style_hint(c: Column) -> Column:
    return hint(F.lower(c), STYLE_HINTS, own=True)


def sector_hint(c: Column) -> Column:
    text = T.null_if_blank(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")))
    names = F.create_map(*[F.lit(x) for pair in SECTOR_HINTS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, text), text)


def duration_bounds(source: Column, asof: str) -> tuple[Column, Column]:
    """Years from and to: a range of months, a range of years, an open range, or a maturity year seen from `asof`.

    A range that runs backwards is none, and the next form is tried.
    """
    part = lambda e, g: F.nullif(F.regexp_extract(source, e, g), F.lit("")).try_cast("double")
    month = F.regexp_extract(source, MATURITY, 1)
    number = F.when(month == "", 12).otherwise(F.floor((F.instr(F.lit(MONTHS), F.substring(month, 1, 3)) + 2) / 3))
    now = F.to_date(F.lit(asof))
    left = ((part(MATURITY, 2) - F.year(now)) * 12 + number - F.month(now)) / 12.0
    by_month, by_year = part(MONTH_RANGE, 1) <= part(MONTH_RANGE, 2), part(YEAR_RANGE, 1) <= part(YEAR_RANGE, 2)
    is_open = part(OPEN_RANGE, 1).isNotNull()
    low = F.when(by_month, part(MONTH_RANGE, 1) / 12).when(by_year, part(YEAR_RANGE, 1)).when(is_open, part(OPEN_RANGE, 1)).when(left >= 0, 0.0)
    high = F.when(by_month, part(MONTH_RANGE, 2) / 12).when(by_year, part(YEAR_RANGE, 2)).when(is_open, None).when(left >= 0, F.round(left, 2))
    return low, high


def duration_bucket(source: Column, low: Column, high: Column, words: Column, cash: Column) -> Column:
    """short, intermediate or long: by the bounds, else by words of the name."""
    long_words = source.rlike(LONG_WORDS)
    return F.coalesce(
        T.first_match(
            [
                (low.isNotNull() & ((low >= 10) | long_words), "long"),
                (low.isNotNull() & (high <= 3), "short"),
                ((low <= 10) & (high >= 3), "intermediate"),
                (long_words | (words == "long"), "long"),
                ((cash == 1) | source.rlike(SHORT_RANGES) | source.rlike(SHORT_WORDS) | (words == "short"), "short"),
                (words == "intermediate", "intermediate"),
            ]
        ),
        F.lit("unknown"),
    )


def classify(df: DataFrame, asof: str, keep: tuple[str, ...] = ("isin",)) -> DataFrame:
    """Taxonomy columns of every row; `asof` stands for today."""
    both = F.concat_ws(" ", F.nullif("instrument_name", F.lit("")), F.nullif("benchmark_name", F.lit("")))
    df = with_inputs(df).withColumns({"_src": R.source_text(both), "_t": R.analysis_text(both), "_name": R.source_text(F.col("instrument_name"))})
    t, src, name = F.col("_t"), F.col("_src"), F.col("_name")
    rules = {"_commodity": R.COMMODITY, "_sector": R.SECTOR, "theme": R.THEME, "factor": R.FACTOR, "_size": R.SIZE, "_style": R.STYLE}
    rules |= {"_country": R.COUNTRY, "_region": R.REGION, "_bond": R.BOND_TYPE, "_hedge": R.HEDGED, "_term": R.DURATION}
    df = df.withColumns({c: R.classify(t, r) for c, r in rules.items()})
    low, high = duration_bounds(src, asof)
    df = df.withColumns(
        {
            "gold_flag": (name.rlike(R.GOLD) & ~name.rlike(R.GOLD_EQUITY)).cast("int"),
            "_proxy": name.rlike(R.GOLD) & name.rlike(R.GOLD_EQUITY),
            "_hint": asset_hint(F.col("asset_class_hint")),
            "_size_hint": size_hint(F.col("equity_size_hint")),
            "_style_hint": style_hint(F.col("equity_style_hint")),
            "_sector_hint": F.when(F.coalesce("sector_weight", F.lit(SECTOR_WEIGHT)) >= SECTOR_WEIGHT, sector_hint(F.col("sector_hint"))),
            "cash_proxy_flag": (src.rlike(R.CASH) | t.rlike(R.CASH)).cast("int"),
            "_special": src.rlike(R.BOND_SPECIAL),
            "_low": low,
            "_high": high,
        }
    )
    df = df.withColumns(
        {
            "sector": F.coalesce("_sector_hint", "_sector"),
            "equity_size": F.coalesce("_size_hint", "_size"),
            "equity_style": F.coalesce("_style_hint", "_style"),
            "commodity_type": F.when(F.col("gold_flag") == 1, "gold").otherwise(F.col("_commodity")),
        }
    )
    country, region = F.split_part("_country", F.lit("|"), F.lit(1)), F.split_part("_country", F.lit("|"), F.lit(2))
    told = F.coalesce("_region", "_country", "sector", "factor", "equity_size", "equity_style", "theme").isNotNull()
    of_hint = lambda kind: F.coalesce(F.col("_hint") == kind, F.lit(False))
    asset = T.first_match(
        [
            (F.col("commodity_type").isNotNull() | of_hint("commodity"), "commodity"),
            (of_hint("bond") | t.rlike(R.BOND) | F.col("_special"), "bond"),
            (of_hint("cash") | (F.col("cash_proxy_flag") == 1), "cash"),
            (of_hint("multi") | t.rlike(R.MULTI), "multi"),
            (of_hint("equity") | t.rlike(R.EQUITY_HINT) | told | (F.upper("instrument_type") == "ETF"), "equity"),
        ]
    )
    df = df.withColumn("asset_class", F.coalesce(asset, F.lit("unknown")))
    is_equity, is_bond, dated = F.col("asset_class") == "equity", F.col("asset_class") == "bond", F.col("asset_class").isin("bond", "cash")
    govt = t.rlike(dict(R.BOND_TYPE)["govt"]) | F.col("_special")
    scope = T.first_match(
        [
            (F.col("_country").isNotNull(), "country"),
            (F.col("_region") == "global", "global"),
            (F.col("_region").isNotNull(), "regional"),
            (is_equity & F.col("sector").isNotNull(), "sector"),
            (is_equity & F.col("theme").isNotNull(), "thematic"),
            (is_equity, "unknown"),
        ]
    )
    df = df.withColumns(
        {
            "geography_scope": scope,
            "bond_type": F.when(is_bond, F.when(F.col("_bond") == "linkers", "linkers").when(govt, "govt").otherwise(F.coalesce("_bond", F.lit("unknown")))),
            "govt_bond_flag": (is_bond & govt).cast("int"),
        }
    )
    said = F.col("hedged_flag").isin(0, 1)
    from_profile = F.coalesce(said, F.lit(False)) | F.col("hedged_target").isNotNull()
    target = F.when(from_profile, F.col("hedged_target")).otherwise(F.col("_hedge"))
    plain_hedge = t.contains("HEDGED")
    hedged = F.when(said, F.col("hedged_flag")).when(target.isNotNull() | plain_hedge, 1).otherwise(0)
    domicile = F.coalesce(F.nullif("domicile_country", F.lit("")), T.by_prefix(F.col("isin"), T.DOMICILES))
    tag = lambda label, c: (F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c)))
    shown = T.evidence(
        [
            (F.nullif("benchmark_name", F.lit("")).isNotNull(), "profile:benchmark_name"),
            tag("profile:asset_class_hint=", "_hint"),
            (F.nullif("replication_method", F.lit("")).isNotNull(), F.concat(F.lit("profile:replication="), F.lower("replication_method"))),
            tag("profile:equity_size=", "_size_hint"),
            tag("profile:equity_style=", "_style_hint"),
            (F.col("gold_flag") == 1, "commodity:gold"),
            (F.col("_proxy"), "commodity:gold_proxy_equity_excluded"),
            ((F.col("gold_flag") == 0) & F.col("_commodity").isNotNull(), F.concat(F.lit("commodity:"), F.col("_commodity"))),
            tag("profile:sector=", "_sector_hint"),
            (F.col("_sector_hint").isNull() & F.col("_sector").isNotNull(), F.concat(F.lit("sector:"), F.col("_sector"))),
            tag("theme:", "theme"),
            tag("factor:", "factor"),
            (F.col("_size_hint").isNull() & F.col("_size").isNotNull(), F.concat(F.lit("size:"), F.col("_size"))),
            (F.col("_style_hint").isNull() & F.col("_style").isNotNull(), F.concat(F.lit("style:"), F.col("_style"))),
            (F.col("_country").isNotNull(), F.concat(F.lit("country:"), country)),
            (F.col("_country").isNull() & F.col("_region").isNotNull(), F.concat(F.lit("region:"), F.col("_region"))),
            (F.upper("instrument_name").startswith("JPM-") & F.concat(F.lit(" "), t, F.lit(" ")).contains(" EQ "), "equity:jpm_eq_abbrev"),
            tag("bond_type:", "bond_type"),
            (from_profile, "profile:hedged"),
            (target.isNotNull(), F.concat(F.lit("hedged:"), target)),
            (~from_profile & target.isNull() & plain_hedge, "hedged:explicit"),
            (domicile.isNotNull(), F.concat(F.lit("domicile:"), domicile)),
            (F.nullif("distribution_policy", F.lit("")).isNotNull(), F.concat(F.lit("distribution:"), F.col("distribution_policy"))),
        ]
    )
    placed = F.when(F.col("geography_scope").isin("sector", "thematic"), "global").when(F.col("geography_scope") == "unknown", "unknown")
    return df.select(
        *keep,
        "asset_class",
        "geography_scope",
        placed.otherwise(F.coalesce(region, F.col("_region"))).alias("geography_region"),
        country.alias("geography_country"),
        *["equity_size", "equity_style", "factor", "sector", "theme", "bond_type"],
        F.when(dated, duration_bucket(src, F.col("_low"), F.col("_high"), F.col("_term"), F.col("cash_proxy_flag"))).alias("duration_bucket"),
        F.when(dated, F.col("_low")).alias("duration_years_low"),
        F.when(dated, F.col("_high")).alias("duration_years_high"),
        *["commodity_type", "cash_proxy_flag", "gold_flag"],
        F.when(F.col("asset_class") == "cash", 1).otherwise(F.col("cash_proxy_flag")).alias("cash_flag"),
        "govt_bond_flag",
        hedged.alias("hedged_flag"),
        target.alias("hedged_target"),
        domicile.alias("domicile_country"),
        "distribution_policy",
        F.to_json(F.struct(shown.alias("rules"), t.alias("normalized_name"))).alias("evidence_json"),
    )


def equity_region(region: Column, country: Column, sector: Column) -> Column:
    """The old region of an equity fund: a sector fund is of no region, North America counts as us."""
    return F.coalesce(
        T.first_match(
            [
                (T.null_if_blank(sector).isNotNull(), "sector"),
                (region == "global", "global"),
                ((region == "north_america") | (country == "United States") | (region == "us"), "us"),
                (region == "em", "em"),
                ((region == "asia") | country.isin(*ASIA), "asia"),
                ((region == "europe") | country.isin(*EUROPE), "europe"),
            ]
        ),
        F.lit("unknown"),
    )


def legacy(tax: DataFrame, keep: tuple[str, ...] = ("isin",)) -> DataFrame:
    """The old projection: asset bucket and equity region."""
    old = equity_region(F.col("geography_region"), F.col("geography_country"), F.col("sector"))
    return tax.select(*keep, F.col("asset_class").alias("asset_bucket"), F.when(F.col("asset_class") == "equity", old).alias("equity_region"))
