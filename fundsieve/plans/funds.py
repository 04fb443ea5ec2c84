"""Registered queries of the catalogue jobs: a fund catalogue derived from the given tables, and the same results in SQL.

The tables hold no funds: each part stands for one, line items are its cost log, orders its metadata log and nations
its issuers. The SQL derives the same relations on its own (FUNDS) and states each result from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import coverage as C
from ..operators import extract as X
from ..operators import latest as L
from ..operators import screen as S
from ..operators import serve as V
from ..operators import state as M
from ..operators.ranks import dealt
from .catalogue import query, t

#: The fund relation in SQL: one row a part.
FUNDS = """f AS (SELECT p_partkey AS k, 'IE' || lpad(p_partkey::VARCHAR, 10, '0') AS isin, p_size AS s, p_retailprice AS price, p_brand AS brand,
    p_name || CASE p_size % 10 WHEN 1 THEN ' esg' WHEN 2 THEN ' mining' WHEN 3 THEN ' gold' WHEN 4 THEN ' small cap value' WHEN 5 THEN ' bullion' ELSE '' END AS name,
    CASE WHEN p_type = 'PROMO' THEN 'ETC' ELSE 'ETF' END AS kind, (p_size = 49)::INT AS lev, (p_size % 5 > 0)::INT AS mvp,
    CASE p_type WHEN 'STANDARD' THEN 'equity' WHEN 'ECONOMY' THEN 'equity' WHEN 'SMALL' THEN 'bond' WHEN 'LARGE' THEN 'bond' WHEN 'MEDIUM' THEN CASE WHEN p_size % 2 = 0 THEN 'cash' ELSE 'multi' END ELSE 'commodity' END AS cls,
    CASE split_part(p_brand, '#', 2)::INT % 6 WHEN 0 THEN 'global' WHEN 1 THEN 'us' WHEN 2 THEN 'europe' WHEN 3 THEN 'asia' WHEN 4 THEN 'em' END AS region,
    CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 'small' WHEN 'large' THEN 'large' WHEN 'old' THEN 'mid' WHEN 'new' THEN 'all_cap' END AS sz,
    CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'value' WHEN 'gear' THEN 'growth' WHEN 'widget' THEN 'blend' END AS sty,
    CASE WHEN split_part(p_name, ' ', 1) = 'hot' THEN 'momentum' END AS factor,
    CASE split_part(p_name, ' ', 2) WHEN 'plate' THEN 'technology' WHEN 'anvil' THEN 'energy' END AS sector,
    CASE WHEN split_part(p_name, ' ', 2) = 'gizmo' THEN 'robotics' END AS theme,
    CASE p_size % 4 WHEN 0 THEN 'govt' WHEN 1 THEN 'corp' WHEN 2 THEN 'aggregate' ELSE 'linkers' END AS btype, CASE p_size % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'intermediate' ELSE 'long' END AS dur,
    CASE p_size % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'energy' WHEN 3 THEN 'broad_commodities' ELSE 'industrial_metals' END AS ctype,
    CASE WHEN p_size % 7 > 0 THEN p_retailprice / 1000 END AS fee, CASE split_part(p_brand, '#', 2)::INT % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS cur, CASE WHEN p_size % 3 = 0 THEN 'XETR' ELSE 'XLON' END AS venue,
    CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 25 END AS issuer_id, CASE p_size % 3 WHEN 0 THEN 'Accumulating' WHEN 1 THEN ' ' END AS policy, CASE WHEN p_size % 4 > 0 THEN 'Index ' || p_brand END AS bench,
    CASE WHEN p_size % 6 > 0 THEN p_retailprice * 100000 END AS aum, CASE p_size % 5 WHEN 1 THEN 'physical' WHEN 2 THEN 'synthetic' END AS repl, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS hedge FROM part)"""


def funds(spark, sf_dir) -> DataFrame:
    return funds_of(t(spark, sf_dir, "part"))


def funds_of(parts: DataFrame) -> DataFrame:
    """The same relation by DataFrame functions."""
    k, s = F.col("p_partkey"), F.col("p_size")
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    of = lambda c, names: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)
    kinds = {"STANDARD": "equity", "ECONOMY": "equity", "SMALL": "bond", "LARGE": "bond", "PROMO": "commodity"}
    tail = of(s % 10, {1: " esg", 2: " mining", 3: " gold", 4: " small cap value", 5: " bullion"})
    return parts.select(
        k.alias("instrument_id"),
        F.concat(F.lit("IE"), F.lpad(k.cast("string"), 10, "0")).alias("isin"),
        F.concat("p_name", F.coalesce(tail, F.lit(""))).alias("instrument_name"),
        F.when(F.col("p_type") == "PROMO", "ETC").otherwise("ETF").alias("instrument_type"),
        (s == 49).cast("int").alias("leverage_flag"),
        F.lit(0).alias("inverse_flag"),
        (s % 5 > 0).cast("int").alias("universe_mvp_flag"),
        F.coalesce(of(F.col("p_type"), kinds), F.when(s % 2 == 0, "cash").otherwise("multi")).alias("asset_class"),
        of(number % 6, {0: "global", 1: "us", 2: "europe", 3: "asia", 4: "em"}).alias("geography_region"),
        F.when(number % 6 == 0, "global").when(number % 6 < 5, "regional").alias("geography_scope"),
        of(first, {"small": "small", "large": "large", "old": "mid", "new": "all_cap"}).alias("equity_size"),
        of(last, {"ring": "value", "gear": "growth", "widget": "blend"}).alias("equity_style"),
        F.when(first == "hot", "momentum").alias("factor"),
        of(last, {"plate": "technology", "anvil": "energy"}).alias("sector"),
        F.when(last == "gizmo", "robotics").alias("theme"),
        of(s % 4, {0: "govt", 1: "corp", 2: "aggregate", 3: "linkers"}).alias("bond_type"),
        of(s % 3, {0: "short", 1: "intermediate", 2: "long"}).alias("duration_bucket"),
        of(s % 5, {0: "gold", 1: "silver", 2: "energy", 3: "broad_commodities", 4: "industrial_metals"}).alias("commodity_type"),
        F.lit(0).alias("cash_flag"),
        ((s == 1)).cast("int").alias("cash_proxy_flag"),
        (s % 4 == 0).cast("int").alias("govt_bond_flag"),
        F.when(s % 7 > 0, F.col("p_retailprice") / 1000).alias("ongoing_charges"),
        of(number % 4, {0: "USD", 1: "EUR", 2: "GBP"}).alias("currency"),
        F.when(s % 3 == 0, "XETR").otherwise("XLON").alias("primary_venue"),
        F.concat(F.lit("T"), k.cast("string")).alias("ticker"),
        F.when(k % 11 > 0, k % 25).alias("issuer_id"),
        F.lit("House").alias("issuer_normalized"),
        of(s % 3, {0: "Accumulating", 1: " "}).alias("distribution_policy"),
        F.when(s % 4 > 0, F.concat(F.lit("Index "), "p_brand")).alias("benchmark_name"),
        F.when(s % 6 > 0, F.col("p_retailprice") * 100000).alias("fund_size_value"),
        of(s % 5, {1: "physical", 2: "synthetic"}).alias("replication_method"),
        of(s % 3, {0: 1, 1: 0}).alias("hedged_flag"),
    )


def catalog(spark, sf_dir) -> dict[str, DataFrame]:
    """The catalogue tables over the fund relation, the line items and the orders."""
    f = funds(spark, sf_dir)
    cost = t(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + F.round(F.col("l_discount") * 100)).cast("long").alias("cost_id"),
        F.col("l_partkey").alias("instrument_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("asof_date"),
        F.col("l_discount").alias("ongoing_charges"),
        F.when(F.col("l_returnflag") == "R", "ok").when(F.col("l_returnflag") == "A", "partial").otherwise("parse_fail").alias("quality_flag"),
        F.lit("{}").alias("raw_json"),
    )
    log = t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("instrument_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("asof_date"),
        F.when(F.col("o_orderstatus") == "F", "ft_tearsheet").otherwise("page").alias("source"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.col("o_orderpriority").alias("quality_flag"),
        F.concat(F.lit('{"symbol":"S'), F.col("o_orderkey").cast("string"), F.lit('"}')).alias("raw_json"),
    )
    listing = f.select(F.explode(F.array(F.struct((F.col("instrument_id") * 2).alias("listing_id"), F.lit(1).alias("primary_flag"), F.col("primary_venue").alias("venue_mic"), "ticker", F.col("currency").alias("trading_currency")), F.struct((F.col("instrument_id") * 2 + 1).alias("listing_id"), F.lit(0).alias("primary_flag"), F.lit("XPAR").alias("venue_mic"), F.concat(F.lit("A"), F.col("instrument_id").cast("string")).alias("ticker"), F.lit("EUR").alias("trading_currency")))).alias("l"), "instrument_id")
    listing = listing.select("instrument_id", "l.*", F.lit("active").alias("status")).where("primary_flag = 1 or instrument_id % 4 = 0")
    issuer = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("issuer_id"), F.col("n_name").alias("issuer_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("House "), F.col("n_nationkey").cast("string"))).alias("normalized_name"))
    return {
        "instrument": f.withColumns({"status": F.lit("active"), "ucits_flag": F.lit(1)}),
        "listing": listing,
        "issuer": issuer,
        "product_profile": f.withColumn("fund_size_currency", F.lit("USD")),
        "instrument_taxonomy": f.withColumn("hedged_flag", F.lit(0)).withColumn("distribution_policy", F.lit(None).cast("string")),
        "cost_snapshot": cost,
        "issuer_metadata_snapshot": log,
    }


COSTS = """c AS (SELECT * FROM (SELECT l_partkey AS k, l_discount AS cost, row_number() OVER (PARTITION BY l_partkey ORDER BY strftime(l_shipdate, '%Y-%m-%d') DESC, ((l_orderkey * 8 + l_linenumber) * 100 + round(l_discount * 100))::BIGINT DESC) AS rn FROM lineitem WHERE l_returnflag IN ('R', 'A')) WHERE rn = 1)"""
VIEW = f"""{FUNDS}, {COSTS}, i AS (SELECT n_nationkey AS issuer_id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'House ' || n_nationkey END, n_name) AS issuer FROM nation),
    v AS (SELECT f.*, issuer, coalesce(fee, cost) AS charge, cost, coalesce(policy, NULL) AS dist FROM f LEFT JOIN c USING (k) LEFT JOIN i USING (issuer_id))"""

# --------------------------------------------------------------------------- screening

SPECS = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in b.values()) + ")" for b in S.buckets())
LADDER = """l(g, attempt, step, allv, fees, mode) AS (VALUES ('generic', 1, 'strict', false, false, 'strict'), ('generic', 2, 'fallback_venue_expand', true, false, 'strict'), ('generic', 3, 'fallback_allow_missing_fees', true, true, 'strict'),
    ('core_global', 1, 'strict', false, false, 'strict'), ('core_global', 2, 'fallback_venue_expand', true, false, 'strict'), ('core_global', 3, 'fallback_allow_factor', true, false, 'allow_factor'), ('core_global', 4, 'fallback_allow_missing_fees', true, true, 'allow_factor'),
    ('small_cap_value', 1, 'strict', false, false, 'strict'), ('small_cap_value', 2, 'fallback_venue_expand', true, false, 'strict'), ('small_cap_value', 3, 'fallback_small_cap_proxy', true, false, 'proxy'), ('small_cap_value', 4, 'fallback_small_cap_proxy_allow_missing_fees', true, true, 'proxy'),
    ('cash', 1, 'strict', false, false, 'strict'), ('cash', 2, 'fallback_venue_expand', true, false, 'strict'), ('cash', 3, 'fallback_short_bond_proxy', true, false, 'bond_proxy'), ('cash', 4, 'fallback_short_bond_proxy_allow_missing_fees', true, true, 'bond_proxy'))"""
RUN = f"""{FUNDS}, b(bucket, kind2, spec_class, spec_region, spec_size, spec_style, spec_sector, spec_bond, spec_duration, spec_commodity, govt_only) AS (VALUES {SPECS}), {LADDER},
    a AS (SELECT * FROM b JOIN l ON g = CASE WHEN kind2 IN ('core_global', 'small_cap_value', 'cash') THEN kind2 ELSE 'generic' END),
    x AS (SELECT *, sector IS NOT NULL OR theme IS NOT NULL AS topical, contains(name, ' esg') AS odd, contains(name, ' mining') AS miner, coalesce(sz, '') IN ('', 'large', 'all_cap') AS wide, coalesce(sty, '') IN ('', 'blend') AS plain, s % 4 = 0 OR btype = 'govt' AS govt FROM f),
    m AS (SELECT bucket, attempt, step, x.*, CASE kind2 WHEN 'core_global' THEN 20 * odd::INT + 5 * (factor IS NOT NULL)::INT + 5 * (sz IS NOT NULL)::INT + 5 * (sty IS NOT NULL)::INT WHEN 'small_cap_value' THEN 20 * (coalesce(sty, '') <> 'value')::INT WHEN 'cash' THEN 10 * (cls <> 'cash')::INT
    ELSE CASE WHEN spec_class = 'equity' THEN 15 * (factor IS NOT NULL)::INT + CASE WHEN spec_sector IS NULL THEN 20 * odd::INT + 8 * (spec_size IS NULL AND NOT wide)::INT + 8 * (spec_style IS NULL AND NOT plain)::INT ELSE 0 END ELSE 0 END END AS pref, CASE WHEN kind2 = 'small_cap_value' THEN CASE WHEN mode = 'proxy' THEN 'small_cap_proxy' WHEN sz = 'small' AND sty = 'value' THEN 'small_cap_value_taxonomy' ELSE 'small_cap_value_name' END END AS why
    FROM a JOIN x ON (allv OR venue = 'XLON') AND (kind = 'ETF' OR (spec_class = 'commodity' AND kind = 'ETC')) AND lev = 0 AND (fees OR fee IS NOT NULL) AND cur IS NOT NULL AND CASE kind2
    WHEN 'core_global' THEN cls = 'equity' AND region = 'global' AND NOT topical AND (mode = 'allow_factor' OR (factor IS NULL AND wide AND plain AND NOT odd))
    WHEN 'small_cap_value' THEN cls = 'equity' AND region = 'global' AND NOT topical AND CASE WHEN mode = 'proxy' THEN sz = 'small' OR contains(name, 'small cap') ELSE (sz = 'small' AND sty = 'value') OR contains(name, 'small cap value') END
    WHEN 'cash' THEN cls = 'cash' OR s = 1 OR (mode = 'bond_proxy' AND cls = 'bond' AND dur = 'short' AND govt) WHEN 'gold' THEN cls = 'commodity' AND ctype = 'gold' AND NOT miner
    ELSE cls = spec_class AND CASE spec_class WHEN 'equity' THEN CASE WHEN spec_sector IS NOT NULL THEN sector = spec_sector ELSE NOT topical AND NOT odd AND region = spec_region AND CASE WHEN spec_size IS NULL THEN wide ELSE sz = spec_size END AND CASE WHEN spec_style IS NULL THEN plain ELSE sty = spec_style END AND factor IS NULL END
    WHEN 'bond' THEN (govt_only = 0 OR govt) AND (spec_bond IS NULL OR btype = spec_bond) AND (spec_duration IS NULL OR dur = spec_duration) WHEN 'commodity' THEN ctype = spec_commodity AND NOT miner ELSE true END END),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket, attempt ORDER BY pref, (fee IS NULL)::INT, coalesce(fee, 99), CASE venue WHEN 'XLON' THEN 0 ELSE 1 END, CASE cur WHEN 'USD' THEN 0 WHEN 'EUR' THEN 1 ELSE 2 END, isin) AS rank FROM m),
    n AS (SELECT bucket, attempt, a.step, allv, fees, mode, spec_class, count(k) AS hits FROM a LEFT JOIN m USING (bucket, attempt) GROUP BY ALL), p AS (SELECT bucket, coalesce(min(attempt) FILTER (WHERE hits >= 5), max(attempt)) AS attempt FROM n GROUP BY bucket),
    o AS (SELECT r.* FROM r JOIN p USING (bucket, attempt) WHERE rank <= 5)"""


def run(spark, sf_dir, specs=None) -> S.Run:
    """A run over the funds, dealt out: a fund has a row for each attempt that it fits, which are sorted where it lies."""
    return S.Run(funds_of(dealt(t(spark, sf_dir, "part"), "p_partkey")), specs, selected=("XLON",), allow_missing_fees=True)


@query(f"WITH {RUN} SELECT bucket, step, rank, isin, pref AS preference, fee FROM o")
def fund_shortlist(spark, sf_dir):
    """The five best funds of all buckets, through hard filters, matching, ranking and the ladder."""
    return run(spark, sf_dir).picked().select("bucket", "step", "rank", "isin", "preference", F.col("ongoing_charges").alias("fee"))


@query(
    f"""WITH {RUN}, q AS (SELECT count(*) AS all_n, sum((venue = 'XLON')::INT) AS sel_n FROM f), h AS (SELECT allv, fees, com, count(*) FILTER (WHERE (allv OR venue = 'XLON') AND (kind = 'ETF' OR (com AND kind = 'ETC')) AND lev = 0 AND (fees OR fee IS NOT NULL) AND cur IS NOT NULL) AS kept FROM f, (VALUES (true), (false)) AS va(allv), (VALUES (true), (false)) AS vf(fees), (VALUES (true), (false)) AS vc(com) GROUP BY ALL)
    SELECT bucket, n.attempt, step, CASE WHEN n.allv THEN 'XLON,XETR' ELSE 'XLON' END AS venues, n.fees AS allow_fees, mode, CASE WHEN n.allv THEN all_n ELSE sel_n END::BIGINT AS considered, kept AS hard_kept, hits AS bucket_matches, least(hits, 5) AS final_selected, n.attempt = p.attempt AS final
    FROM n JOIN p USING (bucket) JOIN h ON h.allv = n.allv AND h.fees = n.fees AND h.com = (spec_class = 'commodity'), q WHERE n.attempt <= p.attempt"""
)
def shortlist_diagnostics(spark, sf_dir):
    """What each executed attempt of each bucket considered, kept, matched and selected."""
    return run(spark, sf_dir).attempt_counts()


@query(
    f"""WITH {RUN} SELECT bucket, rank, isin, CASE bucket WHEN 'equity_global' THEN 'asset_class=equity;geography_region=global;core_scope=global' WHEN 'gold' THEN 'asset_class=commodity;commodity_type=gold' WHEN 'cash' THEN CASE WHEN cls = 'cash' OR s = 1 THEN 'asset_class=cash_or_proxy' ELSE 'short_govt_bond_proxy' END WHEN 'equity_small_cap_value' THEN why
    ELSE concat_ws(';', 'asset_class=' || spec_class, 'sector=' || spec_sector, 'geography_region=' || CASE WHEN spec_class = 'equity' THEN spec_region END, 'equity_size=' || spec_size, 'equity_style=' || spec_style, CASE WHEN govt_only = 1 THEN 'bond_type=govt' ELSE 'bond_type=' || spec_bond END, 'duration=' || spec_duration, 'commodity_type=' || spec_commodity) END AS reasons,
    CASE venue WHEN 'XLON' THEN 0 ELSE 1 END AS venue_rank, CASE cur WHEN 'USD' THEN 0 WHEN 'EUR' THEN 1 ELSE 2 END AS currency_rank, CASE WHEN bucket = 'gold' THEN 'disclosed_non_ucits_physical_gold_exception' END AS policy FROM o JOIN b USING (bucket)"""
)
def selection_reasons(spark, sf_dir):
    """What the JSON of each picked row says."""
    why = F.from_json("selection_reason", "filters array<string>, bucket_reasons array<string>, rank_keys struct<venue_rank:int,currency_rank:int>, bucket_policy string")
    rows = run(spark, sf_dir).picked().withColumn("w", why)
    return rows.select("bucket", "rank", "isin", F.array_join("w.bucket_reasons", ";").alias("reasons"), "w.rank_keys.venue_rank", "w.rank_keys.currency_rank", F.col("w.bucket_policy").alias("policy"))


MIXES = {"butterfly": [("equity_global", 20.0), ("equity_small_cap_value", 20.0), ("long_govt_bonds", 20.0), ("short_bonds", 20.0), ("gold", 20.0)], "plain": [("equity_global", 60.0), ("multi_asset", 40.0)]}
MIX_SQL = "mix(strategy, bucket, weight) AS (VALUES ('butterfly', 'equity_global', 20.0::DOUBLE), ('butterfly', 'equity_small_cap_value', 20.0), ('butterfly', 'long_govt_bonds', 20.0), ('butterfly', 'short_bonds', 20.0), ('butterfly', 'gold', 20.0), ('plain', 'equity_global', 60.0), ('plain', 'multi_asset', 40.0))"


@query(f"WITH {RUN}, {MIX_SQL} SELECT strategy, bucket, weight AS target_weight, rank, isin, 'T' || k AS ticker, (fee IS NULL)::INT AS fee_missing_flag, 0 AS currency_missing_flag FROM mix JOIN o USING (bucket)")
def strategy_report(spark, sf_dir):
    """The report of two strategies: buckets are searched once, whoever uses them."""
    rows = S.report_rows(S.strategies(spark, MIXES), run(spark, sf_dir, S.held(MIXES)))
    return rows.select("strategy", "bucket", "target_weight", "rank", "isin", "ticker", "fee_missing_flag", "currency_missing_flag")


@query(f"WITH {RUN}, {MIX_SQL}, z AS (SELECT strategy, bucket, count(k) AS n FROM mix LEFT JOIN o USING (bucket) GROUP BY 1, 2) SELECT strategy, sum(n)::BIGINT AS total_rows_emitted, min(n) AS min_candidates_per_bucket FROM z GROUP BY 1")
def strategy_emitted(spark, sf_dir):
    """How many rows a strategy gets, and its poorest bucket."""
    return S.emitted(S.strategies(spark, MIXES), run(spark, sf_dir, S.held(MIXES)))


@query(f"WITH {RUN}, {MIX_SQL}, d AS (SELECT bucket, count(*) FILTER (WHERE n.attempt <= p.attempt) AS attempts, max(CASE WHEN n.attempt = p.attempt THEN step END) AS final_step, max(CASE WHEN n.attempt = p.attempt THEN hits END) AS hits FROM n JOIN p USING (bucket) GROUP BY 1) SELECT strategy, bucket, weight AS target_weight, attempts::INT AS attempts, final_step, least(hits, 5)::INT AS rows FROM mix JOIN d USING (bucket)")
def strategy_snapshot(spark, sf_dir):
    """The nested snapshot of strategies, opened again."""
    rows = S.snapshot(S.strategies(spark, MIXES), run(spark, sf_dir, S.held(MIXES))).select("strategy", F.explode("buckets").alias("b"))
    return rows.select("strategy", "b.bucket", "b.target_weight", F.size("b.attempts").alias("attempts"), "b.final_step", F.when(F.col("b.rows").isNull(), 0).otherwise(F.size("b.rows")).alias("rows"))


@query(f"WITH {FUNDS}, x AS (SELECT *, kind <> 'ETF' AS a, lev <> 0 AS b, fee IS NULL AS c, cur IS NULL AS d FROM f WHERE venue IN ('XLON', 'XETR')) SELECT count(*) AS considered, sum((NOT (a OR b OR c OR d))::INT)::BIGINT AS kept, sum(a::INT)::BIGINT AS instrument_type, sum(b::INT)::BIGINT AS leverage_flag, 0::BIGINT AS inverse_flag, 0::BIGINT AS xs_isin, 0::BIGINT AS name_etp_etn_note, 0::BIGINT AS issuer_denylist, sum(c::INT)::BIGINT AS missing_fees, sum(d::INT)::BIGINT AS missing_currency FROM x")
def strict_hard_filters(spark, sf_dir):
    """The eight hard filters over plain funds, counted in one pass."""
    return S.strict_counts(funds(spark, sf_dir))


@query(f"WITH {FUNDS} SELECT count(*) FILTER (WHERE regexp_matches(name, 'gold|bullion') AND mvp = 1) AS eligible, count(*) FILTER (WHERE regexp_matches(name, 'gold|bullion') AND mvp = 0) AS exceptions, 0::BIGINT AS ignored, count(*) AS total FROM f")
def gold_policy(spark, sf_dir):
    """Gold funds inside and outside the universe, and gold equity that is left out."""
    rows = funds(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    return S.gold_policy(rows).select("eligible", "exceptions", "ignored", F.lit(1).alias("one")).join(total, "one").drop("one")


# --------------------------------------------------------------------------- catalogue


@query(f"WITH {VIEW} SELECT isin, 'T' || k AS ticker, issuer, charge AS ongoing_charges FROM v WHERE mvp = 1 AND cls = 'equity' AND charge BETWEEN 0.5 AND 0.95 AND hedge = 1 ORDER BY charge, isin LIMIT 50")
def catalog_list(spark, sf_dir):
    """A page of the fund list: facet, fee range, hedge, sort."""
    page, _ = K.list_funds(spark, catalog(spark, sf_dir), {"asset_class": "equity"}, hedged="true", fee_min=0.5, fee_max=0.95, sort="fee")
    return page.select("isin", "ticker", "issuer", "ongoing_charges")


@query(f"WITH {VIEW} SELECT count(*) AS total FROM v WHERE mvp = 1 AND (contains(name, 'gold') OR contains(lower('T' || k), 'gold') OR contains(lower(issuer), 'gold'))")
def catalog_search_total(spark, sf_dir):
    """How many funds a search finds in names, issuers, benchmarks and alias tickers."""
    return K.list_funds(spark, catalog(spark, sf_dir), q=" GOLD ")[1]


@query(f"WITH {VIEW} SELECT isin, name AS instrument_name, issuer, charge AS ongoing_charges, mvp AS universe_mvp_flag FROM v WHERE isin = 'IE0000000045'")
def catalog_detail(spark, sf_dir):
    return K.fund_detail(spark, catalog(spark, sf_dir), " ie0000000045").select("isin", "instrument_name", "issuer", "ongoing_charges", "universe_mvp_flag")


@query(
    f"""WITH {VIEW}, u AS (SELECT unnest([{{'facet': 'asset_class', 'value': cls}}, {{'facet': 'geography_region', 'value': region}}, {{'facet': 'equity_size', 'value': sz}}, {{'facet': 'equity_style', 'value': sty}}, {{'facet': 'factor', 'value': factor}}, {{'facet': 'sector', 'value': sector}}, {{'facet': 'theme', 'value': theme}}, {{'facet': 'bond_type', 'value': btype}}, {{'facet': 'duration_bucket', 'value': dur}}, {{'facet': 'commodity_type', 'value': ctype}},
    {{'facet': 'distribution_policy', 'value': policy}}, {{'facet': 'replication_method', 'value': repl}}, {{'facet': 'primary_venue', 'value': venue}}, {{'facet': 'currency', 'value': cur}}, {{'facet': 'issuer', 'value': issuer}}, {{'facet': 'instrument_type', 'value': kind}}]) AS z FROM v WHERE mvp = 1) SELECT z.facet AS facet, z.value AS value, count(*) AS n FROM u WHERE z.value IS NOT NULL GROUP BY 1, 2"""
)
def catalog_facets(spark, sf_dir):
    """All facets of the fund list with their counts, in one pass."""
    return K.filter_options(spark, catalog(spark, sf_dir))["facets"]


@query(f"WITH {VIEW} SELECT round(min(charge), 2) AS low, round(max(charge), 2) AS high FROM v WHERE mvp = 1")
def fee_range(spark, sf_dir):
    return C.value_range(K.fund_view(spark, catalog(spark, sf_dir)), F.col("ongoing_charges"))


@query(
    f"""WITH {VIEW}, x AS (SELECT * FROM v WHERE mvp = 1), w AS (SELECT 'asset_class' AS field, count(cls) AS known, count(*) AS total FROM x UNION ALL SELECT 'geography_region', count(region), count(*) FROM x UNION ALL SELECT 'equity_size', count(sz), count(*) FROM x WHERE cls = 'equity' UNION ALL SELECT 'equity_style', count(sty), count(*) FROM x WHERE cls = 'equity'
    UNION ALL SELECT 'sector', count(sector), count(*) FROM x WHERE cls = 'equity' UNION ALL SELECT 'bond_type', count(btype), count(*) FROM x WHERE cls = 'bond' UNION ALL SELECT 'duration_bucket', count(dur), count(*) FROM x WHERE cls = 'bond')
    SELECT field, known, total, CASE WHEN total > 0 THEN round(100.0 * known::DOUBLE / total, 2) ELSE 0.0 END AS pct FROM w"""
)
def taxonomy_coverage(spark, sf_dir):
    """Coverage of the taxonomy's fields, each over the funds that it applies to."""
    return K.completeness(spark, catalog(spark, sf_dir))["taxonomy"]


GAPS = f"""{FUNDS}, i AS (SELECT n_nationkey AS issuer_id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'House ' || n_nationkey END, n_name) AS issuer FROM nation), o AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'ft_tearsheet' ELSE 'page' END AS source, o_orderpriority AS flag, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
    ft AS (SELECT k, arg_max(flag, (d, o_orderkey)) AS flag, arg_max(o_orderkey, (d, o_orderkey)) AS n FROM o WHERE source = 'ft_tearsheet' GROUP BY 1), lt AS (SELECT k, arg_max(source, (d, o_orderkey)) AS source FROM o GROUP BY 1),
    g AS (SELECT isin, coalesce(issuer, 'Unknown') AS issuer, coalesce(ft.flag, 'not_attempted') AS ft_status, 'S' || ft.n AS ft_symbol, lt.source AS latest_metadata_source, list_filter([CASE WHEN fee IS NULL THEN 'ongoing_charges' END, CASE WHEN bench IS NULL THEN 'benchmark_name' END, CASE WHEN trim(coalesce(policy, '')) = '' THEN 'distribution_policy' END, CASE WHEN aum IS NULL THEN 'fund_size' END, 'domicile_country', CASE WHEN region IS NULL THEN 'region' END, CASE WHEN repl IS NULL THEN 'replication_method' END,
    CASE WHEN cls = 'equity' AND sz IS NULL THEN 'equity_size' END, CASE WHEN cls = 'equity' AND sty IS NULL THEN 'equity_style' END, CASE WHEN cls = 'equity' AND sector IS NULL THEN 'sector' END], lambda x: x IS NOT NULL) AS m FROM f LEFT JOIN i USING (issuer_id) LEFT JOIN ft USING (k) LEFT JOIN lt USING (k) WHERE mvp = 1)"""


@query(f"WITH {GAPS} SELECT isin, issuer, ft_status, ft_symbol, latest_metadata_source, array_to_string(m, ',') AS missing_fields, len(m)::BIGINT AS n_missing FROM g WHERE len(m) > 0")
def fund_gaps(spark, sf_dir):
    """What each fund lacks, with the status of its tearsheet and its latest source."""
    return K.gap_report(spark, catalog(spark, sf_dir)).select("isin", "issuer", "ft_status", "ft_symbol", "latest_metadata_source", "missing_fields", "n_missing")


@query(f"WITH {GAPS}, u AS (SELECT 'missing_field' AS facet, unnest(m) AS value FROM g UNION ALL SELECT 'ft_status', ft_status FROM g UNION ALL SELECT 'latest_source', coalesce(latest_metadata_source, 'none') FROM g UNION ALL SELECT 'issuer', issuer FROM g) SELECT facet, value, count(*) AS n FROM u GROUP BY 1, 2")
def gap_histograms(spark, sf_dir):
    """Missing fields, statuses, sources and issuers of the gap report, in one pass."""
    return K.gap_histograms(K.gap_report(spark, catalog(spark, sf_dir)))


@query(f"WITH {FUNDS} SELECT isin, 'commodity' AS asset_class, 'gold' AS commodity_type FROM f WHERE mvp = 0 AND regexp_matches(name, 'gold|bullion') AND lev = 0")
def gold_exceptions(spark, sf_dir):
    """Gold outside the universe, classified by name."""
    return K.gold_exceptions(spark, catalog(spark, sf_dir)).select("isin", "asset_class", "commodity_type")


BUNDLE = f"{FUNDS}, {COSTS}, e AS (SELECT * FROM f WHERE mvp = 1 OR (regexp_matches(name, 'gold|bullion') AND lev = 0))"


@query(f"WITH {BUNDLE} SELECT 'instrument' AS table_name, count(*) AS n FROM e UNION ALL SELECT 'listing', count(*) + sum((k % 4 = 0)::INT)::BIGINT FROM e UNION ALL SELECT 'product_profile', count(*) FROM e UNION ALL SELECT 'instrument_taxonomy', count(*) FROM e UNION ALL SELECT 'cost_snapshot', count(*) FROM e JOIN c USING (k) UNION ALL SELECT 'issuer', count(DISTINCT issuer_id) FROM e")
def bundle_counts(spark, sf_dir):
    """The tables of an export bundle, counted in one job."""
    return V.bundle_counts(K.export_bundle(spark, catalog(spark, sf_dir)))


@query(f"WITH {BUNDLE} SELECT isin, 'a' AS only_in FROM f WHERE isin NOT IN (SELECT isin FROM e)")
def export_parity(spark, sf_dir):
    """What the catalogue has and its bundle lacks: the funds outside the universe."""
    source = catalog(spark, sf_dir)
    return V.parity(source["instrument"].select("isin"), K.export_bundle(spark, source)["instrument"].select("isin"))


LABEL = lambda c: f"coalesce(upper({c}[1]) || {c}[2:], 'Unknown')"


@query(
    f"""WITH {VIEW} SELECT isin, {LABEL("cls")} AS asset_type, coalesce(issuer, 'Unknown') AS issuer, CASE WHEN aum IS NULL THEN 'Unknown' ELSE 'USD ' || regexp_replace(printf('%.2f', aum / 1e6), '\\.?0+$', '') || 'm' END AS fund_size, CASE WHEN policy = 'Accumulating' THEN policy ELSE 'Unknown' END AS distribution, coalesce(printf('%.2f%%', charge), 'Unknown') AS ter,
    CASE region WHEN 'us' THEN 'United States' WHEN 'em' THEN 'Emerging markets' ELSE {LABEL("region")} END AS region, CASE WHEN cls <> 'equity' THEN 'Unknown' WHEN sz = 'all_cap' THEN 'All cap' ELSE {LABEL("sz")} END AS size, CASE WHEN cls <> 'bond' THEN 'N.A.' ELSE CASE btype WHEN 'govt' THEN 'Government' WHEN 'corp' THEN 'Corporate' WHEN 'linkers' THEN 'Inflation-linked' ELSE 'Aggregate' END END AS bond_type FROM v WHERE mvp = 1"""
)
def explorer_table(spark, sf_dir):
    """The fund view as labels."""
    return K.explorer(K.fund_view(spark, catalog(spark, sf_dir))).select("isin", "asset_type", "issuer", "fund_size", "distribution", "ter", "region", "size", "bond_type")


# --------------------------------------------------------------------------- state


@query(
    """WITH o AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS flag, CASE WHEN p_size % 4 > 0 THEN p_size::BIGINT END AS house, CASE WHEN p_size % 5 = 0 THEN 'inactive' ELSE 'active' END AS status FROM part WHERE p_partkey % 3 > 0),
    w AS (SELECT l_partkey AS k, arg_min(l_shipdate::DATE::VARCHAR, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS name, max((l_returnflag = 'R')::INT) AS flag, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS house FROM lineitem GROUP BY 1),
    j AS (SELECT k, o.k AS ok, o.name AS a1, o.flag AS a2, o.house AS a3, o.status, coalesce(o.name, w.name) AS name, greatest(o.flag, w.flag) AS flag, coalesce(o.house, w.house) AS house FROM o FULL JOIN w USING (k)),
    e AS (SELECT *, CASE WHEN ok IS NULL THEN 'inserted' WHEN (name IS DISTINCT FROM a1 OR flag IS DISTINCT FROM a2 OR house IS DISTINCT FROM a3) THEN CASE WHEN status = 'active' THEN 'updated' ELSE 'reactivated' END END AS event FROM j)
    SELECT k::VARCHAR AS isin, name AS instrument_name, flag AS ucits_flag, house AS issuer_id, CASE WHEN event IS NOT NULL THEN 'active' ELSE status END AS status, event FROM e"""
)
def instrument_upsert(spark, sf_dir):
    """Instruments merged with a feed: names and issuers stay, a flag only rises, changes reactivate."""
    s = F.col("p_size")
    old = t(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("string").alias("isin"), F.when(s % 2 == 0, F.col("p_name")).alias("instrument_name"), F.when(s % 3 == 0, 0).when(s % 3 == 1, 1).alias("ucits_flag"), F.when(s % 4 > 0, s.cast("long")).alias("issuer_id"), F.when(s % 5 == 0, "inactive").otherwise("active").alias("status"))
    feed = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("isin"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("instrument_name"), (F.col("l_returnflag") == "R").cast("int").alias("ucits_flag"), F.col("l_suppkey").alias("issuer_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("pos"))
    return M.merge_instruments(old, feed, "pos")


@query(
    """WITH o AS (SELECT p_partkey AS k, 'V' || p_size % 3 AS v, 'T' || p_size % 7 AS tk, CASE WHEN p_size % 4 = 0 THEN 'Hall' END AS e, CASE WHEN p_size % 2 = 0 THEN 'USD' END AS c, (p_size % 6 = 0)::INT AS p, CASE WHEN p_size % 5 = 0 THEN 'inactive' ELSE 'active' END AS st FROM part WHERE p_partkey % 2 = 0),
    w AS (SELECT p_partkey AS k, 'V' || p_size % 3 AS v, 'T' || p_size % 7 AS tk, CASE WHEN p_size % 3 = 0 THEN 'Floor' END AS e, CASE WHEN p_size % 3 > 0 THEN 'EUR' END AS c, (p_size % 9 = 0)::INT AS p FROM part WHERE p_partkey % 3 > 0)
    SELECT k AS instrument_id, v AS venue_mic, tk AS ticker, coalesce(w.e, o.e) AS exchange_name, coalesce(w.c, o.c) AS trading_currency, CASE WHEN w.k IS NULL THEN o.p WHEN o.p = 1 OR w.p = 1 THEN 1 ELSE 0 END AS primary_flag, CASE WHEN w.k IS NULL THEN o.st ELSE 'active' END AS status, CASE WHEN w.k IS NULL THEN 'old' ELSE 'new' END AS data_source, CASE WHEN w.k IS NULL THEN '2026-01-01' ELSE '2026-02-01' END AS asof_date,
    CASE WHEN w.k IS NULL THEN NULL WHEN o.k IS NULL THEN 'inserted' WHEN o.st <> 'active' THEN 'reactivated' ELSE 'updated' END AS event FROM o FULL JOIN w USING (k, v, tk)"""
)
def listing_upsert(spark, sf_dir):
    """Listings merged with a feed: new values win, primary is never lost, observed rows are active."""
    s = F.col("p_size")
    keys = (F.col("p_partkey").alias("instrument_id"), F.concat(F.lit("V"), (s % 3).cast("string")).alias("venue_mic"), F.concat(F.lit("T"), (s % 7).cast("string")).alias("ticker"))
    rows = t(spark, sf_dir, "part")
    old = rows.where("p_partkey % 2 = 0").select(*keys, F.when(s % 4 == 0, "Hall").alias("exchange_name"), F.when(s % 2 == 0, "USD").alias("trading_currency"), (s % 6 == 0).cast("int").alias("primary_flag"), F.when(s % 5 == 0, "inactive").otherwise("active").alias("status"), F.lit("old").alias("data_source"), F.lit("2026-01-01").alias("asof_date"))
    feed = rows.where("p_partkey % 3 > 0").select(*keys, F.when(s % 3 == 0, "Floor").alias("exchange_name"), F.when(s % 3 > 0, "EUR").alias("trading_currency"), (s % 9 == 0).cast("int").alias("primary_flag"), F.lit(1).alias("pos"))
    return M.merge_listings(old, feed, "new", "2026-02-01", "pos")


@query(
    """WITH i AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Supplier#' || lpad(n_nationkey::VARCHAR, 9, '0') END AS norm, CASE WHEN n_nationkey % 4 = 0 THEN 'kept.com' END AS dom FROM nation),
    w AS (SELECT s_name AS name, min('n' || s_nationkey || '.com') AS dom FROM supplier GROUP BY 1), j AS (SELECT w.*, coalesce((SELECT min(id) FROM i WHERE norm = w.name), (SELECT min(id) FROM i WHERE i.name = w.name)) AS id FROM w)
    SELECT i.id::BIGINT AS issuer_id, i.name AS issuer_name, norm AS normalized_name, coalesce(i.dom, x.dom) AS domain FROM i LEFT JOIN (SELECT id, min(dom) AS dom FROM j GROUP BY 1) x USING (id) UNION ALL SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY name), name, name, dom FROM j WHERE id IS NULL"""
)
def issuer_upsert(spark, sf_dir):
    """Issuers looked up by normalised name, then by name, else added with the next ids; domains are filled once."""
    k = F.col("n_nationkey")
    old = t(spark, sf_dir, "nation").select(k.cast("long").alias("issuer_id"), F.col("n_name").alias("issuer_name"), F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).alias("normalized_name"), F.when(k % 4 == 0, "kept.com").alias("domain"))
    names = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".com")).alias("domain"))
    return M.merge_issuers(old, names)


@query("SELECT n_nationkey::BIGINT AS issuer_id, n_name AS issuer_name, coalesce(tgt, n_nationkey)::BIGINT AS target_id, 'NATION_' || coalesce(tgt, n_nationkey) AS canonical_name FROM nation LEFT JOIN (SELECT 'NATION_' || (c_nationkey::INT) AS alias, min(c_custkey % 25) AS tgt FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 GROUP BY 1) ON alias = n_name")
def issuer_aliases(spark, sf_dir):
    """Issuers through a table of aliases to their canonical ones."""
    issuer = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("issuer_id"), F.col("n_name").alias("issuer_name"), F.lit(None).cast("string").alias("normalized_name"), F.lit(None).cast("string").alias("domain"))
    alias = t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' and c_acctbal > 9000").select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("alias"), (F.col("c_custkey") % 25).alias("issuer_id"))
    return M.apply_aliases(issuer, alias).select("issuer_id", "issuer_name", "target_id", "canonical_name")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'new ' || p_type ELSE p_type END AS asset_class, CASE WHEN p_size > 20 THEN NULL ELSE p_brand END AS sector FROM part WHERE p_partkey % 3 > 0 OR p_size > 20")
def taxonomy_merge(spark, sf_dir):
    """New rows replace old ones whole, NULLs included; rows that left the universe stay."""
    rows = t(spark, sf_dir, "part")
    old = rows.where("p_partkey % 3 > 0").select("p_partkey", F.col("p_type").alias("asset_class"), F.col("p_brand").alias("sector"))
    new = rows.where("p_size > 20").select("p_partkey", F.concat(F.lit("new "), "p_type").alias("asset_class"), F.lit(None).cast("string").alias("sector"))
    return M.merge_taxonomy(old, new, "p_partkey")


@query("SELECT coalesce(o.isin, w.isin) AS isin, coalesce(o.name, w.name) AS instrument_name, coalesce(o.flag, w.flag) AS ucits_flag, coalesce(o.house, w.house) AS issuer_id, coalesce(o.st, w.st) AS status FROM (SELECT p_partkey::VARCHAR AS isin, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 0 END AS flag, CASE WHEN p_size % 5 > 0 THEN p_size::BIGINT END AS house, 'inactive' AS st FROM part WHERE p_partkey % 2 = 0) o FULL JOIN (SELECT p_partkey::VARCHAR AS isin, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS name, 1 AS flag, 7::BIGINT AS house, 'active' AS st FROM part WHERE p_partkey % 3 > 0) w ON o.isin = w.isin")
def instrument_seed(spark, sf_dir):
    """Seeds fill gaps only; a new name is read off the page's url."""
    s, rows = F.col("p_size"), t(spark, sf_dir, "part")
    old = rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("isin"), F.when(s % 2 == 0, F.col("p_name")).alias("instrument_name"), F.when(s % 3 == 0, 0).alias("ucits_flag"), F.when(s % 5 > 0, s.cast("long")).alias("issuer_id"), F.lit("inactive").alias("status"))
    seeds = rows.where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("string").alias("isin"), F.concat(F.lit("https://h.example/funds/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/ucitsetf/")).alias("url"), F.lit(7).cast("long").alias("issuer_id"))
    return M.seed_instruments(old, seeds)


@query(f"WITH {FUNDS}, w AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'CHF' END AS c FROM part) SELECT k AS instrument_id, coalesce(cur, c) AS trading_currency, cur IS NULL AND c IS NOT NULL AS filled FROM f JOIN w USING (k)")
def currency_fill(spark, sf_dir):
    """Blank primary currencies from a second feed."""
    listing = catalog(spark, sf_dir)["listing"].where("primary_flag = 1")
    feed = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("instrument_id"), F.when(F.col("p_size") % 2 == 0, " chf ").alias("trading_currency"))
    return M.fill_currency(listing, feed, ["instrument_id"]).select("instrument_id", "trading_currency", "filled")


@query(f"WITH {FUNDS} SELECT k AS instrument_id, CASE WHEN contains(name, 'red') THEN 'Red House' ELSE 'Gold House' END AS issuer_name, 'name_heuristic' AS issuer_source FROM f WHERE issuer_id IS NULL AND (contains(name, 'red') OR contains(name, 'gold'))")
def issuer_backfill(spark, sf_dir):
    """Issuers for funds without one, by words of their names."""
    return M.backfill_issuers(catalog(spark, sf_dir)["instrument"], [("Red House", "RED"), ("Gold House", "GOLD")]).select("instrument_id", "issuer_name", "issuer_source")


@query(f"WITH {FUNDS}, x AS (SELECT kind, lev, 'ETF' AS nt, 0 AS nl, 0 AS ni FROM f) SELECT count(*) AS total, sum((kind IS DISTINCT FROM nt)::INT)::BIGINT AS changed_instrument_type, sum((lev IS DISTINCT FROM nl)::INT)::BIGINT AS changed_leverage_flag, 0::BIGINT AS changed_inverse_flag FROM x")
def refresh_types(spark, sf_dir):
    """How many rows a new classification by name changes, field by field."""
    return M.refresh_types(catalog(spark, sf_dir)["instrument"])[1]


@query("SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status FROM orders")
def run_states(spark, sf_dir):
    """The last state of each run of an append-only log."""
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), F.lit(2).alias("n"))
    return M.run_states(rows.unionByName(rows.withColumns({"status": F.lit("running"), "n": F.lit(1)})), "run", "n").select("run", "status")


# --------------------------------------------------------------------------- queues, documents, reports


@query(f"WITH {VIEW} SELECT isin FROM v WHERE contains(upper(coalesce(issuer, '')), 'HOUSE 1') OR contains(upper(name), 'HOUSE 1') OR contains(upper(coalesce(issuer, '')), 'GOLD') OR contains(upper(name), 'GOLD')")
def issuer_filter(spark, sf_dir):
    """Funds with a term in their issuer or name."""
    rows = K.fund_view(spark, catalog(spark, sf_dir), False).withColumnRenamed("issuer", "issuer_name")
    return V.filter_issuers(rows, [" house  1, gold", "Gold"], ("issuer_name", "instrument_name")).select("isin")


@query(f"WITH {VIEW} SELECT isin, cost FROM v WHERE mvp = 1 AND kind = 'ETF' AND (cost IS NULL OR cost <= 0.02) AND issuer IN ('House 2', 'House 4', 'NATION_3')")
def fee_targets(spark, sf_dir):
    """Funds of some houses whose current fee is missing or suspiciously small."""
    rows = K.fund_view(spark, catalog(spark, sf_dir))
    return V.fee_targets(rows, "current_cost", ["house 2", "House 4", "nation_3"], "issuer", 0.02).select("isin", F.col("current_cost").alias("cost"))


@query(f"WITH {FUNDS} SELECT isin FROM f WHERE mvp = 1 AND (bench IS NULL OR trim(coalesce(policy, '')) = '' OR aum IS NULL)")
def needs_enrichment(spark, sf_dir):
    """Universe funds that lack one of some fields; blanks are missing."""
    rows = funds(spark, sf_dir).where("universe_mvp_flag = 1")
    return rows.where(V.needs_enrichment(rows, ["benchmark_name", "distribution_policy", "fund_size_value"])).select("isin")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1) WHERE v IN ('1-URGENT', '2-HIGH'))")
def pending_rows(spark, sf_dir):
    """Rows whose newest log row has none of the accepted values."""
    log = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p_partkey"), "o_orderkey", "o_orderpriority")
    return V.pending(t(spark, sf_dir, "part").select("p_partkey"), log, "p_partkey", "o_orderkey", F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'O')::INT, strftime(o_orderdate, '%Y%m%d')::BIGINT DESC, (o_orderpriority <> '1-URGENT')::INT, lpad(o_orderkey::VARCHAR, 12, '0')) AS rn FROM orders) WHERE rn = 1")
def best_document(spark, sf_dir):
    """Of each product's documents the English one, the newest, the one with the mark, by name."""
    docs = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", " English ").otherwise("French").alias("language"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("recorded"), F.when(F.col("o_orderpriority") == "1-URGENT", "/x/ETF/y").otherwise("/x/y").alias("alias"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"))
    return L.best_document(docs, "o_custkey", "language", "recorded", "alias", "name").select("o_custkey", "o_orderkey")


@query("WITH b AS (SELECT l_suppkey, l_partkey % 40 AS url, max(l_linenumber) AS score, arg_min(l_shipmode, (-l_linenumber, l_shipmode)) AS label FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, label, url) AS rank FROM b) WHERE rank <= 10")
def candidate_ranking(spark, sf_dir):
    """Each url once with its best score, the ten best of each key."""
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40).alias("url"), F.col("l_linenumber").alias("score"), F.concat("l_returnflag", "l_linestatus").alias("label"))
    return L.rank_candidates(rows, "l_suppkey", "url", "score", "label")


@query("SELECT l_partkey, q AS l_quantity FROM (SELECT l_partkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS q FROM lineitem GROUP BY 1) WHERE q < 5 OR q > 45")
def fee_outliers(spark, sf_dir):
    """Keys whose newest value is out of range."""
    return L.fee_outliers(t(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], 5, 45)


@query(f"WITH {FUNDS} SELECT k AS instrument_id, CASE WHEN cur IS NULL THEN 'A' || k ELSE 'T' || k END AS ticker FROM f WHERE cur IS NOT NULL OR k % 4 = 0")
def listed_by_venue(spark, sf_dir):
    """One active listing a fund that has a ticker and a currency."""
    return L.listed_by_venue(catalog(spark, sf_dir)["listing"], "instrument_id", S.VENUES).select("instrument_id", "ticker")


@query(f"WITH {FUNDS} SELECT 'instruments' AS measure, NULL AS value, count(*) AS n FROM f UNION ALL SELECT 'venue', venue, count(*) FROM f GROUP BY venue UNION ALL SELECT 'venue', 'XPAR', count(*) FROM f WHERE k % 4 = 0 UNION ALL SELECT 'multi_listed', NULL, count(*) FROM f WHERE k % 4 = 0 UNION ALL SELECT 'repeated_isins', NULL, 0 UNION ALL SELECT 'repeated_listings', NULL, 0")
def ingest_sanity(spark, sf_dir):
    """Totals, venues, several listings and repeated keys after an ingest."""
    c = catalog(spark, sf_dir)
    return C.ingest_sanity(c["instrument"], c["listing"])


@query(
    f"""WITH {FUNDS}, m AS (SELECT venue, arg_min(cur, (-n, cur)) AS mode FROM (SELECT venue, cur, count(*) AS n FROM f WHERE cur IS NOT NULL GROUP BY 1, 2) GROUP BY 1), x AS (SELECT f.*, coalesce(cur, mode) AS after FROM f LEFT JOIN m USING (venue))
    SELECT 'before_null' AS measure, NULL AS value, sum((cur IS NULL)::INT)::BIGINT AS n FROM x UNION ALL SELECT 'after_null', NULL, sum((after IS NULL)::INT)::BIGINT FROM x UNION ALL SELECT 'imputed', NULL, sum((cur IS NULL AND after IS NOT NULL)::INT)::BIGINT FROM x UNION ALL SELECT 'venue_currency', venue || ' | ' || coalesce(after, 'NULL'), count(*) FROM x GROUP BY 2 UNION ALL SELECT 'issuer', coalesce(issuer_id::VARCHAR, 'NULL'), count(*) FROM x GROUP BY 2"""
)
def refine_report(spark, sf_dir):
    """Currencies before and after imputation by venue, with counts by venue, currency and issuer."""
    rows = funds(spark, sf_dir).select("instrument_id", "primary_venue", "currency", F.col("issuer_id").cast("string").alias("issuer"))
    after = M.impute(rows, "currency", L.mode_by(rows, ["primary_venue"], "currency", F.lit(0), "mode"), ["primary_venue"], "mode", "quality")
    return C.refine_report(rows, after, "instrument_id", "currency", "primary_venue", "issuer", "quality")


@query("SELECT user_id, min(value) FILTER (WHERE event_id = f) AS value, min('s' || rk) FILTER (WHERE event_id = f) AS source, count(*) AS attempts, CASE WHEN max(f) IS NOT NULL THEN 'ok' WHEN bool_or(event_type = 'error') THEN 'parse_fail' WHEN bool_or(event_type <> 'click') THEN 'download_fail' ELSE 'no_source' END AS outcome, string_agg('s' || rk || ':' || CASE WHEN ok THEN 'ok' WHEN event_type = 'click' THEN 'no_source' WHEN event_type = 'error' THEN 'parse_fail' ELSE 'download_fail' END, ',' ORDER BY event_id) AS log FROM (SELECT *, event_type = 'purchase' AND value > 12 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk, min(event_id) FILTER (WHERE event_type = 'purchase' AND value > 12) OVER (PARTITION BY user_id) AS f FROM events) WHERE f IS NULL OR event_id <= f GROUP BY 1")
def attempt_log(spark, sf_dir):
    """A chain of sources until the first success, with the log of what was tried."""
    from pyspark.sql import Window

    kind, ok = F.col("event_type"), (F.col("event_type") == "purchase") & (F.col("value") > 12)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tries = t(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("s"), n.cast("string")).alias("source"), F.when(ok, F.col("value")).alias("value"), F.when(kind != "click", "u").alias("url"), (ok | (kind == "error")).alias("fetched"))
    return X.attempt_log(tries, "user_id", "event_id", "value", "source", "url", "fetched")


SHEET = """s AS (SELECT p_partkey AS k, p_size, CASE WHEN p_size % 9 > 0 THEN 'https://h.example/' || p_partkey END AS url, CASE WHEN p_size % 8 > 0 THEN 'x Ongoing charge 1 ' || printf('%.2f', p_size / 10.0) || ' % Index ' || p_brand || ' Index currency USD Replication method ' || CASE WHEN p_size % 2 = 0 THEN 'Physical' ELSE 'Synthetic' END || ' Domicile Ireland Dividend treatment ' || CASE WHEN p_size % 3 = 0 THEN 'Accumulating' ELSE 'Distributing' END || ' Currency hedged ' || CASE WHEN p_size % 5 = 0 THEN 'Yes' ELSE 'No' END || ' UCITS compliant Yes' ELSE CASE WHEN p_size % 3 = 0 THEN 'nothing here' END END AS txt FROM part)"""


def sheets(spark, sf_dir) -> DataFrame:
    """Factsheet texts of the parts that have one."""
    s = F.col("p_size")
    text = F.concat(F.lit("x Ongoing  charge 1 ").substr(1, 2), F.lit("Ongoing charge 1 "), F.format_string("%.2f", s / 10.0), F.lit(" %\n Index "), "p_brand", F.lit(" Index currency USD Replication method "), F.when(s % 2 == 0, "Physical").otherwise("Synthetic"), F.lit(" Domicile Ireland Dividend treatment "), F.when(s % 3 == 0, "Accumulating").otherwise("Distributing"), F.lit(" Currency hedged "), F.when(s % 5 == 0, "Yes").otherwise("No"), F.lit(" UCITS compliant Yes"))
    return t(spark, sf_dir, "part").where("p_size % 9 > 0").select("p_partkey", F.concat(F.lit("https://h.example/"), F.col("p_partkey").cast("string")).alias("url"), F.when(s % 8 > 0, text).when(s % 3 == 0, "nothing here").alias("text"))


@query(f"WITH {SHEET} SELECT k AS p_partkey, CASE WHEN p_size % 8 > 0 THEN p_size / 10.0 END::DOUBLE AS ongoing_charges, CASE WHEN p_size % 8 > 0 THEN 'Brand#' || split_part(split_part(txt, 'Brand#', 2), ' ', 1) END AS benchmark_name, CASE WHEN p_size % 8 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 'physical' ELSE 'synthetic' END END AS replication_method, CASE WHEN p_size % 8 > 0 THEN CASE WHEN p_size % 3 = 0 THEN 'Accumulating' ELSE 'Distributing' END END AS distribution_policy, CASE WHEN p_size % 8 > 0 THEN (p_size % 5 = 0)::INT END AS hedged_flag FROM s WHERE url IS NOT NULL")
def factsheet_fields(spark, sf_dir):
    """Labelled fields of factsheet texts."""
    return X.factsheet_fields(sheets(spark, sf_dir), ["p_partkey"], "text").select("p_partkey", "ongoing_charges", "benchmark_name", "replication_method", "distribution_policy", "hedged_flag")


@query(f"WITH {SHEET}, x AS (SELECT CASE WHEN url IS NULL THEN 'no_source' WHEN txt IS NULL THEN 'download_fail' WHEN p_size % 8 = 0 THEN 'parse_fail' WHEN p_size > 30 THEN 'outlier' ELSE 'ok' END AS st FROM s) SELECT 'sheet' AS source, count(*) AS attempted, sum((st = 'ok')::INT)::BIGINT AS n_ok, sum((st = 'outlier')::INT)::BIGINT AS n_outlier, sum((st = 'parse_fail')::INT)::BIGINT AS n_parse_fail, sum((st = 'download_fail')::INT)::BIGINT AS n_download_fail, sum((st = 'no_source')::INT)::BIGINT AS n_no_source FROM x")
def enrichment_kpis(spark, sf_dir):
    """The KPIs of a whole enrichment stage: queue, pages, facts, quality."""
    return X.enrich_stage(t(spark, sf_dir, "part").select("p_partkey"), sheets(spark, sf_dir), "p_partkey", "url", "text", "sheet", "2026-01-01")["kpi"]


@query(f"WITH {SHEET} SELECT k AS p_partkey, '2026-01-01' AS asof_date, CASE WHEN p_size % 8 > 0 THEN p_size / 10.0 END::DOUBLE AS ongoing_charges, CASE WHEN p_size % 8 = 0 THEN 'parse_fail' WHEN p_size > 30 THEN 'outlier' ELSE 'ok' END AS quality_flag FROM s WHERE url IS NOT NULL AND txt IS NOT NULL")
def enrichment_costs(spark, sf_dir):
    """The cost rows that an enrichment stage appends."""
    return X.enrich_stage(t(spark, sf_dir, "part").select("p_partkey"), sheets(spark, sf_dir), "p_partkey", "url", "text", "sheet", "2026-01-01")["cost"].drop("raw_json")


@query(
    """WITH a AS (SELECT p_partkey AS target, p_name || ' ' || lower(p_type) AS fam, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS page, p_name || ' ' || lower(p_type) AS fam, p_size, CASE WHEN p_size % 4 > 0 THEN p_brand END AS bench, p_size / 10.0 AS ter FROM part WHERE p_partkey % 2 = 1), e AS (SELECT p_size AS id, min(page) AS page FROM b WHERE p_size < 20 GROUP BY 1), m AS (SELECT fam, min(page) AS page FROM b WHERE bench IS NOT NULL GROUP BY 1)
    SELECT target, coalesce(e.page, m.page) AS page, CASE WHEN e.page IS NOT NULL THEN 'isin' ELSE 'family' END AS match, b.bench AS benchmark_name, CASE WHEN e.page IS NOT NULL THEN b.ter END::DOUBLE AS ter FROM a LEFT JOIN e ON a.p_size = e.id LEFT JOIN m USING (fam) JOIN b ON b.page = coalesce(e.page, m.page)"""
)
def identity_resolution(spark, sf_dir):
    """Exact ids first, else the family of names with useful facts, which drops the facts of the share class."""
    s = F.col("p_size")
    rows = t(spark, sf_dir, "part").select("p_partkey", F.when((F.col("p_partkey") % 2 == 0) | (s < 20), s.cast("string")).alias("isin"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "UCITS ETF (Acc)").otherwise("DIST 2")).alias("name"), F.when(s % 4 > 0, F.col("p_brand")).alias("benchmark_name"), (s / 10.0).alias("ter"))
    targets = rows.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "target")
    pages = rows.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "page")
    return X.resolve_identity(targets, pages, "target", "page", "isin", "name", ["benchmark_name", "ter"], ["benchmark_name"])


@query("SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS label, CASE WHEN p_type IN ('LARGE') THEN 'large' WHEN p_type = 'SMALL' THEN 'small' WHEN p_type = 'MEDIUM' THEN 'mid' ELSE lower(p_type) END AS size, CASE WHEN contains(p_name, 'red') THEN 'financials' ELSE replace(p_name, ' ', '_') END AS sector FROM part")
def value_maps(spark, sf_dir):
    """Size and sector words of sources as the catalogue's values."""
    from ..functions import text as T

    name = F.when(F.col("p_name").contains("red"), " Financial  Services").otherwise(F.col("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99)).alias("label"), T.norm_equity_size(F.col("p_type")).alias("size"), T.norm_sector(name).alias("sector"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Technology' ELSE 'Health Care' END AS label, CASE p_size % 4 WHEN 0 THEN 'energy' WHEN 1 THEN 'technology' ELSE 'health_care' END AS sector_hint, (CASE WHEN p_size % 4 = 0 THEN 60.5 ELSE 70.0 END)::DOUBLE AS sector_weight, 2 AS n FROM part")
def sector_table(spark, sf_dir):
    """Sector weights of an HTML table and the dominant sector."""
    s = F.col("p_size")
    top = F.when(s % 4 == 0, "Energy").when(s % 4 == 1, "Technology").otherwise(" Health  Care")
    html = F.concat(F.lit("<table><tr><th>Sector</th></tr><tr><td>Other</td><td>99%</td></tr><tr><td>Utilities</td><td>20,25 %</td></tr><tr><td>"), top, F.lit("</td><td>"), F.when(s % 4 == 0, "60.5%").otherwise("70%"), F.lit("</td></tr></table>"))
    rows = X.sector_weights(t(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    both = rows.groupBy("p_partkey").agg(F.max_by("label", "weight").alias("label"), F.count(F.lit(1)).cast("int").alias("n"))
    return X.dominant_sector(rows, "p_partkey").join(both, "p_partkey").select("p_partkey", "label", "sector_hint", "sector_weight", "n")


@query("SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END), max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)) AS k, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'map' WHEN bool_or(o_orderstatus = 'F') THEN 'document' ELSE 'candidate' END AS url_source FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def known_url(spark, sf_dir):
    """The mapped url, else the newest document's, else the newest candidate's, of given hosts."""
    host = F.when(F.col("o_totalprice") > 100000, "https://www.a.example/").otherwise("https://b.example/")
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(host, F.col("o_orderkey").cast("string")).alias("url"), "o_orderstatus")
    of = lambda s: rows.where(F.col("o_orderstatus") == s)
    out = X.known_url("o_custkey", of("P"), of("F"), of("O"), "url", "o_orderkey", ["a.example"])
    return out.select("o_custkey", F.split_part("url", F.lit("/"), F.lit(4)).cast("long").alias("k"), "url_source")
