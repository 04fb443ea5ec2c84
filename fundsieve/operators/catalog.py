"""Jobs over the catalogue tables: the fund view and its queries, profile and universe refresh, reports, exports.

A catalogue is a mapping of table names to DataFrames; tables and columns that are missing are read as empty or NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import TABLES
from ..sources.feeds import write_counted
from . import coverage as C
from . import latest as L
from . import screen as S
from . import serve as V
from . import state as M
from .ranks import durable

Catalog = Mapping[str, DataFrame]

#: The equality facets of the fund list, and what stands for unknown.
FACETS = {"asset_class": "unknown", "geography_region": "unknown", "geography_country": None, "equity_size": None, "equity_style": None, "factor": None, "sector": None, "theme": None, "bond_type": None, "duration_bucket": None, "commodity_type": None, "distribution_policy": "Unknown", "domicile_country": None, "replication_method": None, "primary_venue": None, "currency": None, "issuer": None, "instrument_type": None}
PROFILE = ("distribution_policy", "ongoing_charges", "benchmark_name", "asset_class_hint", "domicile_country", "fund_size_value", "fund_size_currency", "fund_size_asof", "fund_size_scope", "replication_method", "hedged_flag", "hedged_target", "equity_size_hint", "equity_style_hint", "sector_hint")


def table(spark: SparkSession, catalog: Catalog, name: str) -> DataFrame:
    """A table with all its columns; missing ones are NULL, a missing table is empty."""
    schema = T.StructType.fromDDL(TABLES[name])
    df = catalog.get(name)
    if df is None:
        return spark.createDataFrame([], schema)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def active_primary(listing: DataFrame) -> DataFrame:
    """A NULL status counts as active, a NULL flag as no."""
    return listing.where((F.coalesce("primary_flag", F.lit(0)) == 1) & (F.coalesce("status", F.lit("active")) == "active"))


def current_costs(cost: DataFrame, flags: Sequence[str] = L.ACCEPTED_FLAGS) -> DataFrame:
    return L.latest_accepted(cost, "instrument_id", "ongoing_charges", "quality_flag", flags, ["asof_date", "cost_id"])


def fund_view(spark: SparkSession, catalog: Catalog, universe_only: bool = True) -> DataFrame:
    """One row a fund with an active primary: the star of issuer, profile, taxonomy and current cost."""
    t = lambda n: table(spark, catalog, n)
    inst = t("instrument").where("universe_mvp_flag = 1") if universe_only else t("instrument")
    primary = active_primary(t("listing")).select("instrument_id", F.col("venue_mic").alias("primary_venue"), "ticker", F.col("trading_currency").alias("currency"))
    issuer = t("issuer").select("issuer_id", F.coalesce("normalized_name", "issuer_name").alias("issuer"))
    profile = t("product_profile").select("instrument_id", *[F.col(c).alias(f"p_{c}") for c in PROFILE])
    cost = current_costs(t("cost_snapshot")).select("instrument_id", F.col("ongoing_charges").alias("current_cost"))
    tax = t("instrument_taxonomy").withColumnsRenamed({c: f"t_{c}" for c in ("hedged_flag", "hedged_target", "domicile_country", "distribution_policy")})
    out = inst.join(primary, "instrument_id").join(issuer, "issuer_id", "left").join(profile, "instrument_id", "left").join(tax, "instrument_id", "left").join(cost, "instrument_id", "left")
    out = out.withColumns({"ongoing_charges": F.coalesce("p_ongoing_charges", "current_cost"), "distribution_policy": F.coalesce("p_distribution_policy", "t_distribution_policy"), "domicile_country": F.coalesce("p_domicile_country", "t_domicile_country"), "hedged": X.resolve_hedge(F.col("p_hedged_flag"), F.col("t_hedged_flag"))})
    return out.withColumnsRenamed({"p_benchmark_name": "benchmark_name", "p_replication_method": "replication_method"})


def facet_columns() -> dict[str, Column]:
    return {k: F.col(k) if d is None else F.coalesce(F.col(k), F.lit(d)) for k, d in FACETS.items()}


def list_funds(spark: SparkSession, catalog: Catalog, params: Mapping[str, str] | None = None, q: str | None = None, hedged: str | None = None, gold: str | None = None, fee_min: float | None = None, fee_max: float | None = None, sort: str = "isin", direction: str = "asc", limit: int | None = None, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of the fund list and the total of all that fit; unknown parameters raise."""
    rows = fund_view(spark, catalog)
    tests = V.facet_tests(facet_columns(), params or {}) + V.range_tests(F.col("ongoing_charges"), fee_min, fee_max) + V.hedge_test(F.col("p_hedged_flag"), F.col("t_hedged_flag"), V.tri_state(hedged))
    if (want := V.tri_state(gold)) is not None:
        tests.append(F.coalesce("gold_flag", F.lit(0)) == int(want))
    if q and q.strip():
        alias = V.ids_by_alias(table(spark, catalog, "listing"), "instrument_id", "ticker", q).withColumn("_alias", F.lit(True))
        rows = rows.join(alias, "instrument_id", "left")
        tests.append(V.any_of([*V.search_test([F.col(c) for c in ("isin", "instrument_name", "issuer", "benchmark_name")], q), F.coalesce("_alias", F.lit(False))]))
    found = rows.where(V.everything(tests))
    known = {"isin": F.col("isin"), "name": F.col("instrument_name"), "issuer": F.col("issuer"), "fee": F.col("ongoing_charges"), "venue": F.col("primary_venue"), "asset_class": F.col("asset_class"), "region": F.col("geography_region")}
    return V.page(found, V.sort_columns(known, sort, direction, "isin", ["fee"]), limit, offset), found.agg(F.count(F.lit(1)).alias("total"))


def fund_detail(spark: SparkSession, catalog: Catalog, isin: str) -> DataFrame:
    """One fund by id, whatever the letters' case, with its evidence parsed."""
    return fund_view(spark, catalog, False).where(F.upper("isin") == isin.strip().upper()).withColumn("evidence", F.try_parse_json("evidence_json"))


def filter_options(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """Facet counts, hedge counts, funds without a sector and the fee range."""
    rows = fund_view(spark, catalog)
    known = {k: F.when(F.lower(c) != "unknown", c) for k, c in facet_columns().items()}
    return {
        "facets": C.facets(rows, known),
        "hedged": C.flag_counts(rows, F.col("hedged")),
        "blank_sector": rows.agg(F.count_if(V.blank(F.col("sector"))).alias("n")),
        "fees": rows.agg(F.min("ongoing_charges").alias("low"), F.max("ongoing_charges").alias("high")),
    }


# Labels of the explorer.
REGIONS = {"us": "United States", "em": "Emerging markets", "north_america": "North America"}
SIZES = {"all_cap": "All cap"}
BOND_TYPES = {"govt": "Government", "corp": "Corporate", "linkers": "Inflation-linked"}


def explorer(rows: DataFrame) -> DataFrame:
    """The fund view as it is shown: seventeen columns of labels; Unknown for what is missing, N.A. where it does not apply."""
    asset = F.lower(F.coalesce("asset_class", F.lit("unknown")))
    shown = lambda c: F.coalesce(c, F.lit("Unknown"))
    of_equity = lambda c: shown(F.when(asset == "equity", c))
    of_bond = lambda c: F.when(asset == "bond", shown(c)).otherwise("N.A.")
    label, text = X.show_label, X.known_text
    return rows.select(
        shown(label(F.col("asset_class"))).alias("asset_type"),
        shown(text(F.col("issuer"))).alias("issuer"),
        shown(text(F.col("isin"))).alias("isin"),
        shown(text(F.col("ticker"))).alias("ticker"),
        shown(text(F.col("instrument_name"))).alias("fund_name"),
        shown(X.show_amount(F.col("p_fund_size_value"), F.col("p_fund_size_currency"))).alias("fund_size"),
        shown(label(F.col("domicile_country"))).alias("domicile"),
        shown(X.show_income(F.col("distribution_policy"))).alias("distribution"),
        shown(text(F.col("currency"))).alias("currency"),
        shown(X.show_percent(F.col("ongoing_charges"))).alias("ter"),
        shown(label(F.col("geography_region"), REGIONS)).alias("region"),
        of_equity(label(F.col("equity_size"), SIZES)).alias("size"),
        of_equity(label(F.col("equity_style"))).alias("style"),
        of_equity(label(F.col("sector"))).alias("sector"),
        shown(label(F.col("replication_method"))).alias("replication"),
        of_bond(label(F.col("bond_type"), BOND_TYPES)).alias("bond_type"),
        of_bond(label(F.col("duration_bucket"))).alias("duration"),
    )


def refresh_profile(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The profile merged with both snapshot logs.

    Of each field the first known value counts: all metadata snapshots newest first, then all cost snapshots newest
    first, a payload's containers laid over one another; values already stored are never cleared.
    """
    meta, cost, inst = (table(spark, catalog, n) for n in ("issuer_metadata_snapshot", "cost_snapshot", "instrument"))
    field = lambda raw, k: X.flatten_payload(raw, k)
    of = lambda raw, fee, income: [F.coalesce(fee, field(raw, "ongoing_charges").try_cast("double")).alias("ongoing_charges"), X.income_policy(F.coalesce(income, field(raw, "use_of_income"), field(raw, "distribution_policy"))).alias("distribution_policy"), *[X.null_if_blank(field(raw, c)).alias(c) for c in ("benchmark_name", "asset_class_hint", "fund_size_currency", "fund_size_scope", "equity_size_hint", "equity_style_hint", "sector_hint", "hedged_target")], X.to_iso_date(field(raw, "fund_size_asof")).alias("fund_size_asof"), X.to_number_loc(field(raw, "fund_size_value")).alias("fund_size_value"), X.first_match([(field(raw, "replication_method").rlike("(?i)synth|swap"), "synthetic"), (field(raw, "replication_method").rlike("(?i)sampl"), "sampling"), (field(raw, "replication_method").rlike("(?i)physical|full"), "physical")]).alias("replication_method"), F.coalesce(X.to_flag(field(raw, "hedged_flag")), F.when(field(raw, "hedged_target").isNotNull(), 1)).alias("hedged_flag"), X.null_if_blank(field(raw, "domicile_country")).alias("domicile_country")]
    none = F.lit(None).cast("string")
    newest = lambda rank, id_: F.struct(F.lit(rank).alias("log"), (-F.unix_date(F.try_to_date("asof_date"))).alias("d"), (-F.col(id_)).alias("i")).alias("o")
    log = meta.select("instrument_id", newest(0, "id"), *of(F.col("raw_json"), F.col("ter"), F.col("use_of_income"))).unionByName(cost.select("instrument_id", newest(1, "cost_id"), *of(F.col("raw_json"), F.lit(None).cast("double"), none)))
    merged = L.coalesce_by_precedence(log, "instrument_id", F.col("o"), list(PROFILE))
    merged = merged.join(inst.select("instrument_id", "isin"), "instrument_id", "left").withColumn("domicile_country", F.coalesce("domicile_country", X.by_prefix(F.col("isin"), X.PROFILE_DOMICILES))).drop("isin")
    return M.merge_profile(table(spark, catalog, "product_profile").select("instrument_id", *PROFILE), merged, "instrument_id", list(PROFILE), [c for c in PROFILE if not c.startswith("fund_size")])


def build_universe(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The eligible universe with issuer names, rebuilt whole."""
    issuer = table(spark, catalog, "issuer").select("issuer_id", "issuer_name", "normalized_name")
    return S.eligible(table(spark, catalog, "instrument"), table(spark, catalog, "listing")).join(issuer, "issuer_id", "left")


def unknown_issuers(spark: SparkSession, catalog: Catalog, names: Sequence[tuple[str, str]], hosts: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Issuers for instruments without one: by host of the newest document, of the mapped url, then by name rule."""
    inst = table(spark, catalog, "instrument").where("issuer_id is null")
    docs = L.latest_by_id(table(spark, catalog, "document"), "instrument_id", "document_id").select("instrument_id", F.col("url").alias("doc_url"))
    urls = table(spark, catalog, "instrument_url_map").groupBy("instrument_id").agg(F.min("url").alias("map_url"))
    by_host = lambda c: X.first_match([(X.domain_in(X.url_host(F.col(c)), ds), n) for n, ds in hosts])
    by_name = X.first_match([(F.upper("instrument_name").rlike(e), n) for n, e in names])
    rows = inst.join(docs, "instrument_id", "left").join(urls, "instrument_id", "left").select("instrument_id", by_host("doc_url").alias("d"), by_host("map_url").alias("u"), by_name.alias("n"))
    return rows.select("instrument_id", F.coalesce("d", "u", "n").alias("issuer_name"), X.first_match([(F.col("d").isNotNull(), "document_host"), (F.col("u").isNotNull(), "url_map"), (F.col("n").isNotNull(), "name_rule")]).alias("issuer_source")).where("issuer_name is not null")


def normalize_unknown_issuers(spark: SparkSession, catalog: Catalog, path: str, names: Sequence[tuple[str, str]], hosts: Sequence[tuple[str, Sequence[str]]]) -> dict[str, int]:
    """Write the issuers found for instruments without one under `path`, and return what the write did.

    candidates: instruments without an issuer; updated: those that get one; document_host, url_map, name_rule: by what.
    The counts are observed in the write itself, so they are those of what was written and cost no second job.
    """
    rows = table(spark, catalog, "instrument").where("issuer_id is null").select("instrument_id")
    found = rows.join(unknown_issuers(spark, catalog, names, hosts), "instrument_id", "left")
    by = {s: F.count_if(F.col("issuer_source") == s) for s in ISSUER_SOURCES}
    return write_counted(found, path, where="issuer_name is not null", candidates=F.count(F.lit(1)), updated=F.count("issuer_name"), **by)


#: What an issuer may be told by, in order.
ISSUER_SOURCES = ("document_host", "url_map", "name_rule")


def fill_listing_aliases(listing: DataFrame, rows: DataFrame) -> DataFrame:
    """Alias listings from a secondary source: new ones are not primary, known ones are filled and made active."""
    keys = ["instrument_id", "venue_mic", "ticker"]
    new = rows.select(*keys, F.lit(0).alias("primary_flag"), F.lit("active").alias("status"), "trading_currency")
    return M.merge(listing, new, keys, {"primary_flag": M.first_wins, "status": M.new_wins, "trading_currency": lambda o, n: F.coalesce(X.null_if_blank(o), n)})


def gap_report(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """A row for each universe fund with a missing field: what is missing, its tearsheet status and its latest source.

    Funds without an active listing are reported too. Which fields count depends on the asset class.
    """
    t = lambda n: table(spark, catalog, n)
    inst = t("instrument").where("universe_mvp_flag = 1").select("instrument_id", "isin", "instrument_name", "issuer_id")
    listed = L.representative(t("listing"), "instrument_id", [F.col("listing_id")]).select("instrument_id", "ticker", F.col("venue_mic").alias("venue"), F.col("trading_currency").alias("currency"))
    issuer = t("issuer").select("issuer_id", F.coalesce("normalized_name", "issuer_name").alias("issuer"))
    profile = t("product_profile").select("instrument_id", "ongoing_charges", "benchmark_name", "distribution_policy", F.col("fund_size_value").alias("fund_size"), "domicile_country", "replication_method")
    tax = t("instrument_taxonomy").select("instrument_id", "asset_class", "geography_region", "equity_size", "equity_style", "sector", "bond_type", "duration_bucket")
    logs = L.latest_by_source(t("issuer_metadata_snapshot").withColumn("source", F.coalesce("source", F.lit("?"))), "instrument_id", "source", "ft_tearsheet", ["asof_date", "id"], ["source", "source_url", "quality_flag", "raw_json"])
    rows = inst.join(listed, "instrument_id", "left").join(issuer, "issuer_id", "left").join(profile, "instrument_id", "left").join(tax, "instrument_id", "left").join(logs, "instrument_id", "left")
    told = lambda c: F.when(F.lower(c) != "unknown", F.col(c))
    rows = rows.withColumns({"region": told("geography_region"), "bond_type": told("bond_type"), "duration_bucket": told("duration_bucket")})
    equity, bond = F.col("asset_class") == "equity", F.col("asset_class") == "bond"
    fields = ["ongoing_charges", "benchmark_name", "distribution_policy", "fund_size", "domicile_country", "region", "replication_method", "equity_size", "equity_style", "sector", "bond_type", "duration_bucket"]
    expected = {"equity_size": equity, "equity_style": equity, "sector": equity, "bond_type": bond, "duration_bucket": bond}
    rows = rows.withColumns(
        {
            "issuer": F.coalesce("issuer", F.lit("Unknown")),
            "asset_class": F.coalesce("asset_class", F.lit("unknown")),
            "ft_status": F.coalesce("ft_tearsheet_quality_flag", F.lit("not_attempted")),
            "ft_symbol": F.get_json_object("ft_tearsheet_raw_json", "$.symbol"),
            "ft_match_type": F.get_json_object("ft_tearsheet_raw_json", "$.match_type"),
            "latest_metadata_source": F.col("latest_source"),
            "latest_metadata_quality": F.col("latest_quality_flag"),
        }
    )
    keep = ("issuer", "ticker", "venue", "currency", "asset_class", "instrument_name", "ft_status", "ft_match_type", "ft_symbol", "latest_metadata_source", "latest_metadata_quality")
    return C.gap_rows(rows, "isin", fields, expected, keep)


def gap_histograms(gaps: DataFrame) -> DataFrame:
    """facet, value, n: missing fields, tearsheet status, latest sources and issuers of a gap report."""
    return C.gap_counts(gaps, {"ft_status": F.col("ft_status"), "latest_source": F.coalesce("latest_metadata_source", F.lit("none")), "issuer": F.col("issuer")})


def completeness(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """The whole report: universe, profile, taxonomy and fee coverage, gaps and their histogram.

    The fund view is joined once and persisted for the reports that read it; Spark drops it when it is no longer used.
    """
    rows = fund_view(spark, catalog).persist()
    inst = table(spark, catalog, "instrument").where("universe_mvp_flag = 1")
    primary = active_primary(table(spark, catalog, "listing")).select("instrument_id", "venue_mic")
    equity, bond = F.col("asset_class") == "equity", F.col("asset_class") == "bond"
    by_class = {"equity_size": equity, "equity_style": equity, "sector": equity, "bond_type": bond, "duration_bucket": bond}
    gaps = gap_report(spark, catalog)
    return {
        "universe": inst.join(primary, "instrument_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("status", F.lit("active")) == "active").alias("active"), F.count("venue_mic").alias("with_primary")),
        "venues": C.count_by(primary.join(inst, "instrument_id", "left_semi"), F.coalesce("venue_mic", F.lit("unknown"))),
        "profile": C.coverage(rows.withColumnsRenamed({"p_fund_size_value": "fund_size_value"}), ["ongoing_charges", "distribution_policy", "benchmark_name", "p_asset_class_hint", "domicile_country", "fund_size_value", "p_fund_size_currency", "p_fund_size_asof", "p_fund_size_scope", "replication_method", "hedged", "p_equity_size_hint", "p_equity_style_hint", "p_sector_hint"]),
        "taxonomy": C.coverage(rows, ["asset_class", "geography_region", "equity_size", "equity_style", "sector", "bond_type", "duration_bucket"], where=by_class),
        "fees": rows.agg(F.count_if(F.col("ongoing_charges").isNull()).alias("missing_fee"), F.count_if(F.col("ongoing_charges").isNull() & V.blank(F.col("currency"))).alias("missing_both")),
        "fee_issuers": C.count_by(rows.where("ongoing_charges is null"), F.coalesce("issuer", F.lit("unknown")), "issuer").limit(10),
        "gaps": gaps,
        "histogram": C.gap_summary(gaps),
    }


def completeness_report(spark: SparkSession, catalog: Catalog, asof: str, mixes: DataFrame) -> dict[str, DataFrame]:
    """The report over refreshed read models, with gap histograms and the readiness of strategies."""
    fresh = refresh_read_models(spark, catalog, asof)
    funds = candidates(spark, fresh)
    run = S.Run(funds)
    return completeness(spark, fresh) | {"histograms": gap_histograms(gap_report(spark, fresh)), "strict": S.strict_counts(funds), "readiness": S.emitted(mixes, run), "attempts": run.attempt_counts()}


def refresh_read_models(spark: SparkSession, catalog: Catalog, asof: str) -> dict[str, DataFrame]:
    """The catalogue with its profile merged from the logs and its taxonomy classified anew for the universe."""
    from . import classify as K

    profile = refresh_profile(spark, catalog)
    inst = table(spark, catalog, "instrument").where("universe_mvp_flag = 1").select("instrument_id", "isin", "instrument_name", "instrument_type")
    primary = active_primary(table(spark, catalog, "listing")).select("instrument_id").distinct()
    rows = inst.join(primary, "instrument_id", "left_semi").join(profile, "instrument_id", "left")
    names = [c for c in table(spark, catalog, "instrument_taxonomy").columns if c != "instrument_id"]
    new = K.classify(rows, asof, ("instrument_id",)).select("instrument_id", *names).persist()
    return dict(catalog) | {"product_profile": profile, "instrument_taxonomy": M.merge_taxonomy(table(spark, catalog, "instrument_taxonomy"), new, "instrument_id")}


def candidates(spark: SparkSession, catalog: Catalog, venues: Sequence[str] = S.VENUES, exceptions: bool = True) -> DataFrame:
    """The base relation of screening: universe funds on the venues with the current cost as their fee.

    The fee is that of the cost log, not the profile's, which keeps old values. Gold exceptions are flagged.
    """
    rows = fund_view(spark, catalog).where(F.col("primary_venue").isin(*venues)).withColumn("gold_policy_exception_flag", F.lit(0))
    if exceptions:
        rows = rows.unionByName(gold_exceptions(spark, catalog, venues).withColumn("gold_policy_exception_flag", F.lit(1)))
    return rows.withColumns({"ongoing_charges": F.col("current_cost"), "issuer_normalized": F.coalesce("issuer", F.lit("")), "currency": X.null_if_blank(F.col("currency"))}).withColumnsRenamed({"p_fund_size_value": "fund_size_value", "p_fund_size_currency": "fund_size_currency"}).persist()  # read by every attempt


def gold_exceptions(spark: SparkSession, catalog: Catalog, venues: Sequence[str] = S.VENUES) -> DataFrame:
    """Physical gold outside the universe on the venues: gold-like names, not levered, classified as gold."""
    from . import classify as K

    rows = fund_view(spark, catalog, False).where((F.coalesce("universe_mvp_flag", F.lit(0)) == 0) & F.col("primary_venue").isin(*venues))
    up = F.upper("instrument_name")
    plain = (F.coalesce("leverage_flag", F.lit(0)) == 0) & (F.coalesce("inverse_flag", F.lit(0)) == 0) & ~up.rlike(S.LEVERED)
    rows = rows.where((up.contains("GOLD") | up.contains("BULLION")) & plain).persist()
    inputs = rows.select("instrument_id", "isin", "instrument_name", "instrument_type", "benchmark_name", F.col("p_asset_class_hint").alias("asset_class_hint"))
    # persisted, as a filter that moved below the cascades would copy them for each column it reads
    found = K.classify(inputs, "1970-01-01", ("instrument_id",)).persist().where("asset_class = 'commodity' and commodity_type = 'gold'")
    told = ["asset_class", "geography_scope", "geography_region", "geography_country", "equity_size", "equity_style", "factor", "sector", "theme", "bond_type", "duration_bucket", "commodity_type", "cash_proxy_flag", "gold_flag", "cash_flag", "govt_bond_flag"]
    return rows.join(found.select("instrument_id", *[F.col(c).alias(f"_{c}") for c in told]), "instrument_id").withColumns({c: F.col(f"_{c}") for c in told}).drop(*[f"_{c}" for c in told])


def export_bundle(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """The tables restricted to the universe and the gold exceptions; active alias listings stay, costs are the current ones."""
    ids = table(spark, catalog, "instrument").where("universe_mvp_flag = 1").select("instrument_id").union(gold_exceptions(spark, catalog).select("instrument_id")).distinct().persist()  # read by every table
    t = lambda n: table(spark, catalog, n)
    listing = t("listing").where(F.coalesce("status", F.lit("active")) == "active")
    out = V.closure({"instrument": (t("instrument"), "instrument_id"), "listing": (listing, "instrument_id"), "product_profile": (t("product_profile"), "instrument_id"), "instrument_taxonomy": (t("instrument_taxonomy"), "instrument_id"), "cost_snapshot": (current_costs(t("cost_snapshot")), "instrument_id")}, ids, "instrument_id")
    return out | V.closure({"issuer": (t("issuer"), "issuer_id")}, out["instrument"].select("issuer_id"), "issuer_id")


def smoke_check(spark: SparkSession, catalog: Catalog, custom: Sequence[tuple[str, float]] = (("equity_global", 60.0), ("short_govt_bonds", 40.0))) -> DataFrame:
    """check, ok: a bundle gives a list, facets, gold, rows of a custom mix and candidates by strict filters."""
    # what several checks read is written once, so none of them carries the plan of the fund view or of all attempts
    written = {name: durable(table(spark, catalog, name), name) for name in catalog}
    page, total = list_funds(spark, written)
    facets = filter_options(spark, written)["facets"]
    funds = durable(candidates(spark, written), "candidates")
    picked = durable(S.Run(funds).picked().select("bucket", "isin"), "picked")
    mixed = S.strategy_rows(S.custom_mix(spark, list(custom), whole=True), picked)
    one = lambda name, df: df.agg((F.count(F.lit(1)) > 0).alias("ok")).select(F.lit(name).alias("check"), "ok")
    positive = lambda name, df, c: df.select(F.lit(name).alias("check"), (F.col(c) > 0).alias("ok"))
    checks = one("list", page).unionByName(one("facets", facets)).unionByName(one("shortlist", picked)).unionByName(positive("total", total, "total"))
    return checks.unionByName(one("gold", picked.where("bucket = 'gold'"))).unionByName(one("custom", mixed)).unionByName(positive("strict", S.strict_counts(funds), "kept"))


def manifest(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row: table counts, profile coverage and smoke results as nested values."""
    counts = V.bundle_counts(export_bundle(spark, catalog)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "n")))).alias("tables"))
    covered = completeness(spark, catalog)["profile"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "pct")))).alias("coverage"))
    checks = smoke_check(spark, catalog).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "ok")))).alias("checks"))
    key = lambda df: df.withColumn("_k", F.lit(1))
    return key(counts).join(key(covered), "_k").join(key(checks), "_k").drop("_k")
