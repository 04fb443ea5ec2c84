"""Schemas of the catalogue tables, as DDL. Flags are three-valued: 0, 1 or NULL."""

TABLES = {
    "issuer": "issuer_id long, issuer_name string, normalized_name string, domain string",
    "issuer_alias": "alias string, issuer_id long, note string",
    "instrument": "instrument_id long, isin string, instrument_name string, instrument_type string, issuer_id long, universe_mvp_flag int, leverage_flag int, inverse_flag int, ucits_flag int, ucits_source string, status string",
    "listing": "listing_id long, instrument_id long, primary_flag int, status string, venue_mic string, ticker string, trading_currency string",
    "product_profile": "instrument_id long, distribution_policy string, ucits_flag int, ucits_source string, ongoing_charges double, ongoing_charges_asof string, benchmark_name string, asset_class_hint string, domicile_country string, fund_size_value double, fund_size_currency string, fund_size_asof string, fund_size_scope string, replication_method string, hedged_flag int, hedged_target string, equity_size_hint string, equity_style_hint string, sector_hint string, sector_weight double",
    "cost_snapshot": "cost_id long, instrument_id long, asof_date string, ongoing_charges double, entry_costs double, exit_costs double, transaction_costs double, quality_flag string, raw_json string",
    "issuer_metadata_snapshot": "id long, instrument_id long, asof_date string, source string, source_url string, ter double, use_of_income string, ucits_compliant int, quality_flag string, raw_json string",
    "instrument_taxonomy": "instrument_id long, asset_class string, geography_scope string, geography_region string, geography_country string, equity_size string, equity_style string, factor string, sector string, theme string, bond_type string, duration_bucket string, commodity_type string, cash_proxy_flag int, gold_flag int, cash_flag int, govt_bond_flag int, hedged_flag int, hedged_target string, domicile_country string, distribution_policy string, evidence_json string",
    "instrument_url_map": "instrument_id long, url_type string, url string",
    "document": "document_id long, instrument_id long, doc_type string, url string, hash_sha256 string",
}
