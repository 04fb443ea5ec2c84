"""Further catalogue queries: single expressions over whole tables, precedence, identity and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import classify as K
from ..operators import coverage as C
from ..operators import extract as X
from ..operators import latest as L
from ..operators import screen as S
from ..operators import serve as V
from ..operators import state as M
from ..operators.ranks import dealt
from .catalogue import BAND_SQL, SPECS_SQL, bucketed, query, t


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY 1")
def latest_known_value(spark, sf_dir):
    """The newest known value of each key."""
    rows = t(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "view", F.col("value")))
    return L.latest_known(rows, "user_id", "value", ["ts", "event_id"])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N')::INT DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_linestatus = 'O') WHERE rn = 1"""
)
def representative_listing(spark, sf_dir):
    """One active row a key: primary first, else the lowest number."""
    rows = t(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "active").otherwise("inactive")).withColumn("primary_flag", (F.col("l_returnflag") == "N").cast("int"))
    return L.representative(rows, "l_orderkey", [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, CASE WHEN regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '(^|\.)(example\.com|example\.net)$') THEN 1 ELSE 0 END AS known FROM pages"""
)
def url_functions(spark, sf_dir):
    """Canonical url, a query parameter and whether the host is below a known domain."""
    url = F.col("url")
    known = T.domain_in(T.url_host(url), ["example.com", "example.net"]).cast("int")
    return t(spark, sf_dir, "pages").select("page_id", T.url_canonical(url).alias("canonical"), T.url_param(url, "page").alias("page"), known.alias("known"))


@query("SELECT o_orderkey, o_totalprice AS continental, o_totalprice AS plain, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice % 100, 2) AS percent FROM orders")
def numbers_and_dates(spark, sf_dir):
    """Numbers and dates written in several ways and read back."""
    plain = F.format_number("o_totalprice", 2)
    continental = F.translate(plain, ",.", ".,")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    percent = F.concat(F.translate(F.round(F.col("o_totalprice") % 100, 2).cast("decimal(10,2)").cast("string"), ".", ","), F.lit(" %"))
    return t(spark, sf_dir, "orders").select("o_orderkey", T.to_number_loc(continental).alias("continental"), T.to_number_loc(plain).alias("plain"), T.to_iso_date(day).alias("day"), T.to_percent(percent).alias("percent"))


@query(
    """SELECT count(*) FILTER (WHERE ok) AS valid, count(*) AS total FROM (SELECT list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN r[i]::INT WHEN 2 * r[i]::INT > 9 THEN 2 * r[i]::INT - 9 ELSE 2 * r[i]::INT END)) % 10 = 0 AS ok
    FROM (SELECT s, reverse(s) AS r FROM (SELECT '3028' || lpad((c_custkey * 7919)::VARCHAR, 9, '0') || (c_custkey % 10)::VARCHAR AS s FROM customer)))"""
)
def id_checksums(spark, sf_dir):
    """How many made-up identifiers have a right check digit."""
    code = F.concat(F.lit("us "), F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0"), (F.col("c_custkey") % 10).cast("string"))
    return t(spark, sf_dir, "customer").agg(F.count_if(T.isin_ok(code)).alias("valid"), F.count(F.lit(1)).alias("total"))


ISSUERS = (("Alpha House", r"example\.com"), ("Beta House", r"example\.(?:net|org)"), ("Gamma House", r"example"))


@query(
    r"""SELECT issuer, lang, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, 'example\.com') THEN 'Alpha House' WHEN regexp_matches(url, 'example\.(net|org)') THEN 'Beta House' WHEN regexp_matches(url, 'example') THEN 'Gamma House' END AS issuer, nullif(regexp_extract(url, '(?i)/(en|de|fr|it|es|nl)(?:[-_/]|$)', 1), '') AS lang FROM pages) GROUP BY 1, 2"""
)
def issuer_by_url(spark, sf_dir):
    """Issuers by the first url rule that matches, counted by language."""
    rows = R.first_rule(t(spark, sf_dir, "pages"), ISSUERS, "url", "issuer")
    return rows.groupBy("issuer", T.url_lang(F.col("url")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_nationkey, c_mktsegment, coalesce(n.c_custkey, o.c_custkey) AS c_custkey FROM (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2) o FULL JOIN (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1, 2) n USING (c_nationkey, c_mktsegment)"""
)
def url_map_upsert(spark, sf_dir):
    """One value a pair of keys: the last new one wins over the stored one."""
    keys = ["c_nationkey", "c_mktsegment"]
    last = lambda rows: rows.groupBy(*keys).agg(F.max("c_custkey").alias("c_custkey"))
    rows = t(spark, sf_dir, "customer")
    return M.merge(last(rows.where("c_custkey % 2 = 0")), last(rows.where("c_custkey % 2 = 1")), keys, {"c_custkey": M.sticky})


@query(
    """SELECT user_id, arg_min(value, event_id) FILTER (WHERE event_type = 'purchase' AND value > 12) AS value, count(*) AS attempts, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase' AND value > 12) > 0 THEN 'ok' ELSE arg_max(event_type, event_id) END AS outcome FROM events GROUP BY 1"""
)
def fallback_chain(spark, sf_dir):
    """The first attempt that succeeded, else how the last one failed."""
    rows = t(spark, sf_dir, "events").withColumn("value", F.when((F.col("event_type") == "purchase") & (F.col("value") > 12), F.col("value")))
    return X.first_success(rows, "user_id", "event_id", "value", "event_type")


MIXES = {"careful": [("any_mid", 60.0), ("econ", 40.0)], "bold": [("promo_large", 50.0), ("large_any", 50.0)]}


@query(
    f"""WITH m(strategy, bucket, weight) AS (VALUES ('careful', 'any_mid', 60.0), ('careful', 'econ', 40.0), ('bold', 'promo_large', 50.0), ('bold', 'large_any', 50.0)), n AS (SELECT bucket, count(*) AS n FROM part JOIN {SPECS_SQL} ON (st IS NULL OR st = p_type) AND (sb IS NULL OR sb = {BAND_SQL}) WHERE p_retailprice < 910 GROUP BY 1)
    SELECT strategy, min(coalesce(n, 0)) AS fewest FROM m LEFT JOIN n USING (bucket) GROUP BY 1"""
)
def strategy_readiness(spark, sf_dir):
    """The fewest candidates that any bucket of a strategy has."""
    mixes = spark.createDataFrame([(s, b, w) for s, parts in MIXES.items() for b, w in parts], "strategy string, bucket string, weight double")
    return S.readiness(mixes, bucketed(spark, sf_dir).where("p_retailprice < 910"))


@query("SELECT DISTINCT c_name FROM customer ORDER BY lower(c_name) DESC, c_name LIMIT 20")
def case_insensitive_order(spark, sf_dir):
    """The last twenty names, whatever their letters' case."""
    return t(spark, sf_dir, "customer").select("c_name").distinct().orderBy(F.lower("c_name").desc(), "c_name").limit(20)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000")
def export_ids(spark, sf_dir):
    """Distinct ids of the universe and its exceptions."""
    a = t(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")
    return a.union(t(spark, sf_dir, "orders").where("o_totalprice > 490000").select("o_custkey")).distinct()


@query(
    """SELECT 'all' AS scope, count(*) AS total, sum((c_acctbal > 0)::INT)::BIGINT AS active, sum((c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))::INT)::BIGINT AS with_primary FROM customer
    UNION ALL SELECT 'nation ' || c_nationkey, count(*), sum((c_acctbal > 0)::INT)::BIGINT, sum((c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))::INT)::BIGINT FROM customer GROUP BY c_nationkey"""
)
def universe_summary(spark, sf_dir):
    """Totals and totals by group in one pass; the right side is filtered before the join and keeps rows without a match."""
    primary = t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    rows = t(spark, sf_dir, "customer").join(primary, "c_custkey", "left")
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("nation "), "c_nationkey")))
    return rows.select(scopes.alias("scope"), "c_acctbal", "has").groupBy("scope").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if("has").alias("with_primary"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id = 42")
def detail_row(spark, sf_dir):
    """One row by id with its payload parsed."""
    return t(spark, sf_dir, "events").where("event_id = 42").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(
    f"""SELECT bucket, count(*) AS n, string_agg(p_partkey || ' ' || p_name, '; ' ORDER BY rank) AS line FROM (SELECT bucket, p_partkey, p_name, row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice, p_partkey) AS rank FROM part JOIN {SPECS_SQL} ON (st IS NULL OR st = p_type) AND (sb IS NULL OR sb = {BAND_SQL})) WHERE rank <= 3 GROUP BY bucket"""
)
def bucket_table(spark, sf_dir):
    """The three candidates of each bucket as one line."""
    top = L.top_rows(bucketed(spark, sf_dir), ["bucket"], [F.col("p_retailprice"), F.col("p_partkey")], 3, "rank")
    return V.bucket_tables(top, "bucket", "rank", F.concat_ws(" ", "p_partkey", "p_name"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE (p_retailprice, p_partkey) > (905.0, 50) ORDER BY p_retailprice, p_partkey LIMIT 50")
def page_after(spark, sf_dir):
    """The page after a given row, without skipping those before."""
    return V.page_after(t(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", (905.0, 50))


@query(
    """SELECT l_returnflag AS flag, l_linestatus AS line, count(*) AS n, sum((l_quantity > 45)::INT)::BIGINT AS outliers FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1, 2"""
)
def newest_outliers(spark, sf_dir):
    """Newest row of each key, then how many are out of range by group."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
    newest = L.top_rows(t(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.col(c).desc() for c in order])
    return newest.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 45).alias("outliers"))


#: How the words of a part's columns read in a fund's name; the tables hold no funds. Brand, type, adjective, noun.
PLACES = ("MSCI WRLD", "U.S.", "CANADA", "MEXICO", "ATX", "FRANCE", "SWITIT9", "AEX", "SOFIX", "CROBEX", "CZECH", "BUX", "MBI10", "WIG20", "SLOVAKIA", "SBI TOP", "BELEX", "IBEX", "U.K.", "BRAZIL", "MSCI AUST", "NIK400", "KUWAIT", "HANG SENG", "EM.EQ")
KINDS = {"STANDARD": "EQ", "ECONOMY": "GO.BD", "PROMO": "HY BD", "SMALL": "T-BILL", "LARGE": "PLATINUM", "MEDIUM": "MULTI ASSET"}
TRAITS = {"hot": "MOMENTUM", "cold": "LOW VOL", "red": "GROWTH", "blue": "VAL", "small": "SMLL CAP", "large": "LARGE CAP", "old": "DIVIDEND", "new": "QUALITY"}
TOPICS = {"ring": "SEMICONDUCTR", "gear": "INSURANCE", "widget": "UTILITIES", "bolt": "MATERIALS", "plate": "REITS", "anvil": "HYDROGEN", "gizmo": "ROBOTICS", "rod": "DECRB"}


def part_names(spark, sf_dir):
    """A fund-like name for each part, from its brand, type, name and size."""
    of = lambda c, names: F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), c)
    brand, low = F.element_at(F.split("p_brand", "#"), 2), F.col("p_size") % 12
    term = F.concat(low.cast("string"), F.lit("-"), (low + F.col("p_size") % 5).cast("string"), F.lit("Y"))
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.concat_ws(" ", of(brand, {str(i + 1): p for i, p in enumerate(PLACES)}), of(F.col("p_type"), KINDS), of(first, TRAITS), of(last, TOPICS), term)
    return dealt(t(spark, sf_dir, "part"), "p_partkey").select("p_partkey", name.alias("instrument_name"), F.lit("ETF").alias("instrument_type"))


@query(
    """WITH place(brand, country, region) AS (VALUES ('Brand#1', NULL, 'global'), ('Brand#2', 'United States', 'us'), ('Brand#3', 'Canada', 'north_america'), ('Brand#4', 'Mexico', 'em'), ('Brand#5', 'Austria', 'europe'),
    ('Brand#6', 'France', 'europe'), ('Brand#7', 'Switzerland', 'europe'), ('Brand#8', 'Netherlands', 'europe'), ('Brand#9', 'Bulgaria', 'europe'), ('Brand#10', 'Croatia', 'europe'), ('Brand#11', 'Czech Republic', 'europe'),
    ('Brand#12', 'Hungary', 'europe'), ('Brand#13', 'North Macedonia', 'europe'), ('Brand#14', 'Poland', 'europe'), ('Brand#15', 'Slovakia', 'europe'), ('Brand#16', 'Slovenia', 'europe'), ('Brand#17', 'Serbia', 'europe'), ('Brand#18', 'Spain', 'europe'),
    ('Brand#19', 'United Kingdom', 'europe'), ('Brand#20', 'Brazil', 'em'), ('Brand#21', 'Australia', 'asia'), ('Brand#22', 'Japan', 'asia'), ('Brand#23', 'Kuwait', 'em'), ('Brand#24', 'China', 'asia'), ('Brand#25', NULL, 'em')),
    kind(p_type, asset_class, bond_type, cash, govt, commodity_type) AS (VALUES ('STANDARD', 'equity', NULL, 0, 0, NULL), ('ECONOMY', 'bond', 'govt', 0, 1, NULL), ('PROMO', 'bond', 'corp', 0, 0, NULL), ('SMALL', 'cash', NULL, 1, 0, NULL), ('LARGE', 'commodity', NULL, 0, 0, 'precious_metals'), ('MEDIUM', 'multi', NULL, 0, 0, NULL)),
    trait(a, factor, equity_size, equity_style) AS (VALUES ('hot', 'momentum', NULL, NULL), ('cold', 'minimum_volatility', NULL, NULL), ('red', NULL, NULL, 'growth'), ('blue', NULL, NULL, 'value'), ('small', NULL, 'small', NULL), ('large', NULL, 'large', NULL), ('old', 'dividend_income', NULL, NULL), ('new', 'quality', NULL, NULL)),
    topic(b, sector, theme) AS (VALUES ('ring', 'technology', NULL), ('gear', 'financials', NULL), ('widget', 'utilities', NULL), ('bolt', 'materials', NULL), ('plate', 'real_estate', NULL), ('anvil', NULL, 'hydrogen'), ('gizmo', NULL, 'robotics'), ('rod', NULL, 'green_deal')),
    n AS (SELECT *, p_size % 12 AS low, p_size % 12 + p_size % 5 AS high, asset_class IN ('bond', 'cash') AS dated FROM part JOIN place ON p_brand = brand JOIN kind USING (p_type) JOIN trait ON a = split_part(p_name, ' ', 1) JOIN topic ON b = split_part(p_name, ' ', 2))
    SELECT p_partkey, asset_class, CASE WHEN country IS NOT NULL THEN 'country' WHEN region = 'global' THEN 'global' ELSE 'regional' END AS geography_scope, region AS geography_region, country AS geography_country, equity_size, equity_style, factor, sector, theme, bond_type,
    CASE WHEN NOT dated THEN NULL WHEN low >= 10 THEN 'long' WHEN high <= 3 THEN 'short' ELSE 'intermediate' END AS duration_bucket, CASE WHEN dated THEN low::DOUBLE END AS duration_years_low, CASE WHEN dated THEN high::DOUBLE END AS duration_years_high,
    commodity_type, cash AS cash_flag, govt AS govt_bond_flag, CASE WHEN asset_class = 'equity' THEN CASE WHEN sector IS NOT NULL THEN 'sector' WHEN region = 'north_america' THEN 'us' ELSE region END END AS equity_region FROM n"""
)
def fund_taxonomy(spark, sf_dir):
    """Names classified by all cascades, with the old region of equity."""
    tax = K.classify(part_names(spark, sf_dir), "2026-01-01", ("p_partkey",))
    old = K.equity_region(F.col("geography_region"), F.col("geography_country"), F.col("sector"))
    shown = ("p_partkey", "asset_class", "geography_scope", "geography_region", "geography_country", "equity_size", "equity_style", "factor", "sector", "theme", "bond_type", "duration_bucket", "duration_years_low", "duration_years_high", "commodity_type", "cash_flag", "govt_bond_flag")
    return tax.select(*shown, F.when(F.col("asset_class") == "equity", old).alias("equity_region"))
