"""The registered catalogue queries: each operator on the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import coverage as C
from ..operators import extract as X
from ..operators import latest as L
from ..operators import screen as S
from ..operators import serve as V
from ..operators import state as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: A total order of lineitem rows, newest first.
NEWEST = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
NEWEST_SQL = ", ".join(f"{c} DESC" for c in NEWEST)


def current_cost(spark, sf_dir) -> DataFrame:
    return L.latest_accepted(t(spark, sf_dir, "lineitem"), "l_partkey", "l_discount", "l_returnflag", ["R", "A"], NEWEST)


CURRENT_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {NEWEST_SQL}) AS rn FROM lineitem WHERE l_discount IS NOT NULL AND l_returnflag IN ('R', 'A')) WHERE rn = 1"


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate, l_discount FROM ({CURRENT_SQL})")
def latest_accepted_cost(spark, sf_dir):
    return current_cost(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_discount")


@query(
    f"""WITH c AS ({CURRENT_SQL}) SELECT p_brand, count(*) AS total, count(c.l_partkey) AS known,
    CASE WHEN count(*) > 0 THEN round(100.0 * count(c.l_partkey)::DOUBLE / count(*), 2) ELSE 0.0 END AS pct
    FROM part LEFT JOIN c ON p_partkey = l_partkey AND l_discount > 0 GROUP BY p_brand"""
)
def coverage_of_current_cost(spark, sf_dir):
    """Latest accepted cost per part, then its coverage by brand."""
    cost = current_cost(spark, sf_dir).where("l_discount > 0").select(F.col("l_partkey").alias("p_partkey"), "l_discount")
    rows = t(spark, sf_dir, "part").join(cost, "p_partkey", "left")
    return C.coverage(rows, ["l_discount"], ["p_brand"]).drop("field")


@query(
    """SELECT p.l_partkey, p.l_orderkey, p.l_linenumber, p.l_returnflag, p.l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY
    CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_returnflag NULLS FIRST, CASE upper(l_linestatus) WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, upper(l_linestatus) NULLS FIRST,
    l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem) p WHERE rn = 1"""
)
def primary_selection(spark, sf_dir):
    rows = L.choose_primary(t(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_linestatus", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"], ["N", "A"], ["O", "F"])
    return rows.where("primary_flag = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query(
    """WITH f AS (SELECT l_partkey, sum((l_returnflag = 'N')::INT) AS f, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT count(*) AS keys, sum((f = 0)::INT)::BIGINT AS without, sum((f > 1)::INT)::BIGINT AS several, sum((n > 1)::INT)::BIGINT AS repeated FROM f"""
)
def primary_checks(spark, sf_dir):
    return C.key_checks(t(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_returnflag") == "N")


@query(
    """SELECT ANY_VALUE(c.c_nationkey) AS c_nationkey, c_custkey, any_value(CASE WHEN c_custkey % 10 = 0 THEN m.mode ELSE c_mktsegment END) AS c_mktsegment, any_value(CASE WHEN c_custkey % 10 <> 0 THEN 'ok' WHEN m.mode IS NOT NULL THEN 'imputed' ELSE 'missing' END) AS quality
    FROM customer c LEFT JOIN (SELECT c_nationkey, arg_min(c_mktsegment, rank) AS mode FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1, 2) GROUP BY 1) m USING (c_nationkey) GROUP BY c_custkey"""
)
def impute_mode(spark, sf_dir):
    """Blank segments filled with the most frequent one of the nation."""
    rows = t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    modes = L.mode_by(rows, ["c_nationkey"], "c_mktsegment", F.lit(0), "mode")
    return M.impute(rows, "c_mktsegment", modes, ["c_nationkey"], "mode", "quality").select("c_nationkey", "c_custkey", "c_mktsegment", "quality")


def gappy_parts(spark, sf_dir) -> DataFrame:
    """Parts with derived gaps: three fields that miss where a rule on the key says so."""
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select("p_partkey", F.when(k % 7 != 0, F.col("p_brand")).alias("brand"), F.when(k % 5 != 0, F.col("p_type")).otherwise(" ").alias("kind"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("price"), "p_size", "p_name")


GAPPY_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE ' ' END AS kind, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price, p_size, p_name FROM part"


@query(
    f"""WITH g AS ({GAPPY_SQL}), c AS (SELECT count(*) AS n, count(brand) AS b, sum((trim(kind) <> '')::INT) AS k, count(price) AS p, sum((p_size > 25)::INT) AS nl, sum((p_size > 25 AND price IS NOT NULL)::INT) AS pl FROM g)
    SELECT field, known::BIGINT AS known, total::BIGINT AS total, CASE WHEN total > 0 THEN round(100.0 * known::DOUBLE / total, 2) ELSE 0.0 END AS pct FROM (SELECT 'brand' AS field, b AS known, n AS total FROM c UNION ALL SELECT 'kind', k, n FROM c UNION ALL SELECT 'price', pl, nl FROM c)"""
)
def coverage_report(spark, sf_dir):
    """Known, total and share of three fields; the price only counts for large parts."""
    return C.coverage(gappy_parts(spark, sf_dir), ["brand", "kind", "price"], where={"price": F.col("p_size") > 25})


@query(f"SELECT p_partkey, concat_ws(',', CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN kind IS NULL OR trim(kind) = '' THEN 'kind' END, CASE WHEN price IS NULL AND p_size > 25 THEN 'price' END) AS missing_fields, ((brand IS NULL)::INT + (kind IS NULL OR trim(kind) = '')::INT + (price IS NULL AND p_size > 25)::INT)::BIGINT AS n_missing FROM ({GAPPY_SQL}) WHERE brand IS NULL OR trim(kind) = '' OR (price IS NULL AND p_size > 25)")
def gap_rows(spark, sf_dir):
    return C.gap_rows(gappy_parts(spark, sf_dir), "p_partkey", ["brand", "kind", "price"], {"price": F.col("p_size") > 25})


@query(f"SELECT field, count(*) AS n FROM (SELECT unnest(string_split(missing_fields, ',')) AS field FROM ({SQL['gap_rows']})) GROUP BY field")
def gap_summary(spark, sf_dir):
    return C.gap_summary(gap_rows(spark, sf_dir))


@query(
    """SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2
    UNION ALL SELECT 'size_band', CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'mid' ELSE 'large' END, count(*) FROM part GROUP BY 2"""
)
def facet_counts(spark, sf_dir):
    return C.facets(t(spark, sf_dir, "part"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size_band": size_band(F.col("p_size"))})


def size_band(c: Column) -> Column:
    return F.when(c < 15, "small").when(c < 35, "mid").otherwise("large")


@query("SELECT sum((p_size % 3 = 1)::INT)::BIGINT AS yes, sum((p_size % 3 = 0)::INT)::BIGINT AS no, sum((p_size % 3 = 2)::INT)::BIGINT AS unknown FROM part")
def flag_counts(spark, sf_dir):
    m = F.col("p_size") % 3
    return C.flag_counts(t(spark, sf_dir, "part"), F.when(m == 1, 1).when(m == 0, 0))


@query(
    """SELECT p_partkey, p_name, p_brand, price FROM (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price FROM part) WHERE p_name ILIKE '%r_d%' AND p_type = 'SMALL' AND price >= 900.0 AND price <= 990.0
    ORDER BY price DESC NULLS LAST, p_partkey NULLS FIRST LIMIT 50 OFFSET 5"""
)
def fund_list_page(spark, sf_dir):
    """A page of a search: text, facet, price range, sort with NULLs last."""
    rows = t(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")))
    tests = V.search_test([F.col("p_name")], " R_D ") + V.facet_tests({"type": F.col("p_type"), "brand": F.col("p_brand")}, {"type": "SMALL", "brand": ""}) + V.range_tests(F.col("price"), 900.0, 990.0)
    order = V.sort_columns({"price": F.col("price"), "name": F.col("p_name")}, "price", "desc", "p_partkey", ["price"])
    return V.page(rows.where(V.everything(tests)), order, None, 5).select("p_partkey", "p_name", "p_brand", "price")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND upper(trim('k' || l_suppkey)) IN ('K1', 'K7'))")
def identifier_filter(spark, sf_dir):
    """Rows named by id or by an active alias row."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit(" k"), "l_suppkey").alias("ticker"), F.when(F.col("l_linestatus") == "O", "active").otherwise("inactive").alias("status"))
    rows = t(spark, sf_dir, "part").withColumn("code", F.col("p_partkey").cast("string"))
    return V.filter_identifiers(rows, lines, "p_partkey", "code", "ticker", ["3", " 5", "8", "5"], ["k1", "K7"]).select("p_partkey", "p_name")


CUT = "1998-07-01"
LISTING_SQL = f"SELECT DISTINCT o_custkey, o_orderpriority, CASE WHEN o_custkey % 4 = 0 THEN 'other' ELSE 'main' END AS source FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'"
OBSERVED_SQL = f"SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'"


def runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """State from the orders before a date and a later run of the source main; an entity is a customer, its listings the priorities."""
    orders = t(spark, sf_dir, "orders")
    before = orders.where(F.col("o_orderdate") < CUT).select("o_custkey", "o_orderpriority").distinct()
    listing = before.withColumn("source", F.when(F.col("o_custkey") % 4 == 0, "other").otherwise("main")).withColumn("status", F.lit("active"))
    return listing, orders.where(F.col("o_orderdate") >= CUT).select("o_custkey", "o_orderpriority")


RECONCILE_SQL = f"""SELECT coalesce(l.o_custkey, s.o_custkey) AS o_custkey, coalesce(l.o_orderpriority, s.o_orderpriority) AS o_orderpriority, CASE WHEN s.o_custkey IS NOT NULL THEN 'main' ELSE source END AS source,
    CASE WHEN s.o_custkey IS NOT NULL THEN 'active' WHEN source = 'main' THEN 'inactive' ELSE 'active' END AS status FROM ({LISTING_SQL}) l FULL JOIN ({OBSERVED_SQL}) s ON l.o_custkey = s.o_custkey AND l.o_orderpriority = s.o_orderpriority"""


@query(RECONCILE_SQL)
def reconcile_state(spark, sf_dir):
    listing, seen = runs(spark, sf_dir)
    return M.reconcile(listing, seen, ["o_custkey", "o_orderpriority"], "source", "main")


@query(
    f"""WITH a AS ({RECONCILE_SQL}), o AS (SELECT DISTINCT o_custkey, 'active' AS previous_status FROM ({LISTING_SQL})), n AS (SELECT o_custkey, CASE WHEN bool_or(status = 'active') THEN 'active' ELSE 'inactive' END AS new_status FROM a GROUP BY 1)
    SELECT 'instrument' AS entity_type, o_custkey, previous_status, new_status, CASE WHEN previous_status IS NULL THEN 'inserted' ELSE 'deactivated' END AS event_type FROM o FULL JOIN n USING (o_custkey) WHERE previous_status IS NULL OR new_status = 'inactive'"""
)
def lifecycle_events(spark, sf_dir):
    listing, seen = runs(spark, sf_dir)
    after = M.reconcile(listing, seen, ["o_custkey", "o_orderpriority"], "source", "main")
    return M.diff_events(M.entity_status(listing, "o_custkey"), M.entity_status(after, "o_custkey"), ["o_custkey"], "instrument")


@query(f"SELECT l.o_custkey, l.o_orderpriority FROM ({LISTING_SQL}) l ANTI JOIN ({OBSERVED_SQL}) s ON l.o_custkey = s.o_custkey AND l.o_orderpriority = s.o_orderpriority")
def listings_not_seen(spark, sf_dir):
    listing, seen = runs(spark, sf_dir)
    return M.not_seen(listing, seen, ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority")


@query(
    """SELECT c_custkey, coalesce(n.seg, o.seg) AS c_mktsegment, coalesce(n.bal, o.bal) AS c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 5 <> 0) o
    FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END AS seg, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 END AS bal FROM customer WHERE c_custkey % 4 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 7 = 0)) n USING (c_custkey)"""
)
def sticky_merge(spark, sf_dir):
    """New values win, known ones are never cleared, rows without any value are not made."""
    k, rows = F.col("c_custkey"), t(spark, sf_dir, "customer")
    old = rows.where(k % 5 != 0).select("c_custkey", F.when(k % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    new = rows.where(k % 4 != 0).select("c_custkey", F.when(k % 3 == 0, F.lower("c_mktsegment")).alias("c_mktsegment"), F.when(k % 7 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return M.merge_profile(old, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query(
    """WITH o AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS r, CASE WHEN event_type <> 'click' THEN value END AS v, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS e FROM events)
    SELECT user_id, first(v ORDER BY r, ts DESC, event_id) FILTER (WHERE v IS NOT NULL) AS v, first(e ORDER BY r, ts DESC, event_id) FILTER (WHERE e IS NOT NULL) AS e FROM o GROUP BY user_id"""
)
def precedence_coalesce(spark, sf_dir):
    """Of each field the first known value, by kind of event, then newest first."""
    kind = F.col("event_type")
    rows = t(spark, sf_dir, "events").select("user_id", F.when(kind != "click", F.col("value")).alias("v"), F.when(kind.isin("click", "view"), kind).alias("e"), F.struct(L.rank_of(kind, ["purchase", "click"]).alias("r"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("o"))
    return L.coalesce_by_precedence(rows, "user_id", F.col("o"), ["v", "e"])


@query(
    """SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k') WHEN event_id % 3 = 1 THEN NULL ELSE 'top' END AS field FROM events"""
)
def payload_extract(spark, sf_dir):
    """A field of layered payloads: a later container wins even with NULL."""
    m = F.col("event_id") % 3
    inner = F.when(m == 0, F.concat(F.lit('{"x":'), F.get_json_object("props", "$.k"), F.lit("}"))).when(m == 1, F.lit('{"x":null}')).otherwise(F.lit("{}"))
    payload = F.concat(F.lit('{"x":"top","parsed":{"x":"first"},"metadata":'), inner, F.lit("}"))
    payload = F.when(m == 2, F.lit('{"x":"top","metadata":{}}')).otherwise(payload)
    return t(spark, sf_dir, "events").select("event_id", T.json_first(F.col("props"), ["none", "k"]).cast("long").alias("k"), T.flatten_payload(payload, "x").alias("field"))


NAME_RULES = R.word_rules("""
warm: RED, HOT, ORANGE
cold: BLUE, COLD, GREEN
little: SMALL, MINI, TINY
""")
PART_RULES = R.word_rules("""
ring: RINGS?
gear: GEARS?, BOLTS?
widget: WIDGET
""")


def classified(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "part").withColumn("txt", R.analysis_text(F.col("p_name")))
    return rows.withColumns({"tone": R.classify(F.col("txt"), NAME_RULES), "thing": R.classify(F.col("txt"), PART_RULES)})


RULE_SQL = """SELECT p_partkey, p_type, p_size, p_brand, p_retailprice, p_name, CASE WHEN regexp_matches(upper(p_name), '\\b(RED|HOT|ORANGE)\\b') THEN 'warm' WHEN regexp_matches(upper(p_name), '\\b(BLUE|COLD|GREEN)\\b') THEN 'cold' WHEN regexp_matches(upper(p_name), '\\b(SMALL|MINI|TINY)\\b') THEN 'little' END AS tone,
    CASE WHEN regexp_matches(upper(p_name), '\\bRINGS?\\b') THEN 'ring' WHEN regexp_matches(upper(p_name), '\\b(GEARS?|BOLTS?)\\b') THEN 'gear' WHEN regexp_matches(upper(p_name), '\\bWIDGET\\b') THEN 'widget' END AS thing FROM part"""


@query(f"SELECT p_partkey, tone, thing, concat_ws('|', 'tone:' || tone, 'thing:' || thing) AS evidence FROM ({RULE_SQL})")
def rule_cascade(spark, sf_dir):
    """Ordered rules, first match wins, with what matched."""
    said = T.evidence([(F.col("tone").isNotNull(), F.concat(F.lit("tone:"), "tone")), (F.col("thing").isNotNull(), F.concat(F.lit("thing:"), "thing"))])
    return classified(spark, sf_dir).select("p_partkey", "tone", "thing", F.concat_ws("|", said).alias("evidence"))


#: Buckets over parts: type and size band, NULL fits anything.
PART_SPECS = (("econ_small", "ECONOMY", "small"), ("econ", "ECONOMY", None), ("large_any", "LARGE", None), ("any_mid", None, "mid"), ("promo_large", "PROMO", "large"))
SPECS_SQL = "(VALUES ('econ_small', 'ECONOMY', 'small'), ('econ', 'ECONOMY', NULL), ('large_any', 'LARGE', NULL), ('any_mid', NULL, 'mid'), ('promo_large', 'PROMO', 'large')) AS s(bucket, st, sb)"
BAND_SQL = "CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'mid' ELSE 'large' END"


def bucketed(spark, sf_dir) -> DataFrame:
    specs = spark.createDataFrame(list(PART_SPECS), "bucket string, st string, sb string")
    rows = t(spark, sf_dir, "part").withColumn("band", size_band(F.col("p_size")))
    fits = (F.col("st").isNull() | (F.col("st") == F.col("p_type"))) & (F.col("sb").isNull() | (F.col("sb") == F.col("band")))
    return rows.join(F.broadcast(specs), fits)  # five specs


@query(f"SELECT bucket, count(*) AS n, min(p_retailprice) AS cheapest FROM part JOIN {SPECS_SQL} ON (st IS NULL OR st = p_type) AND (sb IS NULL OR sb = {BAND_SQL}) GROUP BY bucket")
def bucket_match(spark, sf_dir):
    return bucketed(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("cheapest"))


@query(
    f"""SELECT bucket, rank, p_partkey, p_retailprice FROM (SELECT bucket, p_partkey, p_retailprice, row_number() OVER (PARTITION BY bucket ORDER BY CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END, p_retailprice, p_partkey) AS rank
    FROM part JOIN {SPECS_SQL} ON (st IS NULL OR st = p_type) AND (sb IS NULL OR sb = {BAND_SQL})) WHERE rank <= 5"""
)
def shortlist_topn(spark, sf_dir):
    """The five best parts of each bucket by venue-like rank, price and id."""
    order = [L.rank_of(F.col("p_brand"), ["Brand#1", "Brand#2"]), F.col("p_retailprice"), F.col("p_partkey")]
    return L.top_rows(bucketed(spark, sf_dir), ["bucket"], order, 5, "rank").select("bucket", "rank", "p_partkey", "p_retailprice")


@query(
    f"""WITH a(attempt, cap) AS (VALUES (1, 3), (2, 12), (3, 50)), m AS (SELECT bucket, attempt, p_partkey, row_number() OVER (PARTITION BY bucket, attempt ORDER BY p_retailprice, p_partkey) AS rank
    FROM part JOIN {SPECS_SQL} ON (st IS NULL OR st = p_type) AND (sb IS NULL OR sb = {BAND_SQL}) JOIN a ON p_size <= cap AND p_brand IN ('Brand#3', 'Brand#4')),
    n AS (SELECT s.bucket, attempt, (SELECT count(*) FROM m WHERE m.bucket = s.bucket AND m.attempt = a.attempt) AS n FROM {SPECS_SQL}, a),
    p AS (SELECT bucket, coalesce(min(attempt) FILTER (WHERE n >= 5), max(attempt)) AS attempt FROM n GROUP BY bucket)
    SELECT bucket, attempt, rank, p_partkey FROM m JOIN p USING (bucket, attempt) WHERE rank <= 5"""
)
def fallback_shortlist(spark, sf_dir):
    """Each bucket by the first of three widening attempts that finds enough, else the last."""
    ladder = spark.createDataFrame([(1, 3), (2, 12), (3, 50)], "attempt int, cap int")
    rows = bucketed(spark, sf_dir).where(F.col("p_brand").isin("Brand#3", "Brand#4")).join(F.broadcast(ladder), F.col("p_size") <= F.col("cap"))
    ranked = L.top_rows(rows, ["bucket", "attempt"], [F.col("p_retailprice"), F.col("p_partkey")], 5, "rank")
    every = spark.createDataFrame([(b[0], a) for b in PART_SPECS for a in (1, 2, 3)], "bucket string, attempt int")
    n = every.join(ranked.groupBy("bucket", "attempt").agg(F.count(F.lit(1)).alias("n")), ["bucket", "attempt"], "left").na.fill(0, ["n"])
    return ranked.join(F.broadcast(S.pick_attempt(n, ["bucket"], 5)), ["bucket", "attempt"]).select("bucket", "attempt", "rank", "p_partkey")


@query(
    """SELECT * FROM (SELECT 'large' AS reason, sum((p_size > 40)::INT)::BIGINT AS n FROM part UNION ALL SELECT 'promo', sum((p_type = 'PROMO')::INT)::BIGINT FROM part UNION ALL SELECT 'red', sum(contains(upper(p_name), 'RED')::INT)::BIGINT FROM part UNION ALL SELECT 'kept', sum((p_size <= 40 AND p_type <> 'PROMO' AND NOT contains(upper(p_name), 'RED'))::INT)::BIGINT FROM part)"""
)
def hard_filter_counts(spark, sf_dir):
    """How many rows fail each test, and how many fail none."""
    tests = [("large", F.col("p_size") > 40), ("promo", F.col("p_type") == "PROMO"), ("red", F.upper("p_name").contains("RED"))]
    rows = t(spark, sf_dir, "part").withColumn("why", S.reasons(tests)).withColumn("why", F.when(F.size("why") == 0, F.array(F.lit("kept"))).otherwise(F.col("why")))
    return S.count_reasons(rows, "why", ["large", "promo", "red", "kept"])


@query(
    """SELECT l_returnflag, CASE WHEN c > 0 THEN s / c END AS weighted_value, coalesce(c, 0.0) AS covered_weight, w AS total_weight FROM (SELECT l_returnflag, sum(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END) AS s, sum(CASE WHEN l_discount > 0 THEN l_quantity END) AS c, sum(l_quantity) AS w FROM lineitem GROUP BY 1)"""
)
def weighted_cost(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem")
    return C.weighted_mean(rows, ["l_returnflag"], F.col("l_quantity"), F.when(F.col("l_discount") > 0, F.col("l_discount")))


@query(f"SELECT p_partkey, brand, price FROM ({GAPPY_SQL}) WHERE brand IS NULL OR price IS NULL OR trim(kind) = '' ORDER BY CASE WHEN price IS NULL THEN 0 ELSE 1 END, CASE WHEN brand IS NULL THEN 0 ELSE 1 END, p_partkey NULLS FIRST LIMIT 200")
def work_queue(spark, sf_dir):
    """What to enrich first: rows without a price, then without a brand; a batch of 200."""
    rows = gappy_parts(spark, sf_dir)
    return V.work_queue(rows.where(F.col("brand").isNull() | F.col("price").isNull() | V.blank(F.col("kind"))), [F.col("price").isNull(), F.col("brand").isNull()], "p_partkey", 200).select("p_partkey", "brand", "price")


def export(spark, sf_dir) -> dict[str, DataFrame]:
    customers = t(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(1, 2)).select("c_custkey")
    rich = t(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey")
    ids = customers.union(rich).distinct()
    first = V.closure({"customer": (t(spark, sf_dir, "customer"), "c_custkey"), "orders": (t(spark, sf_dir, "orders"), "o_custkey")}, ids, "c_custkey")
    return first | V.closure({"lineitem": (t(spark, sf_dir, "lineitem"), "l_orderkey")}, first["orders"].select("o_orderkey"), "o_orderkey")


IDS_SQL = "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) OR c_acctbal > 9000"


@query(
    f"""SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_custkey IN ({IDS_SQL}) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN ({IDS_SQL})
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({IDS_SQL}))"""
)
def export_closure(spark, sf_dir):
    """Rows of each table of a bundle restricted to the exported ids."""
    return V.bundle_counts(export(spark, sf_dir))


@query(
    """WITH b AS (SELECT p_partkey, p_name, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first' WHEN p_brand LIKE 'Brand#1%' THEN 'teens' END AS canonical FROM part)
    SELECT p_name AS alias, canonical, p_partkey AS own_id, min(p_partkey) OVER (PARTITION BY canonical) AS target_id FROM b WHERE canonical IS NOT NULL"""
)
def alias_bucket(spark, sf_dir):
    """Names of one canonical group point to its smallest id."""
    group = T.first_match([(F.col("p_brand").isin("Brand#1", "Brand#2"), "first"), (F.col("p_brand").like("Brand#1%"), "teens")])
    return M.alias_targets(t(spark, sf_dir, "part"), group, "p_partkey", "p_name")


@query(
    """WITH f AS (SELECT p_partkey, list_filter(string_split(upper(p_name) || ' ' || p_type || ' ' || upper(p_brand[1:5]), ' '), lambda x: x <> '' AND x NOT IN ('BRAND')) AS k FROM part)
    SELECT array_to_string(k, ' ') AS family, count(*) AS members, min(p_partkey) AS first_id FROM f WHERE len(k) >= 3 GROUP BY 1"""
)
def family_match(spark, sf_dir):
    """Members of each family of names with the same tokens, by an equi join key."""
    name = F.concat_ws(" ", "p_name", "p_type", F.substring("p_brand", 1, 5))
    rows = t(spark, sf_dir, "part").select("p_partkey", T.family_key(name, ["BRAND"]).alias("k")).where(F.size("k") >= 3)
    return rows.groupBy(F.array_join("k", " ").alias("family")).agg(F.count(F.lit(1)).alias("members"), F.min("p_partkey").alias("first_id"))


@query(
    """SELECT p_type, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_name, p_partkey) AS rn FROM (SELECT p_type, p_partkey, p_name,
    (5 * len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring'])) + 3 * len(list_intersect(list_distinct(string_split(p_name, ' ')), ['hot'])) + CASE WHEN p_size > 40 THEN 4 ELSE 0 END)::INT AS score FROM part)) WHERE rn <= 10"""
)
def match_score_topk(spark, sf_dir):
    """The ten candidates of each type that share most tokens with a query."""
    words = lambda *w: F.array(*map(F.lit, w))
    score = T.match_score(F.split("p_name", " "), words("red", "ring"), words("hot"), [(F.col("p_size") > 40, 4)])
    return L.top_rows(t(spark, sf_dir, "part").withColumn("score", score), ["p_type"], [F.col("score").desc(), F.col("p_name"), F.col("p_partkey")], 10).select("p_type", "p_partkey", "score")


@query(
    r"""WITH p AS (SELECT doc_id, string_split(lower(text), 'license') AS p FROM documents), h AS (SELECT doc_id, i - 1 AS i, p[i] AS part FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p WHERE len(p) > 1)),
    v AS (SELECT doc_id, i, CASE WHEN i > 0 THEN list_filter(list_transform(regexp_extract_all(substr(part, 1, 40), '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE), lambda x: x BETWEEN 0 AND 9)[1] END AS a, list_min(list_filter(list_transform(regexp_extract_all(right(part, 40), '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE), lambda x: x BETWEEN 0 AND 9)) AS b FROM h)
    SELECT doc_id, count(*) - 1 AS n_hits, coalesce(first(a ORDER BY i) FILTER (WHERE a IS NOT NULL), min(b)) AS value FROM v GROUP BY doc_id"""
)
def window_value(spark, sf_dir):
    """The first plausible number near each hit of a word in the texts."""
    return X.window_value(t(spark, sf_dir, "documents"), "doc_id", "text", "license", r"(\d+(?:\.\d+)?)", 40, 0.0, 9.0)


@query(
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?is)version.{0,10}?(\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(text, '(?is)BY-NC.{0,10}?(\d+(?:\.\d+)?)', 1), '')) AS version, nullif(regexp_extract(text, '(?is)token.{0,6}?([0-9a-f]{8})', 1), '') AS token FROM documents"""
)
def label_value(spark, sf_dir):
    """Labelled fields of every text: the first value shortly after a label."""
    return X.labelled_fields(t(spark, sf_dir, "documents"), "doc_id", "text", {"version": (["version", "BY-NC"], r"(\d+(?:\.\d+)?)", 10), "token": (["token"], "([0-9a-f]{8})", 6)})


@query(
    r"""SELECT DISTINCT page_id, regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '') AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1)) AS link FROM pages) WHERE regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '') <> ''"""
)
def extract_links(spark, sf_dir):
    return X.extract_links(t(spark, sf_dir, "pages"), "page_id", "html")


@query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html lang="([a-z]+)"', 1), '') AS lang, regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/?#:]+)', 1) AS host,
    nullif(regexp_extract(url, '(?i)/(en|de|fr|it|es|nl)(?:[-_/]|$)', 1), '') AS url_lang FROM pages"""
)
def html_facts(spark, sf_dir):
    """Title, language and host of every page."""
    got = lambda e: T.null_if_blank(F.regexp_extract("html", e, 1))
    return t(spark, sf_dir, "pages").select("page_id", got("(?is)<title[^>]*>(.*?)</title>").alias("title"), got('(?i)<html lang="([a-z]+)"').alias("lang"), T.url_host(F.col("url")).alias("host"), T.url_lang(F.col("url")).alias("url_lang"))


@query(
    r"""WITH h AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '(src\d+|@mail\d+)', 1)) AS code FROM documents), k AS (SELECT DISTINCT '@mail' || s_suppkey AS code FROM supplier)
    SELECT doc_id, code, list_filter(list_transform(regexp_extract_all(substr(text, instr(text, code) + length(code), 60), '(\d+(?:\.\d+)?)', 1), lambda x: x::DOUBLE), lambda x: x BETWEEN 0 AND 50)[1] AS value FROM h JOIN k USING (code)"""
)
def value_after_key(spark, sf_dir):
    """Numbers shortly after known codes that stand in the texts; an equi join on the codes found."""
    keys = t(spark, sf_dir, "supplier").select(F.concat(F.lit("@mail"), "s_suppkey").alias("code"))
    return X.values_after_keys(t(spark, sf_dir, "documents"), "doc_id", "text", keys, "code", r"src\d+|@mail\d+", r"(\d+(?:\.\d+)?)", 60, 0.0, 50.0)


@query(
    """WITH d AS (SELECT doc_id, source, 'u' || (doc_id // 2) AS url, sha256(text) AS digest FROM documents), o AS (SELECT source, url, min(digest) AS old FROM d WHERE doc_id % 2 = 0 GROUP BY 1, 2)
    SELECT doc_id, CASE WHEN old IS NULL OR old = digest THEN d.url ELSE d.url || '#sha256=' || digest[1:12] END AS stored_url, CASE WHEN old IS NULL THEN 'insert' WHEN old = digest THEN 'reuse' ELSE 'version' END AS action FROM d LEFT JOIN o ON d.source = o.source AND d.url = o.url WHERE doc_id % 2 = 1 OR doc_id % 6 = 0"""
)
def version_documents(spark, sf_dir):
    """New documents against stored ones by digest."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("u"), F.floor(F.col("doc_id") / 2)).alias("url"), F.sha2("text", 256).alias("digest"))
    stored = rows.where("doc_id % 2 = 0").groupBy("source", "url").agg(F.min("digest").alias("digest"))
    return M.version_documents(stored, rows.where("doc_id % 2 = 1 or doc_id % 6 = 0"), ["source"], "url", "digest").select("doc_id", "stored_url", "action")


@query(
    """WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1)
    SELECT count(*) AS total, sum((s <> 'P')::INT)::BIGINT AS found, sum((s <> 'P' AND p > 100000)::INT)::BIGINT AS parsed, sum((s <> 'P' AND p > 100000 AND p < 300000)::INT)::BIGINT AS charges FROM l"""
)
def document_funnel(spark, sf_dir):
    """How far the newest row of each key has come, each step within the one before."""
    newest = L.latest_by_id(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return C.funnel(newest, {"found": F.col("o_orderstatus") != "P", "parsed": F.col("o_totalprice") > 100000, "charges": F.col("o_totalprice") < 300000})


@query(
    """SELECT event_type, count(*) AS attempted, sum((value > 10)::INT)::BIGINT AS n_high, sum((user_id % 2 = 0)::INT)::BIGINT AS n_even, round(100.0 * sum((value > 10)::INT)::DOUBLE / count(*), 2) AS pct_high, round(100.0 * sum((user_id % 2 = 0)::INT)::DOUBLE / count(*), 2) AS pct_even FROM events GROUP BY 1"""
)
def stage_kpis(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("high", F.col("value") > 10).withColumn("even", F.col("user_id") % 2 == 0)
    return C.stage_kpis(rows, "event_type", ["high", "even"])


@query(
    """SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase_value, arg_max(value, (ts, event_id)) AS latest_value, arg_max(event_type, (ts, event_id)) AS latest_event_type, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'purchase' END AS purchase_event_type FROM events GROUP BY 1"""
)
def latest_by_source(spark, sf_dir):
    """The newest row of one source beside the newest of any."""
    return L.latest_by_source(t(spark, sf_dir, "events"), "user_id", "event_type", "purchase", ["ts", "event_id"], ["value", "event_type"])


@query("SELECT l_partkey AS p, arg_max(l_returnflag, q) AS l_returnflag, max(q) AS weight FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) + CASE l_returnflag WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.2 ELSE 0.1 END AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def dominant_sector(spark, sf_dir):
    """The label with the largest weight of each key."""
    bump = F.when(F.col("l_returnflag") == "A", 0.3).when(F.col("l_returnflag") == "N", 0.2).otherwise(0.1)
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p"), "l_returnflag").agg(F.sum("l_quantity").alias("q")).withColumn("weight", F.col("q") + bump).withColumn("pos", F.lit(0))
    return L.dominant(rows, "p", "l_returnflag", "weight", "pos")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, segment LIMIT 3")
def top_groups(spark, sf_dir):
    """The three largest groups."""
    return C.count_by(t(spark, sf_dir, "customer"), F.col("c_mktsegment"), "segment").limit(3)
