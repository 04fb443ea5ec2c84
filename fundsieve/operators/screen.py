"""Screening and ranked shortlists: hard filters, bucket matching, ranking, the ladder of fallbacks.

Buckets and attempts are small tables, joined to all rows: every attempt of every bucket is counted in one job, and the
rows of the attempt that counts are ranked per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import whole_words
from .latest import rank_of

# Words of names and issuers that rule a fund out or in.
THEMATIC = whole_words(
    "WATER, HYDROGEN, ROBOTICS?, AI, ARTIFICIAL INTELLIGENCE, AUTOMATION, CYBER, SECURITY, BLOCKCHAIN, METAVERSE, CLOUD, DIGITAL, BATTERY, LITHIUM, URANIUM, "
    "CLEAN ENERGY, NEW ENERGY, SPACE, GENOM(?:IC|ICS), SEMICONDUCTOR, FINTECH, INFRASTRUCTURE, PRIVATE EQUITY, REAL ESTATE, PROPERTY"
)
NON_CORE = whole_words("ALPHA, ENHANCED, RESEARCH, REI, ESG, SRI, SCREENED, CLIMATE, PARIS, LOW CARBON, EXCLUSIONS?")
GOLD_EQUITY = whole_words("MINERS?, MINING, PRODUCERS?, BUGS, ROYALT(?:Y|IES)")
LEVERED = r"\b(?:[2-9]X|LEVERAGED?|INVERSE|SHORT|ULTRA|DAILY)\b|-[1-9]X\b"
NOTES, ISSUER_DENYLIST, SMALL_VALUE_SEEDS = ("ETP", "ETN", "NOTE"), ("LEVERAGE SHARES",), ("IE0003R87OG3",)
VENUES, CURRENCIES, NEEDED = ("XLON", "XETR"), ("USD", "EUR", "GBP"), 5
GOLD_POLICY = "disclosed_non_ucits_physical_gold_exception"

# The bucket catalogue, in order.
BUCKETS = """
equity_global kind=core_global class=equity region=global
equity_us class=equity region=us
equity_europe class=equity region=europe
equity_asia class=equity region=asia
equity_em class=equity region=em
equity_small_cap_value kind=small_cap_value class=equity region=global size=small style=value
equity_global_large_blend class=equity region=global size=large style=blend
equity_global_large_value class=equity region=global size=large style=value
equity_global_large_growth class=equity region=global size=large style=growth
equity_global_mid_blend class=equity region=global size=mid style=blend
equity_global_mid_value class=equity region=global size=mid style=value
equity_global_mid_growth class=equity region=global size=mid style=growth
equity_global_small_blend class=equity region=global size=small style=blend
equity_global_small_growth class=equity region=global size=small style=growth
equity_us_large_blend class=equity region=us size=large style=blend
equity_us_large_value class=equity region=us size=large style=value
equity_us_large_growth class=equity region=us size=large style=growth
equity_us_mid_blend class=equity region=us size=mid style=blend
equity_us_mid_value class=equity region=us size=mid style=value
equity_us_mid_growth class=equity region=us size=mid style=growth
equity_us_small_blend class=equity region=us size=small style=blend
equity_us_small_value class=equity region=us size=small style=value
equity_europe_large_blend class=equity region=europe size=large style=blend
equity_europe_large_value class=equity region=europe size=large style=value
equity_europe_large_growth class=equity region=europe size=large style=growth
equity_europe_mid_blend class=equity region=europe size=mid style=blend
equity_europe_mid_value class=equity region=europe size=mid style=value
equity_europe_mid_growth class=equity region=europe size=mid style=growth
equity_asia_large_blend class=equity region=asia size=large style=blend
equity_asia_large_value class=equity region=asia size=large style=value
equity_asia_large_growth class=equity region=asia size=large style=growth
equity_em_large_blend class=equity region=em size=large style=blend
equity_em_large_value class=equity region=em size=large style=value
equity_em_large_growth class=equity region=em size=large style=growth
equity_sector_technology class=equity sector=technology
equity_sector_health_care class=equity sector=health_care
equity_sector_financials class=equity sector=financials
equity_sector_industrials class=equity sector=industrials
equity_sector_materials class=equity sector=materials
equity_sector_real_estate class=equity sector=real_estate
equity_sector_consumer_cyclical class=equity sector=consumer_cyclical
equity_sector_consumer_defensive class=equity sector=consumer_defensive
equity_sector_communication class=equity sector=communication
equity_sector_utilities class=equity sector=utilities
equity_sector_energy class=equity sector=energy
government_bonds class=bond govt
corporate_bonds class=bond bond=corp
aggregate_bonds class=bond bond=aggregate
inflation_linked_bonds class=bond bond=linkers
short_govt_bonds class=bond govt duration=short
intermediate_govt_bonds class=bond govt duration=intermediate
long_govt_bonds class=bond govt duration=long
short_bonds class=bond duration=short
intermediate_bonds class=bond duration=intermediate
long_bonds class=bond duration=long
cash kind=cash class=cash
gold kind=gold class=commodity commodity=gold
broad_commodities class=commodity commodity=broad_commodities
energy_commodities class=commodity commodity=energy
industrial_metals class=commodity commodity=industrial_metals
silver class=commodity commodity=silver
multi_asset class=multi
"""

# The steps of the ladder by kind of bucket: step, venues, missing fees allowed, mode of matching.
LADDER = (("strict", "selected", False, "strict"), ("fallback_venue_expand", "all", False, "strict"))
LAST_STEP = ("fallback_allow_missing_fees", "all", True, "strict")
LOOSER = {
    "core_global": (("fallback_allow_factor", "all", False, "allow_factor"), ("fallback_allow_missing_fees", "all", True, "allow_factor")),
    "small_cap_value": (("fallback_small_cap_proxy", "all", False, "proxy"), ("fallback_small_cap_proxy_allow_missing_fees", "all", True, "proxy")),
    "cash": (("fallback_short_bond_proxy", "all", False, "bond_proxy"), ("fallback_short_bond_proxy_allow_missing_fees", "all", True, "bond_proxy")),
}


def bucket(name: str, kind: str = "generic", **spec) -> dict:
    none = dict.fromkeys(("spec_class", "spec_region", "spec_size", "spec_style", "spec_sector", "spec_bond", "spec_duration", "spec_commodity"))
    return {"bucket": name, "kind": kind} | none | {"govt_only": 0} | spec


def buckets() -> list[dict]:
    """The bucket catalogue as specs."""
    out = []
    for line in BUCKETS.strip().splitlines():
        name, *parts = line.split(" ")
        spec = dict(p.split("=") for p in parts if "=" in p)
        out.append(bucket(name, spec.pop("kind", "generic"), **{f"spec_{k}": v for k, v in spec.items()}, govt_only=int("govt" in parts)))
    return out


def attempts(specs: Sequence[dict], allow_missing_fees: bool, selected: Sequence[str]) -> list[dict]:
    """bucket, attempt, step, venues, allow_fees, mode: the ladder of each bucket, without repeats of the same search."""
    out = []
    for s in specs:
        seen = set()
        for step, scope, fees, how in (*LADDER, *LOOSER.get(s["kind"], (LAST_STEP,))):
            venues = tuple(VENUES if scope == "all" else selected)
            if (fees and not allow_missing_fees) or (venues, fees, how) in seen:
                continue
            seen.add((venues, fees, how))
            out.append({"bucket": s["bucket"], "attempt": len(seen), "step": step, "venues": list(venues), "allow_fees": fees, "mode": how})
    return out


def spec_frames(spark: SparkSession, specs: Sequence[dict], ladder: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    schema = "bucket string, kind string, spec_class string, spec_region string, spec_size string, spec_style string, spec_sector string, spec_bond string, spec_duration string, spec_commodity string, govt_only int"
    return spark.createDataFrame([tuple(s.values()) for s in specs], schema), spark.createDataFrame([tuple(a.values()) for a in ladder], "bucket string, attempt int, step string, venues array<string>, allow_fees boolean, mode string")


def reasons(tests: Sequence[tuple[str, Column]]) -> Column:
    """The names of all tests that a row fails, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))


def hard_tests(commodity: Column, allow_fees: Column, allow_currency: bool) -> list[tuple[str, Column]]:
    """Eight tests that rule a fund out; commodities may be ETCs, from any id, and notes unless levered."""
    up = F.upper(F.coalesce("instrument_name", F.lit("")))
    note = F.lit(False)
    for w in NOTES:
        note = note | up.contains(w)
    denied = F.lit(False)
    for w in ISSUER_DENYLIST:
        denied = denied | F.upper(F.coalesce("issuer_normalized", F.lit(""))).contains(w)
    kind = F.upper(F.coalesce("instrument_type", F.lit("")))
    return [
        ("instrument_type", ~((kind == "ETF") | (commodity & (kind == "ETC")))),
        ("leverage_flag", F.coalesce("leverage_flag", F.lit(0)) != 0),
        ("inverse_flag", F.coalesce("inverse_flag", F.lit(0)) != 0),
        ("xs_isin", ~commodity & F.upper("isin").startswith("XS")),
        ("name_etp_etn_note", note & (~commodity | up.rlike(LEVERED))),
        ("issuer_denylist", denied),
        ("missing_fees", F.col("ongoing_charges").isNull() & ~allow_fees),
        ("missing_currency", (T.null_if_blank(F.col("currency")).isNull()) & F.lit(not allow_currency)),
    ]


def count_reasons(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """reason, n: how many rows fail each test, in one pass; a row can fail several."""
    wide = rows.agg(*[F.count_if(F.array_contains(column, n)).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in names]))
    return wide.select(pairs.alias("p")).select("p.reason", "p.n")


def matches() -> Column:
    """Whether a fund fits a bucket under an attempt's mode; a spec that is NULL fits anything."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name = F.col("_match")
    size, style = low("equity_size"), low("equity_style")
    topical = F.coalesce("sector", "theme").isNotNull() | name.rlike(THEMATIC)
    govt = (F.coalesce("govt_bond_flag", F.lit(0)) == 1) | (low("bond_type") == "govt")
    fits = lambda spec, c: F.col(spec).isNull() | (F.col(spec) == low(c))
    core = (low("asset_class") == "equity") & (low("geography_region") == "global") & (low("geography_scope") == "global") & ~topical
    strict = F.col("factor").isNull() & size.isin("", "large", "all_cap") & style.isin("", "blend") & ~name.rlike(NON_CORE)
    small = (low("asset_class") == "equity") & (low("geography_region") == "global") & ~topical
    seeded = F.upper("isin").isin(*SMALL_VALUE_SEEDS) | ((size == "small") & (style == "value")) | name.contains("SMALL CAP VALUE")
    money = (low("asset_class") == "cash") | (F.coalesce("cash_flag", F.lit(0)) == 1) | (F.coalesce("cash_proxy_flag", F.lit(0)) == 1)
    proxy = (F.col("mode") == "bond_proxy") & (low("asset_class") == "bond") & (low("duration_bucket") == "short") & govt
    miner = name.rlike(GOLD_EQUITY)
    sized = F.when(F.col("spec_size").isNull(), size.isin("", "large", "all_cap")).otherwise(F.col("spec_size") == size)
    styled = F.when(F.col("spec_style").isNull(), style.isin("", "blend")).otherwise(F.col("spec_style") == style)
    equity = F.when(F.col("spec_sector").isNotNull(), F.col("spec_sector") == low("sector")).otherwise(~topical & ~name.rlike(NON_CORE) & fits("spec_region", "geography_region") & sized & styled & F.col("factor").isNull())
    bond = ((F.col("govt_only") == 0) | govt) & fits("spec_bond", "bond_type") & fits("spec_duration", "duration_bucket")
    generic = (F.col("spec_class") == low("asset_class")) & F.when(F.col("spec_class") == "equity", equity).when(F.col("spec_class") == "bond", bond).when(F.col("spec_class") == "commodity", fits("spec_commodity", "commodity_type") & ~miner).otherwise(F.col("spec_class") == "multi")
    kind = F.col("kind")
    return (
        F.when(kind == "core_global", core & ((F.col("mode") == "allow_factor") | strict))
        .when(kind == "small_cap_value", small & F.when(F.col("mode") == "proxy", (size == "small") | name.contains("SMALL CAP")).otherwise(seeded))
        .when(kind == "cash", money | proxy)
        .when(kind == "gold", (low("asset_class") == "commodity") & (low("commodity_type") == "gold") & ~miner)
        .otherwise(generic)
    )


def preference() -> Column:
    """Points against a fund in a bucket: the fewer, the better."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    points = lambda test, n: F.when(test, n).otherwise(0)
    odd, factor = F.col("_match").rlike(NON_CORE), F.col("factor").isNotNull()
    core = points(odd, 20) + points(factor, 5) + points(F.col("equity_size").isNotNull(), 5) + points(F.col("equity_style").isNotNull(), 5)
    plain = points(odd, 20) + points(F.col("spec_size").isNull() & ~low("equity_size").isin("", "large", "all_cap"), 8) + points(F.col("spec_style").isNull() & ~low("equity_style").isin("", "blend"), 8)
    equity = points(factor, 15) + F.when(F.col("spec_sector").isNull(), plain).otherwise(0)
    kind = F.col("kind")
    return F.when(kind == "core_global", core).when(kind == "small_cap_value", points(low("equity_style") != "value", 20)).when(kind == "cash", points(low("asset_class") != "cash", 10)).when(F.col("spec_class") == "equity", equity).otherwise(0)


def currency_order(user: Sequence[str] = ()) -> list[str]:
    """The user's currencies, upper case, then the usual ones, each once."""
    return list(dict.fromkeys([*[c.strip().upper() for c in user if c.strip()], *CURRENCIES]))


def rank_keys(currencies: Sequence[str]) -> list[Column]:
    """preference, fee missing, fee, venue, currency, isin: a total order."""
    return [F.col("preference"), F.col("ongoing_charges").isNull().cast("int"), F.coalesce("ongoing_charges", F.lit(99.0)), rank_of(F.col("primary_venue"), VENUES), rank_of(F.upper("currency"), currencies, 50, 99), F.col("isin")]


def pick_attempt(counts: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Of each key the first attempt with enough rows, else the last one."""
    enough = F.min(F.when(F.col("n") >= need, F.col("attempt")))
    return counts.groupBy(*keys).agg(F.coalesce(enough, F.max("attempt")).alias("attempt"))


def match_reasons() -> Column:
    """Why a fund that fits a bucket does so, as texts."""
    kind, spec = F.col("kind"), F.col("spec_class")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    said = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}="), F.col(c)))
    small = F.when(F.col("mode") == "proxy", "small_cap_proxy").when(F.upper("isin").isin(*SMALL_VALUE_SEEDS), "small_cap_value_seed")
    small = small.when((low("equity_size") == "small") & (low("equity_style") == "value"), "small_cap_value_taxonomy").otherwise("small_cap_value_name")
    money = (low("asset_class") == "cash") | (F.coalesce("cash_flag", F.lit(0)) == 1) | (F.coalesce("cash_proxy_flag", F.lit(0)) == 1)
    bond = F.when(F.col("govt_only") == 1, F.lit("bond_type=govt")).otherwise(said("bond_type", "spec_bond"))
    generic = F.array(
        F.concat(F.lit("asset_class="), spec),
        said("sector", "spec_sector"),
        F.when(spec == "equity", said("geography_region", "spec_region")),
        F.when(spec == "equity", said("equity_size", "spec_size")),
        F.when(spec == "equity", said("equity_style", "spec_style")),
        F.when(spec == "bond", bond),
        F.when(spec == "bond", said("duration", "spec_duration")),
        F.when(spec == "commodity", said("commodity_type", "spec_commodity")),
    )
    texts = lambda *parts: F.array(*map(F.lit, parts))
    return (
        F.when(kind == "core_global", texts("asset_class=equity", "geography_region=global", "core_scope=global"))
        .when(kind == "small_cap_value", F.array(small))
        .when(kind == "cash", F.array(F.when(money, "asset_class=cash_or_proxy").otherwise("short_govt_bond_proxy")))
        .when(kind == "gold", texts("asset_class=commodity", "commodity_type=gold"))
        .otherwise(F.array_compact(generic))
    )


def selection_reason(currencies: Sequence[str]) -> Column:
    """JSON of a picked row: filters, reasons of the match, rank keys and, for gold, the policy."""
    gold, exception = F.col("bucket") == "gold", F.coalesce("gold_policy_exception_flag", F.lit(0)) == 1
    keys = rank_keys(currencies)
    filters = F.array_compact(
        F.array(
            F.lit("plain_vanilla"),
            F.lit("taxonomy_backed"),
            F.concat(F.lit("bucket="), F.col("bucket")),
            F.concat(F.lit("selection_step="), F.col("step")),
            F.when(gold & exception, F.lit("non_ucits_gold_exception_disclosed")),
        )
    )
    ranks = F.struct(
        F.col("preference").alias("bucket_preference"),
        F.col("ongoing_charges").alias("fee"),
        F.col("primary_venue").alias("venue"),
        "currency",
        keys[3].alias("venue_rank"),
        keys[4].alias("currency_rank"),
        "isin",
    )
    policy = F.when(gold, F.lit(GOLD_POLICY)).alias("bucket_policy")
    apart = F.when(gold & exception, F.lit("non_ucits_physical_gold")).alias("bucket_policy_exception")
    return F.to_json(F.struct(filters.alias("filters"), match_reasons().alias("bucket_reasons"), ranks.alias("rank_keys"), policy, apart))


class Run:
    """A recommendation run over funds: every attempt of every bucket counted in one job, those that count ranked.

    Rows of funds: the shortlist columns of the catalogue. Only rows on an attempt's venues take part; rows whose
    gold_policy_exception_flag is 1 are seen by the gold bucket only.
    """

    def __init__(self, funds: DataFrame, specs: Sequence[dict] | None = None, selected: Sequence[str] = VENUES, currencies: Sequence[str] = (), top: int = 5, allow_missing_fees: bool = False, allow_missing_currency: bool = False):
        self.spark, self.specs, self.top, self.currencies = funds.sparkSession, list(specs or buckets()), top, currency_order(currencies)
        self.allow_missing_currency = allow_missing_currency
        if "gold_policy_exception_flag" not in funds.columns:
            funds = funds.withColumn("gold_policy_exception_flag", F.lit(0))
        self.funds = funds.withColumn("_match", T.name_for_match(F.col("instrument_name")))
        self.ladder = attempts(self.specs, allow_missing_fees, selected)
        spec_df, self.ladder_df = spec_frames(self.spark, self.specs, self.ladder)
        tried = F.broadcast(spec_df.join(self.ladder_df, "bucket"))  # a row for each bucket and attempt
        # every row meets the small table of attempts through its venue and its class; cash also takes proxies
        money = (F.coalesce("cash_flag", F.lit(0)) == 1) | (F.coalesce("cash_proxy_flag", F.lit(0)) == 1) | (F.lower("asset_class") == "bond")
        classes = F.array_distinct(F.array_compact(F.array(F.lower("asset_class"), F.when(money, "cash"))))
        rows = self.funds.withColumn("spec_class", F.explode_outer(classes)).join(tried.withColumn("primary_venue", F.explode("venues")), ["primary_venue", "spec_class"])
        seen = (F.col("bucket") == "gold") | (F.col("gold_policy_exception_flag") != 1)
        failed = reasons(hard_tests(F.col("spec_class") == "commodity", F.col("allow_fees"), allow_missing_currency))
        self.matched = rows.where(seen & matches()).where(F.size(failed) == 0).withColumn("preference", preference())

    def chosen(self) -> DataFrame:
        """bucket, attempt: the first attempt with enough rows, else the last one; rows are counted, not sorted."""
        found = self.matched.groupBy("bucket", "attempt").agg(F.count(F.lit(1)).alias("n"))
        counts = self.ladder_df.select("bucket", "attempt").join(found, ["bucket", "attempt"], "left").na.fill(0, ["n"])
        return pick_attempt(counts, ["bucket"], min(self.top, NEEDED))

    def picked(self, top: int | None = None) -> DataFrame:
        """The rows of each bucket's attempt that counts, with rank and selection_reason; those of other attempts are not sorted."""
        w = Window.partitionBy("bucket", "attempt").orderBy(*rank_keys(self.currencies))
        out = self.matched.join(F.broadcast(self.chosen()), ["bucket", "attempt"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (top or self.top))
        return out.withColumn("selection_reason", selection_reason(self.currencies)).drop("_match")

    def pre_rank(self) -> DataFrame:
        """bucket, rank and the shown fields of the first 20 matches of the attempt that counts."""
        shown = ("isin", F.col("primary_venue").alias("venue"), "ticker", F.col("ongoing_charges").alias("fee"), "currency", "asset_class", "geography_region", "bond_type", "duration_bucket", "instrument_name")
        return self.picked(20).select("bucket", "rank", *shown)

    def shapes(self) -> list[tuple]:
        """The distinct (venues, fees, commodity, gold) of all attempts: what considered and kept rows depend on."""
        kind = {s["bucket"]: (s["spec_class"] == "commodity", s["bucket"] == "gold") for s in self.specs}
        return list(dict.fromkeys((tuple(a["venues"]), a["allow_fees"], *kind[a["bucket"]]) for a in self.ladder))

    def attempt_counts(self) -> DataFrame:
        """One row an attempt that was executed: considered, hard_kept, bucket_matches, final_selected, final.

        What is considered and kept depends on few shapes of attempts, all counted in one pass over the funds.
        """
        shapes, aggs = self.shapes(), []
        number = {shape: i for i, shape in enumerate(shapes)}
        for i, (venues, fees, commodity, gold) in enumerate(shapes):
            here = F.col("primary_venue").isin(*venues) & (F.lit(gold) | (F.col("gold_policy_exception_flag") != 1))
            kept = F.size(reasons(hard_tests(F.lit(commodity), F.lit(fees), self.allow_missing_currency))) == 0
            aggs += [F.count_if(here).alias(f"c{i}"), F.count_if(here & kept).alias(f"k{i}")]
        wide = self.funds.agg(*aggs)
        both = F.explode(F.array(*[F.struct(F.lit(i).alias("shape"), F.col(f"c{i}").alias("considered"), F.col(f"k{i}").alias("hard_kept")) for i in range(len(shapes))]))
        counted = wide.select(both.alias("s")).select("s.*")
        kind = {s["bucket"]: (s["spec_class"] == "commodity", s["bucket"] == "gold") for s in self.specs}
        of = self.spark.createDataFrame([(a["bucket"], a["attempt"], number[(tuple(a["venues"]), a["allow_fees"], *kind[a["bucket"]])]) for a in self.ladder], "bucket string, attempt int, shape int")
        found = self.matched.groupBy("bucket", "attempt").agg(F.count(F.lit(1)).alias("bucket_matches"))
        rows = self.ladder_df.join(of, ["bucket", "attempt"]).join(F.broadcast(counted), "shape").join(found, ["bucket", "attempt"], "left").na.fill(0, ["bucket_matches"])
        last = self.chosen().select("bucket", F.col("attempt").alias("last"))
        rows = rows.join(F.broadcast(last), "bucket").where("attempt <= last")
        selected = F.least("bucket_matches", F.lit(self.top)).cast("long").alias("final_selected")
        return rows.select("bucket", "attempt", "step", F.array_join("venues", ",").alias("venues"), "allow_fees", "mode", "considered", "hard_kept", "bucket_matches", selected, (F.col("attempt") == F.col("last")).alias("final"))


def shortlist(funds: DataFrame, specs: Sequence[dict] | None = None, selected: Sequence[str] = VENUES, currencies: Sequence[str] = (), top: int = 5, allow_missing_fees: bool = False, allow_missing_currency: bool = False) -> DataFrame:
    """The best `top` funds of each bucket by the first attempt that finds enough, with reasons as JSON."""
    run = Run(funds, specs, selected, currencies, top, allow_missing_fees, allow_missing_currency)
    return run.picked().select("bucket", "step", "rank", "isin", "instrument_name", "ongoing_charges", "primary_venue", "currency", "preference", "selection_reason")


def strategies(spark: SparkSession, mixes: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """strategy, bucket, weight; weights may not be negative and buckets must be known."""
    known = {b["bucket"] for b in buckets()}
    rows = [(s, b, float(w)) for s, parts in mixes.items() for b, w in parts]
    if bad := [r for r in rows if r[1] not in known or r[2] < 0]:
        raise ValueError(f"unknown bucket or negative weight: {bad}")
    return spark.createDataFrame(rows, "strategy string, bucket string, weight double")


def held(mixes: Mapping[str, Sequence[tuple[str, float]]]) -> list[dict]:
    """The specs of the buckets that strategies hold: a run for them need not match funds to any other bucket."""
    names = {b for parts in mixes.values() for b, _ in parts}
    return [s for s in buckets() if s["bucket"] in names]


def strategy_rows(mixes: DataFrame, picked: DataFrame) -> DataFrame:
    """Each strategy's buckets with the funds picked for them; buckets are searched once, whoever uses them."""
    return mixes.join(picked, "bucket")


def readiness(mixes: DataFrame, picked: DataFrame) -> DataFrame:
    """The fewest funds that any bucket of a strategy has; empty buckets count as zero."""
    n = picked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return mixes.join(n, "bucket", "left").na.fill(0, ["n"]).groupBy("strategy").agg(F.min("n").alias("fewest"))


def custom_mix(spark: SparkSession, parts: Sequence[tuple[str, float]], whole: bool = False) -> DataFrame:
    """One to ten buckets with weights, as a strategy named custom; `whole` also asks for distinct buckets and 100 percent."""
    if not 1 <= len(parts) <= 10:
        raise ValueError("one to ten buckets")
    if whole and (len({b for b, _ in parts}) < len(parts) or abs(sum(w for _, w in parts) - 100) > 0.05):
        raise ValueError("buckets must be distinct and weights sum to 100")
    return strategies(spark, {"custom": parts})


#: Columns of a run's report besides strategy, bucket and weight.
REPORT = ("isin", "primary_venue", "ticker", "currency", "issuer_normalized", "distribution_policy", "ongoing_charges", "ongoing_charges_asof", "fund_size_value", "fund_size_currency", "instrument_name", "asset_class", "geography_scope", "geography_region", "geography_country", "equity_size", "equity_style", "factor", "sector", "theme", "bond_type", "duration_bucket")


def report_rows(mixes: DataFrame, run: Run) -> DataFrame:
    """The report of all strategies: each one's buckets with weights and picked funds; missing columns are NULL."""
    picked = run.picked()
    shown = [F.col(c) if c in picked.columns else F.lit(None).cast("string").alias(c) for c in REPORT]
    missing = [F.col("ongoing_charges").isNull().cast("int").alias("fee_missing_flag"), T.null_if_blank(F.col("currency")).isNull().cast("int").alias("currency_missing_flag")]
    return F.broadcast(mixes).join(picked.select("bucket", "rank", *shown, *missing, "selection_reason"), "bucket").select("strategy", "bucket", F.col("weight").alias("target_weight"), "rank", *REPORT, "fee_missing_flag", "currency_missing_flag", "selection_reason")


def write_reports(report: DataFrame, path: str) -> None:
    """One CSV with a header a strategy, as folders strategy=...; buckets in order of their rank."""
    report.repartition("strategy").sortWithinPartitions("strategy", "bucket", "rank").write.partitionBy("strategy").option("header", True).mode("overwrite").csv(path)


def emitted(mixes: DataFrame, run: Run) -> DataFrame:
    """strategy, total_rows_emitted, min_candidates_per_bucket: empty buckets count as zero."""
    n = run.picked().groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    of = mixes.join(n, "bucket", "left").na.fill(0, ["n"])
    return of.groupBy("strategy").agg(F.sum("n").alias("total_rows_emitted"), F.min("n").alias("min_candidates_per_bucket"))


def strict_counts(funds: DataFrame, selected: Sequence[str] = VENUES, allow_missing_currency: bool = False) -> DataFrame:
    """considered, kept and one count for each hard filter, for plain funds on the venues with known fees; one pass."""
    tests = hard_tests(F.lit(False), F.lit(False), allow_missing_currency)
    rows = funds.where(F.col("primary_venue").isin(*selected)).select(reasons(tests).alias("failed"))
    each = [F.count_if(F.array_contains("failed", n)).alias(n) for n, _ in tests]
    return rows.agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.size("failed") == 0).alias("kept"), *each)


def snapshot(mixes: DataFrame, run: Run) -> DataFrame:
    """One row a strategy for serving: its buckets in order of weight, each with diagnostics and rows, as nested values."""
    diagnosed = run.attempt_counts().groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("attempt", "step", "venues", "allow_fees", "mode", "considered", "hard_kept", "bucket_matches", "final_selected"))).alias("attempts"),
        F.max(F.when(F.col("final"), F.col("step"))).alias("final_step"),
        F.max(F.when(F.col("final"), F.col("final_selected"))).alias("final_selected"),
        F.max(F.when(F.col("final"), F.col("hard_kept"))).alias("final_hard_kept"),
        F.max(F.when(F.col("final"), F.col("bucket_matches"))).alias("final_bucket_matches"),
    )
    # at most `top` rows a bucket
    rows = run.picked().groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "isin", "instrument_name", "ongoing_charges", "selection_reason"))).alias("rows"))
    part = mixes.join(diagnosed, "bucket", "left").join(rows, "bucket", "left")
    of = F.struct(F.col("weight").alias("target_weight"), "bucket", "final_step", "final_selected", "final_hard_kept", "final_bucket_matches", "attempts", "rows")
    return part.groupBy("strategy").agg(F.sort_array(F.collect_list(of), asc=False).alias("buckets"))


def eligible(instrument: DataFrame, listing: DataFrame, venues: Sequence[str] = VENUES, currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    """The universe: compliant plain ETFs with an active primary listing on the venues, in a known currency or none."""
    primary = listing.where((F.coalesce("primary_flag", F.lit(0)) == 1) & (F.coalesce("status", F.lit("active")) == "active") & F.col("venue_mic").isin(*venues))
    money = T.null_if_blank(F.col("trading_currency"))
    primary = primary.where(money.isNull() | F.upper(money).isin(*currencies)).select("instrument_id", "venue_mic", "ticker", "trading_currency")
    plain = instrument.where((F.col("instrument_type") == "ETF") & (F.col("ucits_flag") == 1) & (F.coalesce("leverage_flag", F.lit(0)) == 0) & (F.coalesce("inverse_flag", F.lit(0)) == 0))
    return plain.join(primary, "instrument_id")


def gold_policy(rows: DataFrame) -> DataFrame:
    """Gold funds inside the universe, exceptions outside it, and gold equity that is left out."""
    gold = F.col("_m").rlike(r"\b(?:GOLD|BULLION)\b")
    miner = F.col("_m").rlike(GOLD_EQUITY)
    out = rows.withColumn("_m", T.name_for_match(F.col("instrument_name"))).agg(
        F.count_if(gold & ~miner & (F.col("universe_mvp_flag") == 1)).alias("eligible"),
        F.count_if(gold & ~miner & (F.coalesce("universe_mvp_flag", F.lit(0)) == 0)).alias("exceptions"),
        F.count_if(gold & miner).alias("ignored"),
    )
    return out.withColumn("note", F.format_string("%d eligible, %d disclosed exceptions, %d gold equity funds left out", "eligible", "exceptions", "ignored"))
