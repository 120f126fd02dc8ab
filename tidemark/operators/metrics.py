"""Seven KPIs, each as reported and after replayed events are removed, by month, rolling window and segment."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.exprs import money, month_of, relative, safe_ratio
from tidemark.operators import periods
from tidemark.operators.dedup import flag_kept

Tables = Mapping[str, DataFrame]
ACCOUNT_CUTS = ("product_type", "fico_band", "customer_segment", "region")
FEE_ISSUE = "Fees or interest"


def _one() -> Column:
    return F.lit(1).cast("long")


def _flag(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Metric:
    """A KPI. numerator and denominator build row expressions that are summed."""

    name: str
    display_name: str
    definition: str
    numerator_label: str
    denominator_label: str
    family: str
    cuts: tuple[str, ...]
    numerator: Callable[[], Column] = _one
    denominator: Callable[[], Column] = _one
    higher_is_bad: bool = True
    lineage: tuple[str, ...] = field(default=())


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("dispute_rate", "Dispute rate", "Purchases that were disputed, of all purchases.", "disputed purchases", "purchases", "purchase", ("merchant_category", "channel", "customer_segment", "product_type", "fico_band", "region"), _flag("is_disputed"), lineage=("transactions", "accounts")),
        Metric("fraud_claim_rate", "Fraud claim rate", "Purchases with a fraud claim, of all purchases.", "purchases with a fraud claim", "purchases", "purchase", ("merchant_category", "channel", "product_type", "fico_band", "region"), _flag("is_fraud_claim"), lineage=("transactions", "accounts")),
        Metric("payment_failure_rate", "Payment failure rate", "Payments that failed or came back, of all payments.", "failed payments", "payments", "payment", ("channel", "product_type", "fico_band", "customer_segment", "region"), _flag("payment_failed"), lineage=("transactions", "accounts")),
        Metric("delinquency_rate_30dpd_balance", "30+ DPD balance rate", "Balance 30 or more days past due, of the balance of active accounts.", "30+ DPD balance", "statement balance", "balance", ACCOUNT_CUTS, lambda: money(F.col("statement_balance")) * F.col("is_30dpd"), lambda: money(F.col("statement_balance")), lineage=("account_monthly_snapshot", "accounts")),
        Metric("net_charge_off_rate_proxy", "Net charge-off proxy", "Charged-off balance times twelve, of the balance of active accounts.", "annualised charge-off balance", "statement balance", "balance", ACCOUNT_CUTS, lambda: money(F.col("charge_off_balance")) * 12, lambda: money(F.col("statement_balance")), lineage=("account_monthly_snapshot", "accounts")),
        Metric("complaint_rate", "Complaint rate", "Complaints per 1,000 active accounts.", "complaints", "active accounts", "complaint_volume", ("product_type", "customer_segment", "fico_band", "region"), lineage=("complaints", "account_monthly_snapshot")),
        Metric("fee_complaint_share", "Fee complaint share", "Complaints about fees or interest, of all complaints.", "fee complaints", "complaints", "complaint_share", ("submitted_via", "product_type", "customer_segment", "fico_band", "region"), lambda: F.when(F.col("issue") == FEE_ISSUE, 1).otherwise(0).cast("long"), lineage=("complaints",)),
    )
}


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"unknown KPI {name!r}; expected one of {list(METRICS)}")
    return METRICS[name]


def with_account_columns(rows: DataFrame, accounts: DataFrame | None, wanted) -> DataFrame:
    """rows with those of the wanted account columns that they lack."""
    absent = [c for c in wanted if accounts is not None and c in accounts.columns and c not in rows.columns]
    return rows.join(accounts.select("account_id", *absent), "account_id", "left") if absent else rows


def metric_rows(tables: Tables, m: Metric) -> DataFrame:
    """Rows with month, kept, n and d (what is summed) and the columns of m's cuts that exist."""
    if m.family in ("purchase", "payment"):
        # Replays are found over all transactions, before any are filtered out.
        rows = flag_kept(tables["transactions"]).filter(F.col("transaction_type") == m.family).withColumn("month", month_of(F.col("transaction_date")))
        rows = with_account_columns(rows, tables.get("accounts"), m.cuts)
    elif m.family == "balance":
        rows = tables["account_monthly_snapshot"].filter("active_flag = 1").withColumn("month", F.col("snapshot_month").cast("string")).withColumn("kept", F.lit(True))
        rows = with_account_columns(rows, tables.get("accounts"), m.cuts)
    elif m.family == "complaint_share":
        rows = tables["complaints"].withColumn("month", month_of(F.col("date_received"))).withColumn("kept", F.lit(True))
    else:
        raise ValueError(f"{m.name} has its numerator and denominator in different tables")
    return rows.select("month", "kept", m.numerator().alias("n"), m.denominator().alias("d"), *[c for c in m.cuts if c in rows.columns])


def _active(tables: Tables) -> DataFrame:
    return tables["account_monthly_snapshot"].filter("active_flag = 1").withColumn("month", F.col("snapshot_month").cast("string"))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def monthly(tables: Tables, name: str, corrected: bool) -> DataFrame:
    """month, metric_name, variant, numerator, denominator, value (complaint_rate: per 1,000)."""
    m = metric(name)
    variant = F.lit("corrected" if corrected else "raw")
    if m.family == "complaint_volume":
        found = _complaint_counts(tables)
        value = safe_ratio(F.col("numerator"), F.col("denominator")) * 1000
    else:
        rows = metric_rows(tables, m)
        found = (rows.filter("kept") if corrected else rows).groupBy("month").agg(_sum(F.col("n")).alias("numerator"), _sum(F.col("d")).alias("denominator"))
        value = safe_ratio(F.col("numerator"), F.col("denominator"))
    return found.select("month", F.lit(name).alias("metric_name"), variant.alias("variant"), "numerator", "denominator", value.alias("value")).orderBy("month")


def _complaint_counts(tables: Tables) -> DataFrame:
    count = tables["complaints"].groupBy(month_of(F.col("date_received")).alias("month")).agg(F.count("*").cast("double").alias("numerator"))
    active = _active(tables).groupBy("month").agg(F.count_distinct("account_id").cast("double").alias("denominator"))
    return count.join(active, "month", "full").na.fill(0.0, ["numerator", "denominator"])


def _finished(sums: DataFrame) -> DataFrame:
    raw, corrected = safe_ratio(F.col("raw_numerator"), F.col("raw_denominator")), safe_ratio(F.col("corrected_numerator"), F.col("corrected_denominator"))
    return sums.select(
        "month", "period_grain", "start_month", "end_month", "period_months", "metric_name", "raw_numerator", "raw_denominator", raw.alias("raw_value"), "corrected_numerator", "corrected_denominator", corrected.alias("corrected_value"),
        (F.col("raw_numerator") - F.col("corrected_numerator")).alias("duplicate_numerator_removed"), (F.col("raw_denominator") - F.col("corrected_denominator")).alias("duplicate_denominator_removed"), (raw - corrected).alias("value_difference"),
    )


def monthly_trend(tables: Tables, name: str) -> DataFrame:
    """Raw and corrected in one pass: the corrected sums count only the rows that stay."""
    m = metric(name)
    if m.family == "complaint_volume":
        sums = _complaint_counts(tables).select("month", *[F.col(c).alias(f"{v}_{c}") for v in ("raw", "corrected") for c in ("numerator", "denominator")])
    else:
        kept = lambda c: F.when(F.col("kept"), F.col(c))
        sums = metric_rows(tables, m).groupBy("month").agg(_sum(F.col("n")).alias("raw_numerator"), _sum(F.col("d")).alias("raw_denominator"), _sum(kept("n")).alias("corrected_numerator"), _sum(kept("d")).alias("corrected_denominator"))
    sums = sums.withColumns({"period_grain": F.lit("monthly"), "start_month": F.col("month"), "end_month": F.col("month"), "period_months": F.array("month"), "metric_name": F.lit(name)})
    return _finished(sums).orderBy("month")


def trend(tables: Tables, name: str, grain: str = "monthly") -> DataFrame:
    """Sums over rolling windows of months; rates are never averaged, and incomplete windows are left out."""
    by_month = monthly_trend(tables, name)
    k = periods.width_of(grain)
    if k == 1:
        return by_month
    run = W.orderBy("month").rowsBetween(-(k - 1), 0)
    parts = ("raw_numerator", "raw_denominator", "corrected_numerator", "corrected_denominator")
    sums = by_month.select("month", "metric_name", F.collect_list("month").over(run).alias("period_months"), *[F.sum(c).over(run).alias(c) for c in parts]).filter(F.size("period_months") == k)
    first, last = F.col("period_months")[0], F.col("month")
    sums = sums.withColumns({"start_month": first, "end_month": last, "period_grain": F.lit(grain)}).withColumn("month", F.concat(first, F.lit(" to "), last))
    return _finished(sums).orderBy("end_month")


def selected(trend_table: DataFrame, current: str, previous: str) -> DataFrame:
    """The trend's rows of two periods, the earlier first."""
    return trend_table.withColumn("place", F.when(F.col("month") == previous, 0).when(F.col("month") == current, 1)).filter("place is not null").orderBy("place")


def comparison(trend_table: DataFrame, name: str, current: str, previous: str) -> DataFrame:
    """Two rows, raw and corrected."""
    at = lambda p, c: F.max(F.when(F.col("month") == p, F.col(c)))
    found = trend_table.agg(*[at(p, f"{v}_{c}").alias(f"{w}_{v}_{c}") for w, p in (("current", current), ("previous", previous)) for v in ("raw", "corrected") for c in ("value", "numerator", "denominator")])
    change = F.col("current_value") - F.col("previous_value")
    both = found.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), *[F.col(f"{w}_{v}_{c}").alias(f"{w}_{c}") for w in ("current", "previous") for c in ("value", "numerator", "denominator")]) for v in ("raw", "corrected")])).alias("r")).select("r.*")
    return both.select(
        F.lit(name).alias("metric_name"), "variant", F.lit(current).alias("current_period"), F.lit(previous).alias("previous_period"), "current_value", "previous_value", change.alias("absolute_change"), relative(change, F.col("previous_value")).alias("percent_change"),
        "current_numerator", "current_denominator", "previous_numerator", "previous_denominator",
    )


def remediation(trend_table: DataFrame, name: str, period: str) -> DataFrame:
    """What removing replays did to one period."""
    return trend_table.filter(F.col("month") == period).select(
        F.lit(name).alias("metric_name"), F.lit(period).alias("period"), "raw_value", "corrected_value", "value_difference", "raw_numerator", "corrected_numerator", "duplicate_numerator_removed", "raw_denominator", "corrected_denominator", "duplicate_denominator_removed",
    )


def _per_segment(rows: DataFrame, cuts: list[str], current: list[str], previous: list[str]) -> DataFrame:
    """n and d by segment and period, in one pass over all cuts. A month may belong to both periods."""
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("segment_name"), F.col(c).cast("string").alias("segment_value")) for c in cuts])).alias("s")
    inside = rows.filter(F.col("month").isin(*set(current + previous))).select("month", "n", "d", cut)
    part = lambda c, months: _sum(F.when(F.col("month").isin(*months), F.col(c)))
    return inside.groupBy("s.segment_name", "s.segment_value").agg(part("n", previous).alias("previous_numerator"), part("n", current).alias("current_numerator"), part("d", previous).alias("previous_denominator"), part("d", current).alias("current_denominator"))


def _complaints_per_segment(tables: Tables, cuts: list[str], current: list[str], previous: list[str]) -> DataFrame:
    """Complaints and distinct active accounts by segment; rows without a segment value are left out."""
    accounts = tables.get("accounts")
    count = with_account_columns(tables["complaints"].withColumn("month", month_of(F.col("date_received"))), accounts, cuts)
    active = with_account_columns(_active(tables), accounts, cuts)
    cuts = [c for c in cuts if c in count.columns and c in active.columns]
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("segment_name"), F.col(c).cast("string").alias("segment_value")) for c in cuts])).alias("s")
    months = {"previous": previous, "current": current}
    split = lambda rows: rows.filter(F.col("month").isin(*set(current + previous))).select("month", "account_id", cut).filter("s.segment_value is not null").groupBy("s.segment_name", "s.segment_value")
    n = split(count).agg(*[_sum(F.when(F.col("month").isin(*v), 1)).alias(f"{k}_numerator") for k, v in months.items()])
    d = split(active).agg(*[F.count_distinct(F.when(F.col("month").isin(*v), F.col("account_id"))).cast("double").alias(f"{k}_denominator") for k, v in months.items()])
    return n.join(d, ["segment_name", "segment_value"], "full").na.fill(0.0)


def segment_drivers(tables: Tables, name: str, current_months: list[str], previous_months: list[str], min_denominator: int = 100) -> DataFrame:
    """Movement of each segment value between two periods, over corrected rows."""
    m = metric(name)
    if m.family == "complaint_volume":
        sums, scale = _complaints_per_segment(tables, list(m.cuts), current_months, previous_months), 1000
    else:
        rows = metric_rows(tables, m).filter("kept")
        sums, scale = _per_segment(rows, [c for c in m.cuts if c in rows.columns], current_months, previous_months), 1
    rate = lambda w: safe_ratio(F.col(f"{w}_numerator"), F.col(f"{w}_denominator")) * scale
    found = sums.withColumns({"numerator_change": F.col("current_numerator") - F.col("previous_numerator"), "denominator_change": F.col("current_denominator") - F.col("previous_denominator"), "previous_value": rate("previous"), "current_value": rate("current")})
    found = found.withColumn("absolute_change", F.col("current_value") - F.col("previous_value"))
    gain = F.greatest(F.col("numerator_change"), F.lit(0.0))
    total = F.sum(gain).over(W.partitionBy("segment_name"))
    return found.select(
        "segment_name", "segment_value", "previous_numerator", "current_numerator", "numerator_change", "previous_denominator", "current_denominator", "denominator_change", "previous_value", "current_value", "absolute_change",
        relative(F.col("absolute_change"), F.col("previous_value")).alias("percent_change"), F.coalesce(safe_ratio(gain, total), F.lit(0.0)).alias("contribution_share_of_positive_change"), (F.least("previous_denominator", "current_denominator") < min_denominator).alias("min_denominator_flag"),
    ).orderBy(F.desc("numerator_change"), F.desc_nulls_last("absolute_change"), "segment_name", "segment_value")


@dataclass(frozen=True, eq=False)
class MetricReport:
    """What is known of one KPI and period."""

    metric: Metric
    current_period: str
    previous_period: str
    trend: DataFrame
    comparison: DataFrame
    remediation: DataFrame
    drivers: DataFrame
    definition: dict[str, Any]


def definition(tables: Tables, name: str) -> dict[str, Any]:
    """The catalogue's row, or what the KPI itself says."""
    m = metric(name)
    catalogue = tables.get("metric_definitions")
    row = catalogue.filter(F.col("metric_name") == name).first() if catalogue is not None else None
    return row.asDict() if row else {"metric_name": name, "business_definition": m.definition, "numerator": m.numerator_label, "denominator": m.denominator_label, "grain": "monthly", "source_tables": ", ".join(m.lineage)}


def report(tables: Tables, name: str, grain: str = "monthly", current: str | None = None, previous: str | None = None, min_denominator: int = 100) -> MetricReport:
    table = trend(tables, name, grain)
    current, previous = periods.resolve(table, current, previous)
    months = [periods.months_of(table, p) for p in (current, previous)]
    return MetricReport(metric(name), current, previous, table, comparison(table, name, current, previous), remediation(table, name, current), segment_drivers(tables, name, *months, min_denominator), definition(tables, name))


def governance_table(spark: SparkSession) -> DataFrame:
    """The KPI catalogue as a table."""
    rows = [(m.name, m.definition, m.numerator_label, m.denominator_label, "monthly", "monthly", "Analytics", ", ".join(m.lineage), "Synthetic data.") for m in METRICS.values()]
    return spark.createDataFrame(rows, "metric_name string, business_definition string, numerator string, denominator string, grain string, refresh_frequency string, owner string, source_tables string, known_limitations string")
