"""Checks of the tables. Each gives rows of one result schema; the numbers behind them are operators of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.exprs import any_of, band, count_when, floored_z, is_blank, mentions_month, month_of, or_missing, outside, psi_term, safe_ratio, severity, sign_rules
from tidemark.operators.dedup import duplicate_summary

Tables = Mapping[str, DataFrame]
RESULT = ("check_name", "check_type", "table_name", "status", "severity", "affected_rows", "affected_columns", "observed_value", "expected_value", "explanation", "recommended_action")

# Required fields, accepted domains, monitored fields.
REQUIRED = {
    "accounts": ("account_id", "open_date", "product_type", "customer_segment", "fico_band", "region", "active_flag", "credit_limit"),
    "transactions": ("transaction_id", "source_transaction_id", "account_id", "transaction_date", "posted_date", "merchant_category", "channel", "transaction_amount", "transaction_type", "is_disputed", "ingestion_batch_id", "source_system"),
    "complaints": ("complaint_id", "account_id", "date_received", "product", "issue", "complaint_narrative", "submitted_via"),
    "account_monthly_snapshot": ("snapshot_month", "account_id", "active_flag", "statement_balance", "credit_limit", "is_30dpd"),
}
ACCEPTED = {
    ("transactions", "transaction_type"): ("purchase", "payment", "fee", "refund"),
    ("transactions", "channel"): ("card_present", "web", "mobile", "recurring", "system"),
    ("transactions", "merchant_category"): ("grocery", "restaurant", "gas", "online_retail", "subscription", "travel", "health", "education", "fee", "payment"),
    ("accounts", "fico_band"): (">660", "<=660"),
    ("accounts", "product_type"): ("cash_rewards", "travel_rewards", "student_card", "secured_card", "venture_style"),
    ("complaints", "issue"): ("Problem with a purchase shown on your statement", "Fees or interest", "Problem when making payments", "Problem with fraud alerts or security"),
}
FOREIGN_KEYS = (("transactions", "account_id", "accounts", "account_id"), ("complaints", "account_id", "accounts", "account_id"), ("account_monthly_snapshot", "account_id", "accounts", "account_id"))
NULL_RATES = (("transactions", "merchant_category"), ("transactions", "channel"), ("transactions", "transaction_amount"), ("transactions", "posted_date"), ("complaints", "issue"), ("complaints", "complaint_narrative"), ("account_monthly_snapshot", "statement_balance"), ("account_monthly_snapshot", "is_30dpd"))
MIXES = (("transactions", "merchant_category"), ("transactions", "channel"))
GOVERNED = ("metric_name", "business_definition", "numerator", "denominator", "grain", "owner", "source_tables", "known_limitations")


@dataclass(frozen=True)
class Thresholds:
    window: int = 6
    min_periods: int = 3
    warn_z: float = 2.0
    fail_z: float = 3.0
    psi_warn: float = 0.10
    psi_fail: float = 0.25
    row_count_floor: float = 0.0
    null_rate_floor: float = 0.002
    kpi_floor: float = 0.001


DEFAULT = Thresholds()


def month_key(table: str) -> Column:
    return {"transactions": month_of(F.col("transaction_date")), "complaints": month_of(F.col("date_received")), "account_monthly_snapshot": F.col("snapshot_month").cast("string")}[table]


# --- numbers ---------------------------------------------------------------


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: rows_with_blank, and blank_<field> for each field; a field that isn't there counts as all blank."""
    there = [c for c in fields if c in df.columns]
    absent = [F.count("*").alias(f"blank_{c}") for c in fields if c not in df.columns]
    return df.agg(count_when(any_of([is_blank(df, c) for c in there])).alias("rows_with_blank"), *[count_when(is_blank(df, c)).alias(f"blank_{c}") for c in there], *absent)


def date_order(df: DataFrame, first: str = "transaction_date", second: str = "posted_date") -> DataFrame:
    lag = F.datediff(F.col(second), F.col(first))
    return df.agg(count_when(F.coalesce(F.col(second) < F.col(first), F.lit(False))).alias("violations"), F.min(lag).alias("min_lag"), F.max(lag).alias("max_lag"), F.count("*").alias("rows"))


def amount_signs(df: DataFrame) -> DataFrame:
    """Violations of each rule, and rows that break any."""
    rules = sign_rules()
    return df.agg(*[count_when(c).alias(k) for k, c in rules.items()], count_when(any_of(list(rules.values()))).alias("rows_in_violation"))


def unaccepted(df: DataFrame, field: str, domain: Sequence[str]) -> DataFrame:
    """violations, and the first five values outside the domain."""
    bad = F.when(outside(df, field, domain), F.col(field))
    # A count for each value first, so that a set of values never grows with the rows.
    per_value = df.groupBy(bad.alias("v")).agg(F.count("*").alias("n")).filter("v is not null")
    rank = F.row_number().over(W.orderBy("v"))
    return per_value.withColumn("r", rank).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.coalesce(F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("v"))))), F.lit("")).alias("examples"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows without a parent (a null key has none) and distinct keys among them."""
    rows = child.select(F.col(key).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    lost = rows.join(parent.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count("k").alias("orphan_keys"))


def scan_series(series: DataFrame, floor: float, t: Thresholds = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """series (by..., month, value) with the mean and deviation of the rows before each, and the floored z."""
    before = W.partitionBy(*by).orderBy("month").rowsBetween(-t.window, -1)
    enough = F.count("value").over(before) >= t.min_periods
    scored = series.withColumns({"baseline_mean": F.when(enough, F.avg("value").over(before)), "baseline_std": F.when(enough, F.stddev_pop("value").over(before))})
    return scored.withColumn("z", floored_z(F.col("value"), F.col("baseline_mean"), F.col("baseline_std"), floor, t.fail_z))


def worst_month(series: DataFrame, floor: float, t: Thresholds = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """by..., the month with the largest absolute z (the earliest of equals), its z, value and baseline, months scored, status."""
    scored = scan_series(series, floor, t, by)
    order = W.partitionBy(*by).orderBy(F.abs("z").desc_nulls_last(), "month")
    everything = W.partitionBy(*by)
    worst = scored.withColumns({"r": F.row_number().over(order), "months_scored": F.count("z").over(everything)}).filter("r = 1").drop("r")
    return worst.withColumn("month", F.when(F.col("z").isNotNull(), F.col("month"))).withColumn("status", band(F.abs("z"), t.warn_z, t.fail_z))


def monthly_counts(df: DataFrame, table: str) -> DataFrame:
    """month, rows"""
    return df.groupBy(month_key(table).alias("month")).agg(F.count("*").alias("rows"))


def monthly_blanks(df: DataFrame, table: str, fields: Sequence[str]) -> DataFrame:
    """field, month, blanks, rows, value (blank rate); all fields in one pass."""
    by_month = df.groupBy(month_key(table).alias("month")).agg(F.count("*").alias("rows"), *[count_when(is_blank(df, c)).alias(c) for c in fields])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("blanks")) for c in fields])).alias("f")
    return by_month.select("month", "rows", each).select("f.field", "month", "f.blanks", "rows", safe_ratio(F.col("blanks"), F.col("rows")).alias("value"))


def monthly_mix(df: DataFrame, table: str, field: str) -> DataFrame:
    """month, bucket, rows, share; every bucket in every month."""
    counts = df.groupBy(month_key(table).alias("month"), or_missing(df, field).alias("bucket")).agg(F.count("*").alias("rows"))
    # Both sides are one row a month or a bucket.
    skeleton = counts.select("month").distinct().crossJoin(counts.select("bucket").distinct())
    full = skeleton.join(counts, ["month", "bucket"], "left").na.fill(0, ["rows"])
    return full.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy("month")))


def psi(mix: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """month, psi, top_bucket, top_rows for months with enough history; the baseline is the mean share of the months before."""
    before = W.partitionBy("bucket").orderBy("month").rowsBetween(-t.window, -1)
    scored = mix.withColumns({"expected": F.avg("share").over(before), "history": F.count("share").over(before)}).filter(F.col("history") >= t.min_periods)
    terms = scored.withColumn("term", psi_term(F.col("share"), F.col("expected")))
    top = F.max(F.struct("term", F.struct("bucket", "rows").alias("b")))
    return terms.groupBy("month").agg(F.sum("term").alias("psi"), F.max_by("bucket", "term").alias("top_bucket"), F.max_by("rows", "term").alias("top_rows"), top.alias("_t")).drop("_t")


def worst_psi(mix: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row: the month with the largest PSI (the earliest of equals), or nulls without enough history."""
    found = psi(mix, t).withColumns({"r": F.row_number().over(W.orderBy(F.desc("psi"), "month")), "months_scored": F.count("*").over(W.partitionBy())})
    one = found.filter("r = 1").agg(*[F.first(c).alias(c) for c in ("month", "psi", "top_bucket", "top_rows", "months_scored")])
    return one.withColumn("status", F.when(F.col("psi").isNull(), "pass").otherwise(band(F.col("psi"), t.psi_warn, t.psi_fail)))


def dispute_series(df: DataFrame) -> DataFrame:
    """month, rows (disputed purchases), value (rate as reported)."""
    bought = df.filter(F.col("transaction_type") == "purchase").groupBy(month_of(F.col("transaction_date")).alias("month"))
    return bought.agg(F.sum("is_disputed").alias("rows"), (F.sum("is_disputed") / F.count("*")).alias("value"))


def governance(catalogue: DataFrame) -> DataFrame:
    """Incomplete KPIs, and the governed fields that the catalogue lacks."""
    there = [c for c in GOVERNED if c in catalogue.columns]
    lacks = [c for c in GOVERNED if c not in catalogue.columns]
    bad = any_of([is_blank(catalogue, c) for c in there]) if not lacks else F.lit(True)
    return catalogue.agg(count_when(bad).alias("incomplete_metrics"), F.lit(", ".join(lacks)).alias("missing_columns"), F.count("*").alias("metrics"))


# --- results ---------------------------------------------------------------


def _result(df: DataFrame, name: str | Column, kind: str, table: str, status: Column, affected: Column, columns: str | Column, observed: Column, expected: str, why: str, then: str, fail: str = "high", warn: str = "medium") -> DataFrame:
    s = F.col("_status")
    return df.withColumn("_status", status).select(
        F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"), F.lit(table).alias("table_name"), s.alias("status"), severity(s, fail, warn).alias("severity"), F.when(s == "pass", 0).otherwise(F.coalesce(affected, F.lit(0))).cast("long").alias("affected_rows"),
        F.lit(columns).alias("affected_columns"), observed.alias("observed_value"), F.lit(expected).alias("expected_value"), F.lit(why).alias("explanation"), F.when(s == "pass", "Nothing to do.").otherwise(F.lit(then)).alias("recommended_action"),
    )


def _fails(count: Column) -> Column:
    return F.when(count > 0, "fail").otherwise("pass")


def _said(template: str, *columns) -> Column:
    return F.format_string(template, *columns)


def check_duplicates(tables: Tables) -> DataFrame:
    n = F.col("surplus_rows")
    return _result(duplicate_summary(tables["transactions"]), "duplicate_source_event_ids", "rule_based", "transactions", _fails(n), n, "source_transaction_id", _said("%d surplus rows of %d repeated events", n, F.col("repeated_keys")), "each event once", "A replayed batch counts an event more than once and inflates every rate built on it.", "Remove replayed events before measuring, and make ingestion idempotent.")


def check_completeness(tables: Tables) -> list[DataFrame]:
    out = []
    for table, fields in REQUIRED.items():
        absent = [c for c in fields if c not in tables[table].columns]
        n = F.col("rows_with_blank")
        blanks = F.concat_ws(", ", *[F.when(F.col(f"blank_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"blank_{c}").cast("string"))) for c in fields])
        status = F.lit("fail") if absent else _fails(n)
        out.append(_result(completeness(tables[table], fields), f"required_field_completeness__{table}", "rule_based", table, status, n, ", ".join(fields), blanks, "no blanks", "Blank required fields drop rows from joins and cuts.", "Backfill the fields from their source." + (f" Absent columns: {', '.join(absent)}." if absent else "")))
    return out


def check_dates(tables: Tables) -> DataFrame:
    n = F.col("violations")
    return _result(date_order(tables["transactions"]), "posted_on_or_after_transaction", "rule_based", "transactions", _fails(n), n, "transaction_date, posted_date", _said("%d rows; lag %s to %s days", n, F.col("min_lag").cast("string"), F.col("max_lag").cast("string")), "posted_date >= transaction_date", "A row that posts before it happens lands in the wrong period.", "Ask the source for the right dates.")


def check_amounts(tables: Tables) -> DataFrame:
    n = F.col("rows_in_violation")
    each = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in sign_rules()])
    return _result(amount_signs(tables["transactions"]), "amount_sign_validity", "rule_based", "transactions", _fails(n), n, "transaction_amount, transaction_type, payment_failed", each, "no violations", "An amount with the wrong sign reverses what it should add up to.", "Correct the signs at the source.")


def check_domains(tables: Tables, accepted: Mapping[tuple[str, str], Sequence[str]] = ACCEPTED) -> list[DataFrame]:
    n = F.col("violations")
    return [_result(unaccepted(tables[t], c, domain), f"accepted_values__{t}__{c}", "rule_based", t, _fails(n), n, c, _said("%d rows; %s", n, F.col("examples")), "one of " + ", ".join(domain), "A value outside the domain is a mapping that changed.", "Map the value or widen the domain.", fail="medium") for (t, c), domain in accepted.items()]


def check_references(tables: Tables) -> list[DataFrame]:
    n = F.col("orphan_rows")
    return [_result(orphans(tables[c], k, tables[p], pk), f"referential_integrity__{c}__{p}", "rule_based", c, _fails(n), n, k, _said("%d rows, %d keys", n, F.col("orphan_keys")), f"each {k} in {p}", "Orphans lose their account columns.", "Load the missing parents.") for c, k, p, pk in FOREIGN_KEYS]


def _anomaly(worst: DataFrame, name: str | Column, kind: str, table: str, columns: str | Column, affected: Column, t: Thresholds, why: str) -> DataFrame:
    observed = F.when(F.col("month").isNull(), "not enough history").otherwise(_said("%s: %.4f, z %.2f (%d months scored)", F.col("month"), F.col("value").cast("double"), F.col("z"), F.col("months_scored")))
    return _result(worst, name, kind, table, F.col("status"), affected, columns, observed, f"|z| < {t.warn_z} against the {t.window} months before", why, "Compare the month with source counts.")


def check_counts(tables: Tables, t: Thresholds = DEFAULT) -> list[DataFrame]:
    out = []
    for table in ("transactions", "complaints", "account_monthly_snapshot"):
        series = monthly_counts(tables[table], table).withColumn("value", F.col("rows").cast("double"))
        out.append(_anomaly(worst_month(series, t.row_count_floor, t), f"monthly_row_count_anomaly__{table}", "statistical", table, "*", F.col("rows"), t, "A jump in rows is a load that ran twice or not at all, or real volume."))
    return out


def check_null_rates(tables: Tables, t: Thresholds = DEFAULT, monitored: Sequence[tuple[str, str]] = NULL_RATES) -> list[DataFrame]:
    out = []
    for table in dict.fromkeys(n for n, _ in monitored):
        fields = [c for n, c in monitored if n == table and c in tables[table].columns]
        # One pass and one plan a table: a row for each of its fields.
        worst = worst_month(monthly_blanks(tables[table], table, fields), t.null_rate_floor, t, by=["field"])
        name = F.concat(F.lit(f"null_rate_drift__{table}__"), F.col("field"))
        out.append(_anomaly(worst, name, "statistical", table, F.col("field"), F.col("blanks"), t, "A field that goes blank moves its rows to another bucket."))
    return out


def check_mixes(tables: Tables, t: Thresholds = DEFAULT, mixes: Sequence[tuple[str, str]] = MIXES) -> list[DataFrame]:
    out = []
    for table, c in mixes:
        observed = F.when(F.col("month").isNull(), "not enough history").otherwise(_said("%s: PSI %.4f, most from %s (%d months scored)", F.col("month"), F.col("psi"), F.col("top_bucket"), F.col("months_scored")))
        out.append(_result(worst_psi(monthly_mix(tables[table], table, c), t), f"category_distribution_drift__{table}__{c}", "statistical", table, F.col("status"), F.col("top_rows"), c, observed, f"PSI < {t.psi_warn}", "A change of mix moves a rate although no segment's rate changed.", "Tell a changed mapping from changed behaviour."))
    return out


def check_kpi(tables: Tables, t: Thresholds = DEFAULT) -> DataFrame:
    return _anomaly(worst_month(dispute_series(tables["transactions"]), t.kpi_floor, t), "kpi_anomaly__dispute_rate", "statistical", "transactions", "is_disputed", F.col("rows"), t, "The KPI as reported left its own recent range.")


def check_governance(catalogue: DataFrame) -> DataFrame:
    n = F.col("incomplete_metrics")
    lacks = [c for c in GOVERNED if c not in catalogue.columns]
    return _result(governance(catalogue), "metric_governance_completeness", "governance", "metric_definitions", F.lit("fail") if lacks else _fails(n), n, ", ".join(GOVERNED), _said("%d of %d KPIs incomplete", n, F.col("metrics")), "every field filled", "A KPI without owner or definition can't be defended.", "Complete the catalogue.", fail="medium")


def ordered(results: DataFrame) -> DataFrame:
    rank = lambda c, *values: F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(99))
    return results.orderBy(rank("status", "fail", "warn", "pass"), rank("severity", "high", "medium", "low", "none"), F.desc("affected_rows"), "check_name")


def run_checks(tables: Tables, thresholds: Thresholds = DEFAULT, accepted: Mapping[tuple[str, str], Sequence[str]] = ACCEPTED) -> DataFrame:
    """All checks, failures first. tables has the four fact and dimension tables and metric_definitions."""
    found = [check_duplicates(tables), *check_completeness(tables), check_dates(tables), check_amounts(tables), *check_domains(tables, accepted), *check_references(tables), *check_counts(tables, thresholds), *check_null_rates(tables, thresholds), *check_mixes(tables, thresholds), check_kpi(tables, thresholds), check_governance(tables["metric_definitions"])]
    return ordered(reduce(DataFrame.unionByName, found))


def summarize(results: DataFrame) -> DataFrame:
    """One row: counts by status, the weighted pass rate (a warning counts half) and the names of what failed or warned."""
    n = lambda s: count_when(F.col("status") == s)
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check_name"))))
    return results.agg(F.count("*").alias("total"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), safe_ratio(n("pass") + n("warn") * 0.5, F.count("*")).alias("weighted_pass_rate"), names("fail").alias("failed_checks"), names("warn").alias("warned_checks"))


def for_selection(results: DataFrame, tables: Sequence[str], months: Sequence[str]) -> DataFrame:
    """The checks that bear on a KPI's tables and months: those that passed, and those that speak of one of the months."""
    said = ("check_name", "affected_columns", "observed_value", "explanation", "recommended_action")
    return ordered(results.filter(F.col("table_name").isin(*tables) & ((F.col("status") == "pass") | mentions_month(said, months))))
