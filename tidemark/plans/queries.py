"""One query an operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import actions, dedup, drivers, evidence, metrics, periods, quality, sqlviews, themes
from tidemark.plans.report import settled
from tidemark.sources import roles, synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW, BEFORE = "2001-10", "2001-09"  # the last full months of the transactions
QUARTER, QUARTER_BEFORE = ["2001-08", "2001-09", "2001-10"], ["2001-07", "2001-08", "2001-09"]
TEXT_NOW, TEXT_BEFORE = "2001-08", "2001-07"
TAXONOMY = {
    "english": ("the of and to in is that with", "this is from the and that was"),
    "french": ("de la le et les des en un une que", "le la les dans pour par sur"),
    "german": ("der die und das ist nicht mit ein", "von zu den auf eine sich"),
    "spanish": ("de la el que y en los una con", "las del por se no es"),
    themes.UNCLEAR: ("general question about something else",),
}
DOMAINS = {("transactions", "channel"): ("1-URGENT", "2-HIGH", "3-MEDIUM"), ("accounts", "fico_band"): (">660", "<=660"), ("transactions", "transaction_type"): ("purchase", "payment", "fee", "refund"), ("complaints", "issue"): roles.ISSUES[:3], ("transactions", "merchant_category"): ("PROMO BURNISHED COPPER", "STANDARD ANODIZED TIN"), ("accounts", "product_type"): ("product_0", "product_1", "product_2")}
PROBES = {"license": "[Ll]icen[sc]e", "address": "@", "table": r"\|", "number": "[0-9]{3}"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return roles.tables(spark, sf_dir) | {"metric_definitions": metrics.governance_table(spark)}


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("period_months", F.array_join("period_months", "|"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


# --- replays and trends --------------------------------------------------------


@query
def dedup_events(spark, sf_dir):
    return dedup.deduplicate(roles.transactions(spark, sf_dir)).select("source_transaction_id", "transaction_id", "account_id", "transaction_type", "is_disputed")


@query
def removed_duplicates(spark, sf_dir):
    return dedup.removed(roles.transactions(spark, sf_dir)).select("source_transaction_id", "transaction_id", "transaction_type")


@query
def duplicate_count(spark, sf_dir):
    return dedup.duplicate_summary(roles.transactions(spark, sf_dir))


@query
def top_batches(spark, sf_dir):
    return dedup.top_batches(roles.transactions(spark, sf_dir))


def _monthly(name: str, kpi: str, corrected: bool) -> None:
    QUERIES[name] = lambda spark, sf_dir: metrics.monthly(_tables(spark, sf_dir), kpi, corrected).drop("variant", "metric_name")


_monthly("monthly_rate_raw", "dispute_rate", False)
_monthly("monthly_rate_corrected", "dispute_rate", True)
_monthly("fraud_rate_monthly", "fraud_claim_rate", True)
_monthly("payment_failure_monthly", "payment_failure_rate", True)
_monthly("balance_delinquency_monthly", "delinquency_rate_30dpd_balance", False)
_monthly("charge_off_monthly", "net_charge_off_rate_proxy", False)
_monthly("complaint_rate_monthly", "complaint_rate", False)
_monthly("fee_share_monthly", "fee_complaint_share", False)


@query
def trend_raw_vs_corrected(spark, sf_dir):
    return _flat(metrics.monthly_trend(roles.tables(spark, sf_dir), "dispute_rate"))


@query
def trend_rolling_quarter(spark, sf_dir):
    return _flat(metrics.trend(roles.tables(spark, sf_dir), "dispute_rate", "quarterly"))


@query
def trend_rolling_half(spark, sf_dir):
    return _flat(metrics.trend(roles.tables(spark, sf_dir), "payment_failure_rate", "semiannual"))


@query
def period_windows(spark, sf_dir):
    months = roles.transactions(spark, sf_dir).select(X.month_of(F.col("transaction_date")).alias("month")).distinct()
    return _flat(periods.windows(months, "quarterly"))


@query
def available_periods(spark, sf_dir):
    table = metrics.trend(roles.tables(spark, sf_dir), "fraud_claim_rate", "quarterly")
    return table.filter("corrected_denominator > 0").select("month", "start_month", "end_month", "corrected_denominator")


@query
def trend_long(spark, sf_dir):
    table = metrics.monthly_trend(roles.tables(spark, sf_dir), "dispute_rate")
    return table.select("month", F.expr("stack(2, 'raw', raw_value, 'corrected', corrected_value) AS (variant, value)"))


@query
def period_comparison(spark, sf_dir):
    return metrics.comparison(metrics.monthly_trend(roles.tables(spark, sf_dir), "dispute_rate"), "dispute_rate", NOW, BEFORE)


@query
def selected_trend(spark, sf_dir):
    return _flat(metrics.selected(metrics.monthly_trend(roles.tables(spark, sf_dir), "dispute_rate"), NOW, BEFORE))


@query
def ground_truth_rates(spark, sf_dir):
    return synthetic.ground_truth(roles.tables(spark, sf_dir))


@query
def dispute_leaders(spark, sf_dir):
    return drivers.dispute_leaders(drivers.purchase_facts(roles.tables(spark, sf_dir)), NOW)


@query
def remediation_impact(spark, sf_dir):
    return metrics.remediation(metrics.monthly_trend(roles.tables(spark, sf_dir), "dispute_rate"), "dispute_rate", NOW)


# --- segments --------------------------------------------------------------------


def _view(name: str, view: str) -> None:
    def run(spark, sf_dir):
        sqlviews.create(spark, roles.tables(spark, sf_dir))
        return spark.table(view)

    QUERIES[name] = run


_view("segment_rate_category", "segment_merchant_category")
_view("segment_rate_channel", "segment_channel")
_view("segment_rate_interaction", "segment_category_channel")


@query
def sql_parity(spark, sf_dir):
    return sqlviews.parity(spark, roles.tables(spark, sf_dir))


def _segments(spark, sf_dir):
    return drivers.segment_drivers(drivers.purchase_facts(roles.tables(spark, sf_dir)), NOW, BEFORE, 50)


@query
def segment_drivers(spark, sf_dir):
    return _segments(spark, sf_dir)


@query
def count_drivers_topn(spark, sf_dir):
    return drivers.count_drivers(_segments(spark, sf_dir), 10)


@query
def rate_deterioration(spark, sf_dir):
    return drivers.rate_deterioration(_segments(spark, sf_dir), n=10)


def _pairs(spark, sf_dir, least=10):
    return drivers.interaction_drivers(drivers.purchase_facts(roles.tables(spark, sf_dir)), "merchant_category", "channel", NOW, BEFORE, least)


@query
def interaction_drivers(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def interaction_heatmap(spark, sf_dir):
    return drivers.heatmap(_pairs(spark, sf_dir), "disputed_change", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query
def heat_domain(spark, sf_dir):
    return drivers.heat_domain(_pairs(spark, sf_dir))


@query
def segment_drivers_generic(spark, sf_dir):
    return metrics.segment_drivers(roles.tables(spark, sf_dir), "fraud_claim_rate", [NOW], [BEFORE])


@query
def segment_drivers_quarterly(spark, sf_dir):
    return metrics.segment_drivers(roles.tables(spark, sf_dir), "fraud_claim_rate", QUARTER, QUARTER_BEFORE)


@query
def complaint_rate_segments(spark, sf_dir):
    return metrics.segment_drivers(roles.tables(spark, sf_dir), "complaint_rate", [TEXT_NOW], [TEXT_BEFORE])


@query
def missing_bucket(spark, sf_dir):
    rows = roles.transactions(spark, sf_dir)
    return rows.groupBy(X.or_missing(rows, "merchant_category").alias("merchant_category")).agg(F.count("*").alias("rows"), F.sum("is_disputed").alias("disputed"))


@query
def tree_rules(spark, sf_dir):
    return drivers.tree_rules(drivers.purchase_facts(roles.tables(spark, sf_dir)), NOW, min_leaf=20)


LEAVES = [[("channel", "==", "1-URGENT"), ("fico_band", "==", "<=660")], [("channel", "==", "1-URGENT"), ("fico_band", "!=", "<=660")], [("channel", "!=", "1-URGENT")]]


@query
def leaf_summary(spark, sf_dir):
    return drivers.leaf_summary(drivers.purchase_facts(roles.tables(spark, sf_dir)).filter(F.col("month") == NOW), LEAVES)


# --- sources and sinks -------------------------------------------------------------


@query
def csv_round_trip(spark, sf_dir):
    """Written as CSV by all tasks, found where there is no Parquet, read with the declared schema, dates parsed."""
    rows, where = roles.transactions(spark, sf_dir), tables.scratch(spark, "csv")
    tables.write_csv(rows, f"{where}/transactions.csv")
    back = tables.load_tables(spark, where, ["transactions"], {"transactions": rows.schema})["transactions"]
    return back.select("transaction_id", "transaction_date", "posted_date", F.coalesce("merchant_category", F.lit("")).alias("merchant_category"), "transaction_amount", "is_disputed")


@query
def parquet_round_trip(spark, sf_dir):
    """Written as Parquet by month, found before CSV; only the months asked for are read."""
    rows, where = roles.transactions(spark, sf_dir), tables.scratch(spark, "parquet")
    tables.write_parquet(rows.withColumn("month", X.month_of(F.col("transaction_date"))), f"{where}/transactions.parquet", ["month"])
    back = tables.resolve(spark, None, where, ["transactions"])["transactions"].filter(F.col("month").cast("string").isin(NOW, BEFORE))
    return back.groupBy(F.col("month").cast("string").alias("month"), "channel").agg(F.count("*").alias("rows"), F.sum("is_disputed").alias("disputed"))


@query
def aliased_views(spark, sf_dir):
    """Tables under their old names, handed to SQL under their own."""
    tables.register({"snapshots": roles.snapshots(spark, sf_dir)})
    tables.run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW active_by_month AS SELECT snapshot_month AS month, count(DISTINCT account_id) AS active FROM account_monthly_snapshot WHERE active_flag = 1 GROUP BY 1;")
    return spark.table("active_by_month")


# --- quality -----------------------------------------------------------------------


@query
def completeness(spark, sf_dir):
    return quality.completeness(roles.transactions(spark, sf_dir), ("transaction_id", "account_id", "merchant_category", "channel", "transaction_amount"))


@query
def date_order_violations(spark, sf_dir):
    return quality.date_order(roles.transactions(spark, sf_dir))


@query
def amount_sign_rules(spark, sf_dir):
    return quality.amount_signs(roles.transactions(spark, sf_dir))


@query
def accepted_values(spark, sf_dir):
    tables = roles.tables(spark, sf_dir)
    found = [quality.unaccepted(tables[t], c, d).select(F.lit(t).alias("table_name"), F.lit(c).alias("field"), "violations", "examples") for (t, c), d in DOMAINS.items()]
    return reduce(DataFrame.unionByName, found)


@query
def fk_orphans(spark, sf_dir):
    t = roles.tables(spark, sf_dir)
    found = [quality.orphans(t[c], k, t[p], pk).select(F.lit(c).alias("child"), "orphan_rows", "orphan_keys") for c, k, p, pk in quality.FOREIGN_KEYS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _count_series(spark, sf_dir):
    return quality.monthly_counts(roles.transactions(spark, sf_dir), "transactions").withColumn("value", F.col("rows").cast("double"))


@query
def row_count_anomaly(spark, sf_dir):
    return _rounded(quality.scan_series(_count_series(spark, sf_dir), 0.0), "baseline_mean", "baseline_std", "z")


@query
def worst_month_scan(spark, sf_dir):
    return _rounded(quality.worst_month(_count_series(spark, sf_dir), 0.0), "baseline_mean", "baseline_std", "z")


@query
def null_rate_drift(spark, sf_dir):
    series = quality.monthly_blanks(roles.transactions(spark, sf_dir), "transactions", ("merchant_category", "channel", "posted_date"))
    return _rounded(quality.worst_month(series, 0.002, by=["field"]), "baseline_mean", "baseline_std", "z", "value")


@query
def category_psi(spark, sf_dir):
    return _rounded(quality.psi(quality.monthly_mix(roles.transactions(spark, sf_dir), "transactions", "merchant_category")), "psi")


@query
def kpi_anomaly(spark, sf_dir):
    return _rounded(quality.worst_month(quality.dispute_series(roles.transactions(spark, sf_dir)), 0.001), "baseline_mean", "baseline_std", "z")


@query
def governance_completeness(spark, sf_dir):
    catalogue = _table(spark, sf_dir, "part").select(F.col("p_name").alias("metric_name"), F.col("p_type").alias("business_definition"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_brand")).alias("numerator"), *[F.col("p_brand").alias(c) for c in ("denominator", "grain", "owner", "source_tables")], F.when(F.col("p_partkey") % 13 != 0, "known").alias("known_limitations"))
    return quality.governance(catalogue)


@query
def quality_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pass").when(F.col("o_orderstatus") == "P", "warn").otherwise("fail")
    results = _table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("check_name"), status.alias("status")).distinct()
    return quality.summarize(results).withColumns({c: F.array_join(c, "|") for c in ("failed_checks", "warned_checks")})


@query
def quality_report(spark, sf_dir):
    found = quality.run_checks(_tables(spark, sf_dir), accepted=DOMAINS)
    return found.select("check_name", "check_type", "table_name", "status", "severity", "affected_rows", "affected_columns", F.md5(F.concat_ws("|", "check_name", "status").cast("binary")).alias("finding"))


# --- text ----------------------------------------------------------------------------


@query
def keyword_probes(spark, sf_dir):
    rows = themes.facts(roles.tables(spark, sf_dir)).select("month", "narrative")
    n = lambda p, m: X.count_when(F.col("narrative").rlike(p) & (F.col("month") == m))
    counted = rows.agg(*[n(p, m).alias(f"{k}_{w}") for k, p in PROBES.items() for w, m in (("previous", TEXT_BEFORE), ("current", TEXT_NOW))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.col(f"{k}_previous").alias("previous"), F.col(f"{k}_current").alias("current")) for k in PROBES])).alias("p")
    return counted.select(each).select("p.*").withColumn("change", F.col("current") - F.col("previous")).orderBy(F.desc("change"), "probe")


@query
def tokenize(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"))


@query
def ngrams(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", X.ngrams(X.tokens(F.col("text")), 2).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_pairs"), F.md5(F.array_join("p", "|").cast("binary")).alias("pairs_md5"))


@query
def hash_vectors(spark, sf_dir):
    found = themes.sparse_vectors(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.sum("weight").alias("terms"), F.sum(F.col("weight") * F.col("weight")).alias("squares"), F.sum(F.col("weight") * F.col("bucket")).alias("moment"))


@query
def cosine_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    probe = rows.agg(F.min_by("v", "vec_id").alias("q"))
    return rows.join(F.broadcast(probe)).select("vec_id", F.round(X.cosine(F.col("v"), F.col("q")), 9).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


def _labelled(spark, sf_dir):
    return themes.assign(themes.facts(roles.tables(spark, sf_dir)), TAXONOMY, min_similarity=0.02)


@query
def theme_assignment(spark, sf_dir):
    return _labelled(spark, sf_dir).select("complaint_id", "theme_name", F.round("theme_similarity", 9).alias("theme_similarity"))


@query
def theme_summary(spark, sf_dir):
    return _rounded(themes.summary(_labelled(spark, sf_dir), TEXT_NOW, TEXT_BEFORE, TAXONOMY), "avg_similarity")


@query
def segment_themes(spark, sf_dir):
    return _rounded(themes.by_segment(_labelled(spark, sf_dir), TEXT_NOW, TEXT_BEFORE, ("merchant_category", "channel"), TAXONOMY), "avg_similarity")


@query
def representative_docs(spark, sf_dir):
    return _rounded(themes.representatives(_labelled(spark, sf_dir), 3, TEXT_NOW), "similarity").select("theme_name", "rank", "complaint_id", "similarity")


@query
def theme_assignment_blake2(spark, sf_dir):
    rows = themes.facts(roles.tables(spark, sf_dir))
    return themes.assign(rows, TAXONOMY, embedder=themes.blake2_embedder()).select("complaint_id", "theme_name", "theme_similarity", "embedding_backend")


@query
def emerging_clusters(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("complaint_id"), F.col("text").alias("narrative"))  # as in roles.complaints: no account or label is read
    spread = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "complaint_id")  # a table may be one file
    return themes.clusters(themes.assign(spread, TAXONOMY, min_similarity=0.02), k=4)


# --- actions and evidence -----------------------------------------------------------------


def _fraud_drivers(spark, sf_dir):
    return metrics.segment_drivers(roles.tables(spark, sf_dir), "fraud_claim_rate", [NOW], [BEFORE], min_denominator=10)


@query
def best_rows(spark, sf_dir):
    return actions.best_driver(_fraud_drivers(spark, sf_dir)).select("segment_name", "segment_value", "numerator_change")


@query
def best_pair(spark, sf_dir):
    return actions.best_interaction(_pairs(spark, sf_dir, 2)).select("segment_a_value", "segment_b_value", "disputed_change", "min_denominator_flag")


@query
def best_theme(spark, sf_dir):
    return actions.best_theme(themes.summary(_labelled(spark, sf_dir), TEXT_NOW, TEXT_BEFORE, TAXONOMY)).select("theme_name", "complaint_change")


@query
def scenarios(spark, sf_dir):
    best = actions.best_driver(_fraud_drivers(spark, sf_dir))
    events = actions.avoidable(F.col("current_numerator"), F.col("current_denominator"), F.col("previous_value"))
    return _rounded(actions.scenarios(best, F.col("current_value"), F.col("current_denominator"), events), "avoidable_events", "portfolio_rate_impact_pp", "projected_current_value")


@query
def finding_confidence(spark, sf_dir):
    kinds = _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "fail").otherwise("warn").alias("status"), F.when(F.col("o_orderpriority") < "3", "high").otherwise("medium").alias("severity"), "o_orderpriority").distinct()
    return kinds.withColumn("confidence", actions.finding_confidence(F.col("status"), F.col("severity")))


def _plan(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    report = metrics.report(tables, "dispute_rate", "monthly", NOW, BEFORE)
    results = settled(quality.run_checks(tables, accepted=DOMAINS))
    driver_report = drivers.report(tables, NOW, BEFORE, 50, with_tree=False)
    theme_report = themes.report(tables, TEXT_NOW, TEXT_BEFORE, TAXONOMY)
    return report, results, driver_report, theme_report, actions.plan(report, results, driver_report, theme_report)


@query
def scorecard(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir)[-1].scorecard.drop("evidence"), "score", "weighted_score")


@query
def recommendations(spark, sf_dir):
    return _plan(spark, sf_dir)[-1].recommendations


@query
def narrative(spark, sf_dir):
    report, results, driver_report, theme_report, plan = _plan(spark, sf_dir)
    said = evidence.explain(evidence.packet(report, quality.summarize(results), results, driver_report, theme_report, plan))
    return spark.createDataFrame([(said.headline, said.markdown(), said.validation.status, len(said.validation.supported), len(said.validation.unsupported))], "headline string, markdown string, status string, supported int, unsupported int")


@query
def extract_numbers(spark, sf_dir):
    return evidence.extracted(_table(spark, sf_dir, "pages"), "page_id", "html")


@query
def number_validation(spark, sf_dir):
    tokens = evidence.extracted(_table(spark, sf_dir, "pages"), "page_id", "html")
    supported = _table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("value")).distinct()
    return evidence.validated(tokens, supported, "page_id").groupBy("page_id", "verdict").agg(F.count("*").alias("tokens"))


@query
def selection_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").withColumn("lineage", F.lit("src0, src1,src2 ,src7"))
    shown = X.mentions_month(("text", "lang"), ("2019-03", "2021-11")) | (F.col("lang") == "en")
    return rows.filter(F.array_contains(X.lineage(F.col("lineage")), F.col("source")) & shown).select("doc_id", "source", "lang")
