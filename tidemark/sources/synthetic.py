"""Seeded tables with known defects. Every value follows from a hash of the row's number, so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import deduplicate
from tidemark.operators.quality import ACCEPTED

SEGMENTS = ("new", "core", "premium", "dormant")
REGIONS = ("north", "south", "east", "west")


def _unit(salt: str, *columns: str, seed: int) -> Column:
    """A number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) for c in columns]), F.lit(1 << 30)) / float(1 << 30)


def _pick(values: Sequence[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def accounts(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    u = lambda salt: _unit(salt, "id", seed=seed)
    return spark.range(n).select(
        F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("account_id"), F.to_timestamp(F.date_add(F.lit("2020-01-01").cast("date"), (u("open") * 2000).cast("int"))).alias("open_date"),
        _pick(ACCEPTED["accounts", "product_type"], u("product")).alias("product_type"), _pick(SEGMENTS, u("segment")).alias("customer_segment"), F.when(u("fico") < 0.3, "<=660").otherwise(">660").alias("fico_band"), _pick(REGIONS, u("region")).alias("region"),
        F.when(u("active") < 0.95, 1).otherwise(0).alias("active_flag"), F.round(u("balance") * 5000, 2).alias("current_balance"), F.round(u("limit") * 20000 + 500, 2).alias("credit_limit"),
    )


def transactions(spark: SparkSession, n: int, n_accounts: int, months: Sequence[str], seed: int = 2, replayed: float = 0.01, blank: float = 0.005, spike: float = 2.0) -> DataFrame:
    """Purchases and payments. In the last month travel by mobile is disputed `spike` times as often, disputed travel is partly replayed, and in the month before some categories are blank."""
    u = lambda salt: _unit(salt, "id", seed=seed)
    kinds = [c for c in ACCEPTED["transactions", "merchant_category"] if c not in ("fee", "payment")]
    rows = spark.range(n).select("id", _pick(months, u("month")).alias("m"), (u("day") * 28).cast("int").alias("d"), F.when(u("kind") < 0.85, "purchase").otherwise("payment").alias("transaction_type"), _pick(kinds, u("category")).alias("c"), _pick(ACCEPTED["transactions", "channel"][:4], u("channel")).alias("channel"))
    buys, last = F.col("transaction_type") == "purchase", F.col("m") == months[-1]
    hot = buys & last & (F.col("c") == "travel")
    rate = F.when(hot & (F.col("channel") == "mobile"), 0.02 * spike).otherwise(0.013)
    day = F.date_add(F.to_date(F.concat("m", F.lit("-01"))), F.col("d"))
    failed = F.when(~buys & (u("failed") < 0.03), 1).otherwise(0)
    made = rows.select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("transaction_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("source_transaction_id"), F.concat(F.lit("A"), F.lpad((u("account") * n_accounts).cast("long").cast("string"), 9, "0")).alias("account_id"),
        F.to_timestamp(day).alias("transaction_date"), F.to_timestamp(F.date_add(day, (u("lag") * 3).cast("int"))).alias("posted_date"),
        F.when(~buys, "payment").when((F.col("m") == months[-2]) & (u("blank") < blank), None).otherwise(F.col("c")).alias("merchant_category"), F.when(buys, F.col("channel")).otherwise("system").alias("channel"),
        F.when(buys, F.round(u("amount") * 300 + 1, 2)).when(failed == 1, 0.0).otherwise(F.round(-u("amount") * 900 - 1, 2)).alias("transaction_amount"), "transaction_type", F.when(buys & (u("dispute") < rate), 1).otherwise(0).alias("is_disputed"),
        F.when(buys & (u("fraud") < 0.004), 1).otherwise(0).alias("is_fraud_claim"), failed.alias("payment_failed"), F.concat(F.lit("B"), F.date_format(day, "yyyyMMdd")).alias("ingestion_batch_id"), F.lit("processor").alias("source_system"), F.to_timestamp(day).alias("created_at"),
        (hot & (u("replay") < replayed * 50)).alias("again"),
    )
    replays = made.filter("again and is_disputed = 1").withColumns({"transaction_id": F.concat("transaction_id", F.lit("R")), "ingestion_batch_id": F.lit("REPLAY"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return made.unionByName(replays).drop("again")


def snapshots(spark: SparkSession, people: DataFrame, months: Sequence[str], seed: int = 3) -> DataFrame:
    rows = people.select("account_id", "active_flag", "credit_limit", F.explode(F.array(*map(F.lit, months))).alias("snapshot_month"))
    u = lambda salt: _unit(salt, "account_id", "snapshot_month", seed=seed)
    late = u("late") < 0.03
    return rows.select("snapshot_month", "account_id", "active_flag", F.round(u("balance") * F.col("credit_limit"), 2).alias("statement_balance"), "credit_limit", F.round(u("balance"), 4).alias("utilization_rate"), F.when(late, 45).otherwise(0).alias("days_past_due"), F.when(late, 1).otherwise(0).alias("is_30dpd"), F.when(u("loss") < 0.002, F.round(u("balance") * 100, 2)).otherwise(0.0).alias("charge_off_balance"), F.lit("ledger").alias("source_system"))


def complaints(spark: SparkSession, n: int, n_accounts: int, months: Sequence[str], taxonomy, seed: int = 4) -> DataFrame:
    u = lambda salt: _unit(salt, "id", seed=seed)
    sentences = [s for texts in taxonomy.values() for s in texts]
    day = F.date_add(F.to_date(F.concat(_pick(months, u("month")), F.lit("-01"))), (u("day") * 28).cast("int"))
    return spark.range(n).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("complaint_id"), F.concat(F.lit("A"), F.lpad((u("account") * n_accounts).cast("long").cast("string"), 9, "0")).alias("account_id"), F.to_timestamp(day).alias("date_received"), F.lit("credit card").alias("product"),
        _pick(ACCEPTED["complaints", "issue"], u("issue")).alias("issue"), _pick(sentences, u("text")).alias("complaint_narrative"), _pick(("web", "phone"), u("via")).alias("submitted_via"), _pick(("travel", "grocery", "gas"), u("category")).alias("merchant_category"), _pick(("mobile", "web"), u("channel")).alias("channel"), _pick(SEGMENTS, u("segment")).alias("customer_segment"), F.when(u("fico") < 0.3, "<=660").otherwise(">660").alias("fico_band"),
    )


def tables(spark: SparkSession, n_accounts: int = 500, n_transactions: int = 20_000, n_complaints: int = 400, months: Sequence[str] = ("2026-01", "2026-02", "2026-03", "2026-04", "2026-05", "2026-06", "2026-07", "2026-08"), seed: int = 461) -> dict[str, DataFrame]:
    from tidemark.operators.themes import TAXONOMY

    people = accounts(spark, n_accounts, seed)
    return {"accounts": people, "transactions": transactions(spark, n_transactions, n_accounts, months, seed + 1), "account_monthly_snapshot": snapshots(spark, people, months, seed + 2), "complaints": complaints(spark, n_complaints, n_accounts, months, TAXONOMY, seed + 3)}


def ground_truth(t: dict[str, DataFrame]) -> DataFrame:
    """What there is to find, by month of purchase: rows, events and blank categories, disputes as loaded and without replays, and both rates."""
    from tidemark.functions.exprs import count_when, is_blank, month_of, safe_ratio

    tx = t["transactions"].filter(F.col("transaction_type") == "purchase").withColumn("month", month_of(F.col("transaction_date")))
    loaded = tx.groupBy("month").agg(F.count("*").alias("rows"), F.sum("is_disputed").cast("long").alias("disputed"), count_when(is_blank(tx, "merchant_category")).alias("blank_categories"))
    once = deduplicate(t["transactions"]).filter(F.col("transaction_type") == "purchase").withColumn("month", month_of(F.col("transaction_date")))
    events = once.groupBy("month").agg(F.count("*").alias("events"), F.sum("is_disputed").cast("long").alias("disputed_events"))
    return loaded.join(events, "month", "left").select("month", "rows", "events", "blank_categories", "disputed", "disputed_events", safe_ratio(F.col("disputed"), F.col("rows")).alias("rate"), safe_ratio(F.col("disputed_events"), F.col("events")).alias("rate_without_replays")).orderBy("month")


def ground_truth_report(t: dict[str, DataFrame], period: str, probes: dict[str, str]) -> str:
    """The same as Markdown, with where the disputes of one period are, what its complaints are about, and which words rose since the month before."""
    from tidemark.functions.exprs import month_of
    from tidemark.operators import drivers

    said = t["complaints"].select(month_of(F.col("date_received")).alias("month"), "issue", F.lower("complaint_narrative").alias("text"))
    before = said.filter(F.col("month") < period).agg(F.max("month").alias("m")).first().m
    issues = said.filter(F.col("month") == period).groupBy("issue").agg(F.count("*").alias("complaints")).orderBy(F.desc("complaints"), "issue")
    counted = said.agg(*[F.count_if(F.col("text").rlike(p) & (F.col("month") == m)).alias(f"{w} {k}") for k, p in probes.items() for w, m in (("was", before), ("now", period))]).first()
    rose = sorted(((counted[f"now {k}"] - counted[f"was {k}"], k, counted[f"was {k}"], counted[f"now {k}"]) for k in probes), key=lambda x: (-x[0], x[1]))
    parts = [
        ("Months", _markdown(ground_truth(t))), (f"Disputes of {period}", _markdown(drivers.dispute_leaders(drivers.purchase_facts(t), period))), (f"Complaints of {period}", _markdown(issues)),
        (f"Words since {before}", _lines(["probe", "before", "now", "change"], [(k, was, now, d) for d, k, was, now in rose])),
    ]
    return "# What was planted\n\n" + "\n\n".join(f"## {title}\n\n{body}" for title, body in parts) + "\n"


def _markdown(df: DataFrame) -> str:
    """A result table of a few dozen rows."""
    return _lines(df.columns, [tuple(r) for r in df.collect()])


def _lines(names: Sequence[str], rows: Sequence[tuple]) -> str:
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in (names, ["---"] * len(names), *rows))
