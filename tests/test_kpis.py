"""Toy tables whose numbers can be checked by eye."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import actions, dedup, drivers, evidence, metrics, periods, quality, sqlviews, themes

DAY = {"2026-07": dt.datetime(2026, 7, 5), "2026-08": dt.datetime(2026, 8, 5)}
TX = "source_transaction_id string, transaction_id string, account_id string, transaction_date timestamp, created_at timestamp, transaction_type string, is_disputed int, is_fraud_claim int, payment_failed int, merchant_category string, channel string, transaction_amount double, posted_date timestamp, ingestion_batch_id string"


def row(event, name, month, kind="purchase", disputed=0, later=0, category="travel", channel="mobile", account="a1", amount=10.0, batch="b1"):
    at = DAY[month]
    return (event, name, account, at, at + dt.timedelta(hours=later), kind, disputed, 0, 0, category, channel, amount, at, batch)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [row(f"j{i}", f"tj{i}", "2026-07", disputed=int(i == 0)) for i in range(4)]
    rows += [row(f"k{i}", f"tk{i}", "2026-08", disputed=int(i < 2), category="" if i == 4 else "travel") for i in range(5)]
    rows += [row("k0", "tk0r", "2026-08", disputed=1, later=2, batch="replay"), row("p", "tp", "2026-08", kind="payment", amount=-5.0)]
    return spark.createDataFrame(rows, TX).cache()


@pytest.fixture(scope="module")
def tables(spark, tx):
    people = spark.createDataFrame([("a1", ">660", "core", "cash_rewards", "north", 1)], "account_id string, fico_band string, customer_segment string, product_type string, region string, active_flag int")
    return {"transactions": tx, "accounts": people}


def test_raw_and_corrected_rates(tables):
    t = {r.month: r for r in metrics.monthly_trend(tables, "dispute_rate").collect()}
    assert (t["2026-07"].raw_value, t["2026-07"].corrected_value) == (0.25, 0.25)
    assert (t["2026-08"].raw_value, t["2026-08"].corrected_value) == (0.5, 0.4)
    assert t["2026-08"].duplicate_numerator_removed == 1
    c = {r.variant: r.percent_change for r in metrics.comparison(metrics.monthly_trend(tables, "dispute_rate"), "dispute_rate", "2026-08", "2026-07").collect()}
    assert c["raw"] == 1.0 and c["corrected"] == pytest.approx(0.6)


def test_replays_dont_depend_on_row_order_and_null_keys_stay(spark, tx):
    more = tx.unionByName(spark.createDataFrame([row(None, "n1", "2026-08"), row(None, "n2", "2026-08")], TX))
    kept = sorted(r.transaction_id for r in dedup.deduplicate(more.orderBy(F.desc("transaction_id"))).collect())
    assert "tk0r" not in kept and {"n1", "n2"} <= set(kept) and len(kept) == 12
    assert [r.transaction_id for r in dedup.removed(more).collect()] == ["tk0r"]
    assert dedup.duplicate_summary(more).first().surplus_rows == 2  # repeated null keys count in the check
    assert dedup.top_batches(tx).first().duplicate_rows == 1


def test_blank_and_sign_rules(spark):
    df = spark.createDataFrame([("   ",), ("",), (None,), ("ok",), ("\t ",)], "s string")
    assert [r[0] for r in df.select(X.is_blank(df, "s")).collect()] == [True, True, True, False, True]
    rows = [("purchase", 5.0, 0), ("purchase", None, 0), ("fee", -1.0, 0), ("payment", -3.0, 0), ("payment", 3.0, 0), ("payment", 1.0, 1), ("payment", 1.0, None)]
    got = quality.amount_signs(spark.createDataFrame(rows, "transaction_type string, transaction_amount double, payment_failed int")).first()
    assert (got.purchase_not_positive, got.fee_not_positive, got.paid_payment_not_negative, got.failed_payment_not_zero, got.rows_in_violation) == (1, 1, 1, 1, 4)


def test_period_errors_and_windows(spark):
    months = spark.createDataFrame([(f"2026-0{i}",) for i in range(1, 5)], "month string")
    assert periods.resolve(months, None, None) == ("2026-04", "2026-03")
    with pytest.raises(KeyError):
        periods.resolve(months, "2025-01", None)
    with pytest.raises(ValueError):
        periods.resolve(months, "2026-01", None)
    w = periods.windows(months, "quarterly").orderBy("end_month").collect()
    assert [r.month for r in w] == ["2026-01 to 2026-03", "2026-02 to 2026-04"]
    with pytest.raises(ValueError):
        periods.width_of("weekly")


def test_segments_add_up_and_blanks_are_a_bucket(tables):
    facts = drivers.purchase_facts(tables)
    s = drivers.segment_drivers(facts, "2026-08", "2026-07", 5).collect()
    by_field = {}
    for r in s:
        by_field[r.segment_name] = by_field.get(r.segment_name, 0) + r.current_purchases
    assert set(by_field.values()) == {5}
    assert {r.segment_value for r in s if r.segment_name == "merchant_category"} == {"travel", X.MISSING}
    missing = next(r for r in s if r.segment_value == X.MISSING)
    assert missing.previous_purchases == 0 and missing.previous_dispute_rate is None and missing.min_denominator_flag
    pairs = drivers.interaction_drivers(facts, "merchant_category", "channel", "2026-08", "2026-07", 1)
    assert sum(r.current_purchases for r in pairs.collect()) == 5
    with pytest.raises(ValueError):
        drivers.interaction_drivers(facts, "channel", "channel", "2026-08", "2026-07")
    rules = drivers.tree_rules(facts, "2026-08", max_depth=2, min_leaf=1).collect()
    assert sum(r.purchases for r in rules) == 5 and sum(r.disputed for r in rules) == 2


def test_rolling_baseline(spark):
    values = [10.0, 10.0, 10.0, 10.0, 40.0, None]
    series = spark.createDataFrame([(f"2026-0{i + 1}", v) for i, v in enumerate(values)], "month string, value double")
    z = {r.month: r for r in quality.scan_series(series, 3.0).collect()}
    assert z["2026-03"].z is None and z["2026-04"].z == 0.0 and z["2026-05"].z == 30.0 and z["2026-06"].z is None
    worst = quality.worst_month(series, 3.0).first()
    assert (worst.month, worst.status, worst.months_scored) == ("2026-05", "fail", 2)
    short = quality.worst_month(series.limit(2), 0.0).first()
    assert short.month is None and short.status == "pass"


def test_psi_of_a_new_bucket_is_finite(spark):
    rows = [(f"2026-0{m}-03", "a" if m < 4 or i % 2 else "b") for m in range(1, 5) for i in range(10)]
    df = spark.createDataFrame(rows, "d string, c string").select(F.to_timestamp("d").alias("transaction_date"), "c")
    worst = quality.worst_psi(quality.monthly_mix(df, "transactions", "c")).first()
    assert worst.month == "2026-04" and worst.top_bucket == "b" and worst.status == "fail" and worst.psi < 100


def test_orphans_and_domains(spark):
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), (None,)], "p string")
    assert tuple(quality.orphans(child, "k", parent, "p").first()) == (3, 1)
    assert tuple(quality.unaccepted(child, "k", ["a"]).first()) == (2, "b")
    assert quality.unaccepted(child, "k", ["a", "b"]).first().violations == 0


def test_sql_views_agree(spark, tables):
    assert all(r.matches for r in sqlviews.parity(spark, tables).collect())


def test_numbers(spark):
    assert evidence.numbers_in("In 2026-08, 1,234 of $5.50 and 3.2% (-4)") == ["1,234", "$5.50", "3.2%", "-4"]
    known = evidence.vouchers({"a": [{"rate": 0.017679, "events": 1234, "held": True}], "fall_rate": -0.25, "undefined": None})
    assert evidence.source_of(1.77, known) == "a[0].rate" and evidence.source_of(25.0, known) == evidence.source_of(-0.25, known) == "fall_rate" and evidence.source_of(1.0, known) is None
    v = evidence.validate("1.77% and 1,234 and 2.1% in 3 parts", known)
    assert v.supported == ("1.77%", "1,234") and v.unsupported == ("2.1%",) and v.ignored == ("3",)
    tokens = evidence.extracted(spark.createDataFrame([(1, "In 2026-08: 12 and 7.5% of 3")], "k int, t string"), "k", "t")
    known = spark.createDataFrame([(12.0,)], "value double")
    assert [r.verdict for r in evidence.validated(tokens, known, "k").orderBy("place").collect()] == ["supported", "unsupported", "ignored"]


def test_themes(spark):
    taxonomy = {"fees": ("unexpected fee",), "app": ("app broken",), themes.UNCLEAR: ("help",)}
    rows = spark.createDataFrame([("1", "2026-08", "An unexpected fee!"), ("2", "2026-08", "the app is broken"), ("3", "2026-07", "  "), ("4", "2026-07", None), ("5", "2026-07", "éé")], "complaint_id string, month string, narrative string")
    got = {r.complaint_id: r.theme_name for r in themes.assign(rows, taxonomy).collect()}
    assert got == {"1": "fees", "2": "app", "3": themes.UNCLEAR, "4": themes.UNCLEAR, "5": themes.UNCLEAR}
    again = {r.complaint_id: r.theme_name for r in themes.assign(rows, taxonomy, embedder=themes.blake2_embedder()).collect()}
    assert again == got
    summary = {r.theme_name: r for r in themes.summary(themes.assign(rows, taxonomy), "2026-08", "2026-07", taxonomy).collect()}
    assert set(summary) == set(taxonomy) and summary["fees"].current_share == 0.5 and summary["fees"].previous_complaints == 0


def test_answers_of_a_client_keep_to_the_schema():
    p = evidence.Packet({"limitations": []})
    client = lambda answer: type("C", (), {"create": lambda self, **_: answer})()
    said = evidence.narrate_with(client('{"headline": "h", "sections": {"a": "3 things"}}'), p)
    assert said.headline == "h" and said.source == "client" and said.validation.ignored == ("3",)
    for answer in ("no json", "[]", '{"headline": "h"}', '{"headline": 1, "sections": {}}', '{"headline": "h", "sections": {"a": 1}}', '{"headline": "h", "sections": {}, "more": 1}'):
        with pytest.raises(ValueError, match="answer|text"):
            evidence.narrate_with(client(answer), p)


def test_text_operators_refuse_bad_arguments(spark):
    rows = spark.createDataFrame([("1", "2026-08", "a fee", "fees", 0.5)], "complaint_id string, month string, narrative string, theme_name string, theme_similarity double")
    with pytest.raises(ValueError, match="positive"):
        themes.representatives(rows, 0)
    with pytest.raises(ValueError, match="positive"):
        themes.blake2_embedder(0)
    with pytest.raises(ValueError, match="clusters"):
        themes.clusters(rows, k=4)
    with pytest.raises(ValueError, match="0 texts"):
        themes.clusters(rows, k=2, period="2026-07")
    with pytest.raises(ValueError, match="vectors for"):
        themes.assign(rows, {"a": ("x",)}, embedder=lambda texts: np.zeros((len(texts) + 1, 2)))


def test_clusters_compute_terms_once(spark):
    rows = spark.createDataFrame([(str(i), "2026-08", text, "a", 0.5) for i, text in enumerate(["fee fee", "a fee", "the app", "the app app", "  ", None, "éé"])], "complaint_id string, month string, narrative string, theme_name string, theme_similarity double")
    found = themes.clusters(rows, k=2)
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    assert [(r.complaints, r.share_of_complaints) for r in found.collect()] == [(2, 0.5), (2, 0.5)]


def test_ngrams_copy_no_array_for_each_run(spark):
    found = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,), (["a", None, "c"],)], "w array<string>").select(X.ngrams(F.col("w"), 1, 2, 3).alias("n"))
    assert "slice(" not in found._jdf.queryExecution().toString()
    assert [r.n for r in found.collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], [], [], ["a", "", "c", "a", "c", "a c"]]


def test_leaders_of_disputes(spark):
    rows = spark.createDataFrame([("2026-08", 1, "travel", "web", ">660")] * 3 + [("2026-08", 1, "gas", "web", ">660")] * 3 + [("2026-08", 0, "gas", "web", ">660"), ("2026-07", 1, "gas", "web", ">660")], "month string, is_disputed int, merchant_category string, channel string, fico_band string")
    assert [tuple(r) for r in drivers.dispute_leaders(rows, "2026-08", n=2).collect()] == [("gas", "web", ">660", 3), ("travel", "web", ">660", 3)]
    with pytest.raises(ValueError, match="positive"):
        drivers.dispute_leaders(rows, "2026-08", n=0)


def test_theme_scores_need_no_shuffle(spark):
    rows = spark.createDataFrame([("1", "a fee and a fee")], "complaint_id string, narrative string")
    plan = themes.assign(rows, {"fees": ("a fee",), "app": ("the app",)})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_actions_follow_the_rules():
    s = actions.Situation("Dispute rate", 0.21, 0.016, 1000.0, 165.0, 165.0, 0.0015, {"segment_name": "c", "segment_value": "v", "numerator_change": 300.0, "current_numerator": 500.0, "current_denominator": 1000.0, "previous_value": 0.2, "contribution_share_of_positive_change": 0.9, "min_denominator_flag": False}, None, None)
    found = sorted(actions.rules(s, 0.8), key=lambda a: -a.score)
    assert [a.kind for a in found] == ["Data quality control", "Business investigation"]
    assert found[0].score == 95.0 and found[1].events == 300.0 and actions.choose_source(found).kind == "Business investigation"
    calm = actions.Situation("Dispute rate", 0.0, 0.01, 10.0, 0.0, 0.0, 0.0, None, None, None)
    assert not list(actions.rules(calm, 0.5)) and actions.monitoring(calm).score == 38.5
    assert actions.decision(calm).startswith("Watch")


def test_whole_run(spark, tmp_path):
    from tidemark.plans import report
    from tidemark.sources import synthetic
    from tidemark.sources.tables import load_tables, write_csv, write_parquet

    t = synthetic.tables(spark, 200, 6000, 120)
    truth = {r.month: r for r in synthetic.ground_truth(t).collect()}
    assert truth["2026-08"].rows > truth["2026-08"].events and truth["2026-07"].rows == truth["2026-07"].events
    write_parquet(t["transactions"], f"{tmp_path}/data/transactions.parquet")
    t["accounts"].write.option("header", True).csv(f"{tmp_path}/data/accounts.csv")
    back = load_tables(spark, f"{tmp_path}/data", ["transactions", "accounts"])
    assert back["transactions"].count() == t["transactions"].count() and dict(back["accounts"].dtypes)["open_date"] == "timestamp"
    r = report.run(spark, t | back, with_tree=False)
    assert r.results.count() == 31 and r.kpi.current_period == "2026-08"
    assert r.results.filter("check_name = 'duplicate_source_event_ids'").first().status == "fail"
    assert r.explanation.validation.status == "pass"
    paths = report.write(spark, r, f"{tmp_path}/out")
    assert len(paths) >= 18
    r.release()
    assert not r.drivers.facts.is_cached and r.drivers.segments.count() > 0
    write_csv(r.kpi.trend, f"{tmp_path}/again")
    told = synthetic.ground_truth_report(t, "2026-08", {"fee": r"\bfee", "app": r"\bapp\b"})
    assert told.startswith("# What was planted") and "| 2026-08 |" in told and "| fee |" in told and "Words since 2026-07" in told
    shown = report.dashboard(t | back, "dispute_rate")
    assert [x.month for x in shown["selected"].collect()] == ["2026-07", "2026-08"] and shown["explanation"].validation.status == "pass"
    assert {x.table_name for x in shown["findings"].collect()} <= {"transactions", "accounts"} and shown["themes"] and shown["drivers"]
    said = shown["findings"].filter("status <> 'pass'").collect()
    assert said and all("2026-07" in str(x) or "2026-08" in str(x) for x in said) and shown["quality"].count() == 31
    other = report.dashboard(t | back, "complaint_rate", "quarterly")
    assert other["drivers"] is None and other["plan"].recommendations.count() > 0


def test_streams(spark, tmp_path):
    from tidemark.streaming import live

    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), 1), (1, dt.datetime(2026, 1, 1, 1), 1), (2, dt.datetime(2026, 1, 2), 0)], "event int, ts timestamp, flag int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.first_events(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "event", "ts")
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    assert [r.value for r in live.windowed_rate(rows, "ts", "flag").orderBy("start").collect()] == [1.0, 0.0]
