"""The queries as SQL for DuckDB. The role views come first as common table expressions."""

from __future__ import annotations

from tidemark.operators import quality
from tidemark.plans import queries as Q
from tidemark.sources.roles import ISSUES


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ROLES = f"""
WITH accounts AS (
    SELECT CAST(c_custkey AS VARCHAR) AS account_id, 'product_' || (c_custkey % 5) AS product_type, c_mktsegment AS customer_segment,
        CASE WHEN c_acctbal < 0 THEN '<=660' ELSE '>660' END AS fico_band, r_name AS region, 1 AS active_flag, c_acctbal + 1000 AS credit_limit
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), transactions AS (
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id, l_orderkey || '-' || l_linenumber AS source_transaction_id,
        CAST(o_custkey AS VARCHAR) AS account_id, l_shipdate AS transaction_date, o_orderdate AS posted_date, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE p_type END AS merchant_category,
        o_orderpriority AS channel, CASE WHEN l_suppkey % 13 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS transaction_amount,
        CASE WHEN l_linestatus = 'F' THEN 'purchase' ELSE 'payment' END AS transaction_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_disputed,
        CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_fraud_claim, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS payment_failed,
        'batch_' || (l_suppkey % 9) AS ingestion_batch_id, 'ledger' AS source_system, l_shipdate AS created_at, strftime(l_shipdate, '%Y-%m') AS month
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
), flagged AS (
    SELECT *, row_number() OVER (PARTITION BY source_transaction_id ORDER BY created_at, transaction_id) = 1 AS kept FROM transactions
), snapshots AS (
    SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey AS VARCHAR) AS account_id, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE 1 END AS active_flag,
        sum(CAST(o_totalprice AS DECIMAL(18,2))) AS statement_balance, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS is_30dpd,
        sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 20 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS charge_off_balance
    FROM orders GROUP BY 1, 2, 3
), complaints AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS complaint_id, CAST(d.doc_id % 150 AS VARCHAR) AS account_id, '2001-0' || (d.doc_id % 8 + 1) AS month, text AS narrative, text AS complaint_narrative, lang AS product, true AS date_received, source AS submitted_via,
        [{_list(ISSUES)}][CAST(d.doc_id % 4 + 1 AS INT)] AS issue, CASE WHEN quality IS NOT NULL THEN 'q' || quality END AS merchant_category,
        'c' || (d.doc_id % 3) AS channel, 'seg' || (d.doc_id % 4) AS customer_segment, CASE WHEN d.doc_id % 7 = 0 THEN '<=660' ELSE '>660' END AS fico_band
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

ORACLE: dict[str, str] = {}


def _add(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = ROLES + "".join(f", {c}" for c in ctes) + "\n" + body


_RATIO = "CASE WHEN denominator > 0 THEN CAST(numerator AS DOUBLE) / CAST(denominator AS DOUBLE) END"

_add("dedup_events", "SELECT source_transaction_id, transaction_id, account_id, transaction_type, is_disputed FROM flagged WHERE kept")
_add("removed_duplicates", "SELECT source_transaction_id, transaction_id, transaction_type FROM flagged WHERE NOT kept")
_KEYS = "per_key AS (SELECT source_transaction_id, count(*) AS n FROM transactions GROUP BY 1)"
_add("duplicate_count", "SELECT CAST(sum(n - 1) AS BIGINT) AS surplus_rows, CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS repeated_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_involved FROM per_key", _KEYS)
_add("top_batches", "SELECT ingestion_batch_id, count(*) AS duplicate_rows FROM transactions SEMI JOIN (SELECT * FROM per_key WHERE n > 1) r USING (source_transaction_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", _KEYS)


def _monthly(name: str, source: str, numerator: str, denominator: str = "count(*)", scale: str = "") -> None:
    _add(name, f"SELECT month, CAST(numerator AS DOUBLE) AS numerator, CAST(denominator AS DOUBLE) AS denominator, {_RATIO}{scale} AS value FROM sums", f"sums AS (SELECT month, {numerator} AS numerator, {denominator} AS denominator FROM {source} GROUP BY month)")


_monthly("monthly_rate_raw", "flagged WHERE transaction_type = 'purchase'", "sum(is_disputed)")
_monthly("monthly_rate_corrected", "flagged WHERE transaction_type = 'purchase' AND kept", "sum(is_disputed)")
_monthly("fraud_rate_monthly", "flagged WHERE transaction_type = 'purchase' AND kept", "sum(is_fraud_claim)")
_monthly("payment_failure_monthly", "flagged WHERE transaction_type = 'payment' AND kept", "sum(payment_failed)")
_monthly("balance_delinquency_monthly", "snapshots WHERE active_flag = 1", "sum(statement_balance * is_30dpd)", "sum(statement_balance)")
_monthly("charge_off_monthly", "snapshots WHERE active_flag = 1", "sum(charge_off_balance * 12)", "sum(statement_balance)")
_monthly("fee_share_monthly", "complaints", "count(CASE WHEN issue = 'Fees or interest' THEN 1 END)")
_add(
    "complaint_rate_monthly",
    f"SELECT month, CAST(numerator AS DOUBLE) AS numerator, CAST(denominator AS DOUBLE) AS denominator, {_RATIO} * 1000 AS value FROM sums",
    "sums AS (SELECT month, coalesce(n, 0) AS numerator, coalesce(d, 0) AS denominator FROM (SELECT month, count(*) AS n FROM complaints GROUP BY 1) FULL JOIN (SELECT month, count(DISTINCT account_id) AS d FROM snapshots WHERE active_flag = 1 GROUP BY 1) USING (month))",
)


def _trend(kind: str, flag: str) -> str:
    return f"""monthly AS (
        SELECT month, CAST(sum({flag}) AS DOUBLE) AS rn, CAST(count(*) AS DOUBLE) AS rd, CAST(coalesce(sum({flag}) FILTER (kept), 0) AS DOUBLE) AS cn, CAST(count(*) FILTER (kept) AS DOUBLE) AS cd
        FROM flagged WHERE transaction_type = '{kind}' GROUP BY month)"""


def _finished(source: str, kpi: str, grain: str, label: str, start: str, months: str) -> str:
    raw, corrected = "CASE WHEN rd > 0 THEN rn / rd END", "CASE WHEN cd > 0 THEN cn / cd END"
    return f"""SELECT {label} AS month, '{grain}' AS period_grain, {start} AS start_month, month AS end_month, {months} AS period_months, '{kpi}' AS metric_name, rn AS raw_numerator, rd AS raw_denominator, {raw} AS raw_value,
        cn AS corrected_numerator, cd AS corrected_denominator, {corrected} AS corrected_value, rn - cn AS duplicate_numerator_removed, rd - cd AS duplicate_denominator_removed, {raw} - {corrected} AS value_difference FROM {source}"""


def _rolling(k: int) -> str:
    run = f"OVER (ORDER BY month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"windows AS (SELECT * FROM (SELECT month, list(month) {run} AS months, sum(rn) {run} AS rn, sum(rd) {run} AS rd, sum(cn) {run} AS cn, sum(cd) {run} AS cd FROM monthly) WHERE len(months) = {k})"


_DISPUTES = _trend("purchase", "is_disputed")
_add("trend_raw_vs_corrected", _finished("monthly", "dispute_rate", "monthly", "month", "month", "month"), _DISPUTES)
_WINDOW = ("months[1] || ' to ' || month", "months[1]", "array_to_string(months, '|')")
_add("trend_rolling_quarter", _finished("windows", "dispute_rate", "quarterly", *_WINDOW), _DISPUTES, _rolling(3))
_add("trend_rolling_half", _finished("windows", "payment_failure_rate", "semiannual", *_WINDOW), _trend("payment", "payment_failed"), _rolling(6))
_add("period_windows", "SELECT months[1] || ' to ' || month AS month, 'quarterly' AS period_grain, months[1] AS start_month, month AS end_month, array_to_string(months, '|') AS period_months FROM (SELECT month, list(month) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS months FROM (SELECT DISTINCT month FROM transactions)) WHERE len(months) = 3")
_add("available_periods", "SELECT months[1] || ' to ' || month AS month, months[1] AS start_month, month AS end_month, cd AS corrected_denominator FROM windows WHERE cd > 0", _trend("purchase", "is_fraud_claim"), _rolling(3))
_add("trend_long", "SELECT month, 'raw' AS variant, CASE WHEN rd > 0 THEN rn / rd END AS value FROM monthly UNION ALL SELECT month, 'corrected', CASE WHEN cd > 0 THEN cn / cd END FROM monthly", _DISPUTES)
_add(
    "period_comparison",
    f"""SELECT 'dispute_rate' AS metric_name, variant, '{Q.NOW}' AS current_period, '{Q.BEFORE}' AS previous_period, cn / cd AS current_value, pn / pd AS previous_value, cn / cd - pn / pd AS absolute_change,
        (cn / cd - pn / pd) / nullif(pn / pd, 0) AS percent_change, cn AS current_numerator, cd AS current_denominator, pn AS previous_numerator, pd AS previous_denominator FROM sides""",
    _DISPUTES,
    f"""sides AS (SELECT 'raw' AS variant, c.rn AS cn, c.rd AS cd, p.rn AS pn, p.rd AS pd FROM monthly c, monthly p WHERE c.month = '{Q.NOW}' AND p.month = '{Q.BEFORE}'
        UNION ALL SELECT 'corrected', c.cn, c.cd, p.cn, p.cd FROM monthly c, monthly p WHERE c.month = '{Q.NOW}' AND p.month = '{Q.BEFORE}')""",
)
_add("remediation_impact", f"SELECT 'dispute_rate' AS metric_name, month AS period, rn / rd AS raw_value, cn / cd AS corrected_value, rn / rd - cn / cd AS value_difference, rn AS raw_numerator, cn AS corrected_numerator, rn - cn AS duplicate_numerator_removed, rd AS raw_denominator, cd AS corrected_denominator, rd - cd AS duplicate_denominator_removed FROM monthly WHERE month = '{Q.NOW}'", _DISPUTES)

for _name, _columns, _n in (("segment_rate_category", "coalesce(nullif(trim(merchant_category), ''), '__missing__') AS merchant_category", 2), ("segment_rate_channel", "channel", 2), ("segment_rate_interaction", "coalesce(nullif(trim(merchant_category), ''), '__missing__') AS merchant_category, channel", 3)):
    _add(_name, f"SELECT month, {_columns}, CAST(sum(is_disputed) AS BIGINT) AS numerator, count(*) AS denominator, CAST(sum(is_disputed) AS DOUBLE) / count(*) AS value FROM flagged WHERE kept AND transaction_type = 'purchase' GROUP BY {', '.join(str(i + 1) for i in range(_n))}")
# The views' way: ROW_NUMBER and grouping. The other way: a row stays unless an earlier one has its event. Both are computed, and compared group by group.
_first = "NOT EXISTS (SELECT 1 FROM transactions e WHERE e.source_transaction_id = t.source_transaction_id AND (e.created_at, e.transaction_id) < (t.created_at, t.transaction_id))"
_both = [("monthly_dispute_rate_raw", "is_disputed", "purchase", "month", "true", "true"), ("monthly_dispute_rate_corrected", "is_disputed", "purchase", "month", "kept", "first"), ("monthly_fraud_claim_rate", "is_fraud_claim", "purchase", "month", "kept", "first"), ("monthly_payment_failure_rate", "payment_failed", "payment", "month", "kept", "first")]
_both += [(f"segment_{k}", "is_disputed", "purchase", f"month, {c}", "kept", "first") for k, c in (("merchant_category", "merchant_category"), ("channel", "channel"), ("category_channel", "merchant_category, channel"))]


def _compared(check: str, flag: str, kind: str, keys: str, kept: str, first: str) -> str:
    label = "* REPLACE (CASE WHEN trim(coalesce(merchant_category, '')) = '' THEN '__missing__' ELSE merchant_category END AS merchant_category)"
    side = lambda x, source, where: f"(SELECT {keys}, CAST(sum({flag}) AS DOUBLE) AS {x}n, CAST(count(*) AS DOUBLE) AS {x}d FROM (SELECT {label} FROM {source}) WHERE transaction_type = '{kind}' AND {where} GROUP BY ALL)"
    off = "count(*) FILTER (an IS DISTINCT FROM bn OR ad IS DISTINCT FROM bd OR abs(an / ad - bn / bd) > 1e-9)"
    return f"SELECT '{check}' AS check_name, count(*) AS compared, {off} AS differences, {off} = 0 AS matches FROM {side('a', 'flagged', kept)} a FULL JOIN {side('b', 'twice', first)} b USING ({keys})"


_add("sql_parity", " UNION ALL ".join(_compared(*x) for x in _both), f"twice AS (SELECT t.*, {_first} AS first FROM transactions t)")
_add("selected_trend", f"SELECT *, CASE WHEN month = '{Q.NOW}' THEN 1 ELSE 0 END AS place FROM ({_finished('monthly', 'dispute_rate', 'monthly', 'month', 'month', 'month')}) WHERE month IN ('{Q.NOW}', '{Q.BEFORE}')", _DISPUTES)
_add(
    "ground_truth_rates",
    """SELECT month, count(*) AS rows, count(*) FILTER (kept) AS events, count(*) FILTER (merchant_category IS NULL OR trim(merchant_category) = '') AS blank_categories, CAST(sum(is_disputed) AS BIGINT) AS disputed, CAST(sum(is_disputed) FILTER (kept) AS BIGINT) AS disputed_events,
        CAST(sum(is_disputed) AS DOUBLE) / count(*) AS rate, CAST(sum(is_disputed) FILTER (kept) AS DOUBLE) / nullif(count(*) FILTER (kept), 0) AS rate_without_replays FROM flagged WHERE transaction_type = 'purchase' GROUP BY month""",
)

_BLANK = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN '__missing__' ELSE {0} END AS {0}"
_FIELDS = ("merchant_category", "channel", "fico_band", "customer_segment", "product_type", "region")
_FACTS = f"facts AS (SELECT f.month, f.is_disputed, {', '.join(_BLANK.format(c) for c in _FIELDS)} FROM flagged f LEFT JOIN accounts USING (account_id) WHERE kept AND transaction_type = 'purchase')"
_CUT = f"cut AS (SELECT month, is_disputed, unnest([{_list(_FIELDS)}]) AS segment_name, unnest([{', '.join(_FIELDS)}]) AS segment_value FROM facts WHERE month IN ('{Q.NOW}', '{Q.BEFORE}'))"


def _moved(source: str, keys: str) -> str:
    part = lambda m, v: f"CAST(coalesce(sum({v}) FILTER (month = '{m}'), 0) AS BIGINT)"
    return f"moved AS (SELECT {keys}, {part(Q.BEFORE, 'is_disputed')} AS pn, {part(Q.NOW, 'is_disputed')} AS cn, {part(Q.BEFORE, '1')} AS pd, {part(Q.NOW, '1')} AS cd FROM {source} WHERE month IN ('{Q.NOW}', '{Q.BEFORE}') GROUP BY ALL)"


def _measures(within: str, least: int) -> str:
    was, now = "CASE WHEN pd > 0 THEN pn / CAST(pd AS DOUBLE) END", "CASE WHEN cd > 0 THEN cn / CAST(cd AS DOUBLE) END"
    return f"""pn AS previous_disputed, cn AS current_disputed, cn - pn AS disputed_change, pd AS previous_purchases, cd AS current_purchases, cd - pd AS purchase_change, {was} AS previous_dispute_rate, {now} AS current_dispute_rate,
        {now} - {was} AS rate_change, coalesce(CAST(greatest(cn - pn, 0) AS DOUBLE) / nullif(CAST(sum(greatest(cn - pn, 0)) OVER ({within}) AS DOUBLE), 0), 0) AS contribution_share_of_positive_dispute_change, least(pd, cd) < {least} AS min_denominator_flag"""


_add("dispute_leaders", f"SELECT merchant_category, channel, fico_band, count(*) AS disputed_purchases FROM facts WHERE month = '{Q.NOW}' AND is_disputed = 1 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 8", _FACTS)
_SEGMENTS = f"SELECT segment_name, segment_value, {_measures('PARTITION BY segment_name', 50)} FROM moved"
_SEG = (_FACTS, _CUT, _moved("cut", "segment_name, segment_value"))
_add("segment_drivers", _SEGMENTS, *_SEG)
_add("count_drivers_topn", f"SELECT * FROM ({_SEGMENTS}) ORDER BY disputed_change DESC, segment_name, segment_value LIMIT 10", *_SEG)
_add("rate_deterioration", f"SELECT * FROM ({_SEGMENTS}) ORDER BY min_denominator_flag, rate_change DESC NULLS LAST, segment_name, segment_value LIMIT 10", *_SEG)
_PAIRS = f"SELECT 'merchant_category' AS segment_a_name, merchant_category AS segment_a_value, 'channel' AS segment_b_name, channel AS segment_b_value, {_measures('', 10)} FROM moved"
_PAIR = (_FACTS, _moved("facts", "merchant_category, channel"))
_add("interaction_drivers", _PAIRS, *_PAIR)
_add("heat_domain", f"SELECT -max(abs(rate_change)) AS low, max(abs(rate_change)) AS high FROM ({_PAIRS})", *_PAIR)
_add("best_pair", f"SELECT segment_a_value, segment_b_value, disputed_change, min_denominator_flag FROM ({_PAIRS.replace('< 10 AS', '< 2 AS')}) WHERE disputed_change > 0 AND NOT min_denominator_flag ORDER BY disputed_change DESC, rate_change DESC NULLS LAST, contribution_share_of_positive_dispute_change DESC, segment_a_value, segment_b_value LIMIT 1", *_PAIR)
_cells = ", ".join(f"any_value(disputed_change) FILTER (segment_b_value = '{c}') AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
_add("interaction_heatmap", f"SELECT segment_a_value, {_cells} FROM ({_PAIRS}) GROUP BY 1", *_PAIR)

_GENERIC = ("merchant_category", "channel", "product_type", "fico_band", "region")


def _generic_rows(now, before, flag: str = "is_fraud_claim", fields: tuple[str, ...] = _GENERIC) -> tuple[str, ...]:
    inside = sorted({*now, *before})
    part = lambda months, v: f"CAST(coalesce(sum({v}) FILTER (month IN ({_list(months)})), 0) AS DOUBLE)"
    return (
        f"cut AS (SELECT f.month, f.{flag}, unnest([{_list(fields)}]) AS segment_name, unnest([{', '.join(fields)}]) AS segment_value FROM flagged f LEFT JOIN accounts USING (account_id) WHERE kept AND transaction_type = 'purchase' AND f.month IN ({_list(inside)}))",
        f"moved AS (SELECT segment_name, segment_value, {part(before, flag)} AS pn, {part(now, flag)} AS cn, {part(before, '1')} AS pd, {part(now, '1')} AS cd FROM cut GROUP BY 1, 2)",
    )


def _generic(scale: str = "", least: int = 100) -> str:
    was, now = f"CASE WHEN pd > 0 THEN pn / pd{scale} END", f"CASE WHEN cd > 0 THEN cn / cd{scale} END"
    return f"""SELECT segment_name, segment_value, pn AS previous_numerator, cn AS current_numerator, cn - pn AS numerator_change, pd AS previous_denominator, cd AS current_denominator, cd - pd AS denominator_change, {was} AS previous_value, {now} AS current_value,
        {now} - {was} AS absolute_change, ({now} - {was}) / nullif({was}, 0) AS percent_change, coalesce(greatest(cn - pn, 0) / nullif(sum(greatest(cn - pn, 0)) OVER (PARTITION BY segment_name), 0), 0) AS contribution_share_of_positive_change, least(pd, cd) < {least} AS min_denominator_flag FROM moved"""


_add("segment_drivers_generic", _generic(), *_generic_rows([Q.NOW], [Q.BEFORE]))
_add("segment_drivers_quarterly", _generic(), *_generic_rows(Q.QUARTER, Q.QUARTER_BEFORE))
_add(
    "complaint_rate_segments",
    _generic(" * 1000"),
    "cc AS (SELECT c.month, unnest(['product_type', 'customer_segment', 'fico_band', 'region']) AS segment_name, unnest([a.product_type, c.customer_segment, c.fico_band, a.region]) AS segment_value FROM complaints c LEFT JOIN accounts a USING (account_id))",
    "aa AS (SELECT s.month, s.account_id, unnest(['product_type', 'customer_segment', 'fico_band', 'region']) AS segment_name, unnest([a.product_type, a.customer_segment, a.fico_band, a.region]) AS segment_value FROM snapshots s LEFT JOIN accounts a USING (account_id) WHERE s.active_flag = 1)",
    f"""moved AS (SELECT segment_name, segment_value, CAST(coalesce(x.pn, 0) AS DOUBLE) AS pn, CAST(coalesce(x.cn, 0) AS DOUBLE) AS cn, CAST(coalesce(y.pd, 0) AS DOUBLE) AS pd, CAST(coalesce(y.cd, 0) AS DOUBLE) AS cd
        FROM (SELECT segment_name, segment_value, count(CASE WHEN month = '{Q.TEXT_BEFORE}' THEN 1 END) AS pn, count(CASE WHEN month = '{Q.TEXT_NOW}' THEN 1 END) AS cn FROM cc WHERE segment_value IS NOT NULL AND month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}') GROUP BY 1, 2) x
        FULL JOIN (SELECT segment_name, segment_value, count(DISTINCT account_id) FILTER (month = '{Q.TEXT_BEFORE}') AS pd, count(DISTINCT account_id) FILTER (month = '{Q.TEXT_NOW}') AS cd FROM aa WHERE segment_value IS NOT NULL AND month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}') GROUP BY 1, 2) y USING (segment_name, segment_value))""",
)
_add("missing_bucket", "SELECT CASE WHEN merchant_category IS NULL OR trim(merchant_category) = '' THEN '__missing__' ELSE merchant_category END AS merchant_category, count(*) AS rows, CAST(sum(is_disputed) AS BIGINT) AS disputed FROM transactions GROUP BY 1")

_leaf = "CASE WHEN channel = '1-URGENT' AND fico_band = '<=660' THEN 'channel == 1-URGENT AND fico_band == <=660' WHEN channel = '1-URGENT' THEN 'channel == 1-URGENT AND fico_band != <=660' ELSE 'channel != 1-URGENT' END"
_add(
    "leaf_summary",
    """SELECT rule, CAST(CASE WHEN rule LIKE '%AND%' THEN 2 ELSE 1 END AS INT) AS depth, p AS purchases, d AS disputed, CAST(d AS DOUBLE) / p AS dispute_rate, CAST(d AS DOUBLE) / p / (CAST(sum(d) OVER () AS DOUBLE) / CAST(sum(p) OVER () AS DOUBLE)) AS lift_vs_overall,
        CAST(p AS DOUBLE) / CAST(sum(p) OVER () AS DOUBLE) AS share_of_purchases FROM leaves""",
    _FACTS,
    f"leaves AS (SELECT {_leaf} AS rule, count(*) AS p, CAST(sum(is_disputed) AS BIGINT) AS d FROM facts WHERE month = '{Q.NOW}' GROUP BY 1)",
)
_add("csv_round_trip", "SELECT transaction_id, transaction_date, posted_date, coalesce(merchant_category, '') AS merchant_category, transaction_amount, is_disputed FROM transactions")
_add("parquet_round_trip", f"SELECT month, channel, count(*) AS rows, CAST(sum(is_disputed) AS BIGINT) AS disputed FROM transactions WHERE month IN ('{Q.NOW}', '{Q.BEFORE}') GROUP BY 1, 2")
_add("aliased_views", "SELECT month, count(DISTINCT account_id) AS active FROM snapshots WHERE active_flag = 1 GROUP BY 1")

# --- quality -----------------------------------------------------------------------

_REQUIRED = ("transaction_id", "account_id", "merchant_category", "channel", "transaction_amount")
_bad = {c: (f"({c} IS NULL)" if c == "transaction_amount" else f"({c} IS NULL OR trim({c}) = '')") for c in _REQUIRED}
_add("completeness", f"SELECT count(CASE WHEN {' OR '.join(_bad.values())} THEN 1 END) AS rows_with_blank, {', '.join(f'count(CASE WHEN {v} THEN 1 END) AS blank_{k}' for k, v in _bad.items())} FROM transactions")
_add("date_order_violations", "SELECT count(CASE WHEN posted_date < transaction_date THEN 1 END) AS violations, CAST(min(date_diff('day', CAST(transaction_date AS DATE), CAST(posted_date AS DATE))) AS INT) AS min_lag, CAST(max(date_diff('day', CAST(transaction_date AS DATE), CAST(posted_date AS DATE))) AS INT) AS max_lag, count(*) AS rows FROM transactions")
_SIGNS = {
    "purchase_not_positive": "transaction_type = 'purchase' AND NOT coalesce(transaction_amount > 0, false)",
    "fee_not_positive": "transaction_type = 'fee' AND NOT coalesce(transaction_amount > 0, false)",
    "paid_payment_not_negative": "transaction_type = 'payment' AND payment_failed = 0 AND NOT coalesce(transaction_amount < 0, false)",
    "failed_payment_not_zero": "transaction_type = 'payment' AND payment_failed = 1 AND NOT coalesce(transaction_amount = 0, false)",
}
_add("amount_sign_rules", f"SELECT {', '.join(f'count(CASE WHEN {v} THEN 1 END) AS {k}' for k, v in _SIGNS.items())}, count(CASE WHEN {' OR '.join(f'({v})' for v in _SIGNS.values())} THEN 1 END) AS rows_in_violation FROM transactions")
_add("accepted_values", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS field, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations, coalesce(string_agg(v, ', ' ORDER BY v) FILTER (r <= 5), '') AS examples FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY {c}) AS r FROM {t} WHERE {c} IS NOT NULL AND trim({c}) <> '' AND {c} NOT IN ({_list(d)}) GROUP BY {c})" for (t, c), d in Q.DOMAINS.items()))
_add("fk_orphans", " UNION ALL ".join(f"SELECT '{name}' AS child, count(*) AS orphan_rows, count(DISTINCT account_id) AS orphan_keys FROM {t} ANTI JOIN accounts USING (account_id)" for name, t in (("transactions", "transactions"), ("complaints", "complaints"), ("account_monthly_snapshot", "snapshots"))))


def _scanned(floor: str, by: str = "") -> str:
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
    return f"""scanned AS (SELECT *, CASE WHEN value IS NULL OR baseline_mean IS NULL THEN NULL WHEN greatest(baseline_std, {floor}) <= 0 THEN 0 ELSE (value - baseline_mean) / greatest(baseline_std, {floor}) END AS z FROM (
        SELECT *, CASE WHEN count(value) {over} >= 3 THEN avg(value) {over} END AS baseline_mean, CASE WHEN count(value) {over} >= 3 THEN stddev_pop(value) {over} END AS baseline_std FROM series))"""


def _worst(by: str = "", extra: str = "", value: str = "value") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {f'{by}, ' if by else ''}CASE WHEN z IS NOT NULL THEN month END AS month, {extra}{value} AS value, round(baseline_mean, 9) AS baseline_mean, round(baseline_std, 9) AS baseline_std, round(z, 9) AS z, months_scored,
        CASE WHEN abs(z) >= 3 THEN 'fail' WHEN abs(z) >= 2 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT *, row_number() OVER ({part}ORDER BY abs(z) DESC NULLS LAST, month) AS r, count(z) OVER ({part}) AS months_scored FROM scanned) WHERE r = 1"""


_COUNTS = "series AS (SELECT month, count(*) AS rows, CAST(count(*) AS DOUBLE) AS value FROM transactions GROUP BY 1)"
_ZERO, _NULLS, _KPI = "CAST(0 AS DOUBLE)", "CAST(0.002 AS DOUBLE) / CAST(3 AS DOUBLE)", "CAST(0.001 AS DOUBLE) / CAST(3 AS DOUBLE)"
_add("row_count_anomaly", "SELECT month, rows, value, round(baseline_mean, 9) AS baseline_mean, round(baseline_std, 9) AS baseline_std, round(z, 9) AS z FROM scanned", _COUNTS, _scanned(_ZERO))
_add("worst_month_scan", _worst(extra="rows, "), _COUNTS, _scanned(_ZERO))
_add(
    "null_rate_drift",
    _worst("field", "blanks, rows, ", "round(value, 9)"),
    "series AS (SELECT field, month, blanks, rows, CAST(blanks AS DOUBLE) / rows AS value FROM (SELECT month, count(*) AS rows, unnest(['merchant_category', 'channel', 'posted_date']) AS field, unnest([count(CASE WHEN merchant_category IS NULL OR trim(merchant_category) = '' THEN 1 END), count(CASE WHEN channel IS NULL OR trim(channel) = '' THEN 1 END), count(CASE WHEN posted_date IS NULL THEN 1 END)]) AS blanks FROM transactions GROUP BY 1))",
    _scanned(_NULLS, "field"),
)
_add("kpi_anomaly", _worst(extra="rows, "), "series AS (SELECT month, CAST(sum(is_disputed) AS BIGINT) AS rows, CAST(sum(is_disputed) AS DOUBLE) / count(*) AS value FROM transactions WHERE transaction_type = 'purchase' GROUP BY 1)", _scanned(_KPI))
_add(
    "category_psi",
    "SELECT month, round(sum(term), 9) AS psi, max_by(bucket, term) AS top_bucket, max_by(rows, term) AS top_rows FROM terms GROUP BY 1",
    "counts AS (SELECT month, CASE WHEN merchant_category IS NULL OR trim(merchant_category) = '' THEN '__missing__' ELSE merchant_category END AS bucket, count(*) AS n FROM transactions GROUP BY 1, 2)",
    "mix AS (SELECT m.month, b.bucket, coalesce(n, 0) AS rows, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY m.month) AS DOUBLE) AS share FROM (SELECT DISTINCT month FROM counts) m CROSS JOIN (SELECT DISTINCT bucket FROM counts) b LEFT JOIN counts c ON c.month = m.month AND c.bucket = b.bucket)",
    "terms AS (SELECT *, (greatest(share, 1e-6) - greatest(expected, 1e-6)) * ln(greatest(share, 1e-6) / greatest(expected, 1e-6)) AS term FROM (SELECT *, avg(share) OVER w AS expected, count(share) OVER w AS history FROM mix WINDOW w AS (PARTITION BY bucket ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE history >= 3)",
)
ORACLE["governance_completeness"] = "SELECT count(CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR trim(p_name) = '' OR trim(p_type) = '' OR trim(p_brand) = '' THEN 1 END) AS incomplete_metrics, '' AS missing_columns, count(*) AS metrics FROM part"
ORACLE["quality_summary"] = """
    WITH results AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS check_name, CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'P' THEN 'warn' ELSE 'fail' END AS status FROM orders)
    SELECT count(*) AS total, count(CASE WHEN status = 'pass' THEN 1 END) AS passed, count(CASE WHEN status = 'warn' THEN 1 END) AS warned, count(CASE WHEN status = 'fail' THEN 1 END) AS failed, (count(CASE WHEN status = 'pass' THEN 1 END) + count(CASE WHEN status = 'warn' THEN 1 END) * CAST(0.5 AS DOUBLE)) / count(*) AS weighted_pass_rate,
        coalesce(string_agg(check_name, '|' ORDER BY check_name) FILTER (status = 'fail'), '') AS failed_checks, coalesce(string_agg(check_name, '|' ORDER BY check_name) FILTER (status = 'warn'), '') AS warned_checks FROM results"""

# --- text ----------------------------------------------------------------------------

_add(
    "keyword_probes",
    "SELECT probe, previous, current, current - previous AS change FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS probe, count(CASE WHEN month = '{Q.TEXT_BEFORE}' AND regexp_matches(narrative, '{p}') THEN 1 END) AS previous, count(CASE WHEN month = '{Q.TEXT_NOW}' AND regexp_matches(narrative, '{p}') THEN 1 END) AS current FROM complaints" for k, p in Q.PROBES.items()) + ")",
)
_TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)"
ORACLE["tokenize"] = f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM tok"
ORACLE["ngrams"] = f"WITH {_TOKENS} SELECT doc_id, CAST(len(p) AS INT) AS n_pairs, md5(array_to_string(p, '|')) AS pairs_md5 FROM (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM tok)"
_HASHED = "(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) % 512)"
_VECTORS = f"vec AS (SELECT doc_id, {_HASHED} AS bucket, count(*) AS weight FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM tok) GROUP BY 1, 2)"
ORACLE["hash_vectors"] = f"WITH {_TOKENS}, {_VECTORS} SELECT doc_id, count(*) AS buckets, CAST(sum(weight) AS BIGINT) AS terms, CAST(sum(weight * weight) AS BIGINT) AS squares, CAST(sum(weight * bucket) AS BIGINT) AS moment FROM vec GROUP BY 1"
ORACLE["cosine_topk"] = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT arg_min(v, vec_id) AS q FROM v) SELECT vec_id, round(list_cosine_similarity(v, q), 9) AS similarity FROM v, q ORDER BY 2 DESC, 1 LIMIT 10"

_ANCHORS = ", ".join(f"('{theme}', {i}, '{i}.{j}', '{text}')" for i, (theme, texts) in enumerate(Q.TAXONOMY.items()) for j, text in enumerate(texts))
_THEMED = (
    _TOKENS,
    _VECTORS,
    f"anchors(theme, place, anchor, text) AS (VALUES {_ANCHORS})",
    f"anchor_vec AS (SELECT anchor, {_HASHED} AS bucket, count(*) AS weight FROM (SELECT anchor, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM (SELECT anchor, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM anchors)) GROUP BY 1, 2)",
    "norms AS (SELECT doc_id, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM vec GROUP BY 1)",
    "anchor_norms AS (SELECT anchor, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS anchor_norm FROM anchor_vec GROUP BY 1)",
    "shared AS (SELECT v.doc_id, a.anchor, sum(v.weight * a.weight) AS s FROM vec v JOIN anchor_vec a USING (bucket) GROUP BY 1, 2)",
    "sims AS (SELECT n.doc_id, t.theme, t.place, max(coalesce(CAST(s AS DOUBLE), 0) / (norm * anchor_norm)) AS similarity FROM norms n CROSS JOIN anchors t JOIN anchor_norms USING (anchor) LEFT JOIN shared USING (doc_id, anchor) GROUP BY 1, 2, 3)",
    "best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, place) AS r FROM sims)",
    """labelled AS (SELECT c.complaint_id, c.month, CASE WHEN c.merchant_category IS NULL OR trim(c.merchant_category) = '' THEN '__missing__' ELSE c.merchant_category END AS merchant_category, c.channel,
        CASE WHEN coalesce(similarity, 0) >= CAST(0.02 AS DOUBLE) THEN theme ELSE 'unclear_or_other' END AS theme_name, coalesce(similarity, 0) AS theme_similarity FROM complaints c LEFT JOIN best ON CAST(doc_id AS VARCHAR) = complaint_id AND r = 1)""",
)
_add("theme_assignment", "SELECT complaint_id, theme_name, round(theme_similarity, 9) AS theme_similarity FROM labelled", *_THEMED)


def _theme_counts(keys: str, skeleton: str, within: str) -> str:
    return f"""SELECT {keys}, p AS previous_complaints, c AS current_complaints, c - p AS complaint_change, p / nullif(CAST(sum(p) OVER ({within}) AS DOUBLE), 0) AS previous_share, c / nullif(CAST(sum(c) OVER ({within}) AS DOUBLE), 0) AS current_share,
        c / nullif(CAST(sum(c) OVER ({within}) AS DOUBLE), 0) - p / nullif(CAST(sum(p) OVER ({within}) AS DOUBLE), 0) AS share_change, round(a, 9) AS avg_similarity
        FROM (SELECT {keys}, coalesce(p, 0) AS p, coalesce(c, 0) AS c, a FROM ({skeleton}) LEFT JOIN (SELECT {keys}, count(CASE WHEN month = '{Q.TEXT_BEFORE}' THEN 1 END) AS p, count(CASE WHEN month = '{Q.TEXT_NOW}' THEN 1 END) AS c, avg(theme_similarity) AS a FROM recent GROUP BY ALL) USING ({keys}))"""


_THEMES = f"(SELECT unnest([{_list(Q.TAXONOMY)}]) AS theme_name)"
_add("theme_summary", _theme_counts("theme_name", f"SELECT * FROM {_THEMES}", ""), *_THEMED, f"recent AS (SELECT * FROM labelled WHERE month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}'))")
_add(
    "best_theme",
    f"SELECT theme_name, complaint_change FROM ({_theme_counts('theme_name', f'SELECT * FROM {_THEMES}', '')}) WHERE complaint_change > 0 ORDER BY complaint_change DESC, share_change DESC NULLS LAST, avg_similarity DESC NULLS LAST, theme_name LIMIT 1",
    *_THEMED,
    f"recent AS (SELECT * FROM labelled WHERE month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}'))",
)
_add(
    "segment_themes",
    _theme_counts("segment_name, segment_value, theme_name", f"SELECT DISTINCT segment_name, segment_value, t.theme_name FROM recent CROSS JOIN {_THEMES} t", "PARTITION BY segment_name, segment_value"),
    *_THEMED,
    f"recent AS (SELECT month, theme_name, theme_similarity, unnest(['merchant_category', 'channel']) AS segment_name, unnest([merchant_category, channel]) AS segment_value FROM labelled WHERE month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}'))",
)
_add("representative_docs", f"SELECT theme_name, CAST(r AS INT) AS rank, complaint_id, round(theme_similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY theme_name ORDER BY theme_similarity DESC, complaint_id) AS r FROM labelled WHERE month = '{Q.TEXT_NOW}') WHERE r <= 3", *_THEMED)

# --- actions and evidence -----------------------------------------------------------------

_BEST = f"best_driver AS (SELECT * FROM ({_generic(least=10)}) WHERE numerator_change > 0 AND NOT min_denominator_flag ORDER BY numerator_change DESC, absolute_change DESC NULLS LAST, contribution_share_of_positive_change DESC, segment_name, segment_value LIMIT 1)"
_FRAUD = _generic_rows([Q.NOW], [Q.BEFORE])
_add("best_rows", "SELECT segment_name, segment_value, numerator_change FROM best_driver", *_FRAUD, _BEST)
_add(
    "scenarios",
    "SELECT s AS scenario, round(events * part, 9) AS avoidable_events, round(events * part / d, 9) AS portfolio_rate_impact_pp, round(greatest(0, value - events * part / d), 9) AS projected_current_value FROM sized, (VALUES ('Conservative', CAST(0.25 AS DOUBLE)), ('Base', CAST(0.5 AS DOUBLE)), ('Stretch', CAST(0.75 AS DOUBLE))) p(s, part) WHERE events > 0 AND d > 0",
    *_FRAUD,
    _BEST,
    "sized AS (SELECT current_value AS value, current_denominator AS d, greatest(0, current_numerator - current_denominator * coalesce(previous_value, 0)) AS events FROM best_driver)",
)
ORACLE["finding_confidence"] = """
    SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'warn' END AS status, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'medium' END AS severity, o_orderpriority,
        least(CAST(CASE WHEN o_orderstatus = 'F' THEN 0.82 ELSE 0.62 END AS DOUBLE) + CAST(CASE WHEN o_orderpriority < '3' THEN 0.12 ELSE 0.06 END AS DOUBLE), CAST(0.98 AS DOUBLE)) AS confidence FROM orders"""
_NUMBERS = r"""nums AS (SELECT page_id, CAST(unnest(range(len(t))) AS INT) AS place, unnest(t) AS token FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '\b\d{4}-\d{2}(?:-\d{2})?\b', ' ', 'g'), '[-+]?\$?\d[\d,]*(?:\.\d+)?%?') AS t FROM pages)), valued AS (SELECT *, TRY_CAST(regexp_replace(token, '[,$%]', '', 'g') AS DOUBLE) AS value FROM nums)"""
ORACLE["extract_numbers"] = f"WITH {_NUMBERS} SELECT page_id, place, token, value FROM valued"
ORACLE["number_validation"] = f"""WITH {_NUMBERS}, keys AS (SELECT DISTINCT round(CAST(p_size AS DOUBLE), d) AS k FROM part, (SELECT unnest([1, 2, 3, 4, 6]) AS d)),
    judged AS (SELECT page_id, CASE WHEN list_has_any([round(value, 1), round(value, 2), round(value, 3), round(value, 4), round(value, 6)], (SELECT list(k) FROM keys)) THEN 'supported'
        WHEN value = floor(value) AND abs(value) <= 10 AND NOT contains(token, '%') AND NOT contains(token, '.') THEN 'ignored' ELSE 'unsupported' END AS verdict FROM valued WHERE value IS NOT NULL)
    SELECT page_id, verdict, count(*) AS tokens FROM judged GROUP BY 1, 2"""
ORACLE["selection_filter"] = "SELECT doc_id, source, lang FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src7') AND (lang = 'en' OR regexp_matches(concat_ws(' ', text, lang), '2019-?03|2021-?11'))"


# --- the whole report: each check as one row ---------------------------------------------------------------

_SOURCES = {"accounts": "accounts", "transactions": "transactions", "complaints": "complaints", "account_monthly_snapshot": "(SELECT *, month AS snapshot_month FROM snapshots)"}
_THERE = {
    "accounts": ("account_id", "product_type", "customer_segment", "fico_band", "region", "active_flag", "credit_limit"), "transactions": quality.REQUIRED["transactions"], "complaints": quality.REQUIRED["complaints"],
    "account_monthly_snapshot": ("snapshot_month", "account_id", "active_flag", "statement_balance", "is_30dpd"),
}


def _empty(c: str) -> str:
    return f"(trim(coalesce(CAST({c} AS VARCHAR), '')) = '')"


def _row(name: str, kind: str, table: str, columns: str, inner: str, fail: str = "high") -> str:
    """inner gives status and n, the rows concerned."""
    return f"SELECT '{name}' AS check_name, '{kind}' AS check_type, '{table}' AS table_name, status, CASE status WHEN 'fail' THEN '{fail}' WHEN 'warn' THEN 'medium' ELSE 'none' END AS severity, CASE WHEN status = 'pass' THEN 0 ELSE n END AS affected_rows, '{columns}' AS affected_columns FROM ({inner})"


def _broken(condition: str, source: str, always: bool = False) -> str:
    return f"SELECT count(*) FILTER ({condition}) AS n, CASE WHEN {'true' if always else f'count(*) FILTER ({condition}) > 0'} THEN 'fail' ELSE 'pass' END AS status FROM {source}"


def _anomalous(series: str, floor: str) -> str:
    return f"WITH series AS ({series}), {_scanned(floor)} SELECT status, n FROM ({_worst(extra='n, ')})"


def _drift(c: str) -> str:
    return f"""WITH counts AS (SELECT month, CASE WHEN {_empty(c)} THEN '__missing__' ELSE {c} END AS bucket, count(*) AS n FROM transactions GROUP BY 1, 2),
        mix AS (SELECT m.month, b.bucket, coalesce(n, 0) AS rows, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY m.month) AS DOUBLE) AS share FROM (SELECT DISTINCT month FROM counts) m CROSS JOIN (SELECT DISTINCT bucket FROM counts) b LEFT JOIN counts c ON c.month = m.month AND c.bucket = b.bucket),
        terms AS (SELECT *, (greatest(share, 1e-6) - greatest(expected, 1e-6)) * ln(greatest(share, 1e-6) / greatest(expected, 1e-6)) AS term FROM (SELECT *, avg(share) OVER w AS expected, count(share) OVER w AS history FROM mix WINDOW w AS (PARTITION BY bucket ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE history >= 3)
        SELECT CASE WHEN psi >= 0.25 THEN 'fail' WHEN psi >= 0.1 THEN 'warn' ELSE 'pass' END AS status, top_rows AS n FROM (SELECT month, sum(term) AS psi, max_by(rows, term) AS top_rows FROM terms GROUP BY 1) ORDER BY psi DESC, month LIMIT 1"""


_CHECKS = [
    _row("duplicate_source_event_ids", "rule_based", "transactions", "source_transaction_id", "SELECT CAST(sum(k - 1) AS BIGINT) AS n, CASE WHEN sum(k - 1) > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT count(*) AS k FROM transactions GROUP BY source_transaction_id)"),
    *(_row(f"required_field_completeness__{t}", "rule_based", t, ", ".join(quality.REQUIRED[t]), _broken(" OR ".join(map(_empty, there)), _SOURCES[t], set(there) != set(quality.REQUIRED[t]))) for t, there in _THERE.items()),
    _row("posted_on_or_after_transaction", "rule_based", "transactions", "transaction_date, posted_date", _broken("posted_date < transaction_date", "transactions")),
    _row("amount_sign_validity", "rule_based", "transactions", "transaction_amount, transaction_type, payment_failed", _broken(" OR ".join(f"({v})" for v in _SIGNS.values()), "transactions")),
    *(_row(f"accepted_values__{t}__{c}", "rule_based", t, c, _broken(f"NOT {_empty(c)} AND {c} NOT IN ({_list(d)})", _SOURCES[t]), "medium") for (t, c), d in Q.DOMAINS.items()),
    *(_row(f"referential_integrity__{t}__accounts", "rule_based", t, "account_id", _broken("true", f"{_SOURCES[t]} ANTI JOIN accounts USING (account_id)")) for t in ("transactions", "complaints", "account_monthly_snapshot")),
    *(_row(f"monthly_row_count_anomaly__{t}", "statistical", t, "*", _anomalous(f"SELECT month, count(*) AS n, CAST(count(*) AS DOUBLE) AS value FROM {_SOURCES[t]} GROUP BY 1", _ZERO)) for t in ("transactions", "complaints", "account_monthly_snapshot")),
    *(_row(f"null_rate_drift__{t}__{c}", "statistical", t, c, _anomalous(f"SELECT month, count(*) FILTER ({_empty(c)}) AS n, CAST(count(*) FILTER ({_empty(c)}) AS DOUBLE) / count(*) AS value FROM {_SOURCES[t]} GROUP BY 1", _NULLS)) for t, c in quality.NULL_RATES),
    *(_row(f"category_distribution_drift__{t}__{c}", "statistical", t, c, _drift(c)) for t, c in quality.MIXES),
    _row("kpi_anomaly__dispute_rate", "statistical", "transactions", "is_disputed", _anomalous("SELECT month, CAST(sum(is_disputed) AS BIGINT) AS n, CAST(sum(is_disputed) AS DOUBLE) / count(*) AS value FROM transactions WHERE transaction_type = 'purchase' GROUP BY 1", _KPI)),
    # The catalogue isn't among the tables: it is the engine's own and complete.
    _row("metric_governance_completeness", "governance", "metric_definitions", ", ".join(quality.GOVERNED), "SELECT 0 AS n, 'pass' AS status", "medium"),
]
_add("quality_report", "SELECT *, CAST(affected_rows AS BIGINT) AS affected_rows, md5(check_name || '|' || status) AS finding FROM (".replace("SELECT *,", "SELECT * EXCLUDE (affected_rows),") + " UNION ALL ".join(f"({c})" for c in _CHECKS) + ")")


# --- what the plan rests on ---------------------------------------------------------------------------------------

_PLAIN_THEMES = tuple(x.replace("CASE WHEN coalesce(similarity, 0) >= CAST(0.02 AS DOUBLE) THEN theme ELSE 'unclear_or_other' END AS theme_name", "coalesce(theme, 'unclear_or_other') AS theme_name") for x in _THEMED)
_RISE = "ORDER BY complaint_change DESC, share_change DESC NULLS LAST, avg_similarity DESC NULLS LAST, theme_name LIMIT 1"
_add(
    "scorecard",
    """SELECT signal, round(score, 9) AS score, weight, round(score * weight, 9) AS weighted_score FROM (
        SELECT 'Corrected KPI movement' AS signal, CASE WHEN change >= CAST(0.05 AS DOUBLE) THEN 1.0::DOUBLE WHEN change > 0 THEN 0.55::DOUBLE ELSE 0 END AS score, 0.3::DOUBLE AS weight FROM moves
        UNION ALL SELECT 'Driver concentration', least(1, greatest(0, coalesce((SELECT contribution_share_of_positive_change FROM lead_driver), 0)) / 0.5::DOUBLE), 0.3::DOUBLE
        UNION ALL SELECT 'Quality readiness', CASE WHEN count(*) = 0 THEN 1 ELSE greatest(0.25::DOUBLE, 1 - 0.2::DOUBLE * least(3, count(*) FILTER (regexp_matches(check_name, 'duplicate|referential|completeness|drift', 'i')))) END, 0.2::DOUBLE FROM checks WHERE status IN ('fail', 'warn')
        UNION ALL SELECT 'Customer text support', coalesce((SELECT least(1, 0.35::DOUBLE + coalesce(avg_similarity, 0)) FROM lead_theme), 0), 0.2::DOUBLE)""",
    _DISPUTES,
    f"moves AS (SELECT (c.cn / c.cd - p.cn / p.cd) / nullif(p.cn / p.cd, 0) AS change FROM monthly c, monthly p WHERE c.month = '{Q.NOW}' AND p.month = '{Q.BEFORE}')",
    *_generic_rows([Q.NOW], [Q.BEFORE], "is_disputed", ("merchant_category", "channel", "customer_segment", "product_type", "fico_band", "region")),
    f"lead_driver AS (SELECT * FROM ({_generic()}) WHERE numerator_change > 0 AND NOT min_denominator_flag ORDER BY numerator_change DESC, absolute_change DESC NULLS LAST, contribution_share_of_positive_change DESC, segment_name, segment_value LIMIT 1)",
    f"checks AS ({' UNION ALL '.join(f'({c})' for c in _CHECKS)})",
    *_PLAIN_THEMES,
    f"recent AS (SELECT * FROM labelled WHERE month IN ('{Q.TEXT_BEFORE}', '{Q.TEXT_NOW}'))",
    f"lead_theme AS (SELECT * FROM ({_theme_counts('theme_name', f'SELECT * FROM {_THEMES}', '')}) WHERE complaint_change > 0 {_RISE})",
)
