"""Input schemas, declared rather than inferred."""

from pyspark.sql import types as T

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TABLES = {
    "accounts": _schema(account_id=S, open_date=TS, product_type=S, customer_segment=S, fico_band=S, region=S, state=S, channel_origin=S, active_flag=I, current_balance=D, credit_limit=D),
    "account_monthly_snapshot": _schema(snapshot_month=S, account_id=S, active_flag=I, statement_balance=D, credit_limit=D, utilization_rate=D, days_past_due=I, is_30dpd=I, charge_off_balance=D, source_system=S, snapshot_loaded_at=TS),
    "transactions": _schema(transaction_id=S, source_transaction_id=S, account_id=S, transaction_date=TS, posted_date=TS, merchant_category=S, merchant_name=S, channel=S, transaction_amount=D, transaction_type=S, is_disputed=I, is_fraud_claim=I, payment_failed=I, ingestion_batch_id=S, source_system=S, created_at=TS),
    "complaints": _schema(complaint_id=S, account_id=S, related_transaction_id=S, date_received=TS, product=S, sub_product=S, issue=S, sub_issue=S, complaint_narrative=S, submitted_via=S, company_response=S, timely_response=S, merchant_category=S, channel=S, customer_segment=S, fico_band=S, state=S),
    "metric_definitions": _schema(metric_name=S, business_definition=S, numerator=S, denominator=S, grain=S, refresh_frequency=S, owner=S, source_tables=S, known_limitations=S),
}

ALIASES = {"snapshots": "account_monthly_snapshot", "snapshot": "account_monthly_snapshot"}
