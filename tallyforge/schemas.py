"""Table schemas. Dates are DateType, money is LongType paise."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DateType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


BANK = _schema(
    settlement_id=_S, date=_D, amount=_L, utr_reference=_S, payer_account=_S, fees_deducted=_L,
    tax_deducted=_L, net_amount=_L, description=_S, currency=_S, ingest_seq=_L,
)
LEDGER = _schema(
    order_id=_S, invoice_date=_D, expected_amount=_L, customer_name=_S, customer_reference=_S,
    expected_settlement_date=_D, tax_amount=_L, currency=_S, status=_S, ingest_seq=_L,
)
GATEWAY = _schema(
    payout_id=_S, payout_date=_D, order_id=_S, utr_reference=_S, gross_amount=_L, gateway_fee=_L,
    gateway_tax=_L, net_payout=_L, status=_S, ingest_seq=_L,
)
MATCHES = _schema(
    settlement_id=_S, order_id=_S, rule_applied=_S, confidence=T.DoubleType(), phase=T.IntegerType(), status=_S,
    payout_id=_S,
)
EXCEPTIONS = _schema(
    record_id=_S, source=_S, category=_S, reason=_S, suggested_action=_S, priority=_S,
    is_exception=T.BooleanType(),
)
GROUND_TRUTH = _schema(settlement_id=_S, order_id=_S, is_true_match=T.BooleanType())
EMBEDDING = T.ArrayType(T.FloatType())
