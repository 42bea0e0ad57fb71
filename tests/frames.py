"""Hand-written frames: a small document chain with every edge case."""

from pyspark.sql import functions as F

ORDER = "salesOrder string, soldToParty string, customerPaymentTerms string, creationDate string, totalNetAmount string, deliveryBlockReason string"
ITEM = "salesOrder string, salesOrderItem string, material string, netAmount string, salesDocumentRjcnReason string"
DELIVERY = "deliveryDocument string, creationDate string"
DELIVERY_ITEM = "deliveryDocument string, deliveryDocumentItem string, referenceSdDocument string, referenceSdDocumentItem string"
BILLING = "billingDocument string, billingDocumentDate string, totalNetAmount string, billingDocumentIsCancelled string, accountingDocument string"
BILLING_ITEM = "billingDocument string, referenceSdDocument string, billingQuantity string, netAmount string"
PAYMENT = "accountingDocument string, postingDate string, amountInTransactionCurrency string"


def day(n, time="00:00:00.000Z"):
    return f"2025-01-{n:02d}T{time}"


def chain(spark):
    """Raw exports: order 1 paid late over a split delivery, 2 cancelled and
    unpaid, 3 delivered, 4 without a header, plus keys that are NULL."""
    make = spark.createDataFrame
    return {
        "order_headers": make(
            [
                ("1", "C1", "Z001", day(1), "100.50", ""),
                ("2", "C1", "Z009", day(1), "oops", "01"),
                ("3", None, None, day(1), "30", None),
                (None, "C9", "Z001", day(1), "1", ""),
            ],
            ORDER,
        ),
        "order_items": make(
            [
                ("1", "10", "M1", "60.5", ""),
                ("1", "20", "M2", "40", "92"),
                ("2", "000010", "M1", "20", None),
                ("2", "20", "M9", "20", ""),
                ("3", "10", None, "30", ""),
                ("4", "10", "M1", "5", ""),
                (None, "10", "M1", "7", ""),
            ],
            ITEM,
        ),
        "delivery_headers": make([("D1", day(4)), ("D2", day(6)), ("D3", day(5, "12:00:00Z"))], DELIVERY),
        "delivery_items": make(
            [
                ("D1", "000010", "1", "000010"),
                ("D2", "000020", "1", "000010"),
                ("D1", "000030", "1", "20"),
                ("D3", "000010", "2", "10"),
                ("D4", "000020", "2", "000020"),
                ("D5", "000010", "3", "10"),
                ("D6", "000010", None, "10"),
            ],
            DELIVERY_ITEM,
        ),
        "billing_headers": make(
            [
                ("B1", day(5), "100.5", "false", "A1"),
                ("B2", day(5), "9", "true", "A2"),
                ("B3", day(4, "23:00:00Z"), "20", "true", "A3"),
                ("B4", day(20), "20", None, "A4"),
            ],
            BILLING,
        ),
        "billing_items": make(
            [
                ("B2", "D1", "1", "9"),
                ("B1", "D1", "2", "100.5"),
                (None, "D1", "1", "bad"),
                ("B3", "D3", "1", "20"),
                ("B4", "D4", "1", "20"),
                ("B9", None, "1", "99"),
            ],
            BILLING_ITEM,
        ),
        "payments": make(
            [("A1", "2025-02-05T00:00:00Z", "60"), ("A1", "2025-02-07T00:00:00Z", "40.5"), (None, day(9), "5")],
            PAYMENT,
        ),
        "partners": make(
            [("C1", "Ann, Bo and Co", "false")],
            "businessPartner string, businessPartnerFullName string, businessPartnerIsBlocked string",
        ),
        "product_texts": make(
            [("M1", "FR", "vis"), ("M1", "EN", "screw"), ("M2", "EN", "bolt")],
            "product string, language string, productDescription string",
        ),
    }


def orders(spark, rows):
    """Order-table rows from partial dicts; what is left out gets a neutral value."""
    from ledgerline.sources.catalog import ORDER_COLUMNS_DDL

    neutral = {
        "sales_order_id": "0", "customer_id": None, "lifecycle_stage": "ordered",
        "is_delivery_delayed": False, "is_payment_overdue": False, "is_billing_cancelled": False,
        "is_unpaid": False, "missing_stage": False, "max_issue_severity": 0, "total_items": 1,
        "order_total_net_amount": 0.0, "total_billed_amount": 0.0, "total_paid_amount": 0.0,
    }
    schema = spark.createDataFrame([], ORDER_COLUMNS_DDL).schema
    full = [tuple({**neutral, **r}.get(name) for name in schema.names) for r in rows]
    return spark.createDataFrame(full, schema)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df):
    (row,) = df.collect()
    return row


def literal(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in columns.items()])
