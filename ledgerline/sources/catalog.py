"""Source catalogue: export folders, their fields, and the serving schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    """One export folder of JSON-lines part files."""

    folder: str
    fields: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        # Leaf fields are read as text, so a value of an unexpected JSON type
        # never costs the whole line; the cleaning operators do the typing.
        return T.StructType([T.StructField(f, T.StringType()) for f in self.fields])


def _source(folder: str, fields: str) -> Source:
    return Source(folder, tuple(fields.split()))


# Folder and field names of the ERP export.
SOURCES: dict[str, Source] = {
    "order_headers": _source(
        "sales_order_headers",
        "salesOrder soldToParty salesOrderType salesOrganization customerPaymentTerms "
        "overallDeliveryStatus deliveryBlockReason headerBillingBlockReason "
        "transactionCurrency creationDate requestedDeliveryDate totalNetAmount",
    ),
    "order_items": _source(
        "sales_order_items",
        "salesOrder salesOrderItem salesOrderItemCategory material requestedQuantity "
        "requestedQuantityUnit transactionCurrency netAmount materialGroup productionPlant "
        "storageLocation salesDocumentRjcnReason itemBillingBlockReason",
    ),
    "delivery_headers": _source(
        "outbound_delivery_headers",
        "deliveryDocument creationDate actualGoodsMovementDate overallGoodsMovementStatus "
        "overallPickingStatus deliveryBlockReason shippingPoint",
    ),
    "delivery_items": _source(
        "outbound_delivery_items",
        "actualDeliveryQuantity batch deliveryDocument deliveryDocumentItem deliveryQuantityUnit "
        "itemBillingBlockReason lastChangeDate plant referenceSdDocument "
        "referenceSdDocumentItem storageLocation",
    ),
    "billing_headers": _source(
        "billing_document_headers",
        "billingDocument billingDocumentType creationDate creationTime lastChangeDateTime "
        "billingDocumentDate billingDocumentIsCancelled cancelledBillingDocument totalNetAmount "
        "transactionCurrency companyCode fiscalYear accountingDocument soldToParty",
    ),
    "billing_items": _source(
        "billing_document_items",
        "billingDocument billingDocumentItem material billingQuantity billingQuantityUnit "
        "netAmount transactionCurrency referenceSdDocument referenceSdDocumentItem",
    ),
    "payments": _source(
        "payments_accounts_receivable",
        "accountingDocument postingDate clearingDate amountInTransactionCurrency customer "
        "transactionCurrency",
    ),
    "partners": _source(
        "business_partners",
        "businessPartner customer businessPartnerCategory businessPartnerFullName "
        "businessPartnerGrouping businessPartnerName correspondenceLanguage createdByUser "
        "creationDate creationTime firstName formOfAddress industry lastChangeDate lastName "
        "organizationBpName1 organizationBpName2 businessPartnerIsBlocked isMarkedForArchiving",
    ),
    "cancellations": _source(
        "billing_document_cancellations",
        "billingDocument cancelledBillingDocument billingDocumentIsCancelled",
    ),
    "products": _source(
        "products",
        "product productType crossPlantStatus crossPlantStatusValidityDate creationDate "
        "createdByUser lastChangeDate lastChangeDateTime isMarkedForDeletion productOldId "
        "grossWeight weightUnit netWeight productGroup baseUnit division industrySector",
    ),
    "product_texts": _source("product_descriptions", "product language productDescription"),
}

# Read only by the document graph, never by the batch pipeline.
JOURNAL = _source(
    "journal_entry_items_accounts_receivable",
    "companyCode fiscalYear accountingDocument glAccount referenceDocument costCenter "
    "profitCenter transactionCurrency amountInTransactionCurrency companyCodeCurrency "
    "amountInCompanyCodeCurrency postingDate documentDate accountingDocumentType "
    "accountingDocumentItem assignmentReference lastChangeDateTime customer "
    "financialAccountType clearingDate clearingAccountingDocument clearingDocFiscalYear",
)

# Columns of the order table, in output order.
ORDER_COLUMNS_DDL = """
    sales_order_id string, customer_id string, customer_name string,
    order_created_date timestamp_ntz, requested_delivery_date timestamp_ntz,
    payment_terms string, currency string, order_total_net_amount double,
    total_items bigint, total_billed_amount double, total_paid_amount double,
    lifecycle_stage string, order_to_delivery_days bigint, delivery_to_billing_days bigint,
    billing_to_payment_days bigint, total_o2c_days bigint, is_delivery_delayed boolean,
    is_payment_overdue boolean, is_billing_cancelled boolean, is_unpaid boolean,
    missing_stage boolean, max_issue_severity bigint, revenue_leakage_amount double
"""

# Columns of the customer KPI list.
CUSTOMER_KPI_DDL = """
    customer_id string, customer_name string, total_orders bigint, total_revenue_inr double,
    total_paid_inr double, avg_o2c_days double, cancelled_orders bigint, overdue_orders bigint,
    unpaid_orders bigint, delayed_orders bigint, risk_score bigint
"""

# Blocks of the KPI document.
KPI_DOCUMENT_DDL = """
    generated_at string,
    overview struct<total_orders: bigint, total_order_items: bigint, unique_customers: bigint,
        total_revenue_inr: double, total_billed_inr: double, total_paid_inr: double,
        revenue_leakage_inr: double, billing_coverage_pct: double, payment_coverage_pct: double>,
    lifecycle_stages map<string, bigint>,
    cycle_times struct<avg_order_to_delivery_days: double, median_order_to_delivery_days: double,
        avg_delivery_to_billing_days: double, avg_billing_to_payment_days: double,
        avg_total_o2c_days: double, median_total_o2c_days: double>,
    issues struct<orders_with_delivery_delay: bigint, orders_payment_overdue: bigint,
        orders_billing_cancelled: bigint, orders_unpaid: bigint, orders_missing_stage: bigint,
        cancellation_rate_pct: double, delivery_delay_rate_pct: double>
"""
