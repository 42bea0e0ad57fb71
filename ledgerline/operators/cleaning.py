"""Cleaning: one projection per source table, from export fields to typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.coerce import KINDS

# Output column, export field, kind.
COLUMNS: dict[str, list[tuple[str, str, str]]] = {
    "order_headers": [
        ("sales_order_id", "salesOrder", "text"),
        ("customer_id", "soldToParty", "text"),
        ("order_type", "salesOrderType", "text"),
        ("sales_org", "salesOrganization", "text"),
        ("payment_terms", "customerPaymentTerms", "text"),
        ("currency", "transactionCurrency", "text"),
        ("order_created_date", "creationDate", "moment"),
        ("requested_delivery_date", "requestedDeliveryDate", "moment"),
        ("order_total_net_amount", "totalNetAmount", "number"),
        ("overall_delivery_status", "overallDeliveryStatus", "text"),
        ("delivery_block_reason", "deliveryBlockReason", "text"),
        ("billing_block_reason", "headerBillingBlockReason", "text"),
    ],
    "order_items": [
        ("sales_order_id", "salesOrder", "text"),
        ("sales_order_item", "salesOrderItem", "text"),
        ("material_id", "material", "text"),
        ("material_group", "materialGroup", "text"),
        ("item_qty", "requestedQuantity", "number"),
        ("qty_unit", "requestedQuantityUnit", "text"),
        ("item_net_amount", "netAmount", "number"),
        ("plant", "productionPlant", "text"),
        ("rejection_reason", "salesDocumentRjcnReason", "text"),
        ("item_billing_block", "itemBillingBlockReason", "text"),
    ],
    "delivery_headers": [
        ("delivery_id", "deliveryDocument", "text"),
        ("delivery_created_date", "creationDate", "moment"),
        ("actual_goods_movement_date", "actualGoodsMovementDate", "moment"),
        ("goods_movement_status", "overallGoodsMovementStatus", "text"),
        ("picking_status", "overallPickingStatus", "text"),
        ("delivery_block", "deliveryBlockReason", "text"),
        ("shipping_point", "shippingPoint", "text"),
    ],
    "delivery_items": [
        ("delivery_id", "deliveryDocument", "text"),
        ("delivery_item", "deliveryDocumentItem", "text"),
        ("sales_order_id", "referenceSdDocument", "text"),
        ("sales_order_item", "referenceSdDocumentItem", "item"),
        ("actual_delivery_qty", "actualDeliveryQuantity", "number"),
        ("delivery_plant", "plant", "text"),
        ("storage_location", "storageLocation", "text"),
    ],
    "billing_headers": [
        ("billing_doc_id", "billingDocument", "text"),
        ("billing_type", "billingDocumentType", "text"),
        ("billing_date", "billingDocumentDate", "moment"),
        ("billing_created", "creationDate", "moment"),
        ("billing_amount", "totalNetAmount", "number"),
        ("is_cancelled", "billingDocumentIsCancelled", "flag"),
        ("accounting_document", "accountingDocument", "text"),
        ("billing_customer_id", "soldToParty", "text"),
        ("company_code", "companyCode", "text"),
    ],
    "billing_items": [
        ("billing_doc_id", "billingDocument", "text"),
        ("billing_doc_item", "billingDocumentItem", "text"),
        ("delivery_id", "referenceSdDocument", "text"),
        ("delivery_item", "referenceSdDocumentItem", "text"),
        ("material_id", "material", "text"),
        ("billed_qty", "billingQuantity", "number"),
        ("billed_amount", "netAmount", "number"),
    ],
    "payments": [
        ("accounting_document", "accountingDocument", "text"),
        ("posting_date", "postingDate", "moment"),
        ("clearing_date", "clearingDate", "moment"),
        ("amount_paid", "amountInTransactionCurrency", "number"),
        ("pay_currency", "transactionCurrency", "text"),
        ("paying_customer", "customer", "text"),
    ],
    "partners": [
        ("customer_id", "businessPartner", "text"),
        ("customer_name", "businessPartnerFullName", "text"),
        ("is_blocked", "businessPartnerIsBlocked", "flag"),
    ],
    "product_texts": [
        ("material_id", "product", "text"),
        ("material_desc", "productDescription", "text"),
    ],
}


def clean(table: str, raw: DataFrame) -> DataFrame:
    """Typed columns of one source; a field the source lacks is all NULL."""
    present = set(raw.columns)
    columns = []
    for name, field, kind in COLUMNS[table]:
        convert, type_name = KINDS[kind]
        value = convert(field) if field in present else f"cast(NULL AS {type_name})"
        columns.append(f"{value} AS {name}")
    return raw.selectExpr(*columns)


def product_texts(raw: DataFrame) -> DataFrame:
    """One description per material: the first by language, then by text.

    Without a product or a description column there are none; without a
    language column the first is by text alone.
    """
    names = ("product", "language", "productDescription")
    texts = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names])
    if not {"product", "productDescription"} <= set(raw.columns):
        texts = texts.limit(0)
    first = F.min(F.struct("language", "productDescription"))
    return (
        texts.groupBy(F.col("product").alias("material_id"))
        .agg(first.alias("first"))
        .select("material_id", F.col("first.productDescription").alias("material_desc"))
    )


def clean_all(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table the item chain needs, cleaned."""
    cleaned = {name: clean(name, raw[name]) for name in COLUMNS if name != "product_texts"}
    cleaned["product_texts"] = product_texts(raw["product_texts"])
    return cleaned
