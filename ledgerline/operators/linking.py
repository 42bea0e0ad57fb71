"""The document chain: orders to deliveries to billing to payments.

All joins are left equi-joins.  ``unified_items`` composes them so that each
document table is joined at its own grain first (a customer name onto the
order header, billing and payment onto the delivery) and the item table, by
far the largest, is shuffled by material while it is narrow and then only by
its order.  Left equi-joins are associative, so the rows are those of the
item-first chain.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.coerce import item_key
from ledgerline.sources.sinks import Steps

ITEM_KEY = ["sales_order_id", "sales_order_item_norm"]


def total(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is NULL."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def billing_per_delivery(billing_items: DataFrame, order_column: str | None = None) -> DataFrame:
    """First billing document, billed quantity and amount of each delivery.

    "First" is the lowest document id, or the one with the lowest
    ``order_column`` (NULLs last); file order means nothing in a distributed scan.  Items
    are added up per document first, a hash aggregate over numbers; the first
    document is then chosen among few rows.
    """
    rank = F.lit(0) if order_column is None else F.min(order_column)  # NULL only if all are
    per_document = (
        billing_items.filter(F.col("delivery_id").isNotNull())
        .groupBy("delivery_id", "billing_doc_id")
        .agg(F.sum("billed_qty").alias("qty"), F.sum("billed_amount").alias("amount"), rank.alias("rank"))
    )
    last = F.col("rank").isNull().alias("last")
    named = F.when(F.col("billing_doc_id").isNotNull(), F.struct(last, "rank", "billing_doc_id"))
    return (
        per_document.groupBy("delivery_id")
        .agg(
            F.min(named).alias("first"),
            total("qty").alias("billed_qty"),
            total("amount").alias("billed_amount_sum"),
        )
        .select("delivery_id", "first.billing_doc_id", "billed_qty", "billed_amount_sum")
    )


def payments_per_document(payments: DataFrame) -> DataFrame:
    """Earliest posting and clearing, and amount paid, of each accounting document."""
    return (
        payments.filter(F.col("accounting_document").isNotNull())
        .groupBy("accounting_document")
        .agg(
            F.min("posting_date").alias("payment_posting_date"),
            F.min("clearing_date").alias("payment_clearing_date"),
            total("amount_paid").alias("total_amount_paid"),
        )
    )


def with_headers(items: DataFrame, headers: DataFrame) -> DataFrame:
    return items.join(headers, "sales_order_id", "left")


def with_item_key(items: DataFrame) -> DataFrame:
    return items.withColumn("sales_order_item_norm", item_key("sales_order_item"))


def delivery_links(delivery_items: DataFrame) -> DataFrame:
    """Delivery items under the normalised item key."""
    return with_item_key(delivery_items).select(
        *ITEM_KEY, "delivery_id", "delivery_item", "actual_delivery_qty", "delivery_plant", "storage_location"
    )


def with_deliveries(
    items: DataFrame,
    delivery_items: DataFrame,
    attach: Callable[[DataFrame], DataFrame] = lambda links: links,
    steps: Steps | None = None,
) -> DataFrame:
    """Split deliveries give one row per delivery item.

    ``attach`` adds to the links what is known of their deliveries, before they
    meet the items.  With ``steps`` it gets the pairs of order and delivery, a
    row for however many links; both are laid out by order, and written so.
    """
    order, pair = "sales_order_id", ["sales_order_id", "delivery_id"]

    def attached() -> DataFrame:
        links = delivery_links(delivery_items).filter(F.col(order).isNotNull())
        known = attach(links.select(*pair).distinct())
        return links.repartition(order).join(known.repartition(order), pair, "left")

    links = attach(delivery_links(delivery_items)) if steps is None else steps("links", attached, order)
    return with_item_key(items).join(links, ITEM_KEY, "left")


def with_delivery_headers(rows: DataFrame, delivery_headers: DataFrame) -> DataFrame:
    return rows.join(delivery_headers, "delivery_id", "left")


def with_billing(rows: DataFrame, billing: DataFrame) -> DataFrame:
    """Attach ``billing_per_delivery``."""
    return rows.join(billing, "delivery_id", "left")


def with_billing_headers(rows: DataFrame, billing_headers: DataFrame) -> DataFrame:
    return rows.join(billing_headers, "billing_doc_id", "left")


def with_payments(rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Attach ``payments_per_document``."""
    return rows.join(payments, "accounting_document", "left")


def with_partners(rows: DataFrame, partners: DataFrame) -> DataFrame:
    return rows.join(partners, "customer_id", "left")


def with_product_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach descriptions; without any in the source they are empty text, not NULL."""
    none = texts.agg(F.count(F.lit(1)) == 0).scalar()
    described = rows.join(texts, "material_id", "left")
    return described.withColumn("material_desc", F.when(none, F.lit("")).otherwise(F.col("material_desc")))


# Columns of the item table, in output order.
ITEM_COLUMNS = """
    sales_order_id sales_order_item material_id material_group item_qty qty_unit item_net_amount
    plant rejection_reason item_billing_block customer_id order_type sales_org payment_terms
    currency order_created_date requested_delivery_date order_total_net_amount
    overall_delivery_status delivery_block_reason billing_block_reason sales_order_item_norm
    delivery_id delivery_item actual_delivery_qty delivery_plant storage_location
    delivery_created_date actual_goods_movement_date goods_movement_status picking_status
    delivery_block shipping_point billing_doc_id billed_qty billed_amount_sum billing_type
    billing_date billing_created billing_amount is_cancelled accounting_document
    billing_customer_id company_code payment_posting_date payment_clearing_date
    total_amount_paid customer_name is_blocked material_desc
""".split()


def unified_items(t: Mapping[str, DataFrame], steps: Steps | None = None) -> DataFrame:
    """One row per order item (and delivery), with everything the chain knows of it.

    With ``steps`` the larger joins are written, so that few shuffles are on disk at a time.
    """

    def step(name: str, plan: Callable[[], DataFrame], *by: str) -> DataFrame:
        return steps(name, plan, *by) if steps else plan()

    def billed() -> DataFrame:
        first = with_billing_headers(billing_per_delivery(t["billing_items"]), t["billing_headers"])
        return with_payments(first, payments_per_document(t["payments"]))

    def delivered(links: DataFrame) -> DataFrame:
        return with_billing(with_delivery_headers(links, t["delivery_headers"]), step("billed", billed))

    def described() -> DataFrame:
        return with_product_texts(t["order_items"], t["product_texts"])

    # product texts meet the narrow items, before header and delivery columns widen them
    ordered = with_headers(step("described", described, "sales_order_id"), with_partners(t["order_headers"], t["partners"]))
    items = with_deliveries(ordered, t["delivery_items"], delivered, steps)
    if steps:
        steps.drop("billed")
    return items.select(*ITEM_COLUMNS)
