"""KPI documents, customer KPIs and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import serving
from ledgerline.operators.milestones import CYCLES

# Keys of the blocks of the KPI document, in output order.
OVERVIEW = [
    "total_orders",
    "total_order_items",
    "unique_customers",
    "total_revenue_inr",
    "total_billed_inr",
    "total_paid_inr",
    "revenue_leakage_inr",
    "billing_coverage_pct",
    "payment_coverage_pct",
]
CYCLE_STATS = [
    "avg_order_to_delivery_days",
    "median_order_to_delivery_days",
    "avg_delivery_to_billing_days",
    "avg_billing_to_payment_days",
    "avg_total_o2c_days",
    "median_total_o2c_days",
]
ISSUE_STATS = [
    "orders_with_delivery_delay",
    "orders_payment_overdue",
    "orders_billing_cancelled",
    "orders_unpaid",
    "orders_missing_stage",
    "cancellation_rate_pct",
    "delivery_delay_rate_pct",
]


def _money(c: Column | str) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 1)).otherwise(F.lit(0.0))


def sum_once_per(items: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of a value that repeats on every item of its document, counted once
    per document."""
    per_document = items.groupBy(key).agg(F.max(value).alias(value))
    return per_document.agg(_money(value).alias(value))


def item_totals(items: DataFrame) -> DataFrame:
    """Item count, billed and paid totals as one struct, from one pass over the items.

    Grouped by both documents first, which leaves a row per pair of documents;
    each total then takes a document once.
    """
    pairs = items.groupBy("billing_doc_id", "accounting_document").agg(
        F.count(F.lit(1)).alias("n"), F.max("billing_amount").alias("billed"), F.max("total_amount_paid").alias("paid")
    )
    kinds = F.array(
        F.struct(F.lit("b").alias("kind"), F.col("billing_doc_id").alias("id"), F.col("billed").alias("v"), F.col("n").alias("n")),
        F.struct(F.lit("p").alias("kind"), F.col("accounting_document").alias("id"), F.col("paid").alias("v"), F.lit(0).cast("long").alias("n")),
    )
    once = pairs.select(F.explode(kinds).alias("d")).groupBy("d.kind", "d.id").agg(
        F.max("d.v").alias("v"), F.sum("d.n").alias("n")
    )
    totals = once.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_order_items"),
        _money(F.when(F.col("kind") == "b", F.col("v"))).alias("total_billed_inr"),
        _money(F.when(F.col("kind") == "p", F.col("v"))).alias("total_paid_inr"),
    )
    return totals.select(F.struct("total_order_items", "total_billed_inr", "total_paid_inr").alias("totals"))


def overview(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Headline totals; billed and paid count each document once."""
    known = item_totals(items).scalar()
    revenue = F.col("total_revenue_inr")
    totals = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
        _money("order_total_net_amount").alias("total_revenue_inr"),
    )
    return (
        totals.withColumn("_known", known)
        .withColumns({c: F.col(f"_known.{c}") for c in ("total_order_items", "total_billed_inr", "total_paid_inr")})
        .withColumn("revenue_leakage_inr", F.round(revenue - F.col("total_paid_inr"), 2))
        .withColumn("billing_coverage_pct", _share(F.col("total_billed_inr"), revenue))
        .withColumn("payment_coverage_pct", _share(F.col("total_paid_inr"), revenue))
        .select(*OVERVIEW)
    )


def stage_counts(orders: DataFrame) -> DataFrame:
    """Orders per stage, most frequent first."""
    return (
        orders.filter(F.col("lifecycle_stage").isNotNull())
        .groupBy("lifecycle_stage")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy(F.desc("order_count"), "lifecycle_stage")
    )


def stage_map(orders: DataFrame) -> DataFrame:
    """The stage counts as one map; the stages are a small closed set."""
    counts = orders.filter(F.col("lifecycle_stage").isNotNull()).groupBy("lifecycle_stage").count()
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("rank"), "lifecycle_stage")))
    entries = F.transform(ranked, lambda e: F.struct(e["lifecycle_stage"], -e["rank"]))
    return counts.agg(F.map_from_entries(entries).alias("lifecycle_stages"))


def _cycle_columns(approximate: bool = False) -> list[Column]:
    def mean(c: str) -> Column:
        return F.round(F.avg(c), 2)

    def middle(c: str) -> Column:
        # Day counts take few distinct values, so the exact median's state stays small.
        half = F.percentile_approx(c, 0.5) if approximate else F.median(c)
        return F.round(half.cast("double"), 2)

    to_delivery, to_billing, to_payment, whole = CYCLES
    columns = [mean(to_delivery), middle(to_delivery), mean(to_billing), mean(to_payment), mean(whole), middle(whole)]
    return [c.alias(name) for c, name in zip(columns, CYCLE_STATS)]


def cycle_time_stats(orders: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean and median cycle times; NULL where no order has the span."""
    return orders.agg(*_cycle_columns(approximate))


def _issue_columns() -> list[Column]:
    def rate(flag: str) -> Column:
        return F.round(F.avg(F.col(flag).cast("int")) * 100, 1)

    columns = [
        F.count_if("is_delivery_delayed"),
        F.count_if("is_payment_overdue"),
        F.count_if("is_billing_cancelled"),
        F.count_if("is_unpaid"),
        F.count_if("missing_stage"),
        rate("is_billing_cancelled"),
        rate("is_delivery_delayed"),
    ]
    return [c.alias(name) for c, name in zip(columns, ISSUE_STATS)]


def issue_rates(orders: DataFrame) -> DataFrame:
    return orders.agg(*_issue_columns())


def _one_row(df: DataFrame, columns: list[str]) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*columns)).scalar()


def _stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def kpi_document(items: DataFrame, orders: DataFrame, generated_at: str | None = None) -> DataFrame:
    """The whole KPI document as one row of nested columns, stamped ``generated_at`` or now."""
    figures = orders.agg(*_cycle_columns(), *_issue_columns())
    return (
        figures.withColumn("overview", _one_row(overview(items, orders), OVERVIEW))
        .withColumn("lifecycle_stages", stage_map(orders).scalar())
        .select(
            (_stamp() if generated_at is None else F.lit(generated_at)).alias("generated_at"),
            "overview",
            "lifecycle_stages",
            F.struct(*CYCLE_STATS).alias("cycle_times"),
            F.struct(*ISSUE_STATS).alias("issues"),
        )
    )


# Filtered figures lack what only the item table knows, and the overdue count.
FILTERED_OVERVIEW = [c for c in OVERVIEW if c not in ("total_billed_inr", "billing_coverage_pct")]
FILTERED_ISSUES = [c for c in ISSUE_STATS if c != "orders_payment_overdue"]


def filtered_kpis(orders: DataFrame, customer: str | None = None, stage: str | None = None) -> DataFrame:
    """KPIs of the orders of one customer and/or stage, one flat row.

    Items and payments are summed over orders here, so a payment that covers
    several orders counts for each of them.
    """
    chosen = serving.select_orders(orders, customer=customer, stage=stage)
    revenue, paid = F.col("total_revenue_inr"), F.col("total_paid_inr")
    figures = chosen.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_order_items"),
        F.count_distinct("customer_id").alias("unique_customers"),
        _money("order_total_net_amount").alias("total_revenue_inr"),
        _money("total_paid_amount").alias("total_paid_inr"),
        *_cycle_columns(),
        *_issue_columns(),
    )
    return (
        figures.withColumn("revenue_leakage_inr", F.round(revenue - paid, 2))
        .withColumn("payment_coverage_pct", _share(paid, revenue))
        .select(*FILTERED_OVERVIEW, *CYCLE_STATS, *FILTERED_ISSUES)
    )


def filtered_document(orders: DataFrame, customer: str | None = None, stage: str | None = None) -> DataFrame:
    """``filtered_kpis`` as a nested document that names its filters."""
    chosen = serving.select_orders(orders, customer=customer, stage=stage)
    return nested(filtered_kpis(orders, customer, stage), stage_map(chosen), customer, stage)


def nested(figures: DataFrame, stages: DataFrame, customer: str | None, stage: str | None) -> DataFrame:
    """Filtered figures and their stage map as a document that names its filters."""
    filters = F.struct(
        F.lit(customer).cast("string").alias("customer"), F.lit(stage).cast("string").alias("stage")
    )
    return figures.withColumn("lifecycle_stages", stages.scalar()).select(
        _stamp().alias("generated_at"),
        filters.alias("filters"),
        F.struct(*FILTERED_OVERVIEW).alias("overview"),
        "lifecycle_stages",
        F.struct(*CYCLE_STATS).alias("cycle_times"),
        F.struct(*FILTERED_ISSUES).alias("issues"),
    )


def kpi_summary(
    document: DataFrame, orders: DataFrame, customer: str | None = None, stage: str | None = None
) -> DataFrame:
    """The stored document when nothing is filtered, else figures of the selection."""
    if not customer and not stage:
        return document
    return filtered_document(orders, customer, stage)


def customer_kpis(orders: DataFrame) -> DataFrame:
    """KPIs per customer, highest risk first.

    Grouped by id and name first: name is then a key and every buffer a number,
    as in the order roll-up; the second step has one row per customer.
    """
    named = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "customer_name")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("order_total_net_amount").alias("revenue"),
            F.sum("total_paid_amount").alias("paid"),
            F.sum("total_o2c_days").alias("days"),
            F.count("total_o2c_days").alias("timed"),
            F.count_if("is_billing_cancelled").alias("cancelled_orders"),
            F.count_if("is_payment_overdue").alias("overdue_orders"),
            F.count_if("is_unpaid").alias("unpaid_orders"),
            F.count_if("is_delivery_delayed").alias("delayed_orders"),
            F.sum("max_issue_severity").alias("risk_score"),
        )
    )
    counts = ["cancelled_orders", "overdue_orders", "unpaid_orders", "delayed_orders"]
    mean_days = F.sum("days") / F.nullif(F.sum("timed"), F.lit(0))
    return (
        named.groupBy("customer_id")
        .agg(
            F.min("customer_name").alias("customer_name"),
            F.sum("total_orders").alias("total_orders"),
            _money("revenue").alias("total_revenue_inr"),
            _money("paid").alias("total_paid_inr"),
            F.round(mean_days, 2).alias("avg_o2c_days"),
            *[F.sum(c).alias(c) for c in counts],
            F.coalesce(F.sum("risk_score"), F.lit(0)).alias("risk_score"),
        )
        .orderBy(F.desc("risk_score"), "customer_id")
    )


def dashboard_tiles(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Issue page counts (cancellations by stage) and the uncollected share."""
    uncollected = overview(items, orders).select(F.round(100 - F.col("payment_coverage_pct"), 1)).scalar()
    return orders.agg(
        F.count_if(F.col("lifecycle_stage") == "cancelled").alias("cancellations"),
        F.count_if("is_delivery_delayed").alias("delivery_delays"),
        F.count_if("is_unpaid").alias("unpaid_orders"),
        F.count_if("missing_stage").alias("missing_stages"),
    ).withColumn("uncollected_pct", uncollected)


def issue_heatmap(orders: DataFrame) -> DataFrame:
    """Orders per customer and issue type, one column per type.

    Orders without a customer are a row of their own, so columns add up to the KPI document.
    """
    return orders.groupBy("customer_id").agg(
        F.count_if("is_delivery_delayed").alias("delayed"),
        F.count_if("is_billing_cancelled").alias("cancelled"),
        F.count_if("is_unpaid").alias("unpaid"),
        F.count_if("missing_stage").alias("missing"),
    )


def revenue_funnel(orders: DataFrame) -> DataFrame:
    """Amount ordered, billed and paid per customer; orders without one are a row of their own."""
    return orders.groupBy("customer_id").agg(
        _money("order_total_net_amount").alias("ordered_inr"),
        _money("total_billed_amount").alias("billed_inr"),
        _money("total_paid_amount").alias("paid_inr"),
    )


def days_sales_outstanding(items: DataFrame, orders: DataFrame, days: int = 365) -> DataFrame:
    """Receivables over revenue, times the days of the period.

    Receivables are what is billed and not paid, each document counted once.
    """
    receivable = F.col("total_billed_inr") - F.col("total_paid_inr")
    revenue = F.nullif(F.col("total_revenue_inr"), F.lit(0.0))
    return overview(items, orders).select(
        F.round(receivable, 2).alias("receivable_inr"),
        F.col("total_revenue_inr"),
        F.round(receivable / revenue * days, 1).alias("dso_days"),
    )
