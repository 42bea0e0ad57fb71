"""One registered query per operator, with its expected-result SQL.

A query takes the ``DataSet`` of a test-table folder: its exports for the
cleaning and linking operators, its written serving tables for the rest.
Where an operator needs text the test tables lack, Spark derives it from them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import answers, bands, coerce, days, display
from ledgerline.operators import (
    cleaning,
    cube,
    directory,
    docgraph,
    grid,
    issues,
    kpis,
    linking,
    milestones,
    payloads,
    rollup,
    serving,
    sketches,
)
from ledgerline.plans import batch, oracle
from ledgerline.plans.store import DataSet
from ledgerline.sources import drops, readers, sinks, snapshots
from ledgerline.sources.catalog import CUSTOMER_KPI_DDL, ORDER_COLUMNS_DDL, SOURCES, Source

Query = Callable[[DataSet], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Arguments of the look-up and filter queries.
CUSTOMER = "42"
ORDER = "7"
AS_OF = "1998-06-01"


def query(sql: str | None = None, chain: bool = True) -> Callable[[Query], Query]:
    """Register under the function's name; ``chain`` puts the item chain's CTEs first."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = oracle.over_chain(sql) if chain else sql
        return build

    return register


def rounded(df: DataFrame, *columns: str, places: int = 2) -> DataFrame:
    """Amounts to cents, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def table(d: DataSet, name: str) -> DataFrame:
    return d.spark.read.parquet(f"{d.sf_dir}/{name}.parquet")


def base_items(d: DataSet) -> DataFrame:
    """The item table as linked, before any derived column."""
    return d.serving().items.select(*linking.ITEM_COLUMNS)


ITEM_ID = ["sales_order_id", "sales_order_item"]

# --- cleaning -------------------------------------------------------------


def _cleaned(d: DataSet, name: str) -> DataFrame:
    return cleaning.clean(name, d.exports()[name])


@query("SELECT * FROM soh")
def clean_order_headers(d: DataSet) -> DataFrame:
    return _cleaned(d, "order_headers")


@query("SELECT * FROM soi")
def clean_order_items(d: DataSet) -> DataFrame:
    return _cleaned(d, "order_items")


@query("SELECT * FROM odh")
def clean_delivery_headers(d: DataSet) -> DataFrame:
    return _cleaned(d, "delivery_headers")


@query("SELECT * FROM odi")
def clean_delivery_items(d: DataSet) -> DataFrame:
    return _cleaned(d, "delivery_items")


@query("SELECT * EXCLUDE (amount, orderkey, status) FROM bdh")
def clean_billing_headers(d: DataSet) -> DataFrame:
    return rounded(_cleaned(d, "billing_headers"), "billing_amount")


@query("SELECT * EXCLUDE (l_partkey, l_orderkey, l_returnflag, o_orderstatus) FROM bdi")
def clean_billing_items(d: DataSet) -> DataFrame:
    return _cleaned(d, "billing_items")


@query("SELECT * REPLACE (round(amount_paid, 4) AS amount_paid) FROM pay")
def clean_payments(d: DataSet) -> DataFrame:
    return rounded(_cleaned(d, "payments"), "amount_paid", places=4)


@query("SELECT * FROM bp")
def clean_partners(d: DataSet) -> DataFrame:
    return _cleaned(d, "partners")


@query("SELECT * FROM pdesc")
def product_desc(d: DataSet) -> DataFrame:
    return cleaning.product_texts(d.exports()["product_texts"])


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 9
        WHEN 4 THEN o_orderdate + INTERVAL 90 MINUTE
        WHEN 5 THEN o_orderdate - INTERVAL 330 MINUTE
        WHEN 6 THEN o_orderdate + INTERVAL 300 MINUTE
        WHEN 7 THEN o_orderdate + INTERVAL 930 MINUTE
        WHEN 8 THEN o_orderdate + INTERVAL 600 MINUTE END AS parsed
    FROM orders""",
    chain=False,
)
def null_tokens(d: DataSet) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("string")
    kind = F.col("o_orderkey") % 9
    text = (
        F.when(kind == 0, "")
        .when(kind == 1, "nan")
        .when(kind == 2, "None")
        .when(kind == 3, "no date")
        .when(kind == 4, F.concat(day, F.lit("T01:30:00.000Z")))
        .when(kind == 5, F.concat(day, F.lit("T00:00:00+05:30")))
        .when(kind == 6, F.concat(day, F.lit("T10:00:00+05")))
        .when(kind == 7, F.concat(day, F.lit("T10:00-0530")))
        .otherwise(F.concat(day, F.lit("T10:00:00z")))
    )
    raw = table(d, "orders").select("o_orderkey", text.alias("raw"))
    return raw.select("o_orderkey", coerce.parse_or_null("raw").alias("parsed"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_extendedprice END AS amount
    FROM lineitem""",
    chain=False,
)
def json_safe(d: DataSet) -> DataFrame:
    line = F.col("l_linenumber")
    amount = (
        F.when(line == 1, float("nan"))
        .when(line == 2, float("inf"))
        .when(line == 3, float("-inf"))
        .otherwise(F.col("l_extendedprice"))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return coerce.json_safe(table(d, "lineitem").select(*keys, amount.alias("amount")))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS is_returned,
        l_linestatus = 'F' AS missing_stage
    FROM lineitem""",
    chain=False,
)
def bool_strings(d: DataSet) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    returned = F.when(flag == "R", "True").when(flag == "A", "False").when(flag == "N", "yes")
    lines = table(d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        returned.alias("is_returned"),
        F.when(status == "F", "True").alias("missing_stage"),
    )
    return coerce.flags_from_text(lines)


@query(
    """
    SELECT sales_order_id, payment_terms,
        CAST(CASE payment_terms WHEN 'Z009' THEN 0 ELSE 30 END AS BIGINT) AS expected_days,
        CAST(CASE payment_terms WHEN 'Z030' THEN 30 WHEN 'Z009' THEN 5 ELSE 10 END AS BIGINT)
            AS expected_days_custom
    FROM soh"""
)
def payment_terms_days(d: DataSet) -> DataFrame:
    terms = F.col("payment_terms")
    return _cleaned(d, "order_headers").select(
        "sales_order_id",
        "payment_terms",
        coerce.payment_term_days(terms).alias("expected_days"),
        coerce.payment_term_days(terms, {"Z030": 30, "Z009": 5}, 10).alias("expected_days_custom"),
    )


# --- joins ----------------------------------------------------------------


@query("SELECT soi.*, soh.* EXCLUDE (sales_order_id) FROM soi LEFT JOIN soh USING (sales_order_id)")
def items_with_headers(d: DataSet) -> DataFrame:
    return linking.with_headers(_cleaned(d, "order_items"), _cleaned(d, "order_headers"))


_DELIVERED = """(
    SELECT soi.*, soi.sales_order_item AS sales_order_item_norm, odi.* EXCLUDE (sales_order_id, sales_order_item),
        odh.* EXCLUDE (delivery_id)
    FROM soi LEFT JOIN odi USING (sales_order_id, sales_order_item) LEFT JOIN odh USING (delivery_id))"""


def _first(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def _delivered(d: DataSet, chain: str = "", billed: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Items with their deliveries; documents meet the narrow links first, and the items are shuffled once.

    With ``billed`` in steps: what is known of deliveries, then the links with it.
    """
    steps = d.steps(chain) if billed else None

    def attach(links: DataFrame) -> DataFrame:
        headed = linking.with_delivery_headers(links, _cleaned(d, "delivery_headers"))
        return linking.with_billing(headed, steps("billed", billed)) if steps else headed

    found = linking.with_deliveries(_cleaned(d, "order_items"), _cleaned(d, "delivery_items"), attach, steps)
    if steps:
        steps.drop("billed")
    return found


@query(f"SELECT * FROM {_DELIVERED}")
def items_with_deliveries(d: DataSet) -> DataFrame:
    return _first(_delivered(d), "delivery_id")


@query(
    """
    SELECT delivery_id, arg_min(billing_doc_id, (known IS NULL, known, billing_doc_id)) AS billing_doc_id,
        sum(billed_qty) AS billed_qty, round(sum(billed_amount), 2) AS billed_amount_sum
    FROM (SELECT *, CASE WHEN billing_doc_id LIKE '%-0' THEN NULL ELSE 7 END AS known FROM bdi)
    GROUP BY delivery_id"""
)
def billing_per_delivery_ordered(d: DataSet) -> DataFrame:
    """The first document by a column that is NULL for some: those come last."""
    known = F.when(~F.col("billing_doc_id").endswith("-0"), F.lit(7))
    items = _cleaned(d, "billing_items").withColumn("known", known)
    return rounded(linking.billing_per_delivery(items, "known"), "billed_amount_sum")


@query("SELECT * FROM bagg")
def billing_per_delivery(d: DataSet) -> DataFrame:
    return rounded(
        linking.billing_per_delivery(_cleaned(d, "billing_items")), "billed_amount_sum"
    )


@query("SELECT * FROM pagg")
def payments_per_document(d: DataSet) -> DataFrame:
    return rounded(linking.payments_per_document(_cleaned(d, "payments")), "total_amount_paid")


_BILLED = f"""(
    SELECT * FROM {_DELIVERED} LEFT JOIN bagg USING (delivery_id)
    LEFT JOIN (SELECT * EXCLUDE (amount, orderkey, status) FROM bdh) USING (billing_doc_id))"""


def _billing(d: DataSet) -> DataFrame:
    """The first billing document of each delivery, with its header."""
    billing = linking.billing_per_delivery(_cleaned(d, "billing_items"))
    return linking.with_billing_headers(billing, _cleaned(d, "billing_headers"))


@query(f"SELECT * FROM {_BILLED}")
def items_with_billing(d: DataSet) -> DataFrame:
    found = _delivered(d, "billed", lambda: _billing(d))
    return rounded(_first(found, "billing_doc_id", "delivery_id"), "billed_amount_sum", "billing_amount")


@query(f"SELECT * FROM {_BILLED} LEFT JOIN pagg USING (accounting_document)")
def items_with_payments(d: DataSet) -> DataFrame:
    def paid() -> DataFrame:
        return linking.with_payments(_billing(d), linking.payments_per_document(_cleaned(d, "payments")))

    found = _delivered(d, "paid", paid)
    return rounded(_first(found, "accounting_document", "billing_doc_id", "delivery_id"), *_ITEM_AMOUNTS)


_ITEM_AMOUNTS = ["billed_amount_sum", "billing_amount", "total_amount_paid"]


def _linked(d: DataSet, chain: str, raw: Mapping[str, DataFrame]) -> DataFrame:
    """The linked items, written by order."""
    return rounded(batch.linked_items(raw, d.steps(chain), lambda items: items), *_ITEM_AMOUNTS)


@query("SELECT * FROM linked")
def unified_items(d: DataSet) -> DataFrame:
    return _linked(d, "unified", d.exports())


# --- derived item columns -------------------------------------------------

_CYCLES = ", ".join(milestones.CYCLES)


@query(f"SELECT sales_order_id, sales_order_item, {_CYCLES} FROM items")
def cycle_times(d: DataSet) -> DataFrame:
    return milestones.cycle_times(base_items(d)).select(*ITEM_ID, *milestones.CYCLES)


@query(
    f"""
    SELECT event_id, {oracle.days("TIMESTAMP '2024-01-10 12:00:00'", "ts")} AS elapsed,
        {oracle.days("ts", "TIMESTAMP '2024-01-10 12:00:00'")} AS elapsed_back,
        CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 86400000000.0 + 0.5)
            AS BIGINT) AS rounded
    FROM events""",
    chain=False,
)
def days_rounded(d: DataSet) -> DataFrame:
    fixed, ts = F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'"), F.col("ts")
    return table(d, "events").select(
        "event_id",
        days.elapsed_days(fixed, ts).alias("elapsed"),
        days.elapsed_days(ts, fixed).alias("elapsed_back"),
        days.rounded_days(fixed, ts).alias("rounded"),
    )


@query(
    """
    SELECT sales_order_id, sales_order_item, lifecycle_stage, has_delivery, has_billing,
        has_payment, missing_stage FROM items"""
)
def lifecycle_stage(d: DataSet) -> DataFrame:
    return milestones.stages(base_items(d)).select(
        *ITEM_ID, "lifecycle_stage", "has_delivery", "has_billing", "has_payment", "missing_stage"
    )


@query(
    """
    SELECT sales_order_id, sales_order_item, order_to_delivery_days, is_delivery_delayed,
        coalesce(order_to_delivery_days > 4, FALSE) AS is_delayed_beyond_4
    FROM items"""
)
def delivery_delayed(d: DataSet) -> DataFrame:
    timed = milestones.cycle_times(base_items(d))
    beyond_4 = milestones.delivery_delayed(timed, 4).withColumnRenamed(
        "is_delivery_delayed", "is_delayed_beyond_4"
    )
    return milestones.delivery_delayed(beyond_4).select(
        *ITEM_ID, "order_to_delivery_days", "is_delivery_delayed", "is_delayed_beyond_4"
    )


@query(
    """
    SELECT sales_order_id, sales_order_item, billing_to_payment_days, expected_payment_days,
        is_payment_overdue FROM items"""
)
def payment_overdue(d: DataSet) -> DataFrame:
    return milestones.payment_overdue(milestones.cycle_times(base_items(d))).select(
        *ITEM_ID, "billing_to_payment_days", "expected_payment_days", "is_payment_overdue"
    )


@query("SELECT sales_order_id, sales_order_item, is_unpaid FROM items")
def unpaid(d: DataSet) -> DataFrame:
    return milestones.unpaid(base_items(d)).select(*ITEM_ID, "is_unpaid")


@query("SELECT sales_order_id, sales_order_item, is_billing_cancelled FROM items")
def cancelled_billing(d: DataSet) -> DataFrame:
    return milestones.billing_cancelled(base_items(d)).select(*ITEM_ID, "is_billing_cancelled")


@query("SELECT sales_order_id, sales_order_item, is_rejected FROM items")
def rejected_items(d: DataSet) -> DataFrame:
    return milestones.rejected(base_items(d)).select(*ITEM_ID, "is_rejected")


@query("SELECT sales_order_id, sales_order_item, has_delivery_block FROM items")
def delivery_blocks(d: DataSet) -> DataFrame:
    return milestones.delivery_blocked(base_items(d)).select(*ITEM_ID, "has_delivery_block")


@query("SELECT * FROM items")
def issue_severity(d: DataSet) -> DataFrame:
    return rounded(milestones.with_milestones(base_items(d)), *_ITEM_AMOUNTS)


@query(
    f"""
    SELECT sales_order_id, sales_order_item,
        coalesce(billing_date + to_days(CAST(expected_payment_days AS INTEGER))
            < TIMESTAMP '{AS_OF}', FALSE) AS is_overdue
    FROM items"""
)
def overdue_as_of(d: DataSet) -> DataFrame:
    as_of = F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")
    term = coerce.payment_term_days(F.col("payment_terms"))
    return base_items(d).select(
        *ITEM_ID, days.overdue_as_of(F.col("billing_date"), term, as_of).alias("is_overdue")
    )


# --- order and customer bands ---------------------------------------------


@query(
    """
    SELECT sales_order_id, max_issue_severity,
        CASE WHEN max_issue_severity >= 4 THEN 'critical' WHEN max_issue_severity >= 2 THEN 'warning'
            ELSE 'info' END AS severity_level,
        CASE WHEN max_issue_severity >= 4 THEN 'Critical' WHEN max_issue_severity >= 2 THEN 'Warning'
            ELSE 'Low' END AS severity_caption,
        least(max_issue_severity, 4) AS severity_band
    FROM order_table"""
)
def severity_level(d: DataSet) -> DataFrame:
    score = F.col("max_issue_severity")
    return d.serving().orders.select(
        "sales_order_id",
        "max_issue_severity",
        bands.severity_level(score).alias("severity_level"),
        bands.severity_caption(score).alias("severity_caption"),
        bands.severity_band(score).alias("severity_band"),
    )


@query(
    """
    SELECT customer_id, risk_score, least(risk_score // 5, 5) AS card_tier,
        least(risk_score, 5) AS table_tier,
        CASE WHEN least(risk_score // 5, 5) >= 4 THEN 'critical'
            WHEN least(risk_score // 5, 5) >= 2 THEN 'warning' ELSE 'info' END AS card_level
    FROM customer_table"""
)
def risk_tier(d: DataSet) -> DataFrame:
    risk = F.col("risk_score")
    return d.serving().customers.select(
        "customer_id",
        "risk_score",
        bands.card_tier(risk).alias("card_tier"),
        bands.table_tier(risk).alias("table_tier"),
        bands.severity_level(bands.card_tier(risk)).alias("card_level"),
    )


@query(
    """
    SELECT sales_order_id, lifecycle_stage, CAST(CASE lifecycle_stage WHEN 'ordered' THEN 0
            WHEN 'delivered' THEN 1 WHEN 'billed' THEN 2 WHEN 'paid' THEN 3 ELSE -1 END AS BIGINT)
            AS stage_index,
        CASE lifecycle_stage WHEN 'ordered' THEN 'active,open,open,open'
            WHEN 'delivered' THEN 'done,active,open,open' WHEN 'billed' THEN 'done,done,active,open'
            WHEN 'paid' THEN 'done,done,done,active' ELSE 'open,open,open,open' END AS track
    FROM order_table"""
)
def stage_position(d: DataSet) -> DataFrame:
    stage = F.col("lifecycle_stage")
    states = F.transform(bands.stage_track(stage), lambda s: s["state"])
    return d.serving().orders.select(
        "sales_order_id",
        "lifecycle_stage",
        bands.stage_position(stage).alias("stage_index"),
        F.array_join(states, ",").alias("track"),
    )


# --- roll-up and KPIs -----------------------------------------------------

_ORDER_AMOUNTS = ["total_billed_amount", "total_paid_amount", "revenue_leakage_amount"]


def _orders(d: DataSet) -> DataFrame:
    return rounded(d.serving().orders, *_ORDER_AMOUNTS)


@query("SELECT * FROM order_table")
def order_view(d: DataSet) -> DataFrame:
    return rounded(rollup.order_view(d.serving().items_by_order, batch.named_headers(cleaning.clean_all(d.exports()))), *_ORDER_AMOUNTS)


@query(
    """
    SELECT customer_id, lifecycle_stage FROM (
        SELECT customer_id, lifecycle_stage, count(*) AS n FROM items
        WHERE customer_id IS NOT NULL GROUP BY customer_id, lifecycle_stage)
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, lifecycle_stage) = 1"""
)
def most_frequent_stage(d: DataSet) -> DataFrame:
    items = d.serving().items.filter(F.col("customer_id").isNotNull())
    return rollup.most_frequent(items, ["customer_id"], "lifecycle_stage")


@query("SELECT * FROM kpi_overview")
def kpi_overview(d: DataSet) -> DataFrame:
    t = d.serving()
    return kpis.overview(t.items, t.orders)


@query(
    """
    SELECT round(sum(v), 2) AS billing_amount
    FROM (SELECT max(billing_amount) AS v FROM items GROUP BY billing_doc_id)"""
)
def sum_once_per_document(d: DataSet) -> DataFrame:
    return kpis.sum_once_per(d.serving().items, "billing_doc_id", "billing_amount")


@query(
    "SELECT lifecycle_stage, count(*) AS order_count FROM order_table GROUP BY lifecycle_stage"
)
def stage_counts(d: DataSet) -> DataFrame:
    return kpis.stage_counts(d.serving().orders)


@query("SELECT * FROM cycle_stats")
def cycle_time_stats(d: DataSet) -> DataFrame:
    return kpis.cycle_time_stats(d.serving().orders)


@query("SELECT * FROM issue_stats")
def issue_rates(d: DataSet) -> DataFrame:
    return kpis.issue_rates(d.serving().orders)


_STAGE_TEXT = """(SELECT string_agg(lifecycle_stage || '=' || n, ',' ORDER BY lifecycle_stage)
    FROM (SELECT lifecycle_stage, count(*) AS n FROM order_table{where} GROUP BY lifecycle_stage))"""


def _stage_text() -> F.Column:
    pairs = F.transform(
        F.map_entries("lifecycle_stages"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(F.sort_array(pairs), ",").alias("stage_text")


_DOCUMENT = f"kpi_overview.*, cycle_stats.*, issue_stats.*, {_STAGE_TEXT.format(where='')} AS stage_text"


@query(f"SELECT '2025-01-01' AS generated_at, {_DOCUMENT} FROM kpi_overview, cycle_stats, issue_stats")
def kpi_document(d: DataSet) -> DataFrame:
    """The document as JSON text, parsed back."""
    t = d.serving()
    document = kpis.kpi_document(t.items, t.orders, generated_at="2025-01-01")
    text = F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"})
    parsed = document.select(F.from_json(text, document.schema).alias("p")).select("p.*")
    return parsed.select("generated_at", "overview.*", "cycle_times.*", "issues.*", _stage_text())


@query(
    f"""
    SELECT kpi_overview.*, cycle_stats.*, issue_stats.*, {_STAGE_TEXT.format(where="")} AS stage_text
    FROM kpi_overview, cycle_stats, issue_stats"""
)
def kpi_document_flat(d: DataSet) -> DataFrame:
    t = d.serving()
    document = kpis.kpi_document(t.items, t.orders)
    return document.select("overview.*", "cycle_times.*", "issues.*", _stage_text())


@query("SELECT * FROM customer_table")
def customer_kpis(d: DataSet) -> DataFrame:
    return kpis.customer_kpis(d.serving().orders)


@query("SELECT * FROM customer_table")
def customer_kpis_from_exports(d: DataSet) -> DataFrame:
    """The whole chain in one plan, from JSON lines."""
    return batch.plan(readers.read_all(d.spark, d.jsonl(), files=_FILES)).customers


def _filtered_sql(where: str) -> str:
    cycles = ", ".join(
        f"round(avg({c}), 2) AS avg_{c}"
        + (f", round(CAST(median({c}) AS DOUBLE), 2) AS median_{c}" if median else "")
        for c, median in zip(milestones.CYCLES, (True, False, False, True))
    )
    return f"""
    SELECT *, round(total_revenue_inr - total_paid_inr, 2) AS revenue_leakage_inr,
        coalesce(round(total_paid_inr / nullif(total_revenue_inr, 0) * 100, 1), 0)
            AS payment_coverage_pct
    FROM (SELECT count(*) AS total_orders,
            CAST(coalesce(sum(total_items), 0) AS BIGINT) AS total_order_items,
            count(DISTINCT customer_id) AS unique_customers,
            round(coalesce(sum(order_total_net_amount), 0), 2) AS total_revenue_inr,
            round(coalesce(sum(total_paid_amount), 0), 2) AS total_paid_inr, {cycles},
            count(*) FILTER (WHERE is_delivery_delayed) AS orders_with_delivery_delay,
            count(*) FILTER (WHERE is_billing_cancelled) AS orders_billing_cancelled,
            count(*) FILTER (WHERE is_unpaid) AS orders_unpaid,
            count(*) FILTER (WHERE missing_stage) AS orders_missing_stage,
            round(avg(CAST(is_billing_cancelled AS INTEGER)) * 100, 1) AS cancellation_rate_pct,
            round(avg(CAST(is_delivery_delayed AS INTEGER)) * 100, 1) AS delivery_delay_rate_pct
        FROM order_table WHERE {where})"""


@query(_filtered_sql("lifecycle_stage = 'paid'"))
def kpi_filtered(d: DataSet) -> DataFrame:
    return cube.filtered_kpis(d.serving().cube, stage="paid")


@query(_filtered_sql("lifecycle_stage = 'paid'"))
def kpi_filtered_scan(d: DataSet) -> DataFrame:
    """The same figures over the order table."""
    return kpis.filtered_kpis(d.serving().orders, stage="paid")


@query(_filtered_sql(f"customer_id = '{CUSTOMER}' AND lifecycle_stage = 'no such stage'"))
def kpi_filtered_empty(d: DataSet) -> DataFrame:
    return cube.filtered_kpis(d.serving().cube, CUSTOMER, "no such stage")


_REQUESTS = {
    "everything": ("TRUE", None, None),
    "customer": (f"customer_id = '{CUSTOMER}'", CUSTOMER, None),
    "customer and stage": (f"customer_id = '{CUSTOMER}' AND lifecycle_stage = 'paid'", CUSTOMER, "paid"),
    "stage": ("lifecycle_stage = 'billed'", None, "billed"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS request, * FROM ({_filtered_sql(where)})" for name, (where, _, _) in _REQUESTS.items()))
def kpi_cube_requests(d: DataSet) -> DataFrame:
    """Requests of all kinds of filter, each from the cube's cells of its level."""
    answers = [
        cube.filtered_kpis(d.serving().cube, customer, stage).withColumn("request", F.lit(name))
        for name, (_, customer, stage) in _REQUESTS.items()
    ]
    return reduce(DataFrame.unionByName, answers)


@query(
    f"""
    SELECT 'all' AS request, total_orders, total_paid_inr, {_STAGE_TEXT.format(where="")} AS stage_text
    FROM kpi_overview
    UNION ALL
    SELECT 'customer', count(*), round(sum(total_paid_amount), 2),
        {_STAGE_TEXT.format(where=f" WHERE customer_id = '{CUSTOMER}'")}
    FROM order_table WHERE customer_id = '{CUSTOMER}'"""
)
def kpi_dispatch(d: DataSet) -> DataFrame:
    t = d.serving()

    def line(request: str, customer: str | None) -> DataFrame:
        answer = cube.summary(t.document, t.cube, customer)
        return answer.select(
            F.lit(request).alias("request"),
            "overview.total_orders",
            "overview.total_paid_inr",
            _stage_text(),
        )

    return line("all", None).unionByName(line("customer", CUSTOMER))


@query(
    """
    SELECT lifecycle_stage, count(*) AS orders, TRUE AS customers_near, TRUE AS orders_near, TRUE AS median_near
    FROM order_table GROUP BY lifecycle_stage"""
)
def sketch_estimates(d: DataSet) -> DataFrame:
    """Distinct counts and medians out of merged sketches, held against the exact ones.

    Near: within four standard errors of the count, and within a hundredth of the ranks.
    """
    orders, by = d.serving().orders, "lifecycle_stage"
    found = sketches.estimates(sketches.merged(sketches.build(orders), by), by)
    span = "order_to_delivery_days"
    exact = orders.groupBy(by).agg(
        F.count_distinct("customer_id").alias("c"), F.count_distinct("sales_order_id").alias("o"), F.count(span).alias("n")
    )
    ranked = orders.join(found.select(by, f"p50_{span}"), by).groupBy(by).agg(
        F.count_if(F.col(span) < F.col(f"p50_{span}")).alias("below"), F.count_if(F.col(span) <= F.col(f"p50_{span}")).alias("upto")
    )
    error = 4 * 1.04 / 2 ** (sketches.REGISTERS / 2)

    def near(estimate: str, count: str) -> F.Column:
        return F.abs(F.col(estimate) - F.col(count)) <= F.ceil(F.col(count) * error)

    median = (F.col("below") <= F.col("n") * 0.51) & (F.col("upto") >= F.col("n") * 0.49)
    return found.join(exact, by).join(ranked, by).select(
        by,
        "orders",
        near("customers", "c").alias("customers_near"),
        near("distinct_orders", "o").alias("orders_near"),
        median.alias("median_near"),
    )


@query(
    """
    SELECT 'cancelled' AS issue_type, count(*) FILTER (WHERE is_billing_cancelled) AS order_count
        FROM order_table
    UNION ALL SELECT 'delayed', count(*) FILTER (WHERE is_delivery_delayed) FROM order_table
    UNION ALL SELECT 'missing', count(*) FILTER (WHERE missing_stage) FROM order_table
    UNION ALL SELECT 'unpaid', count(*) FILTER (WHERE is_unpaid) FROM order_table"""
)
def issue_counts_by_type(d: DataSet) -> DataFrame:
    return issues.counts_by_type(d.serving().orders)


_ANY = "(is_delivery_delayed OR is_billing_cancelled OR is_unpaid OR missing_stage)"


@query(f"SELECT count(*) FILTER (WHERE {_ANY}) AS total_flagged FROM order_table")
def total_flagged(d: DataSet) -> DataFrame:
    return issues.total_flagged(d.serving().orders)


@query(
    """
    SELECT max_issue_severity AS severity, count(*) AS order_count
    FROM order_table GROUP BY max_issue_severity"""
)
def severity_histogram(d: DataSet) -> DataFrame:
    return issues.severity_histogram(d.serving().orders)


@query(
    """
    SELECT DISTINCT 'stage' AS list_name, lifecycle_stage AS list_value FROM order_table
    UNION ALL SELECT DISTINCT 'customer', customer_id FROM order_table"""
)
def filter_values(d: DataSet) -> DataFrame:
    return serving.filter_values(d.serving().orders)


@query(
    """
    SELECT count(*) FILTER (WHERE lifecycle_stage = 'cancelled') AS cancellations,
        count(*) FILTER (WHERE is_delivery_delayed) AS delivery_delays,
        count(*) FILTER (WHERE is_unpaid) AS unpaid_orders,
        count(*) FILTER (WHERE missing_stage) AS missing_stages,
        (SELECT round(100 - payment_coverage_pct, 1) FROM kpi_overview) AS uncollected_pct
    FROM order_table"""
)
def dashboard_tiles(d: DataSet) -> DataFrame:
    t = d.serving()
    return kpis.dashboard_tiles(t.items, t.orders)


@query(
    """
    SELECT customer_id, count(*) FILTER (WHERE is_delivery_delayed) AS delayed,
        count(*) FILTER (WHERE is_billing_cancelled) AS cancelled,
        count(*) FILTER (WHERE is_unpaid) AS unpaid, count(*) FILTER (WHERE missing_stage) AS missing
    FROM order_table GROUP BY customer_id"""
)
def issue_heatmap(d: DataSet) -> DataFrame:
    return kpis.issue_heatmap(d.serving().orders)


@query(
    """
    SELECT customer_id, round(sum(order_total_net_amount), 2) AS ordered_inr,
        round(sum(total_billed_amount), 2) AS billed_inr, round(sum(total_paid_amount), 2) AS paid_inr
    FROM order_table GROUP BY customer_id"""
)
def revenue_funnel(d: DataSet) -> DataFrame:
    return kpis.revenue_funnel(d.serving().orders)


@query(
    """
    SELECT round(total_billed_inr - total_paid_inr, 2) AS receivable_inr, total_revenue_inr,
        round((total_billed_inr - total_paid_inr) / total_revenue_inr * 365, 1) AS dso_days
    FROM kpi_overview"""
)
def dso(d: DataSet) -> DataFrame:
    t = d.serving()
    return kpis.days_sales_outstanding(t.items, t.orders)


# --- serving --------------------------------------------------------------


@query(f"SELECT * FROM order_table WHERE customer_id = '{CUSTOMER}'")
def orders_by_customer(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), customer=CUSTOMER)


@query("SELECT * FROM order_table WHERE lifecycle_stage = 'cancelled'")
def orders_by_stage(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), stage="cancelled")


@query("SELECT * FROM order_table WHERE max_issue_severity >= 2")
def orders_min_severity(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), min_severity=2)


@query("SELECT * FROM order_table WHERE is_unpaid")
def orders_by_issue(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), issue_type="unpaid")


@query("SELECT * FROM order_table")
def orders_unknown_issue(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), issue_type="no such issue")


@query(
    """
    SELECT * FROM order_table
    WHERE lifecycle_stage = 'billed' AND max_issue_severity >= 2 AND is_delivery_delayed"""
)
def orders_combined_filter(d: DataSet) -> DataFrame:
    return serving.select_orders(_orders(d), stage="billed", min_severity=2, issue_type="delayed")


@query(f"SELECT * FROM order_table WHERE sales_order_id = '{ORDER}'")
def order_lookup(d: DataSet) -> DataFrame:
    return serving.order_by_id(_orders(d), ORDER)


@query(
    f"""
    SELECT *, (SELECT count(*) FROM items WHERE sales_order_id = '{ORDER}') AS item_count
    FROM items WHERE sales_order_id = '{ORDER}'"""
)
def order_items(d: DataSet) -> DataFrame:
    return serving.order_items(rounded(d.serving().items, *_ITEM_AMOUNTS), ORDER)


@query(f"SELECT * FROM customer_table WHERE customer_id = '{CUSTOMER}'")
def customer_lookup(d: DataSet) -> DataFrame:
    return serving.customer_by_id(d.serving().customers, CUSTOMER)


@query(
    f"""
    SELECT *, (SELECT count(*) FROM order_table WHERE customer_id = '{CUSTOMER}') AS order_count
    FROM order_table WHERE customer_id = '{CUSTOMER}'"""
)
def customer_orders(d: DataSet) -> DataFrame:
    return serving.customer_orders(_orders(d), CUSTOMER)


@query(
    """
    SELECT sales_order_id, max_issue_severity, concat_ws(', ',
        CASE WHEN is_delivery_delayed THEN 'Delayed delivery' END,
        CASE WHEN is_payment_overdue THEN 'Payment overdue' END,
        CASE WHEN is_billing_cancelled THEN 'Billing cancelled' END,
        CASE WHEN is_unpaid THEN 'Unpaid' END, CASE WHEN missing_stage THEN 'Missing stage' END)
        AS flags
    FROM order_table WHERE max_issue_severity > 0 OR is_billing_cancelled"""
)
def flagged_orders_ui(d: DataSet) -> DataFrame:
    return (
        d.serving()
        .orders.filter(serving.needs_attention())
        .select(
            "sales_order_id",
            "max_issue_severity",
            F.array_join(bands.flag_captions(), ", ").alias("flags"),
        )
    )


@query(
    """
    SELECT *, (SELECT count(*) FROM order_table WHERE lifecycle_stage = 'billed') AS total
    FROM order_table WHERE lifecycle_stage = 'billed'
    ORDER BY order_created_date DESC NULLS LAST, sales_order_id LIMIT 50 OFFSET 100"""
)
def orders_page(d: DataSet) -> DataFrame:
    return serving.list_orders(_orders(d), stage="billed", limit=50, offset=100)


def _page_sql(where: str, order: str, limit: int, offset: int) -> str:
    return f"""
    SELECT *, (SELECT count(*) FROM order_table WHERE {where}) AS total FROM order_table WHERE {where}
    ORDER BY {order} DESC NULLS LAST, sales_order_id LIMIT {limit} OFFSET {offset}"""


def _paged(found: DataFrame) -> DataFrame:
    return rounded(found, "total_billed_amount", "total_paid_amount", "revenue_leakage_amount")


@query(_page_sql("TRUE", "order_created_date", 100, 10_000))
def orders_page_deep(d: DataSet) -> DataFrame:
    """A page far down, out of the directory: only the ranges it falls into are read."""
    return _paged(directory.list_orders(d.directory("orders"), limit=100, offset=10_000))


@query(_page_sql("lifecycle_stage = 'paid' AND max_issue_severity >= 1", "order_created_date", 50, 400))
def orders_page_deep_filtered(d: DataSet) -> DataFrame:
    return _paged(directory.list_orders(d.directory("orders"), "paid", min_severity=1, limit=50, offset=400))


@query(_page_sql("is_unpaid", "max_issue_severity", 200, 600))
def issues_page_deep(d: DataSet) -> DataFrame:
    return _paged(directory.list_issues(d.directory("issues"), "unpaid", offset=600).drop("issue_labels"))


@query(f"SELECT * FROM order_table WHERE sales_order_id = '{ORDER}'")
def order_lookup_grid(d: DataSet) -> DataFrame:
    """An order out of the grid: a slice of the cells is read."""
    return _paged(grid.order_by_id(d.grid(), ORDER))


@query(
    f"""
    SELECT *, (SELECT count(*) FROM order_table WHERE customer_id = '{CUSTOMER}') AS order_count
    FROM order_table WHERE customer_id = '{CUSTOMER}'"""
)
def customer_orders_grid(d: DataSet) -> DataFrame:
    """A customer's orders out of the grid: a slice of the cells, the other way, is read."""
    return _paged(grid.customer_orders(d.grid(), CUSTOMER))


@query(_page_sql(f"customer_id = '{CUSTOMER}' AND coalesce(max_issue_severity, 0) >= 1", "order_created_date", 20, 0))
def customer_page_grid(d: DataSet) -> DataFrame:
    """A filtered page of one customer's orders out of the grid."""
    return _paged(grid.list_orders(d.grid(), CUSTOMER, min_severity=1, limit=20))


@query("SELECT * FROM order_table ORDER BY total_o2c_days NULLS LAST, sales_order_id")
def orders_sorted(d: DataSet) -> DataFrame:
    return serving.sort_orders(_orders(d), "total_o2c_days", "asc")


@query(
    f"""
    SELECT * EXCLUDE (delayed, cancelled, unpaid, missing), concat_ws(' | ', delayed, cancelled, unpaid,
        missing) AS labels
    FROM (SELECT *, (SELECT count(*) FROM order_table WHERE {_ANY}) AS total,
            CASE WHEN is_delivery_delayed THEN 'Delivery delayed beyond threshold' END AS delayed,
            CASE WHEN is_billing_cancelled THEN 'Billing document cancelled' END AS cancelled,
            CASE WHEN is_unpaid THEN 'Invoice raised but no payment received' END AS unpaid,
            CASE WHEN missing_stage THEN 'Incomplete lifecycle — missing stage' END AS missing
        FROM order_table WHERE {_ANY}
        ORDER BY max_issue_severity DESC NULLS LAST, sales_order_id LIMIT 200 OFFSET 200)"""
)
def issues_page(d: DataSet) -> DataFrame:
    labelled = issues.list_issues(_orders(d), limit=200, offset=200)
    return labelled.withColumn("labels", F.array_join("issue_labels", " | ")).drop("issue_labels")


@query(
    """
    SELECT *, (SELECT count(*) FROM order_table WHERE is_unpaid) AS total FROM order_table WHERE is_unpaid
    ORDER BY max_issue_severity DESC NULLS LAST, sales_order_id LIMIT 50"""
)
def issues_typed(d: DataSet) -> DataFrame:
    return issues.list_issues(_orders(d), issue_type="unpaid", limit=50).drop("issue_labels")


@query(
    f"""
    SELECT *, (SELECT count(*) FROM order_table WHERE {_ANY}) AS total FROM order_table WHERE {_ANY}
    ORDER BY max_issue_severity DESC NULLS LAST, sales_order_id LIMIT 50"""
)
def issues_unknown_type(d: DataSet) -> DataFrame:
    return issues.list_issues(_orders(d), issue_type="no such type", limit=50).drop("issue_labels")


@query("SELECT * FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20", chain=False)
def recent_events(d: DataSet) -> DataFrame:
    return sinks.recent(table(d, "events"), "ts", "event_id")


@query(
    """
    WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id) FROM events),
    latest AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 3 <> 0 ORDER BY ts DESC, event_id DESC) AS n
        FROM e WHERE user_id IS NOT NULL)
    SELECT * EXCLUDE (n) FROM latest
    WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 <> 0 DESC) = 1
    UNION ALL SELECT * FROM e WHERE user_id IS NULL""",
    chain=False,
)
def upsert_latest(d: DataSet) -> DataFrame:
    """A first snapshot and an upsert with many updates of a key, and rows without key, published and read."""
    user = F.when(F.col("event_id") % 50 != 0, F.col("user_id"))
    events = table(d, "events").withColumn("user_id", user)
    first, second = d.fresh("snapshot"), d.fresh("snapshot")
    version = ["ts", "event_id"]
    sinks.publish(None, events.filter("event_id % 3 = 0"), "user_id", first, version)
    sinks.publish(d.spark.read.parquet(first), events.filter("event_id % 3 <> 0"), "user_id", second, version)
    return d.spark.read.parquet(second)


_PUBLISHED = """
    WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id),
        ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS late FROM events)
    SELECT * EXCLUDE (late) FROM e WHERE user_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY late DESC, ts DESC, event_id DESC) = 1
    UNION ALL SELECT * EXCLUDE (late) FROM e WHERE user_id IS NULL"""


@query(_PUBLISHED, chain=False)
def publish_touched(d: DataSet) -> DataFrame:
    """All but the last day's events published as a snapshot, then the last day's into the buckets of their users."""
    user = F.when(F.col("event_id") % 50 != 0, F.col("user_id"))
    events = table(d, "events").withColumn("user_id", user)
    late = F.col("ts") >= F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 DAY")
    snapshot = snapshots.Snapshot.create(d.spark, d.fresh("published"), "user_id", events.schema, buckets=64)
    for batch_ in (events.filter(~late), events.filter(late)):
        snapshot.publish(batch_, ["ts", "event_id"])
    return snapshots.Snapshot.open(d.spark, snapshot.path).rows()


@query(f"SELECT * FROM ({_PUBLISHED}) WHERE user_id = 7", chain=False)
def snapshot_lookup(d: DataSet) -> DataFrame:
    """The document of one key out of a published snapshot, from its bucket alone."""
    user = F.when(F.col("event_id") % 50 != 0, F.col("user_id"))
    events = table(d, "events").withColumn("user_id", user)
    snapshot = snapshots.Snapshot.create(d.spark, d.fresh("published"), "user_id", events.schema, buckets=64)
    snapshot.publish(events, ["ts", "event_id"])
    return snapshot.of_key(7)


_ORDER_SIDE = "o.lifecycle_stage AS order_stage, o.max_issue_severity AS order_severity"
_CONTEXT_SQL = f"""
    SELECT {_ORDER_SIDE}, i.* FROM order_table o
    JOIN (SELECT {", ".join(linking.ITEM_COLUMNS)} FROM items) i USING (sales_order_id)"""


def _order_side(order: str) -> list[F.Column]:
    return [
        F.col(f"{order}.lifecycle_stage").alias("order_stage"),
        F.col(f"{order}.max_issue_severity").alias("order_severity"),
    ]


@query(_CONTEXT_SQL)
def order_context(d: DataSet) -> DataFrame:
    context = serving.order_context(d.serving().orders_by_order, d.serving().items_by_order)
    items = [F.col(f"item.{c}").alias(c) for c in linking.ITEM_COLUMNS]
    return rounded(context.select(*_order_side("order"), *items), *_ITEM_AMOUNTS)


@query(_CONTEXT_SQL)
def context_payload(d: DataSet) -> DataFrame:
    """Each payload parsed back to typed columns."""
    t = d.serving()
    shape = f"order {t.orders.schema.simpleString()}, item {t.items.schema.simpleString()}"
    found = payloads.order_payloads(t.orders_by_order, t.items_by_order).select(F.from_json("payload", shape).alias("p"))
    items = [F.col(f"p.item.{c}").alias(c) for c in linking.ITEM_COLUMNS]
    return rounded(found.select(*_order_side("p.order"), *items), *_ITEM_AMOUNTS)


@query(
    """
    SELECT sales_order_id, any_value(o.customer_id) AS customer_id, count(*) AS item_rows,
        min(sales_order_item) AS first_item
    FROM order_table o JOIN items i USING (sales_order_id) GROUP BY sales_order_id"""
)
def context_payload_fields(d: DataSet) -> DataFrame:
    t = d.serving()
    customer = F.get_json_object("payload", "$.order.customer_id").alias("customer_id")
    item = F.get_json_object("payload", "$.item.sales_order_item").alias("first_item")
    found = payloads.order_payloads(t.orders_by_order, t.items_by_order).select("sales_order_id", customer, item)
    return found.groupBy("sales_order_id").agg(
        F.min("customer_id").alias("customer_id"), F.count("first_item").alias("item_rows"), F.min("first_item").alias("first_item")
    )


@query(
    f"""
    SELECT o.sales_order_id, o.total_items, o.lifecycle_stage, count(*) AS item_rows,
        string_agg(sales_order_item || ':' || i.lifecycle_stage, ',' ORDER BY sales_order_item) AS item_text
    FROM order_table o JOIN items i USING (sales_order_id) WHERE o.sales_order_id = '{ORDER}'
    GROUP BY ALL"""
)
def order_document(d: DataSet) -> DataFrame:
    found = serving.order_document(d.serving().orders, d.serving().items, ORDER)
    texts = F.transform("items", lambda i: F.concat(i["sales_order_item"], F.lit(":"), i["lifecycle_stage"]))
    return found.select(
        "sales_order_id",
        "total_items",
        "lifecycle_stage",
        F.size("items").cast("bigint").alias("item_rows"),
        F.array_join(F.sort_array(texts), ",").alias("item_text"),
    )


@query("SELECT * FROM customer_table")
def customer_payload(d: DataSet) -> DataFrame:
    """Each payload parsed back to typed columns."""
    customers = d.serving().customers
    found = payloads.customer_payloads(customers)
    return found.select(F.from_json("payload", customers.schema).alias("p")).select("p.*")


@query(
    """
    SELECT printf('%d orders of %d customers, INR %.0f ordered, %.0f paid, %.0f open (%.1f%% uncollected); '
        || '%.1f%% cancelled (%d), %d unpaid, %d with a missing stage, %d delivered late (%.1f%%); '
        || '%s days from order to payment, %s from delivery to billing',
        total_orders, unique_customers, total_revenue_inr, total_paid_inr, revenue_leakage_inr,
        100 - payment_coverage_pct, cancellation_rate_pct, orders_billing_cancelled, orders_unpaid,
        orders_missing_stage, orders_with_delivery_delay, delivery_delay_rate_pct,
        CAST(avg_total_o2c_days AS VARCHAR), CAST(avg_delivery_to_billing_days AS VARCHAR)) AS snapshot
    FROM kpi_overview, cycle_stats, issue_stats"""
)
def kpi_snapshot_line(d: DataSet) -> DataFrame:
    return payloads.snapshot_line(d.serving().document)


# --- document graph -------------------------------------------------------

_EDGES = """
    SELECT sales_order_id, 'sales_order' AS src_type, sales_order_id AS src_id,
        'delivery' AS dst_type, delivery_id AS dst_id FROM items WHERE delivery_id IS NOT NULL
    UNION SELECT sales_order_id, 'delivery', delivery_id, 'billing_document', billing_doc_id
        FROM items WHERE billing_doc_id IS NOT NULL
    UNION SELECT sales_order_id, 'billing_document', billing_doc_id, 'accounting_document',
        accounting_document FROM items WHERE accounting_document IS NOT NULL
    UNION SELECT sales_order_id, 'accounting_document', accounting_document, 'journal_entry',
        accounting_document || '/1' FROM items WHERE accounting_document IS NOT NULL"""


@query(_EDGES)
def doc_edges(d: DataSet) -> DataFrame:
    return docgraph.edges(d.serving().items, d.exports()["journal"])


_NODES = " UNION ".join(
    [
        f"SELECT sales_order_id, '{kind}' AS node_type, {c} AS node_id FROM items WHERE {c} IS NOT NULL"
        for kind, c in [
            ("sales_order", "sales_order_id"),
            ("delivery", "delivery_id"),
            ("billing_document", "billing_doc_id"),
            ("accounting_document", "accounting_document"),
        ]
    ]
    + [
        "SELECT sales_order_id, 'journal_entry', accounting_document || '/1' FROM items "
        "WHERE accounting_document IS NOT NULL"
    ]
)


@query(_NODES)
def doc_nodes(d: DataSet) -> DataFrame:
    return docgraph.nodes(d.serving().items, d.exports()["journal"])


@query(f"SELECT * FROM ({_NODES}) WHERE sales_order_id = '{ORDER}'")
def doc_nodes_of_order(d: DataSet) -> DataFrame:
    return docgraph.of_order(docgraph.nodes(d.serving().items, d.exports()["journal"]), ORDER)


_PATHS = [
    ("delivery", "delivery_id", "sales_order", "sales_order_id", -1),
    ("delivery", "delivery_id", "delivery", "delivery_id", 0),
    ("delivery", "delivery_id", "billing_document", "billing_doc_id", 1),
    ("delivery", "delivery_id", "accounting_document", "accounting_document", 2),
    ("delivery", "delivery_id", "journal_entry", "accounting_document || '/1'", 3),
    ("billing_document", "billing_doc_id", "sales_order", "sales_order_id", -2),
    ("billing_document", "billing_doc_id", "delivery", "delivery_id", -1),
    ("billing_document", "billing_doc_id", "billing_document", "billing_doc_id", 0),
    ("billing_document", "billing_doc_id", "accounting_document", "accounting_document", 1),
    ("billing_document", "billing_doc_id", "journal_entry", "accounting_document || '/1'", 2),
]


@query(
    " UNION ".join(
        f"SELECT '{a}' AS start_type, {a_id} AS start_id, '{b}' AS node_type, {b_id} AS node_id, {n} AS hops "
        f"FROM items WHERE {a_id} IS NOT NULL AND {b_id} IS NOT NULL"
        for a, a_id, b, b_id, n in _PATHS
    )
)
def doc_trace(d: DataSet) -> DataFrame:
    """Up and down the chain from every delivery and every billing document."""
    t = d.serving()
    found = docgraph.nodes(t.items).filter(F.col("node_type").isin("delivery", "billing_document"))
    starts = found.select(F.col("node_type").alias("start_type"), F.col("node_id").alias("start_id"))
    return docgraph.trace(docgraph.edges(t.items, d.exports()["journal"]), starts)


@query(
    f"""
    SELECT * FROM ({_EDGES}) WHERE sales_order_id IN (
        SELECT sales_order_id FROM items WHERE billing_doc_id = (SELECT min(billing_doc_id) FROM items))"""
)
def doc_edges_of_billing(d: DataSet) -> DataFrame:
    """The document view opened from a billing document."""
    t, journal = d.serving(), d.exports()["journal"]
    first = t.items.agg(F.min("billing_doc_id")).first()[0]
    found = docgraph.nodes(t.items, journal)
    return docgraph.of_document(docgraph.edges(t.items, journal), found, "billing_document", first)


@query(
    """
    , paid AS (
        SELECT DISTINCT sales_order_id, customer_id || '/' || strftime(payment_posting_date, '%Y-%m') AS document
        FROM items WHERE payment_posting_date IS NOT NULL
    ), pairs AS (
        SELECT DISTINCT a.sales_order_id AS a, b.sales_order_id AS b FROM paid a JOIN paid b USING (document)
    ), reach AS (
        SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
    )
    SELECT sales_order_id, coalesce(least(sales_order_id, min(b)), sales_order_id) AS group_id
    FROM (SELECT DISTINCT sales_order_id FROM items) LEFT JOIN reach ON a = sales_order_id GROUP BY sales_order_id"""
)
def order_groups(d: DataSet) -> DataFrame:
    """Orders joined by payments; a customer's payments of a month count as one document here."""
    paid = F.col("payment_posting_date").isNotNull()
    document = F.concat_ws("/", "customer_id", F.date_format("payment_posting_date", "yyyy-MM"))
    items = d.serving().items.withColumn("accounting_document", F.when(paid, document))
    return docgraph.order_groups(docgraph.nodes(items), d.fresh("groups"), ("accounting_document",))


@query(
    """
    SELECT sales_order_id, sales_order_item, CASE WHEN NOT has_delivery THEN 'delivery'
        WHEN NOT has_billing THEN 'billing' WHEN NOT has_payment THEN 'payment' END AS break_point
    FROM items"""
)
def chain_break(d: DataSet) -> DataFrame:
    return docgraph.chain_breaks(d.serving().items).select(*ITEM_ID, "break_point")


# --- sources, text and display --------------------------------------------

_EXPORTED = {
    "order_headers": ("soh", 0), "order_items": ("soi", 0), "delivery_headers": ("odh", 0), "delivery_items": ("odi", 0),
    "billing_headers": ("bdh", 0), "billing_items": ("bdi", 0), "payments": ("pay", 0), "partners": ("bp", 1),
    "product_texts": ("(SELECT * FROM pdesc UNION ALL SELECT * FROM pdesc)", 0),
}
_FILES = "*.txt.gz"


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST({len(SOURCES[name].fields)} AS BIGINT) "
        f"AS column_count, CAST({bad} AS BIGINT) AS malformed FROM {source}"
        for name, (source, bad) in _EXPORTED.items()
    )
)
def load_profile(d: DataSet) -> DataFrame:
    """Every export as dropped, with the lines that don't parse: counted while the exports are loaded."""
    catalog = {name: SOURCES[name] for name in _EXPORTED}
    return drops.load(d.spark, d.jsonl(), d.replaced("profiled"), catalog, _FILES).profile


_CHANGED = {"order_items": SOURCES["order_items"]}
_THIRD = "l_orderkey % 3 = 0"


@query(
    f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS "salesOrder", {oracle.LINE_KEY} AS "salesOrderItem",
        CAST(l_quantity AS VARCHAR) AS "requestedQuantity", CAST(NULL AS VARCHAR) AS "storageLocation",
        CASE WHEN {_THIRD} THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS "confirmedQuantity",
        CASE WHEN {_THIRD} THEN '{{"language":"EN","note":"' || l_partkey || '"}}' END AS texts
    FROM lineitem""",
    chain=False,
)
def scan_union(d: DataSet) -> DataFrame:
    """A drop with fields the catalogue doesn't know, each a column like the others."""
    loaded = drops.load(d.spark, d.changed(), d.fresh("loaded"), _CHANGED, _FILES)
    found = drops.union_of_keys(loaded.frames["order_items"])
    return found.drop(*[f for f in found.columns if f in _UNSHOWN])


_UNSHOWN = set(SOURCES["order_items"].fields) - {"salesOrder", "salesOrderItem", "requestedQuantity", "storageLocation"}


@query(
    """
    SELECT 'order_items' AS export, substr('{"salesOrder":"' || l_orderkey || '","salesOrderItem":', 1, 30) AS line, TRUE AS located
    FROM lineitem WHERE l_orderkey % 50 = 0""",
    chain=False,
)
def quarantined_lines(d: DataSet) -> DataFrame:
    """The lines of a drop that are no JSON object; located: they name a file of the drop and its time."""
    loaded = drops.load(d.spark, d.changed(), d.fresh("loaded"), _CHANGED, _FILES)
    folder = SOURCES["order_items"].folder
    located = F.col("file").contains(f"/changed/{folder}/part-") & F.col("modified").isNotNull()
    return loaded.quarantine.select("export", "line", located.alias("located"))


_EXTRA = {"confirmedQuantity": "BIGINT", "texts": "OBJECT<language: STRING, note: STRING>"}
_ABSENT = ["salesOrderItemCategory", "transactionCurrency", "storageLocation"]


@query(
    " UNION ALL ".join(
        f"SELECT 'order_items' AS export, '{f}' AS field, {f not in _EXTRA} AS known, count(*) AS rows, "
        + (f"'{_EXTRA.get(f, 'STRING')}' AS type" if f not in _ABSENT else "CAST(NULL AS VARCHAR) AS type")
        + f" FROM lineitem WHERE {_THIRD if f in _EXTRA else f not in _ABSENT}"
        for f in (*SOURCES["order_items"].fields, *_EXTRA)
    ),
    chain=False,
)
def schema_drift(d: DataSet) -> DataFrame:
    """Every field of a drop, with how many rows have it and the type its values share."""
    return drops.drift(d.spark, d.changed(), _CHANGED, _FILES)


@query("SELECT * FROM soi")
def scan_jsonl(d: DataSet) -> DataFrame:
    raw = readers.read_export(d.spark, d.jsonl("order_items"), SOURCES["order_items"], _FILES)
    return cleaning.clean("order_items", raw)


@query(
    """
    SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS payment_posting_date, CAST(NULL AS TIMESTAMP) AS payment_clearing_date,
        CAST(NULL AS DOUBLE) AS total_amount_paid) FROM linked"""
)
def scan_missing_folder(d: DataSet) -> DataFrame:
    """All exports but the payments, whose folder was never dropped: the chain has all rows, without payments."""
    gone = SOURCES["payments"]
    catalog = SOURCES | {"payments": Source("no_such_folder", gone.fields)}
    drop = d.jsonl(*[name for name in _EXPORTED if name != "payments"])
    raw = readers.read_all(d.spark, drop, catalog, files=_FILES)
    return _linked(d, "unpaid", raw)


@query("SELECT * FROM order_table")
def csv_round_trip(d: DataSet) -> DataFrame:
    path = d.fresh("csv")
    sinks.write_csv(d.serving().orders, path)
    orders = readers.read_processed_csv(d.spark, path, ORDER_COLUMNS_DDL)
    return rounded(orders, "total_billed_amount", "total_paid_amount", "revenue_leakage_amount")


@query("SELECT * FROM customer_table")
def json_round_trip(d: DataSet) -> DataFrame:
    path = d.fresh("json")
    sinks.write_json(d.serving().customers, path)
    return d.spark.read.schema(CUSTOMER_KPI_DDL).json(path)


@query("SELECT * FROM customer_table")
def json_documents(d: DataSet) -> DataFrame:
    """Customer KPIs out of JSON documents over many lines, an array of a hundred customers each."""
    path, customers = d.fresh("documents"), d.serving().customers
    whole = F.to_json(F.collect_list(F.struct(*customers.columns)), {"pretty": "true", "ignoreNullFields": "false"})
    hundred = F.floor(F.col("customer_id").cast("bigint") / 100).alias("part")
    customers.groupBy(hundred).agg(whole.alias("value")).write.partitionBy("part").text(path)
    return readers.read_json_document(d.spark, path, CUSTOMER_KPI_DDL).drop("part")


@query("SELECT event_id, 2 AS copies, TRUE AS stamped FROM events", chain=False)
def append_log(d: DataSet) -> DataFrame:
    path = d.fresh("log")
    for _ in range(2):
        sinks.append_log(table(d, "events"), path)
    log = d.spark.read.parquet(path)
    return log.groupBy("event_id").agg(
        F.count(F.lit(1)).cast("int").alias("copies"), (F.count("created_at") == 2).alias("stamped")
    )


@query("SELECT count(*) > 0 AS data_loaded, count(*) AS order_count FROM order_table")
def dataset_health(d: DataSet) -> DataFrame:
    return readers.dataset_health(d.serving().orders)


@query(
    """
    WITH w AS (
        SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS shown,
            CAST(round(abs(c_acctbal) * 1000) AS BIGINT) AS whole
        FROM customer)
    SELECT c_custkey, coalesce('₹' || format('{:,.0f}', shown), '—') AS rupees,
        coalesce('₹' || CASE WHEN shown < 0 THEN '-' ELSE '' END || CASE
            WHEN whole < 1000 THEN CAST(whole AS VARCHAR)
            WHEN whole < 100000 THEN (whole // 1000) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0')
            ELSE (whole // 100000) || ',' || lpad(CAST(whole // 1000 % 100 AS VARCHAR), 2, '0') || ','
                || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') END
            || CASE WHEN shown IS NULL THEN NULL ELSE '' END, '—') AS rupees_lakh,
        coalesce(printf('%.1f%%', round(shown, 1)), '—') AS share,
        coalesce(CAST(CAST(floor(shown + 0.5) AS BIGINT) AS VARCHAR) || 'd', '—') AS day_text
    FROM w""",
    chain=False,
)
def display_amounts(d: DataSet) -> DataFrame:
    shown = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return table(d, "customer").select(
        "c_custkey",
        display.rupees(shown).alias("rupees"),
        display.rupees_lakh(F.round(shown * 1000, 0)).alias("rupees_lakh"),
        display.percent(F.round(shown, 1)).alias("share"),
        display.day_count(shown).alias("day_text"),
    )


@query(
    """
    SELECT sales_order_id, strftime(order_created_date, '%d %b %Y') AS created_text,
        upper(lifecycle_stage[1]) || lifecycle_stage[2:] AS stage_text
    FROM order_table"""
)
def display_dates(d: DataSet) -> DataFrame:
    return d.serving().orders.select(
        "sales_order_id",
        display.short_date(F.col("order_created_date")).alias("created_text"),
        display.stage_name(F.col("lifecycle_stage")).alias("stage_text"),
    )


def _answers(d: DataSet) -> DataFrame:
    """Each conversation turn as an answer text in one of five forms."""
    one = F.struct(
        F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"),
        F.col("text").alias("summary"),
        F.col("role").alias("recommendation"),
        F.lit("warning").alias("severity"),
    )
    form = (F.col("conv_id") + F.col("turn")) % 9
    array = F.to_json(F.array(one, one))
    text = (
        F.when(form == 0, array)
        .when(form == 1, F.concat(F.lit("```json\n"), F.to_json(F.array(one)), F.lit("\n```")))
        .when(form == 2, F.to_json(one))
        .when(form == 3, F.concat(F.lit("Found: "), F.to_json(F.array(one)), F.lit(" as asked.")))
        .when(form == 4, F.concat(F.lit("[broken "), F.col("text")))
        .when(form == 5, F.lit("[]"))
        .when(form == 6, F.concat(F.lit("["), F.to_json(one), F.lit(", null]")))
        .when(form == 7, F.concat(F.to_json(one), F.lit(', "more": 2')))
        .otherwise(F.concat(F.to_json(F.array(one)), F.lit(', "more": [1]')))
    )
    return table(d, "conversations").select("conv_id", "turn", "text", text.alias("answer"))


@query(
    """
    SELECT conv_id, turn, kept.title, kept.recommendation, kept.severity, kept.whole
    FROM conversations, (SELECT unnest([0, 1]) AS copy), LATERAL (SELECT
        (conv_id + turn) % 9 IN (4, 7, 8) AS quoted, (conv_id + turn) % 9 = 5 AS empty), LATERAL (SELECT
        CASE WHEN quoted THEN 'AI Insight' WHEN NOT empty THEN 'T' || turn END AS title,
        CASE WHEN quoted THEN 'See full response for details.' WHEN NOT empty THEN role END AS recommendation,
        CASE WHEN quoted THEN 'info' WHEN NOT empty THEN 'warning' END AS severity,
        NOT empty AS whole) kept
    WHERE copy = 0 OR (conv_id + turn) % 9 = 0""",
    chain=False,
)
def parse_insights(d: DataSet) -> DataFrame:
    """whole: the summary is the text the answer was made of, or all of an answer that is quoted."""
    found = payloads.parse_insights(_answers(d).withColumn("raw", F.col("answer")), "answer")
    whole = (F.col("summary") == F.col("text")) | (F.col("summary") == F.col("raw"))
    whole = F.coalesce(whole, F.lit(False)).alias("whole")
    return found.select("conv_id", "turn", "title", "recommendation", "severity", whole)


@query(
    """
    SELECT conv_id, turn,
        coalesce(nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
            lambda x: trim(x)), lambda x: x <> ''), ' '), ''), text) AS analysis,
        CASE WHEN turn % 2 = 0 THEN 'Call ' || role || ' as noted | Review order end | a | b | c | d | twelfth on two lines'
            ELSE 'Review order lifecycle for any incomplete stages.' END AS steps
    FROM conversations""",
    chain=False,
)
def split_recommendations(d: DataSet) -> DataFrame:
    first = F.concat(F.lit("\n 1. Call "), F.col("role"), F.lit("\nas noted\n2. 3. Review order\n\nend"))
    steps = F.concat(first, F.lit("\n3. a\n4. b\n5. c\n6. d\n12. twelfth\non two lines\n"))
    numbered = F.when(F.col("turn") % 2 == 0, F.concat("text", steps)).otherwise(F.col("text"))
    answered = table(d, "conversations").select("conv_id", "turn", numbered.alias("answer"))
    return payloads.split_answers(answered, "answer").select(
        "conv_id", "turn", "analysis", F.array_join("recommendations", " | ").alias("steps")
    )
