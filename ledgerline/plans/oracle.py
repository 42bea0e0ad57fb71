"""Expected results as SQL over the test tables, for an independent engine.

``PREFIX`` states the exports, the item chain, its derived columns and the
order table as common table expressions; each query's SQL selects from them.
"""

from __future__ import annotations

_DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def days(a: str, b: str) -> str:
    return _DAYS.format(a=a, b=b)


LINE_KEY = (
    "l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' "
    "|| CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"
)
_DELIVERY = "'D' || l_orderkey || '-' || (l_suppkey % 2)"
_BILLING = "'B' || l_orderkey || '-' || (l_suppkey % 2) || '-' || (l_linenumber % 2)"

PREFIX = f"""
WITH RECURSIVE soh AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS sales_order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
        'OR' AS order_type, '1000' AS sales_org,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Z009' WHEN '2-HIGH' THEN 'Z001'
            WHEN '3-MEDIUM' THEN 'Z030' END AS payment_terms,
        'INR' AS currency, o_orderdate AS order_created_date,
        o_orderdate + INTERVAL 7 DAY AS requested_delivery_date,
        o_totalprice AS order_total_net_amount, o_orderstatus AS overall_delivery_status,
        CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '01' ELSE '' END
            AS delivery_block_reason,
        '' AS billing_block_reason
    FROM orders
), soi AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS sales_order_id, {LINE_KEY} AS sales_order_item,
        CAST(l_partkey AS VARCHAR) AS material_id, 'G' || (l_partkey % 10) AS material_group,
        l_quantity AS item_qty, 'EA' AS qty_unit, l_extendedprice AS item_net_amount,
        CAST(l_suppkey AS VARCHAR) AS plant,
        CASE WHEN l_discount >= 0.09 THEN '92' ELSE '' END AS rejection_reason,
        '' AS item_billing_block
    FROM lineitem
), shipped AS (
    SELECT l.*, o_orderstatus, {_DELIVERY} AS delivery_id,
        o_orderdate + to_days(CAST(l_partkey % 6 AS INTEGER)) AS line_date
    FROM lineitem l JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderstatus <> 'P' OR l_linestatus = 'F'
), odh AS (
    SELECT delivery_id, min(line_date) AS delivery_created_date,
        min(line_date) AS actual_goods_movement_date, 'C' AS goods_movement_status,
        'C' AS picking_status, '' AS delivery_block, 'SP' || min(l_suppkey % 2) AS shipping_point
    FROM shipped GROUP BY delivery_id
), odi AS (
    SELECT delivery_id, '0000' || {LINE_KEY} AS delivery_item,
        CAST(l_orderkey AS VARCHAR) AS sales_order_id, {LINE_KEY} AS sales_order_item,
        l_quantity AS actual_delivery_qty, CAST(l_suppkey AS VARCHAR) AS delivery_plant,
        'S' || (l_suppkey % 3) AS storage_location
    FROM shipped
), bdi AS (
    SELECT {_BILLING} AS billing_doc_id, {LINE_KEY} AS billing_doc_item, delivery_id,
        '0000' || {LINE_KEY} AS delivery_item, CAST(l_partkey AS VARCHAR) AS material_id,
        l_quantity AS billed_qty, l_extendedprice AS billed_amount,
        l_partkey, l_orderkey, l_returnflag, o_orderstatus
    FROM shipped WHERE l_linestatus = 'F'
), docs AS (
    SELECT billing_doc_id, delivery_id, min(l_partkey) AS low_part, sum(billed_amount) AS amount,
        bool_and(l_returnflag = 'R') AS cancelled, min(l_orderkey) AS orderkey,
        min(o_orderstatus) AS status
    FROM bdi GROUP BY billing_doc_id, delivery_id
), bdh AS (
    SELECT billing_doc_id, 'F2' AS billing_type,
        delivery_created_date + to_days(CAST(low_part % 9 AS INTEGER)) AS billing_date,
        delivery_created_date + to_days(CAST(low_part % 9 AS INTEGER)) AS billing_created,
        round(amount, 2) AS billing_amount, cancelled AS is_cancelled,
        'A' || billing_doc_id AS accounting_document, CAST(NULL AS VARCHAR) AS billing_customer_id,
        '1000' AS company_code, amount, orderkey, status
    FROM docs JOIN odh USING (delivery_id)
), pay AS (
    SELECT accounting_document,
        billing_date + to_days(CAST(orderkey % 50 + part AS INTEGER)) AS posting_date,
        billing_date + to_days(CAST(orderkey % 50 + part AS INTEGER)) AS clearing_date,
        amount / 2 AS amount_paid, 'INR' AS pay_currency, CAST(NULL AS VARCHAR) AS paying_customer
    FROM bdh, (VALUES (0), (1)) parts(part) WHERE status = 'F'
), bp AS (
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
        c_acctbal < 0 AS is_blocked
    FROM customer
), pdesc AS (
    SELECT CAST(p_partkey AS VARCHAR) AS material_id, p_name AS material_desc FROM part
), bagg AS (
    SELECT delivery_id, min(billing_doc_id) AS billing_doc_id, sum(billed_qty) AS billed_qty,
        round(sum(billed_amount), 2) AS billed_amount_sum
    FROM bdi GROUP BY delivery_id
), pagg AS (
    SELECT accounting_document, min(posting_date) AS payment_posting_date,
        min(clearing_date) AS payment_clearing_date, round(sum(amount_paid), 2) AS total_amount_paid
    FROM pay GROUP BY accounting_document
), linked AS (
    SELECT soi.*, soh.* EXCLUDE (sales_order_id), soi.sales_order_item AS sales_order_item_norm,
        odi.* EXCLUDE (sales_order_id, sales_order_item), odh.* EXCLUDE (delivery_id),
        bagg.* EXCLUDE (delivery_id), bdh.* EXCLUDE (billing_doc_id, amount, orderkey, status),
        pagg.* EXCLUDE (accounting_document), customer_name, is_blocked, material_desc
    FROM soi
    LEFT JOIN soh ON soh.sales_order_id = soi.sales_order_id
    LEFT JOIN odi ON odi.sales_order_id = soi.sales_order_id
        AND odi.sales_order_item = soi.sales_order_item
    LEFT JOIN odh ON odh.delivery_id = odi.delivery_id
    LEFT JOIN bagg ON bagg.delivery_id = odi.delivery_id
    LEFT JOIN bdh ON bdh.billing_doc_id = bagg.billing_doc_id
    LEFT JOIN pagg ON pagg.accounting_document = bdh.accounting_document
    LEFT JOIN bp ON bp.customer_id = soh.customer_id
    LEFT JOIN pdesc ON pdesc.material_id = soi.material_id
), timed AS (
    SELECT *,
        {days("order_created_date", "delivery_created_date")} AS order_to_delivery_days,
        {days("delivery_created_date", "billing_date")} AS delivery_to_billing_days,
        {days("billing_date", "payment_posting_date")} AS billing_to_payment_days,
        {days("order_created_date", "payment_posting_date")} AS total_o2c_days,
        CASE WHEN is_cancelled THEN 'cancelled' WHEN payment_posting_date IS NOT NULL THEN 'paid'
            WHEN billing_doc_id IS NOT NULL THEN 'billed' WHEN delivery_id IS NOT NULL THEN 'delivered'
            ELSE 'ordered' END AS lifecycle_stage,
        delivery_id IS NOT NULL AS has_delivery, billing_doc_id IS NOT NULL AS has_billing,
        payment_posting_date IS NOT NULL AS has_payment,
        delivery_id IS NULL OR billing_doc_id IS NULL AS missing_stage,
        CAST(CASE payment_terms WHEN 'Z009' THEN 0 ELSE 30 END AS BIGINT) AS expected_payment_days,
        coalesce(is_cancelled, FALSE) AS is_billing_cancelled,
        coalesce(rejection_reason, '') <> '' AS is_rejected,
        coalesce(delivery_block_reason, '') <> '' AS has_delivery_block
    FROM linked
), flagged AS (
    SELECT *, coalesce(order_to_delivery_days > 3, FALSE) AS is_delivery_delayed,
        coalesce(billing_to_payment_days > expected_payment_days, FALSE) AS is_payment_overdue,
        has_billing AND NOT has_payment AND NOT is_billing_cancelled AS is_unpaid
    FROM timed
), items AS (
    SELECT *, CAST(CAST(is_delivery_delayed AS INTEGER) + CAST(is_payment_overdue AS INTEGER)
        + CAST(is_billing_cancelled AS INTEGER) + CAST(is_unpaid AS INTEGER)
        + CAST(missing_stage AS INTEGER) AS BIGINT) AS issue_severity
    FROM flagged
), stage_pick AS (
    SELECT sales_order_id, lifecycle_stage
    FROM (SELECT sales_order_id, lifecycle_stage, count(*) AS n FROM items
        GROUP BY sales_order_id, lifecycle_stage)
    QUALIFY row_number() OVER (PARTITION BY sales_order_id ORDER BY n DESC, lifecycle_stage) = 1
), order_sums AS (
    SELECT sales_order_id, min(customer_id) AS customer_id, min(customer_name) AS customer_name,
        min(order_created_date) AS order_created_date,
        min(requested_delivery_date) AS requested_delivery_date,
        min(payment_terms) AS payment_terms, min(currency) AS currency,
        min(order_total_net_amount) AS order_total_net_amount,
        count(sales_order_item) AS total_items,
        round(coalesce(sum(billed_amount_sum), 0), 2) AS total_billed_amount,
        round(coalesce(sum(total_amount_paid), 0), 2) AS total_paid_amount,
        min(order_to_delivery_days) AS order_to_delivery_days,
        min(delivery_to_billing_days) AS delivery_to_billing_days,
        min(billing_to_payment_days) AS billing_to_payment_days,
        min(total_o2c_days) AS total_o2c_days,
        bool_or(is_delivery_delayed) AS is_delivery_delayed,
        bool_or(is_payment_overdue) AS is_payment_overdue,
        bool_or(is_billing_cancelled) AS is_billing_cancelled,
        bool_or(is_unpaid) AS is_unpaid, bool_or(missing_stage) AS missing_stage,
        max(issue_severity) AS max_issue_severity
    FROM items GROUP BY sales_order_id
), order_table AS (
    SELECT order_sums.*, lifecycle_stage,
        round(order_total_net_amount - total_paid_amount, 2) AS revenue_leakage_amount
    FROM order_sums JOIN stage_pick USING (sales_order_id)
), customer_table AS (
    SELECT customer_id, min(customer_name) AS customer_name, count(*) AS total_orders,
        round(sum(order_total_net_amount), 2) AS total_revenue_inr,
        round(sum(total_paid_amount), 2) AS total_paid_inr,
        round(avg(total_o2c_days), 2) AS avg_o2c_days,
        count(*) FILTER (WHERE is_billing_cancelled) AS cancelled_orders,
        count(*) FILTER (WHERE is_payment_overdue) AS overdue_orders,
        count(*) FILTER (WHERE is_unpaid) AS unpaid_orders,
        count(*) FILTER (WHERE is_delivery_delayed) AS delayed_orders,
        CAST(sum(max_issue_severity) AS BIGINT) AS risk_score
    FROM order_table WHERE customer_id IS NOT NULL GROUP BY customer_id
), doc_totals AS (
    SELECT (SELECT sum(v) FROM (SELECT max(billing_amount) AS v FROM items GROUP BY billing_doc_id))
            AS billed,
        (SELECT sum(v) FROM (SELECT max(total_amount_paid) AS v FROM items
            GROUP BY accounting_document)) AS paid
), overview AS (
    SELECT (SELECT count(*) FROM order_table) AS total_orders,
        (SELECT count(*) FROM items) AS total_order_items,
        (SELECT count(DISTINCT customer_id) FROM order_table) AS unique_customers,
        (SELECT round(sum(order_total_net_amount), 2) FROM order_table) AS total_revenue_inr,
        round(billed, 2) AS total_billed_inr, round(paid, 2) AS total_paid_inr
    FROM doc_totals
), kpi_overview AS (
    SELECT *, round(total_revenue_inr - total_paid_inr, 2) AS revenue_leakage_inr,
        round(total_billed_inr / total_revenue_inr * 100, 1) AS billing_coverage_pct,
        round(total_paid_inr / total_revenue_inr * 100, 1) AS payment_coverage_pct
    FROM overview
), cycle_stats AS (
    SELECT round(avg(order_to_delivery_days), 2) AS avg_order_to_delivery_days,
        round(CAST(median(order_to_delivery_days) AS DOUBLE), 2) AS median_order_to_delivery_days,
        round(avg(delivery_to_billing_days), 2) AS avg_delivery_to_billing_days,
        round(avg(billing_to_payment_days), 2) AS avg_billing_to_payment_days,
        round(avg(total_o2c_days), 2) AS avg_total_o2c_days,
        round(CAST(median(total_o2c_days) AS DOUBLE), 2) AS median_total_o2c_days
    FROM order_table
), issue_stats AS (
    SELECT count(*) FILTER (WHERE is_delivery_delayed) AS orders_with_delivery_delay,
        count(*) FILTER (WHERE is_payment_overdue) AS orders_payment_overdue,
        count(*) FILTER (WHERE is_billing_cancelled) AS orders_billing_cancelled,
        count(*) FILTER (WHERE is_unpaid) AS orders_unpaid,
        count(*) FILTER (WHERE missing_stage) AS orders_missing_stage,
        round(avg(CAST(is_billing_cancelled AS INTEGER)) * 100, 1) AS cancellation_rate_pct,
        round(avg(CAST(is_delivery_delayed AS INTEGER)) * 100, 1) AS delivery_delay_rate_pct
    FROM order_table
)
"""


def over_chain(sql: str) -> str:
    return PREFIX + sql
