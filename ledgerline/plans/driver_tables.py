"""Order-to-cash exports derived from the star-schema test tables.

Every frame has the field names and the all-text form of a real export, so the
cleaning operators have work to do.  The text forms are projections made while
reading; only what needs a join or an aggregate is ever written.  All formulas are deterministic and use no
window: a line is named by the four columns that identify it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import sinks
from ledgerline.sources.catalog import SOURCES

EXPORTS = [
    "order_headers",
    "order_items",
    "delivery_headers",
    "delivery_items",
    "billing_headers",
    "billing_items",
    "payments",
    "partners",
    "product_texts",
    "journal",
]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _iso(c: Column) -> Column:
    clock = F.substring(c.cast("string"), 12, 15)
    return F.concat(c.cast("date").cast("string"), F.lit("T"), clock, F.lit("Z"))


def _plus_days(c: Column, days: Column) -> Column:
    return c + F.make_dt_interval(days.cast("int"))


def _line_key() -> Column:
    return _text(
        F.col("l_linenumber"), ".", F.col("l_partkey"), ".", F.col("l_suppkey"), ".",
        F.col("l_shipdate").cast("date"),
    )


def _delivery() -> Column:
    return _text("D", F.col("l_orderkey"), "-", F.col("half"))


def _billing_doc() -> Column:
    return _text("B", F.col("l_orderkey"), "-", F.col("half"), "-", F.col("batch"))


def _halved(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"half": F.col("l_suppkey") % 2, "batch": F.col("l_linenumber") % 2})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halved(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


#: What the document exports need of a line.
_SHIPPED = """
    l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_returnflag l_linestatus l_shipdate
""".split()


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that have a delivery."""
    heads = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderdate"
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_SHIPPED)
    return lines.join(heads, "l_orderkey").filter(
        (F.col("o_orderstatus") != "P") | (F.col("l_linestatus") == "F")
    )


def delivery_documents(shipped: DataFrame) -> DataFrame:
    """One row per delivery, with what its billing documents inherit."""
    return _halved(shipped).groupBy("l_orderkey", "half").agg(
        F.min(_plus_days(F.col("o_orderdate"), F.col("l_partkey") % 6)).alias("created"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("settled"),
    )


def billing_documents(shipped: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row per billing document."""
    return (
        _halved(shipped)
        .filter(F.col("l_linestatus") == "F")
        .groupBy("l_orderkey", "half", "batch")
        .agg(
            F.min("l_partkey").alias("low_part"),
            F.sum("l_extendedprice").alias("amount"),
            F.bool_and(F.col("l_returnflag") == "R").alias("cancelled"),
        )
        .join(deliveries, ["l_orderkey", "half"])
        .withColumn("billed", _plus_days(F.col("created"), F.col("low_part") % 9))
    )


class Exports(Mapping):
    """The source tables the item chain reads, plus the journal, each planned when it is asked for.

    All are projections: of a given table, or of one of the three document
    frames several sources share.  ``written`` gets name and plan of such a
    frame when it is first needed; it may write it and return the table.
    """

    def __init__(
        self, spark: SparkSession, sf_dir: str, written: Callable[[str, DataFrame], DataFrame] | None = None
    ) -> None:
        self._spark, self._sf_dir = spark, sf_dir
        self._written = written or (lambda name, frame: frame)
        self._shared: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(EXPORTS)

    def __len__(self) -> int:
        return len(EXPORTS)

    def __contains__(self, name: object) -> bool:
        return name in EXPORTS

    def __getitem__(self, name: str) -> DataFrame:
        if name not in EXPORTS:
            raise KeyError(name)
        return getattr(self, f"_{name}")()

    def _frame(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._shared:
            self._shared[name] = self._written(name, plan())
        return self._shared[name]

    def _shipped(self) -> DataFrame:
        return self._frame("_shipped", lambda: shipped_lines(self._spark, self._sf_dir))

    def _deliveries(self) -> DataFrame:
        return self._frame("_deliveries", lambda: delivery_documents(self._shipped()))

    def _documents(self) -> DataFrame:
        return self._frame("_documents", lambda: billing_documents(self._shipped(), self._deliveries()))

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._sf_dir}/{name}.parquet")

    def _order_headers(self) -> DataFrame:
        priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
        return _orders(self._spark, self._sf_dir).select(
            _text(F.col("o_orderkey")).alias("salesOrder"),
            _text(F.col("o_custkey")).alias("soldToParty"),
            F.lit("OR").alias("salesOrderType"),
            F.lit("1000").alias("salesOrganization"),
            F.when(priority == "1-URGENT", "Z009")
            .when(priority == "2-HIGH", "Z001")
            .when(priority == "3-MEDIUM", "Z030")
            .alias("customerPaymentTerms"),
            status.alias("overallDeliveryStatus"),
            F.when((priority == "5-LOW") & (status == "P"), "01").otherwise("").alias("deliveryBlockReason"),
            F.lit("").alias("headerBillingBlockReason"),
            F.lit("INR").alias("transactionCurrency"),
            _iso(F.col("o_orderdate")).alias("creationDate"),
            _iso(_plus_days(F.col("o_orderdate"), F.lit(7))).alias("requestedDeliveryDate"),
            _text(F.col("o_totalprice")).alias("totalNetAmount"),
        )

    def _order_items(self) -> DataFrame:
        return _lines(self._spark, self._sf_dir).select(
            _text(F.col("l_orderkey")).alias("salesOrder"),
            _line_key().alias("salesOrderItem"),
            _text(F.col("l_partkey")).alias("material"),
            _text(F.col("l_quantity")).alias("requestedQuantity"),
            F.lit("EA").alias("requestedQuantityUnit"),
            _text(F.col("l_extendedprice")).alias("netAmount"),
            _text("G", F.col("l_partkey") % 10).alias("materialGroup"),
            _text(F.col("l_suppkey")).alias("productionPlant"),
            F.when(F.col("l_discount") >= 0.09, "92").otherwise("").alias("salesDocumentRjcnReason"),
            F.lit("").alias("itemBillingBlockReason"),
        )

    def _delivery_headers(self) -> DataFrame:
        return self._deliveries().select(
            _delivery().alias("deliveryDocument"),
            _iso(F.col("created")).alias("creationDate"),
            _iso(F.col("created")).alias("actualGoodsMovementDate"),
            F.lit("C").alias("overallGoodsMovementStatus"),
            F.lit("C").alias("overallPickingStatus"),
            F.lit("").alias("deliveryBlockReason"),
            _text("SP", F.col("half")).alias("shippingPoint"),
        )

    def _delivery_items(self) -> DataFrame:
        return _halved(self._shipped()).select(
            _delivery().alias("deliveryDocument"),
            _text("0000", _line_key()).alias("deliveryDocumentItem"),
            _text(F.col("l_orderkey")).alias("referenceSdDocument"),
            _text("000", _line_key()).alias("referenceSdDocumentItem"),
            _text(F.col("l_quantity")).alias("actualDeliveryQuantity"),
            _text(F.col("l_suppkey")).alias("plant"),
            _text("S", F.col("l_suppkey") % 3).alias("storageLocation"),
        )

    def _billing_headers(self) -> DataFrame:
        return self._documents().select(
            _billing_doc().alias("billingDocument"),
            F.lit("F2").alias("billingDocumentType"),
            _iso(F.col("billed")).alias("billingDocumentDate"),
            _iso(F.col("billed")).alias("creationDate"),
            _text(F.col("amount")).alias("totalNetAmount"),
            _text(F.col("cancelled")).alias("billingDocumentIsCancelled"),
            _text("A", _billing_doc()).alias("accountingDocument"),
            F.lit("1000").alias("companyCode"),
        )

    def _billing_items(self) -> DataFrame:
        invoiced = _lines(self._spark, self._sf_dir).filter(F.col("l_linestatus") == "F")
        return invoiced.select(
            _billing_doc().alias("billingDocument"),
            _line_key().alias("billingDocumentItem"),
            _delivery().alias("referenceSdDocument"),
            _text("0000", _line_key()).alias("referenceSdDocumentItem"),
            _text(F.col("l_partkey")).alias("material"),
            _text(F.col("l_quantity")).alias("billingQuantity"),
            _text(F.col("l_extendedprice")).alias("netAmount"),
        )

    def _payments(self) -> DataFrame:
        settled = self._documents().filter("settled").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        posted = _iso(_plus_days(F.col("billed"), F.col("l_orderkey") % 50 + F.col("part")))
        return settled.select(
            _text("A", _billing_doc()).alias("accountingDocument"),
            posted.alias("postingDate"),
            posted.alias("clearingDate"),
            _text(F.col("amount") / 2).alias("amountInTransactionCurrency"),
            F.lit("INR").alias("transactionCurrency"),
        )

    def _partners(self) -> DataFrame:
        return self._table("customer").select(
            _text(F.col("c_custkey")).alias("businessPartner"),
            F.col("c_name").alias("businessPartnerFullName"),
            _text(F.col("c_acctbal") < 0).alias("businessPartnerIsBlocked"),
        )

    def _product_texts(self) -> DataFrame:
        return (
            self._table("part")
            .withColumn("language", F.explode(F.array(F.lit("EN"), F.lit("FR"))))
            .select(
                _text(F.col("p_partkey")).alias("product"),
                "language",
                F.when(F.col("language") == "EN", F.col("p_name"))
                .otherwise(_text(F.col("p_name"), " (fr)"))
                .alias("productDescription"),
            )
        )

    def _journal(self) -> DataFrame:
        return self._documents().select(
            _text("A", _billing_doc()).alias("accountingDocument"),
            F.lit("1").alias("accountingDocumentItem"),
        )


def exports(spark: SparkSession, sf_dir: str) -> Exports:
    """All exports, planned only."""
    return Exports(spark, sf_dir)


def stored_exports(spark: SparkSession, sf_dir: str, path: str) -> Exports:
    """All exports; the document frames several of them share are written under ``path`` at their first use."""

    def written(name: str, frame: DataFrame) -> DataFrame:
        return sinks.stored(frame, f"{path}/{name}")

    return Exports(spark, sf_dir, written)


#: Lines of one file of a drop at most: packed files are read whole, each by one task.
LINES_PER_FILE = 500_000


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.write.options(compression="gzip", maxRecordsPerFile=LINES_PER_FILE).text(path)


def write_jsonl(frames: Mapping[str, DataFrame], path: str) -> None:
    """Exports as folders of JSON lines under the names of the catalogue; the partners hold one line
    that is no JSON.  Spark names the files ``part-*.txt.gz``."""
    for name, source in SOURCES.items():
        if name not in frames:
            continue
        lines = frames[name].select(F.to_json(F.struct(*frames[name].columns)).alias("value"))
        if name == "partners":
            lines = lines.unionByName(lines.limit(1).select(F.lit("{broken").alias("value")))
        _write_lines(lines, f"{path}/{source.folder}")


def write_changed_jsonl(frames: Mapping[str, DataFrame], path: str) -> None:
    """Order items as a source drops them after a change: every third order's lines have two fields more, and
    lines of every fiftieth order come once more, cut off."""
    items, order = frames["order_items"], F.col("salesOrder").cast("bigint")
    third = order % 3 == 0
    more = [
        F.when(third, F.col("requestedQuantity").cast("double").cast("bigint")).alias("confirmedQuantity"),
        F.when(third, F.struct(F.lit("EN").alias("language"), F.col("material").alias("note"))).alias("texts"),
    ]
    lines = items.withColumn("value", F.to_json(F.struct(*items.columns, *more)))
    copies = F.explode(F.when(order % 50 == 0, F.array(F.lit(1 << 20), F.lit(30))).otherwise(F.array(F.lit(1 << 20))))
    lines = lines.withColumn("length", copies)
    cut = lines.select(F.substring("value", F.lit(1), F.col("length")))
    _write_lines(cut, f"{path}/{SOURCES['order_items'].folder}")

