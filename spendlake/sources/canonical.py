"""Canonical expense tables over the given Parquet star schema.

Each method is a lazy projection of one scan, so Catalyst prunes columns and
pushes filters to Parquet.  Joins are used only where a canonical table needs
two source tables.
"""

from __future__ import annotations

from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, lookup, moment

RECEIPTS_AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"

PRIORITY_CATEGORY = {
    "1-URGENT": "Combustible",
    "2-HIGH": "Supermercado",
    "3-MEDIUM": "Comida",
    "5-LOW": "Retail",
}
STATUS = {"F": "aceptada", "O": "en_revision", "P": "rechazada"}
MONEY = "decimal(18,2)"

VENDORS = ["LIDER EXPRESS LTDA", "COPEC PRONTO", "FARMACIA CRUZ VERDE", "FALABELLA CENTRO", "COMERCIAL ANDINA"]
PAYMENTS = ["EFECTIVO", "DEBITO", "CREDITO", "TARJETA VISA XXXX 4321 AUTORIZACION: 998877", "TRANSFERENCIA"]
SHELF = ["coca cola", "pepsi", "leche soprole", "yogurt", "pan hallulla", "marraqueta", "pollo", "lomo", "tomate", "paltas",
         "platano", "arroz grado 1", "aceite oliva", "azucar blanca", "detergente", "galletas"]


def dotted(number: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("."))


class Tables:
    """The canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, streaming: tuple[str, ...] = ()):
        self.spark = spark
        self.folder = folder
        self.streaming = streaming

    def raw(self, name: str) -> DataFrame:
        """One source table; the names in ``streaming`` are read as streams of files.

        A stream's path has to be a folder or a pattern: the pattern matches the table's own name only.
        """
        path = f"{self.folder}/{name}.parquet"
        if name in self.streaming:
            schema = self.spark.read.parquet(path).schema
            return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{{{name}}}.parquet")
        return self.spark.read.parquet(path)

    # -- receipts and what hangs on them -------------------------------------

    @staticmethod
    def _order_time() -> Column:
        hours = F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        return F.col("o_orderdate").cast("timestamp") + hours

    def receipts_between(self, since: AsOf | None = None, until: AsOf | None = None) -> DataFrame:
        """Receipts with ``since <= date <= until``.

        The receipt time is derived from the order day, so the exact bound is
        paired with a day bound on the stored column that Parquet can prune on.
        """
        orders = self.raw("orders")
        if since is not None:
            day = moment(since) - timedelta(hours=23)
            orders = orders.filter(F.col("o_orderdate") >= F.lit(str(day)).cast("timestamp_ntz"))
        if until is not None:
            orders = orders.filter(F.col("o_orderdate") <= F.lit(str(moment(until))).cast("timestamp_ntz"))
        when = self._order_time()
        rows = orders.select(
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Vendor "), (F.col("o_orderkey") % 40).cast("string")).alias("company_name"),
            F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("folio_number"),
            F.col("o_orderpriority").alias("description"),
            lookup(F.col("o_orderpriority"), PRIORITY_CATEGORY).alias("category"),
            lookup(F.col("o_orderstatus"), STATUS).alias("status"),
            when.alias("date"),
            when.alias("created_at"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        )
        if since is not None:
            rows = rows.filter(F.col("date") >= F.lit(str(moment(since))).cast("timestamp"))
        if until is not None:
            rows = rows.filter(F.col("date") <= F.lit(str(moment(until))).cast("timestamp"))
        return rows

    @cached_property
    def receipts(self) -> DataFrame:
        return self.receipts_between()

    @cached_property
    def receipts_with_copies(self) -> DataFrame:
        """Receipts plus planted near copies, produced in one pass by ``explode``."""
        base = self.receipts
        variant = F.struct
        zero = F.lit(0).cast("bigint")
        same = variant(zero.alias("shift"), F.lit(0).alias("minutes"), F.lit("1.0").cast("decimal(2,1)").alias("factor"))
        late = variant(
            F.lit(10_000_000).cast("bigint").alias("shift"),
            F.lit(30).alias("minutes"),
            F.lit("1.0").cast("decimal(2,1)").alias("factor"),
        )
        cheaper = variant(
            F.lit(20_000_000).cast("bigint").alias("shift"),
            F.lit(180).alias("minutes"),
            F.lit("0.8").cast("decimal(2,1)").alias("factor"),
        )
        copies = (
            F.when(F.col("receipt_id") % 50 == 0, F.array(same, late))
            .when(F.col("receipt_id") % 50 == 1, F.array(same, cheaper))
            .otherwise(F.array(same))
        )
        return base.withColumn("_c", F.explode(copies)).select(
            (F.col("receipt_id") + F.col("_c.shift")).alias("receipt_id"),
            "user_id",
            "company_name",
            "folio_number",
            "description",
            "category",
            "status",
            (F.col("date") + F.make_interval(mins=F.col("_c.minutes"))).alias("date"),
            "created_at",
            (F.col("total_amount") * F.col("_c.factor")).cast(MONEY).alias("total_amount"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return (
            self.raw("orders")
            .filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
            .select(
                F.col("o_orderkey").alias("receipt_id"),
                F.col("o_custkey").alias("user_id"),
                lookup(F.col("o_orderpriority"), PRIORITY_CATEGORY).alias("category"),
                (F.col("o_orderkey") % 7 == 0).alias("user_corrected"),
                self._order_time().alias("created_at"),
            )
        )

    @cached_property
    def receipt_products(self) -> DataFrame:
        lines, parts = self.raw("lineitem"), self.raw("part")
        method = {"A": "advanced_parser", "N": "manual_entry", "R": "manual_correction"}
        return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
            F.col("l_orderkey").alias("receipt_id"),
            F.col("l_linenumber").alias("line"),
            F.col("p_name").alias("name"),
            F.col("l_partkey").alias("sku"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("total_price"),
            F.col("p_retailprice").cast(MONEY).alias("unit_price"),
            (1 - F.col("l_discount")).alias("confidence"),
            lookup(F.col("l_returnflag"), method).alias("extraction_method"),
            F.col("p_type").alias("category"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def approvals(self) -> DataFrame:
        when = self._order_time()
        return self.raw("orders").select(
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_orderkey").alias("instance_id"),
            F.col("o_custkey").alias("user_id"),
            lookup(F.col("o_orderstatus"), STATUS).alias("status"),
            (F.col("o_custkey") % 20).alias("approver_id"),
            lookup(F.col("o_custkey") % 3, {0: "supervisor", 1: "manager", 2: "director"}).alias("approver_role"),
            (F.col("o_custkey") % 4).alias("workflow_id"),
            when.alias("created_at"),
            (when + F.make_interval(days=F.lit(3))).alias("due_date"),
            (F.col("o_orderkey") % 3).cast("int").alias("escalation_count"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        """One point per receipt: the home city of the user, or a point further south."""
        orders, customers = self.raw("orders"), self.raw("customer")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("o_orderkey").alias("receipt_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Vendor "), (F.col("o_orderkey") % 40).cast("string")).alias("company_name"),
            self._order_time().alias("date"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"),
            lookup(F.col("o_orderpriority"), PRIORITY_CATEGORY).alias("category"),
            (
                F.lit(-33.45)
                + (F.col("c_nationkey") - 12) * F.lit(0.4)
                + F.when(F.col("o_orderkey") % 9 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
            ).alias("lat"),
            (F.lit(-70.67) + (F.col("o_orderkey") % 5) * F.lit(0.003)).alias("lng"),
            F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("address"),
        )

    @cached_property
    def engine_results(self) -> DataFrame:
        """Three readings of each receipt by different engines."""
        base = self.raw("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
        vendor = F.concat(F.lit("Vendor "), (F.col("o_orderkey") % 40).cast("string"))
        lift = F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.1)).otherwise(F.lit(0.0))
        price = F.col("o_totalprice").cast(MONEY)
        wild = F.when(F.col("o_orderkey") % 11 == 0, price * 12).otherwise(price)
        day = F.date_format(self._order_time(), "yyyy-MM-dd")
        slashed = F.date_format(self._order_time(), "dd/MM/yyyy")

        def reading(engine: str, weight: float, name: Column, amount: Column, confidence: float, date: Column) -> Column:
            return F.struct(
                F.lit(engine).alias("engine"),
                F.lit(weight).alias("weight"),
                name.alias("vendor"),
                amount.cast(MONEY).alias("total_amount"),
                (F.lit(confidence) + lift).alias("confidence"),
                date.alias("date"),
            )

        # Mostly the same name in capitals; a stray mark or a foreign word makes the readings disagree.
        k = F.col("o_orderkey") % 7
        spoiled = F.when(k == 3, F.concat(F.upper(vendor), F.lit("."))).when(k == 5, F.lit("XQZW")).otherwise(F.upper(vendor))
        readings = F.array(
            reading("tesseract", 0.25, vendor, price, 0.62, day),
            reading("easyocr", 0.60, spoiled, price * F.lit("1.01").cast("decimal(3,2)"), 0.68, slashed),
            reading("paddleocr", 0.15, F.expr("substring(vendor_text, 2)"), wild, 0.55, day),
        )
        return (
            base.withColumn("vendor_text", vendor)
            .withColumn("_r", F.explode(readings))
            .select(F.col("o_orderkey").alias("receipt_id"), "_r.*")
        )

    # -- people ---------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_nationkey").cast("bigint").alias("employer_id"),
            F.lit("employee").alias("role"),
            F.col("c_mktsegment").alias("department"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
        )

    @cached_property
    def employers(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("employer_id"),
            F.col("n_name").alias("company_name"),
            F.col("r_name").alias("region"),
        )

    @cached_property
    def spending_limits(self) -> DataFrame:
        kinds = [("monthly", 50), ("weekly", 15), ("yearly", 500)]
        kind = F.array(*[F.struct(F.lit(n).alias("limit_type"), F.lit(k).alias("k")) for n, k in kinds])
        return (
            self.raw("customer")
            .withColumn("_k", F.explode(kind))
            .select("*", "_k.*")
            .select(
                F.concat_ws("-", F.col("c_custkey").cast("string"), "limit_type").alias("limit_id"),
                F.col("c_custkey").alias("employee_id"),
                "limit_type",
                (F.abs(F.col("c_acctbal")).cast(MONEY) * F.col("k")).cast(MONEY).alias("limit_amount"),
                F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Retail")))
                .otherwise(F.array().cast("array<string>"))
                .alias("category_restrictions"),
                (F.col("c_custkey") % 10 != 0).alias("is_active"),
                (F.lit("2001-01-01").cast("timestamp") + F.make_interval(hours=(F.col("c_custkey") % 1000).cast("int"))).alias(
                    "created_at"
                ),
            )
        )

    @cached_property
    def invitations(self) -> DataFrame:
        states = {0: "pending", 1: "accepted", 2: "expired", 3: "cancelled"}
        created = F.lit("2001-07-20").cast("timestamp") + F.make_interval(hours=(F.col("c_custkey") % 300).cast("int"))
        return self.raw("customer").select(
            F.col("c_custkey").alias("invitation_id"),
            F.col("c_nationkey").cast("bigint").alias("employer_id"),
            lookup(F.col("c_custkey") % 4, states).alias("status"),
            created.alias("created_at"),
            (created + F.make_interval(days=F.lit(7))).alias("expires_at"),
        )

    # -- fuel -------------------------------------------------------------------

    @cached_property
    def fuel_expenses(self) -> DataFrame:
        vehicle = {0: "economico", 1: "intermedio", 2: "suv"}
        fuel = {0: "gasolina_93", 1: "gasolina_95", 2: "gasolina_97", 3: "diesel"}
        # Order and line repeat, so part and supplier are part of the id.
        line = F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")
        product = (F.col("l_partkey").cast("bigint") * 31 + F.col("l_suppkey")) % 1000003
        return (
            self.raw("lineitem")
            .select(
                (line * 1000003 + product).alias("expense_id"),
                (F.col("l_orderkey") % 1000).alias("user_id"),
                (F.col("l_quantity") * 10).alias("distance_km"),
                lookup(F.col("l_partkey") % 3, vehicle).alias("vehicle_type"),
                lookup(F.col("l_suppkey") % 4, fuel).alias("fuel_type"),
                F.concat(F.lit("City "), (F.col("l_suppkey") % 10).cast("string")).alias("origin"),
                F.concat(F.lit("City "), (F.col("l_partkey") % 10).cast("string")).alias("destination"),
                F.when(F.col("l_linestatus") == "F", F.lit("approved")).otherwise(F.lit("pending")).alias("status"),
                F.col("l_extendedprice").alias("noise"),
                F.col("l_shipdate").cast("timestamp").alias("created_at"),
            )
        )

    # -- events -----------------------------------------------------------------

    @cached_property
    def processing_metrics(self) -> DataFrame:
        engine = F.when(F.col("event_type") == "view", "tesseract").when(
            F.col("event_type") == "click", "google_vision"
        )
        k = F.get_json_object("props", "$.k").cast("int")
        error = F.col("event_type") == "error"
        return self.raw("events").select(
            F.col("event_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            engine.otherwise("hybrid").alias("engine"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
            (F.col("value") / 20).alias("processing_time"),
            (F.col("event_id") % 4 == 0).alias("cache_hit"),
            (F.col("event_id") % 5 == 0).alias("fallback_used"),
            (F.col("event_type") == "click").alias("paid_call"),
            error.alias("error"),
            F.when(error, lookup(k % 3, {0: "timeout", 1: "unreadable", 2: "network"})).alias("error_type"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("notification_id"),
            "user_id",
            F.col("event_type").alias("type"),
            lookup(F.col("event_id") % 3, {0: "low", 1: "medium", 2: "high"}).alias("priority"),
            (F.col("event_id") % 2 == 0).alias("is_read"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.col("props").alias("data"),
        )

    # -- text -------------------------------------------------------------------

    @cached_property
    def receipt_texts(self) -> DataFrame:
        """The text of each receipt with products, in one of three layouts by receipt."""
        k, nl = F.col("l_orderkey"), F.lit("\n")
        amount = F.floor("l_extendedprice")
        quantity = F.col("l_quantity").cast("int")
        name = F.upper("p_name")
        bar = F.concat(F.lit("78"), F.lpad(F.col("l_partkey").cast("string"), 11, "0"))
        counted = F.concat(quantity.cast("string"), F.lit("X"), dotted(F.floor(amount / quantity)))
        inline = F.concat_ws(" ", counted, name, F.concat(F.lit("$"), dotted(amount)))
        coded = F.concat_ws(" ", bar, name, F.concat(F.lit("$"), dotted(amount)))
        price = F.concat(F.lit("$ "), dotted(amount))
        stacked = (
            F.when(F.col("l_partkey") % 3 == 0, F.concat_ws("\n", counted, name, price))
            .when(F.col("l_partkey") % 3 == 1, F.concat(bar, F.lit(" "), name, nl, price))
            .otherwise(F.concat(name, nl, nl, dotted(amount)))
        )
        line = F.when(k % 3 == 0, inline).when(k % 3 == 1, stacked).otherwise(coded)
        lines, parts = self.raw("lineitem"), self.raw("part")
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey", amount.alias("amount"), line.alias("line"))
        body = (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list(order)).alias("rows"), F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))
        )
        orders = self.raw("orders").select("o_orderkey", "o_orderdate")
        o = F.col("o_orderkey")
        text = o.cast("string")

        def pick(values: list[str], by: int) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), (o % by + 1).cast("int"))

        def pad(number: Column, width: int) -> Column:
            return F.lpad(number.cast("string"), width, "0")

        vat = F.floor(F.col("total") * 19 / 119)
        when = self._order_time()
        rows = [
            pick(VENDORS, 5),
            F.concat(F.lit("RUT: 76."), pad(o % 1000, 3), F.lit("."), pad(o * 7 % 1000, 3), F.lit("-"), F.when(o % 11 == 10, "K").otherwise((o % 10).cast("string"))),
            F.concat(F.lit("SUC: "), F.when(o % 4 == 0, "CALLE LOS AROMOS ").otherwise("AV. PROVIDENCIA "), (o % 900 + 100).cast("string"), F.lit(", SANTIAGO")),
            F.concat(F.lit("FONO: +56 2 2"), pad(o % 1000, 3), F.lit(" "), pad(o * 3 % 10000, 4)),
            F.concat(F.lit("BOL. ELECTRONICA: "), F.lpad(text, 10, "0")),
            F.concat(F.lit("FECHA: "), F.date_format(when, "dd/MM/yyyy"), F.lit(" HORA: "), F.date_format(when, "HH:mm:ss")),
            F.concat(F.lit("CAJA: "), pad(o % 90, 4)),
            F.array_join(F.transform("rows", lambda r: r["line"]), "\n"),
            F.concat(F.lit("TOTAL $ "), dotted(F.col("total"))),
            F.concat(F.lit("SUBTOTAL "), dotted(F.col("total"))),
            F.concat(F.lit("AFECTO "), dotted(F.col("total") - vat)),
            F.when(o % 3 == 1, F.concat(F.lit("TOTAL IVA (19.0%)\n"), dotted(vat))).otherwise(F.concat(F.lit("IVA $ "), dotted(vat))),
            F.concat(F.lit("TOTAL NUMERO DE ARTIC VEND = "), F.col("n").cast("string")),
            pick(PAYMENTS, 5),
            F.concat(F.lit("VUELTO $ "), dotted(o % 7 * 100)),
            F.lit("GRACIAS POR SU COMPRA"),
        ]
        joined = orders.join(body, orders.o_orderkey == body.l_orderkey)
        return joined.select(o.alias("receipt_id"), F.concat_ws("\n", *rows).alias("text"), "total", "n", when.alias("date"))

    @cached_property
    def noisy_names(self) -> DataFrame:
        """Product names as an engine might read them: one per part, with confused characters."""
        k = F.col("p_partkey")
        base = F.element_at(F.array(*[F.lit(v) for v in SHELF]), (k % len(SHELF) + 1).cast("int"))
        noisy = (
            F.when(k % 5 == 0, F.translate(base, "o", "0"))
            .when(k % 5 == 1, F.translate(base, "l", "1"))
            .when(k % 5 == 2, F.concat(base, F.lit(" "), F.upper("p_name")))
            .when(k % 5 == 3, F.initcap(base))
            .otherwise(F.regexp_replace(base, "a", "4"))
        )
        return self.raw("part").select(k.alias("sku"), noisy.alias("name"), F.col("p_retailprice").alias("price"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source")

    @cached_property
    def labels(self) -> DataFrame:
        return self.raw("labels")
