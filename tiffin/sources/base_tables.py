"""The model tables and messages derived from the supplied star-schema tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas of the supplied tables; reading them needs no job.
BASE = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(BASE[name]).parquet(f"{folder}/{name}.parquet")


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    username = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
    nation = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    return table(spark, folder, "customer").select(
        key.alias("user_id"),
        username.alias("username"),
        F.concat(username, F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit("+"), nation, F.lit("-"), F.lpad(key.cast("string"), 9, "0")).alias("phone"),
        F.when(key % 100 == 0, "admin").otherwise("customer").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def _category_of_brand():
    return F.substring("p_brand", 7, 10).cast("int")


def categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(
        _category_of_brand().alias("category_id"),
        F.col("p_brand").alias("category_name"),
        (_category_of_brand() % 5 != 0).alias("is_active"),
    )
    # One row per brand. Its size is known once it is made; run-time statistics then choose the join.
    return rows.distinct()


def menu_items(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(size != 1, _category_of_brand()).alias("category_id"),
        F.col("p_name").alias("item_name"),
        F.when(size % 13 != 0, F.col("p_type")).alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.when(size % 3 != 0, F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"))).alias("image_url"),
        (size % 7 != 0).alias("is_available"),
        (size % 11 != 0).alias("is_active"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.col("o_orderstatus")
    priority = F.substring("o_orderpriority", 1, 1)
    open_status = (
        F.when(priority == "1", "confirmed")
        .when(priority == "2", "preparing")
        .when(priority == "3", "ready")
        .when(priority == "4", "cancelled")
        .otherwise("pending")
    )
    return table(spark, folder, "orders").select(
        key.alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("ORD"), F.lpad(key.cast("string"), 13, "0")).alias("order_number"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        F.when(key % 2 == 0, "cash").otherwise("card").alias("payment_method"),
        F.when(state == "F", "paid")
        .when((state == "P") & (priority == "4"), "refunded")
        .otherwise("pending")
        .alias("payment_status"),
        F.when(state == "F", "completed").when(state == "O", "pending").otherwise(open_status).alias("status"),
        F.when(key % 4 == 0, "scheduled").otherwise("asap").alias("order_type"),
        F.when(key % 4 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("scheduled_at"),
        F.when(key % 5 == 0, F.concat(F.lit("Note "), F.col("o_orderpriority"))).alias("special_instructions"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    item = F.col("l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    unit_cents = F.floor(cents / F.col("l_quantity").cast("bigint")).cast("decimal(10,0)")
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        item.alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (unit_cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,2)").alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("subtotal"),
        F.when(item % 10 == 0, "")
        .when(item % 10 == 1, F.concat(F.lit("Snapshot "), item.cast("string")))
        .alias("item_name_snapshot"),
        F.col("l_shipdate").alias("created_at"),
    )


class BaseModel(Mapping):
    """The model tables over a folder; a table is planned when it is asked for."""

    TABLES = {
        "users": users,
        "categories": categories,
        "menu_items": menu_items,
        "orders": orders,
        "order_items": order_items,
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.TABLES[name](self.spark, self.folder)

    def __iter__(self):
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)


def model_from_base(spark: SparkSession, folder: str) -> BaseModel:
    return BaseModel(spark, folder)


# Messages ------------------------------------------------------------------


def _prop_k():
    return F.col("k")


def _with_k(events_df: DataFrame) -> DataFrame:
    """Adds the JSON property ``k``. As a generator, ``json_tuple`` parses each row once,
    however often filters and projections use the value."""
    parsed = events_df.select("*", F.json_tuple("props", "k").alias("k"))
    return parsed.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.col("k").cast("int")})


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _with_k(table(spark, folder, "events"))


# Pieces that the events are streamed in, and so micro-batches of every streamed query.
EVENT_SLICES = 5
# Rows of a piece that one task writes as one file.
FILE_ROWS = 2_000_000


def event_stream(spark: SparkSession, folder: str, run: str, slices: int = EVENT_SLICES) -> DataFrame:
    """All events as a stream of files in order of time, written below ``run``, one piece a micro-batch.

    Events without time are in the last piece.
    """
    rows = table(spark, folder, "events")
    parts = [n / slices for n in range(1, slices)]
    time = F.col("ts").cast("timestamp")
    total, cuts = rows.agg(F.count("*"), F.percentile_approx(time, parts)).first()
    files = max(1, -(-total // (slices * FILE_ROWS)))
    bounds = [None, *(cuts or []), None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        inside = F.lit(True) if low is None else time > F.lit(low)
        if high is not None:
            inside = inside & (time <= F.lit(high))
        # The source takes files by their time of writing, so the pieces are written one after the other, each as the
        # number of files that a micro-batch takes.
        piece = rows.filter(F.coalesce(inside, F.lit(high is None)))
        piece.repartition(files).write.parquet(f"{run}/events/slice-{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{run}/events/*")
    return _with_k(stream)


def cart_events(events_df: DataFrame) -> DataFrame:
    """click adds, view sets a quantity (0 removes), error removes, the rest empties."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "add").when(kind == "view", "set").when(kind == "error", "remove").otherwise("clear")
    )
    item = F.when(kind.isin("click", "view", "error"), _prop_k() % 10).cast("bigint")
    return events_df.select(
        "event_id",
        "ts",
        "user_id",
        action.alias("action"),
        item.alias("item_id"),
        F.when(kind == "view", _prop_k() % 4).cast("int").alias("quantity"),
    )


def cart_payloads(events_df: DataFrame) -> DataFrame:
    """Raw ``cart:add`` messages, some of them malformed."""
    k = _prop_k().cast("string")
    text = (
        F.when(_prop_k() % 7 == 0, "not json")
        .when(_prop_k() % 7 == 1, F.concat(F.lit('{"item": {"quantity": '), k, F.lit("}}")))
        .when(_prop_k() % 7 == 2, F.concat(F.lit('{"item": {"item_id": "'), k, F.lit('"}}')))
        .when(_prop_k() % 7 == 3, F.concat(F.lit('{"item": {"item_id": '), k, F.lit("}}")))
        .when(_prop_k() % 14 == 4, F.concat(F.lit('{"item": {"item_id": '), k, F.lit('.5, "quantity": 2}}')))
        .when(_prop_k() % 14 == 11, F.concat(F.lit('{"item": {"item_id": '), k, F.lit('.0, "quantity": 2}}')))
        .when(_prop_k() % 14 == 5, F.lit('{"x": 1}'))
        .otherwise(F.concat(F.lit('{"item": {"item_id": '), k, F.lit(', "quantity": 3}}')))
    )
    return events_df.filter("event_type = 'click'").select("event_id", "ts", "user_id", text.alias("payload"))


def request_log(events_df: DataFrame) -> DataFrame:
    """Every event as a served HTTP request."""
    kind = F.col("event_type")
    method = F.when(kind.isin("purchase", "signup", "click"), "POST").otherwise("GET")
    path = (
        F.when(kind == "purchase", "/api/orders")
        .when(kind == "signup", "/api/auth/register")
        .when(kind == "click", "/api/cart")
        .when(kind == "view", "/api/menu")
        .otherwise("/api/orders/my-orders")
    )
    return events_df.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("client"),
        method.alias("method"),
        path.alias("path"),
        F.when(kind == "error", 500).when(_prop_k() % 20 == 0, 404).otherwise(200).alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
    )


def busy_request_log(events_df: DataFrame) -> DataFrame:
    """The requests of a month within the first hours of a day, from four addresses that share many users."""
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    ts = F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / 600))
    log = request_log(events_df.withColumn("ts", ts))
    return log.withColumn("client", F.concat(F.lit("10.0.0."), (F.col("client").cast("long") % 4).cast("string")))


def connection_events(events_df: DataFrame) -> DataFrame:
    """view connects, error and signup disconnect."""
    kind = F.col("event_type")
    return events_df.filter(kind.isin("view", "error", "signup")).select(
        "event_id", "ts", "user_id", F.when(kind == "view", "connect").otherwise("disconnect").alias("action")
    )


def routed_messages(events_df: DataFrame) -> DataFrame:
    """Every event as an emitted message with its owner."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "purchase", "order:new")
        .when(kind == "click", "cart:activity")
        .when(kind == "view", "menu:item:update")
        .when(kind == "signup", "category:update")
        .otherwise("order:update")
    )
    return events_df.select("event_id", name.alias("event"), "user_id", (_prop_k() % 3 == 0).alias("status_sent"))


def new_order_messages(events_df: DataFrame) -> DataFrame:
    """Purchases as new-order messages, sent again by some retries."""
    k = _prop_k()
    return events_df.filter("event_type = 'purchase'").select(
        (F.col("user_id") * 100 + k).alias("orderId"),
        F.concat(F.lit("ORD"), F.col("event_id").cast("string")).alias("orderNumber"),
        F.col("value").cast("decimal(12,2)").alias("totalAmount"),
        F.col("user_id").alias("userId"),
        F.lit(None).cast("string").alias("username"),
        F.lit("asap").alias("orderType"),
        F.lit(None).cast("timestamp").alias("scheduledAt"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


def _payload(*entries) -> Column:
    """Map of the fields that were sent; a sent value may be NULL."""
    pairs = [
        F.when(sent, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
        for name, sent, value in entries
    ]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def menu_changes(events_df: DataFrame) -> DataFrame:
    """click adds an item, error deletes it, the rest update some of its fields."""
    kind, k, seq = F.col("event_type"), _prop_k(), F.col("event_id")
    flag = (
        F.when((kind == "purchase") | ((kind == "click") & (k % 11 == 0)), "0").when(kind == "signup", "1")
    )
    payload = _payload(
        ("item_name", (k % 2 == 0) | (kind == "click"), F.concat(F.lit("Name "), seq.cast("string"))),
        ("price", k % 3 == 0, F.concat(k.cast("string"), F.lit(".50"))),
        ("description", k % 5 == 0, F.when(k % 10 == 0, F.lit("changed"))),
        ("is_available", k % 7 == 0, F.when(k % 14 == 0, "true").otherwise("false")),
        ("is_active", flag.isNotNull(), flag),
    )
    return events_df.select(
        F.when(kind == "click", "add").when(kind == "error", "delete").otherwise("update").alias("op"),
        (F.col("user_id") * 14 + k % 14).alias("item_id"),
        payload.alias("payload"),
        F.col("ts").alias("at"),
        seq.alias("seq"),
    )


def category_messages(events_df: DataFrame) -> DataFrame:
    """Sign-up and purchase events as added and updated categories."""
    kind, k, seq = F.col("event_type"), _prop_k(), F.col("event_id")
    payload = _payload(
        ("category_name", F.lit(True), F.concat(F.lit("Category "), seq.cast("string"))),
        ("is_active", k % 2 == 0, F.when(k % 4 == 0, "1").otherwise("0")),
    )
    return events_df.filter("event_type IN ('signup', 'purchase')").select(
        F.when(kind == "signup", "add").otherwise("update").alias("op"),
        (k % 60).cast("int").alias("category_id"),
        payload.alias("payload"),
        F.col("ts").alias("at"),
        seq.alias("seq"),
    )


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One audit row per order, from its first state to its present one."""
    o = orders(spark, folder)
    old = F.to_json(F.struct(F.lit("pending").alias("status"), F.lit("pending").alias("payment_status"), "order_type"))
    new = F.to_json(F.struct("status", "payment_status", F.col("special_instructions").alias("note")))
    return o.select(
        F.col("order_id").alias("log_id"),
        "user_id",
        F.lit("update").alias("action"),
        F.lit("order").alias("entity_type"),
        F.col("order_id").alias("entity_id"),
        old.alias("old_values"),
        new.alias("new_values"),
        F.lit(None).cast("string").alias("ip_address"),
        "created_at",
    )


def status_history(spark: SparkSession, folder: str) -> DataFrame:
    """Status changes per order: one per line, dated by its shipping day."""
    number = F.col("l_linenumber")
    status = (
        F.when(number == 1, "pending")
        .when(number == 2, "confirmed")
        .when(number == 3, "preparing")
        .when(number == 4, "ready")
        .when(number == 5, "completed")
        .when(number == 6, "cancelled")
        .otherwise("lost")
    )
    seq = number * F.lit(100_000_000).cast("bigint") + F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        seq.alias("seq"),
        status.alias("status"),
    )
