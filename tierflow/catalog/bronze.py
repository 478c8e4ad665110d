"""Projections, filters, deduplication and bronze passes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F, types as T

from tierflow.catalog.registry import query, table
from tierflow.functions.names import normalize_columns as normalized
from tierflow.operators import rules, sinks
from tierflow.operators.quality import sample_rows
from tierflow.plans.bronze import run_bronze, to_bronze
from tierflow.sources.files import basename, scan_parquet
from tierflow.specs import LISTINGS, NYC, EntitySpec
from tierflow.workspace import staging_path

DATE = "20240131"


@query("SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand, p_size AS size FROM part")
def normalize_columns(spark, sf_dir):
    ugly = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Part-Key"),
        F.col("p_name").alias("Part Name"),
        F.col("p_brand").alias("BRAND"),
        F.col("p_size").alias("size"),
    )
    return normalized(ugly)


@query(
    """
    SELECT c_custkey AS row_key,
           CASE WHEN c_nationkey IN (0, 3, 4) THEN NULL ELSE c_custkey END AS id,
           CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c_acctbal AS DECIMAL(10, 2)) END AS price,
           c_acctbal AS latitude
    FROM customer"""
)
def typed_casts(spark, sf_dir):
    """Keys as text, some of them no number, with a fraction, padded or empty; some prices
    with a currency sign."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    text_id = (
        F.when(nation == 0, "abc")
        .when(nation == 1, F.concat(key, F.lit(".7")))
        .when(nation == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(nation == 3, "")
        .when(nation == 4, "1e3")
        .otherwise(key)
    )
    price = F.col("c_acctbal").cast("string")
    dollars = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("$"), price)).otherwise(price)
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_key"),
        text_id.alias("id"),
        dollars.alias("price"),
        price.alias("latitude"),
    )
    return rules.clean_values(raw, NYC)


@query("SELECT p_partkey, p_name AS name, chr(9) || p_type AS room_type FROM part")
def trim_text(spark, sf_dir):
    """Blanks go, a TAB stays."""
    padded = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("  "), "p_name", F.lit("   ")).alias("name"),
        F.concat(F.lit(" \t"), "p_type", F.lit(" ")).alias("room_type"),
    )
    return rules.clean_values(padded, NYC)


@query(
    """
    SELECT l_partkey AS id, l_extendedprice AS price, 'part' AS kind FROM lineitem WHERE l_returnflag <> 'A'
    UNION ALL SELECT l_suppkey, l_extendedprice, 'supplier' FROM lineitem WHERE l_returnflag = 'N'"""
)
def explode_products(spark, sf_dir):
    """Wrappers with two, one or no products, or with null for them."""
    part = F.struct(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("price"), F.lit("part").alias("kind"))
    supplier = F.struct(F.col("l_suppkey").alias("id"), F.col("l_extendedprice").alias("price"), F.lit("supplier").alias("kind"))
    flag = F.col("l_returnflag")
    empty = F.filter(F.array(part), lambda _: F.lit(False))
    products = (
        F.when(flag == "N", F.array(part, supplier))
        .when(flag == "R", F.array(part))
        .when(F.col("l_linestatus") == "O", empty)
    )
    return rules.explode_records(table(spark, sf_dir, "lineitem").select(products.alias("products")), "products")


@query(
    """
    SELECT o_custkey AS id, max(o_totalprice) AS price, 'orders.parquet' AS file, true AS has_timestamp,
           '20240131' AS processing_date
    FROM orders GROUP BY 1"""
)
def audit_columns(spark, sf_dir):
    """Audit columns behind a dedup: the source file is still the scanned one."""
    orders = scan_parquet(spark, f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), "_source_file"
    )
    bronze = rules.audited(rules.keep_first(orders, ["id"], ["-price"]), DATE)
    return bronze.select(
        "id",
        "price",
        basename(F.col("_source_file")).alias("file"),
        F.col("_ingestion_timestamp").isNotNull().alias("has_timestamp"),
        F.col("_processing_date").alias("processing_date"),
    )


@query("SELECT s_suppkey, s_name AS name, CAST(s_acctbal AS DECIMAL(10, 2)) AS price FROM supplier WHERE s_acctbal > 0")
def spec_missing_columns(spark, sf_dir):
    """A spec on a table with few of its columns: only the price and name rules apply."""
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("price")
    )
    bronze = to_bronze(supplier, replace(NYC, required=()), DATE)
    return bronze.drop(*rules.AUDIT_COLUMNS)


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def filter_key_not_null(spark, sf_dir):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select(key.alias("id"), "o_totalprice")
    return orders.where(rules.not_null("id"))


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey BETWEEN 5 AND 15")
def filter_bbox(spark, sf_dir):
    box = {"c_acctbal": (100.0, 5000.0), "c_nationkey": (5, 15)}
    return table(spark, sf_dir, "customer").where(rules.within(box))


@query("SELECT * FROM customer WHERE c_acctbal > 0")
def filter_positive(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(rules.positive("c_acctbal"))


@query("SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders")
def dedup_key(spark, sf_dir):
    """Three copies per key, of which the dearest survives."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dearer = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    copies = orders.unionByName(dearer).unionByName(orders)
    return rules.keep_first(copies, ["o_orderkey"], ["-o_totalprice"])


@query(
    """
    SELECT * FROM orders QUALIFY row_number() OVER (
      PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def dedup_latest(spark, sf_dir):
    return rules.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["-o_orderdate", "-o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def sample_ordered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sample_rows(orders, 5, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    """
    SELECT event_id AS id, ts AS event_time, event_type, value, '20240131' AS processing_date FROM events"""
)
def bronze_generic(spark, sf_dir):
    """Events as JSON with awkward names, each twice with another value, plus rows without key."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ID"), F.col("ts").alias("Event-Time"), F.col("event_type").alias("Event Type"), "value"
    )
    dearer = events.withColumn("value", F.col("value") + 1000)
    keyless = events.where(F.col("Event Type") == "error").withColumn("ID", F.lit(None).cast("long"))
    raw, bronze = staging_path(spark, "events-raw"), staging_path(spark, "events-bronze")
    sinks.write_raw_json(events.unionByName(dearer).unionByName(keyless), raw)
    spec = EntitySpec("events", order=("value",), schema=events.schema, multi_line=False)
    run = run_bronze(spark, spec, raw, bronze, DATE)
    return spark.read.parquet(run.path).select(
        "id", "event_time", "event_type", "value", F.col("_processing_date").alias("processing_date")
    )


_LISTING_COLUMNS = """
    SELECT c_custkey AS id, c_name AS name, CAST(40.02 AS DOUBLE) + c_nationkey * CAST(0.05 AS DOUBLE) AS latitude,
           CAST(-74.7 AS DOUBLE) + length(c_mktsegment) * CAST(0.045 AS DOUBLE) AS longitude,
           CAST(c_acctbal AS DECIMAL(10, 2)) AS price, 3 AS minimum_nights, c_nationkey AS number_of_reviews,
           365 AS availability_365
    FROM customer"""


def _rentals_csv(spark, sf_dir, copies):
    """Customers as rental listings in a CSV of text, with a worthless copy of each."""
    customer = table(spark, sf_dir, "customer")
    rows = customer.select(
        F.col("c_custkey").cast("string").alias("ID"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("Name"),
        (F.lit(40.02) + F.col("c_nationkey") * F.lit(0.05)).cast("string").alias("Latitude"),
        (F.lit(-74.7) + F.length("c_mktsegment") * F.lit(0.045)).cast("string").alias("Longitude"),
        F.col("c_acctbal").cast("string").alias("Price"),
        F.lit("3").alias("minimum-nights"),
        F.col("c_nationkey").cast("string").alias("number of reviews"),
        F.lit("365").alias("availability_365"),
    )
    path = staging_path(spark, "rentals-csv")
    rows.unionByName(rows.withColumn("Price", F.lit(copies))).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path, rows.schema


def _rentals(spark, sf_dir, copies, order, dedup_first):
    raw, schema = _rentals_csv(spark, sf_dir, copies)
    spec = replace(NYC, schema=schema, order=(order,), multi_line=False)
    run = run_bronze(spark, spec, raw, staging_path(spark, "rentals-bronze"), DATE, dedup_first)
    return spark.read.parquet(run.path).drop("_ingestion_timestamp", "_source_file", "_processing_date")


@query(f"SELECT * FROM ({_LISTING_COLUMNS}) WHERE latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7 AND price > 0")
def bronze_nyc(spark, sf_dir):
    """A copy without a price never displaces the valid row of its key."""
    return _rentals(spark, sf_dir, "0", "price", dedup_first=False)


@query(
    f"""
    SELECT * FROM ({_LISTING_COLUMNS}) WHERE latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7
      AND price > 0 AND price < 5000"""
)
def bronze_nyc_dedup_first(spark, sf_dir):
    """Dedup ahead of the filters: where the copy at -1 wins, here on prices beyond 5000 as
    ordered by a flag, the key is lost."""
    raw, schema = _rentals_csv(spark, sf_dir, "-1")
    spec = replace(NYC, schema=T.StructType([*schema.fields]), multi_line=False, order=("-_wins",))
    text = spark.read.schema(schema).options(header=True, ignoreLeadingWhiteSpace=False).csv(raw)
    price = F.col("Price").cast("double")
    ranked = text.withColumn("_wins", F.when(price < 0, 1).when(price < 5000, 2).otherwise(0))
    bronze = to_bronze(ranked, spec, DATE, dedup_first=True)
    return bronze.drop("_wins", *rules.AUDIT_COLUMNS)


@query(
    """
    SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS title, CAST(p_retailprice AS DECIMAL(10, 2)) AS price,
           p_brand AS dim_x
    FROM part"""
)
def bronze_listings(spark, sf_dir):
    """Wrapper objects with a product, its dearer copy and one without id."""
    part = table(spark, sf_dir, "part")

    def product(key, extra):
        return F.struct(
            key.alias("id"),
            F.concat(F.lit(" "), "p_name").alias("title"),
            (F.col("p_retailprice") + extra).alias("price"),
            F.col("p_brand").alias("Dim-X"),
        )

    key, missing = F.col("p_partkey"), F.lit(None).cast("long")
    wrappers = part.select(F.array(product(key, 0), product(key, 10), product(missing, 0)).alias("products"))
    raw, bronze = staging_path(spark, "listings-raw"), staging_path(spark, "listings-bronze")
    sinks.write_raw_json(wrappers, raw)
    spec = replace(LISTINGS, schema=wrappers.schema, order=("price",), multi_line=False)
    run = run_bronze(spark, spec, raw, bronze, DATE)
    return spark.read.parquet(run.path).select("id", "title", "price", "dim_x")


@query(
    """
    SELECT p_partkey, p_name, p_brand, CASE WHEN p_brand = 'Brand#4' THEN p_size + 1 ELSE p_size END AS p_size
    FROM part"""
)
def sink_parquet_roundtrip(spark, sf_dir):
    """A second write replaces only the partition it holds."""
    part, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"), staging_path(spark, "part")
    sinks.write_partitions(part, path, ["p_brand"])
    changed = part.where(F.col("p_brand") == "Brand#4").withColumn("p_size", F.col("p_size") + 1)
    sinks.write_partitions(changed, path, ["p_brand"])
    return spark.read.schema(part.schema).parquet(path)


@query(
    """
    SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'quarantine' ELSE 'bronze' END AS place, o_orderkey FROM orders"""
)
def bronze_quarantine(spark, sf_dir):
    """Orders as JSON lines, a tenth of them cut off: what does not parse is set aside with its text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    raw, bronze_at, aside = (staging_path(spark, x) for x in ("lines", "bronze", "quarantine"))
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("o_orderkey") % 10 == 3, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    orders.select(cut.alias("value")).write.text(raw)
    spec = EntitySpec("orders", keys=("o_orderkey",), schema=orders.schema, multi_line=False)
    run_bronze(spark, spec, raw, bronze_at, DATE, quarantine_path=aside)
    text = F.regexp_extract("_corrupt_record", '"o_orderkey":([0-9]+)', 1).cast("bigint")
    return (
        spark.read.parquet(bronze_at).select(F.lit("bronze").alias("place"), "o_orderkey")
        .unionByName(spark.read.parquet(aside).select(F.lit("quarantine").alias("place"), text.alias("o_orderkey")))
    )


@query("SELECT o_orderkey, o_totalprice, 'erp' AS source_system, true AS has_time FROM orders WHERE o_orderstatus <> 'P'")
def bronze_extraction(spark, sf_dir):
    """Two extraction runs of the orders in one table, the second of which is withdrawn by its id."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    spec = EntitySpec("orders", fmt="parquet", keys=("o_orderkey",))
    pending = F.col("o_orderstatus") == "P"
    paths, runs = [], [rules.Extraction("erp"), rules.Extraction("erp")]
    for extraction, part in zip(runs, (orders.where(~pending), orders.where(pending))):
        raw, path = staging_path(spark, "extracted"), staging_path(spark, "traced")
        part.write.parquet(raw)
        run_bronze(spark, spec, raw, path, DATE, extraction=extraction)
        paths.append(path)
    left = rules.without_extractions(spark.read.parquet(*paths), runs[1].extraction_id)
    return left.select("o_orderkey", "o_totalprice", "source_system", F.col("extracted_at").isNotNull().alias("has_time"))
