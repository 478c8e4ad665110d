"""Counts, checks, reports, drift and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.operators import difference, quality, rules, sinks, sketches
from tierflow.workspace import staging_path

def _customer_rules():
    return {
        "key_not_null": rules.not_null("c_custkey"),
        "balance_positive": rules.positive("c_acctbal"),
        "nation_in_range": rules.within({"c_nationkey": (5, 15)}),
    }


def _customer_copies(spark, sf_dir):
    """Customers, their copies, and the furniture segment once more without keys."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    keyless = customer.where(F.col("c_mktsegment") == "FURNITURE").withColumn(
        "c_custkey", F.lit(None).cast("long")
    )
    return customer.unionByName(customer).unionByName(keyless)


_COPIES = """
    WITH r AS (
      SELECT c_custkey, c_acctbal, c_nationkey FROM customer
      UNION ALL SELECT c_custkey, c_acctbal, c_nationkey FROM customer
      UNION ALL SELECT NULL, c_acctbal, c_nationkey FROM customer WHERE c_mktsegment = 'FURNITURE')"""


@query(
    _COPIES
    + """
    SELECT 0 AS step, 'raw' AS stage, count(*) AS n_rows FROM r
    UNION ALL SELECT 1, 'key_not_null', count(*) FROM r WHERE c_custkey IS NOT NULL
    UNION ALL SELECT 2, 'balance_positive', count(*) FROM r WHERE c_custkey IS NOT NULL AND c_acctbal > 0
    UNION ALL SELECT 3, 'nation_in_range', count(*) FROM r
      WHERE c_custkey IS NOT NULL AND c_acctbal > 0 AND c_nationkey BETWEEN 5 AND 15
    UNION ALL SELECT 4, 'deduplicated', count(DISTINCT c_custkey) FROM r
      WHERE c_acctbal > 0 AND c_nationkey BETWEEN 5 AND 15"""
)
def stage_counts(spark, sf_dir):
    return quality.stage_counts(_customer_copies(spark, sf_dir), _customer_rules(), ["c_custkey"])


@query(
    _COPIES
    + """
    SELECT 'key_not_null' AS rule, count(*) FILTER (c_custkey IS NULL) AS n_dropped FROM r
    UNION ALL SELECT 'balance_positive', count(*) FROM r WHERE c_custkey IS NOT NULL AND c_acctbal <= 0
    UNION ALL SELECT 'nation_in_range', count(*) FROM r
      WHERE c_custkey IS NOT NULL AND c_acctbal > 0 AND c_nationkey NOT BETWEEN 5 AND 15
    UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT c_custkey) FROM r
      WHERE c_custkey IS NOT NULL AND c_acctbal > 0 AND c_nationkey BETWEEN 5 AND 15"""
)
def dropped_by_rule(spark, sf_dir):
    return quality.dropped_by_rule(_customer_copies(spark, sf_dir), _customer_rules(), ["c_custkey"])


def _profile_sql(column):
    return f"""
    SELECT '{column}' AS "column", count({column}) AS "count", round(avg(CAST({column} AS DOUBLE)), 4) AS mean,
           round(stddev_samp(CAST({column} AS DOUBLE)), 4) AS stddev, CAST(min({column}) AS DOUBLE) AS "min",
           CAST(max({column}) AS DOUBLE) AS "max"
    FROM lineitem"""


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


@query(" UNION ALL ".join(_profile_sql(c) for c in _PROFILED))
def profile_numeric(spark, sf_dir):
    return quality.profile(table(spark, sf_dir, "lineitem"), _PROFILED, digits=4)


_REPORTED = """
    WITH r AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS id FROM orders)
    SELECT 'orders' AS entity, '20240131' AS date, 'SUCCESS' AS status, count(*) AS bronze_count,
           count(*) FILTER (id IS NULL) AS null_ids,
           count(*) - count(DISTINCT id) - CAST(bool_or(id IS NULL) AS INTEGER) AS duplicate_count
    FROM r"""


def _reported_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("id"), "o_totalprice"
    )
    return quality.quality_report(rules.audited(orders, "20240131"), "orders", "20240131")


@query(_REPORTED)
def quality_report(spark, sf_dir):
    return _reported_orders(spark, sf_dir).select(
        "entity", "date", "status", "bronze_count", "null_ids", "duplicate_count"
    )


@query(_REPORTED)
def report_text(spark, sf_dir):
    """The report written as one line of JSON text and read back."""
    path = staging_path(spark, "report")
    sinks.write_report(quality.report_json(_reported_orders(spark, sf_dir)), path)
    fields = (
        "entity string, date string, status string, bronze_count bigint, null_ids bigint, "
        "duplicate_count bigint"
    )
    return spark.read.text(path).select(F.from_json("value", fields).alias("r")).select("r.*")


@query(
    """
    WITH r AS (
      SELECT props FROM events UNION ALL
      SELECT CASE event_type WHEN 'error' THEN substr(props, 1, length(props) - 1) ELSE props END FROM events)
    SELECT count(*) AS n_rows, count(*) FILTER (json_valid(props)) AS n_valid,
           count(*) FILTER (json_valid(props)) / count(*) AS valid_share, bool_and(json_valid(props)) AS all_valid
    FROM r"""
)
def dq_json_valid(spark, sf_dir):
    """Event payloads, those of one type once more without their last brace."""
    events = table(spark, sf_dir, "events")
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    both = events.select("props").unionByName(events.select(cut.alias("props")))
    return quality.json_validity(both, "props")


def _payloads(spark, sf_dir):
    """Objects with one to three fields depending on the event type; errors are no objects."""
    events = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind == "view", F.to_json(F.struct(F.col("event_id").alias("id"), value)))
        .when(kind == "click", F.to_json(F.struct(F.col("event_id").alias("id"), value, kind.alias("kind"))))
        .when(kind == "error", F.lit("[1, 2]"))
        .otherwise(F.to_json(F.struct(F.col("event_id").alias("id"))))
    )
    return events.select(text.alias("payload"))


_PAYLOADS = """
    WITH r AS (
      SELECT CASE event_type WHEN 'view' THEN '{"id":1,"value":1}' WHEN 'click' THEN '{"id":1,"value":1,"kind":"x"}'
             WHEN 'error' THEN '[1, 2]' ELSE '{"id":1}' END AS payload FROM events),
    o AS (SELECT list_sort(json_keys(payload)) AS keys FROM r WHERE json_type(payload) = 'OBJECT'),
    k AS (SELECT key, count(*) AS n FROM (SELECT unnest(keys) AS key FROM o) GROUP BY 1),
    f AS (
      SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(*) FROM o) AS n_objects,
             (SELECT count(*) FROM k) AS n_fields,
             (SELECT count(*) FROM k WHERE n = (SELECT count(*) FROM o)) AS n_common,
             (SELECT count(DISTINCT keys) FROM o) AS n_key_sets)"""


@query(_PAYLOADS + " SELECT *, n_common / n_fields AS ratio, n_common > 0 AS passed FROM f")
def dq_field_consistency(spark, sf_dir):
    return quality.field_consistency(_payloads(spark, sf_dir), "payload")


@query(_PAYLOADS + " SELECT *, n_common / n_fields AS ratio, n_key_sets = 1 AS passed FROM f")
def dq_field_consistency_strict(spark, sf_dir):
    return quality.field_consistency(_payloads(spark, sf_dir), "payload", strict=True)


@query(
    _PAYLOADS
    + """
    SELECT 'not_empty' AS "check", n_rows > 0 AS passed, false AS warning FROM f
    UNION ALL SELECT 'json_valid', (SELECT bool_and(json_valid(payload)) FROM r), false FROM f
    UNION ALL SELECT 'field_consistency', n_common > 0, n_common / n_fields < 0.5 FROM f
    UNION ALL SELECT 'all', n_rows > 0 AND n_common > 0 AND (SELECT bool_and(json_valid(payload)) FROM r),
              n_common / n_fields < 0.5 FROM f"""
)
def dq_checks(spark, sf_dir):
    return quality.validate_records(_payloads(spark, sf_dir), "payload")


@query(
    """
    WITH b AS (
      SELECT o_custkey, o_orderkey, o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS p
      FROM orders WHERE o_orderstatus <> 'P')
    SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS raw_rows, (SELECT count(*) FROM b) AS bronze_rows,
           (SELECT count(DISTINCT o_orderkey) FROM orders) AS raw_keys,
           (SELECT count(DISTINCT o_orderkey) FROM b) AS bronze_keys,
           (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM b)) AS keys_lost,
           (SELECT count(*) FROM (SELECT o_orderkey FROM b EXCEPT SELECT o_orderkey FROM orders)) AS keys_added,
           (SELECT count(*) FROM b JOIN orders o USING (o_orderkey) WHERE b.p <> o.o_totalprice) AS keys_changed,
           'o_orderdate,o_orderpriority,o_orderstatus' AS columns_only_raw, '_processing_date' AS columns_only_bronze"""
)
def reconcile_raw_bronze(spark, sf_dir):
    """Orders against themselves without pending ones and with urgent ones changed."""
    orders = table(spark, sf_dir, "orders")
    raised = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    bronze = orders.where(F.col("o_orderstatus") != "P").select(
        "o_orderkey", "o_custkey", raised.alias("o_totalprice"), F.lit("20240131").alias("_processing_date")
    )
    return quality.reconcile(orders, bronze, "o_orderkey", ["o_custkey", "o_totalprice"])


@query(
    """
    SELECT count(*) AS n_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows
    FROM (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING n > 1)"""
)
def dq_unique(spark, sf_dir):
    return quality.violations_unique(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(
    """
    SELECT 'o_custkey' AS "column", count(*) FILTER (o_orderstatus = 'P') AS n_null FROM orders
    UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL) FROM orders"""
)
def dq_not_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    )
    return quality.violations_not_null(orders, ["o_custkey", "o_orderkey"])


@query(
    """
    SELECT count(DISTINCT o_custkey) AS n_keys, count(*) AS n_rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def dq_relationships(spark, sf_dir):
    """Orders of customers that a parent table of solvent customers lacks."""
    solvent = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return quality.violations_relationship(table(spark, sf_dir, "orders"), solvent, "o_custkey", "c_custkey")


@query(
    """
    WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS c, o_totalprice FROM orders)
    SELECT 'age_seconds' AS metric, CAST(date_sub('second', max(ts), TIMESTAMP '2024-02-01') AS DOUBLE) AS "value"
      FROM events
    UNION ALL SELECT 'complete_o_custkey', count(c) / count(*) FROM o
    UNION ALL SELECT 'complete_o_totalprice', count(o_totalprice) / count(*) FROM o
    UNION ALL SELECT 'consistency', count(c_custkey) / count(*)
      FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
    UNION ALL SELECT 'accuracy', count(*) FILTER (c_name = 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')) / count(*)
      FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey"""
)
def dq_metrics(spark, sf_dir):
    """Freshness of events, completeness of orders, and agreement of events with customers."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    partial = orders.withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    fresh = quality.freshness(events, "ts", now).select(
        F.lit("age_seconds").alias("metric"), F.col("age_seconds").cast("double").alias("value")
    )
    full = quality.completeness(partial, ["o_custkey", "o_totalprice"]).select(
        F.concat(F.lit("complete_"), "column").alias("metric"), F.col("share").alias("value")
    )
    named = events.withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
    solvent = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    # The truth holds every row twice, and another name besides.
    other = solvent.withColumn("c_name", F.lit("another"))
    shares = quality.match_share(named, solvent.unionByName(solvent).unionByName(other), "user_id", "c_custkey", "name", "c_name")
    matched = shares.select(
        F.inline(
            F.array(
                F.struct(F.lit("consistency").alias("metric"), F.col("consistency").alias("value")),
                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
            )
        )
    )
    return fresh.unionByName(full).unionByName(matched)


def _order_versions(spark, sf_dir):
    """Orders before 1998, and later ones with a channel, without a priority, the key as text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    border = F.lit("1998-01-01").cast("timestamp_ntz")
    old = orders.where(F.col("o_orderdate") < border)
    new = orders.where(F.col("o_orderdate") >= border).drop("o_orderpriority").withColumn("channel", F.lit("web"))
    return old, new


@query(
    """
    SELECT "change", "column", count(*) AS n_rows FROM (
      VALUES ('added', 'channel'), ('removed', 'o_orderpriority'), ('type_changed', 'o_custkey')) v("change", "column"),
      orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL"""
)
def schema_drift(spark, sf_dir):
    """Changes between two versions, with the rows that arrive under the new one."""
    old, new = _order_versions(spark, sf_dir)
    new = new.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    drift = quality.schema_drift_table(old, new).select("change", "column")
    return drift.withColumn("n_rows", new.agg(F.count("*")).scalar())


@query(
    """
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate,
           CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority,
           CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'web' END AS channel
    FROM orders"""
)
def schema_evolve_union(spark, sf_dir):
    """Besides columns that come and go, the customer becomes text and the price, once a decimal, a double."""
    old, new = _order_versions(spark, sf_dir)
    old = old.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    return quality.evolve_union(old, new.withColumn("o_custkey", F.concat("o_custkey", F.lit(""))))


@query(
    """
    WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1)
    SELECT event_id, event_type, value, round((value - m) / d, 4) AS zscore
    FROM events JOIN s USING (event_type) WHERE abs((value - m) / d) > 3"""
)
def outliers_zscore(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    outliers = quality.zscore_outliers(events, ["event_type"], "value")
    return outliers.withColumn("zscore", F.round("zscore", 4))


@query(
    """
    WITH q AS (
      SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    f AS (SELECT event_type, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM q)
    SELECT event_id, event_type, value, low, high
    FROM events JOIN f USING (event_type) WHERE value < f.low OR value > f.high"""
)
def outliers_iqr(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    outliers = quality.iqr_outliers(events, ["event_type"], "value")
    return outliers.select(
        "event_id", "event_type", "value", "low", "high"
    )


@query(
    """
    SELECT 'value' AS column, count(*) AS rows, count(value) AS count, min(value) AS min, max(value) AS max,
        CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DECIMAL(38, 4)) AS sum, true AS within FROM events
    UNION ALL SELECT 'user_id', count(*), count(user_id), min(user_id), max(user_id),
        CAST(sum(CAST(user_id AS DECIMAL(28, 4))) AS DECIMAL(38, 4)), true FROM events
    UNION ALL SELECT 'props', count(*), count(props), NULL, NULL, NULL, true FROM events"""
)
def profile_merged(spark, sf_dir):
    """Profiles of all days from stored states of each day, one of which was loaded a second time: counts, extremes and sums are exact,
    distinct values and quantiles within the sketches' error of exact ones."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path, columns = staging_path(spark, "states"), ["value", "user_id", "props"]
    first = F.day("ts") <= 15
    for part in (first, ~first, F.day("ts") == 20):
        sketches.add_states(events.where(part), path, "day", columns)
    merged = sketches.merged_profile(sketches.read_states(spark, path))
    exact = events.agg(*(F.count_distinct(c).alias(c) for c in columns))
    exact = exact.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns))))
    joined = merged.join(exact, "column")
    # The rank of each estimated quartile among all values.
    quartiles = merged.where("column IN ('value', 'user_id')").select("column", F.explode(F.array("q25", "q50", "q75")).alias("at"))
    values = events.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns[:2]))))
    ranks = values.join(quartiles, "column").groupBy("column", "at").agg(F.avg((F.col("x") < F.col("at")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("at")).cast("int")).alias("upto"))
    error = sketches.RANK_ERROR
    near = [(F.col("below") <= q + error) & (F.col("upto") >= q - error) for q in (0.25, 0.5, 0.75)]
    good = ranks.groupBy("column").agg(F.bool_and(near[0] | near[1] | near[2]).alias("quartiles_near"))
    distinct_near = F.abs(F.col("n_distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
    return joined.join(good, "column", "left").select(
        "column", "rows", "count", "min", "max", "sum", (distinct_near & F.coalesce("quartiles_near", F.lit(True))).alias("within")
    )


_TWO_LOADS = """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 97 <> 1),
    b AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 2 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
      FROM orders WHERE o_orderkey % 83 <> 3)"""


@query(
    _TWO_LOADS
    + """
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
        CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus"""
)
def reconcile_by_digest(spark, sf_dir):
    """What differs between two loads of the orders, found by digests over ranges of keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = orders.where("o_orderkey % 97 <> 1")
    status = F.when(F.col("o_orderkey") % 89 == 2, "X").otherwise(F.col("o_orderstatus"))
    after = orders.where("o_orderkey % 83 <> 3").withColumn("o_orderstatus", status)
    return difference.differences(before, after, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    """
    SELECT 'added' AS change, 'line.tags[].weight' AS column, NULL AS old_type, 'double' AS new_type
    UNION ALL SELECT 'removed', 'line.status', 'string', NULL
    UNION ALL SELECT 'type_changed', 'line.by_name{value}', 'int', 'bigint'"""
)
def nested_drift(spark, sf_dir):
    """Changes inside structs, lists and maps of orders, by path."""
    old, new = _nested_orders(table(spark, sf_dir, "orders"))
    return quality.schema_drift_table(old, new)


@query(
    """
    SELECT o_orderkey, o_orderstatus AS status, o_custkey AS tag, NULL::DOUBLE AS weight, CAST(1 AS BIGINT) AS of_name FROM orders
    UNION ALL SELECT o_orderkey, NULL, o_custkey, o_totalprice, 2 FROM orders"""
)
def nested_union(spark, sf_dir):
    """Both versions of nested orders under the fields of both."""
    old, new = _nested_orders(table(spark, sf_dir, "orders"))
    tag = F.col("line.tags")[0]
    return quality.evolve_union(old, new).select(
        "o_orderkey", F.col("line.status").alias("status"), tag["tag"].alias("tag"), tag["weight"].alias("weight"),
        F.try_element_at("line.by_name", F.lit("n")).alias("of_name"),
    )


def _nested_orders(orders):
    tag = F.col("o_custkey").alias("tag")
    old = F.struct(F.col("o_orderstatus").alias("status"), F.array(F.struct(tag)).alias("tags"), F.create_map(F.lit("n"), F.lit(1)).alias("by_name"))
    weighed = F.array(F.struct(tag, F.col("o_totalprice").alias("weight"))).alias("tags")
    new = F.struct(weighed, F.create_map(F.lit("n"), F.lit(2).cast("bigint")).alias("by_name"))
    return orders.select("o_orderkey", old.alias("line")), orders.select("o_orderkey", new.alias("line"))
