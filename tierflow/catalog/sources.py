"""Scans, fetches, payloads, pages and raw sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.functions.names import raw_glob, raw_key as raw_key_path, raw_key_column
from tierflow.operators import sinks
from tierflow.plans import bronze, ingest
from tierflow.plans.ingest import land_records
from tierflow.sources import fetch, files, html, landing, paging, payload, sniff
from tierflow.specs import EntitySpec
from tierflow.workspace import staging_path


@query("SELECT * FROM events")
def scan_json(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), staging_path(spark, "events-json")
    sinks.write_raw_json(events, path)
    return files.scan_json(spark, path, events.schema).drop(files.SOURCE_FILE)


@query("SELECT * FROM orders")
def scan_csv(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), staging_path(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return files.scan_csv(spark, path, orders.schema).drop(files.SOURCE_FILE)


@query("SELECT * FROM orders")
def scan_xml(spark, sf_dir):
    """Orders as XML documents, a record for each element."""
    orders, path = table(spark, sf_dir, "orders"), staging_path(spark, "orders-xml")
    orders.write.format("xml").option("rootTag", "orders").option("rowTag", "order").save(path)
    return files.scan(spark, path, "xml", orders.schema, row_tag="order").drop(files.SOURCE_FILE)


@query("SELECT * FROM lineitem")
def scan_parquet(spark, sf_dir):
    return files.scan_parquet(spark, f"{sf_dir}/lineitem.parquet").drop(files.SOURCE_FILE)


@query("SELECT * FROM orders WHERE o_orderstatus = 'P'")
def scan_date_glob(spark, sf_dir):
    """Two extraction days land side by side; the glob picks the second."""
    orders, lake = table(spark, sf_dir, "orders"), staging_path(spark, "lake")
    pending = F.col("o_orderstatus") == "P"
    for date, part in (("20240101", orders.where(~pending)), ("20240102", orders.where(pending))):
        key = raw_key_path("shop", "csv", "orders", "retail", date, "csv")
        part.write.option("header", True).csv(f"{lake}/{key}")
    glob = raw_glob("shop", "csv", "orders", "20240102", "csv")
    return files.scan_csv(spark, f"{lake}/{glob}", orders.schema).drop(files.SOURCE_FILE)


def _three_csv_members(spark, orders):
    folder = staging_path(spark, "csv-folder")
    for status in ("F", "O", "P"):
        part = orders.where(F.col("o_orderstatus") == status)
        part.write.option("header", True).csv(f"{folder}/orders_{status.lower()}.csv")
    return folder


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def csv_first_file(spark, sf_dir):
    """Of three members the one with the smallest path."""
    orders = table(spark, sf_dir, "orders")
    folder = _three_csv_members(spark, orders)
    return files.scan_csv_folder(spark, folder, orders.schema, first_only=True).drop(files.SOURCE_FILE)


@query("SELECT * FROM orders")
def csv_all_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    folder = _three_csv_members(spark, orders)
    return files.scan_csv_folder(spark, folder, orders.schema).drop(files.SOURCE_FILE)


@query(
    """
    WITH t AS (
      SELECT doc_id, text, lang, split_part(text, chr(10), 1) AS h FROM documents),
    c AS (
      SELECT *, length(h) - length(replace(h, ',', '')) AS k,
             length(h) - length(replace(h, ';', '')) AS s,
             length(h) - length(replace(h, chr(9), '')) AS b FROM t),
    d AS (
      SELECT *, CASE WHEN s > k AND s > b THEN ';' WHEN b > k AND b > s THEN chr(9) ELSE ',' END AS delimiter
      FROM c)
    SELECT doc_id,
           CASE WHEN lang <> 'en' AND strlen(text) > length(text) THEN 'latin-1' ELSE 'utf-8' END AS encoding,
           delimiter,
           CAST(CASE delimiter WHEN ';' THEN s WHEN ',' THEN k ELSE b END + 1 AS INTEGER) AS n_columns,
           greatest(k, s, b) = 0 AS no_delimiter,
           NOT contains(text, chr(10)) AS header_only
    FROM d"""
)
def csv_sniff(spark, sf_dir):
    """Documents as file contents, those not in English stored as Latin-1."""
    documents = table(spark, sf_dir, "documents")
    content = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(
        F.encode("text", "ISO-8859-1")
    )
    return sniff.sniff_csv(documents.select("doc_id", content.alias("content")), "doc_id")


@query("SELECT * FROM orders")
def csv_detected(spark, sf_dir):
    """Orders in files with commas, semicolons and TABs, one of them in Latin-1, each read in its own way."""
    orders, folder = table(spark, sf_dir, "orders"), staging_path(spark, "dialects")
    for status, mark, encoding in (("F", ",", "UTF-8"), ("O", ";", "ISO-8859-1"), ("P", "\t", "UTF-8")):
        part = orders.where(F.col("o_orderstatus") == status)
        part = part.withColumn("o_orderpriority", F.concat("o_orderpriority", F.lit("é")))
        options = {"header": True, "sep": mark, "encoding": encoding}
        part.write.mode("append").options(**options).csv(folder)
    found = files.scan_csv_detected(spark, folder, orders.schema).drop(files.SOURCE_FILE)
    return found.withColumn("o_orderpriority", F.rtrim("o_orderpriority", F.lit("é")))


@query("SELECT 'application/gzip' AS content_type, true AS bytes_kept, count(*) AS n_rows FROM orders")
def land_binary(spark, sf_dir):
    """Gzip files landed as the objects they are, compared with their source by checksum."""
    orders, drop = table(spark, sf_dir, "orders"), staging_path(spark, "drop")
    orders.repartition(3).write.option("header", True).option("compression", "gzip").csv(drop)
    target = ingest.land_files(spark, drop, f"{staging_path(spark, 'landed')}/orders.csv.gz", "*.csv.gz")
    # The manifest has what was read from the source; what was landed is read back once.
    sent = spark.read.parquet(ingest.manifest_path(target)).select(files.basename(F.col("target")).alias("name"), F.col("sha256").alias("_sent"))
    kept = files.scan_files(spark, target, "*.csv.gz").select(
        files.basename(F.col("path")).alias("name"),
        landing.content_type(F.col("path")).alias("content_type"),
        F.sha2("content", 256).alias("_kept"),
    )
    n_rows = files.scan_csv(spark, target, orders.schema).agg(F.count("*")).scalar()
    return kept.join(sent, "name", "full").groupBy("content_type").agg(
        F.bool_and(F.coalesce(F.col("_kept") == F.col("_sent"), F.lit(False))).alias("bytes_kept")
    ).withColumn("n_rows", n_rows)


@query(
    """
    SELECT page_id, CASE WHEN url LIKE '%.gz' THEN 'application/gzip' WHEN url LIKE '%.csv' THEN 'text/csv'
                         WHEN url LIKE '%.json' THEN 'application/json' ELSE 'application/octet-stream' END
             AS content_type,
           CAST(strlen(html) AS BIGINT) AS n_bytes, sha256(html) AS sha256, strlen(html) = 0 AS is_empty
    FROM pages"""
)
def landing_manifest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    return landing.landing_rows(pages).drop("path", "content")


@query(
    """
    SELECT CAST(page_id AS VARCHAR) AS request_id, 200 AS status, 1 AS attempts, 'GET' AS method,
           split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END
             || 'limit=100' || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END
             AS url
    FROM pages"""
)
def fetch_requests(spark, sf_dir):
    """One request per page address, sent by the fetch job; the transport answers with the request as it reached it."""

    def loopback(method, url, headers, body, timeout):
        return 200, json.dumps({"url": url, "method": method, "sent": body})

    requests = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("request_id"),
        F.lit(1).alias("page"),
        F.lit("get").alias("method"),
        "url",
        F.create_map(F.lit("limit"), F.lit("100")).alias("params"),
    )
    echoed = F.from_json("body", "url string, method string, sent string")
    return fetch.fetch(requests, loopback).select(
        "request_id", "status", "attempts", echoed["method"].alias("method"), echoed["url"].alias("url")
    )


_UNTIL_GAP = """
    c AS (SELECT DISTINCT request_id, page FROM r),
    g AS (SELECT s.request_id, p.page FROM (SELECT DISTINCT request_id FROM r) s,
            (SELECT unnest(generate_series(1, (SELECT max(page) + 1 FROM r))) AS page) p),
    f AS (SELECT g.request_id, min(g.page) AS gap FROM g ANTI JOIN c USING (request_id, page) GROUP BY 1)
"""


def _responses(rows, item):
    """Responses of every request for every page: the items in a list; without any an empty list or, on odd pages, an error."""
    found = rows.groupBy("request_id", "page").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("body"))
    last = rows.agg(F.max("page")).first()[0]
    asked = rows.select("request_id").distinct().select("request_id", F.explode(F.sequence(F.lit(1), F.lit(int(last)))).alias("page"))
    joined = asked.join(found.withColumn("page", F.col("page").cast("int")), ["request_id", "page"], "left")
    failed = F.col("body").isNull() & (F.col("page") % 2 == 1)
    return joined.select(
        "request_id",
        "page",
        F.when(failed, 404).otherwise(200).alias("status"),
        F.when(~failed, F.coalesce("body", F.lit("[]"))).alias("body"),
        F.when(failed, "HTTP 404").alias("error"),
    )


@query(
    f"""
    WITH r AS (SELECT event_id, event_type AS request_id, event_id // 20 + 1 AS page FROM events), {_UNTIL_GAP}
    SELECT event_id, request_id, page FROM r JOIN f USING (request_id) WHERE page < gap"""
)
def paginate_until_empty(spark, sf_dir):
    """Recorded pages of twenty events; each event type is a source that ends at its first empty or failed page."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("request_id"),
        (F.floor(F.col("event_id") / 20) + 1).alias("page"),
    )
    recorded = staging_path(spark, "recorded")
    paging.record_pages(_responses(rows, "event_id"), recorded)
    kept = paging.sequences(paging.read_pages(spark, recorded))
    events = F.explode(F.from_json("body", "array<bigint>")).alias("event_id")
    return kept.select(events, "request_id", F.col("page").cast("bigint").alias("page"))


@query(
    f"""
    WITH r AS (
      SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS request_id, page_id // 8 + 1 AS page
      FROM pages), {_UNTIL_GAP}
    SELECT page_id, request_id, 'https://example.com/' || request_id || '?page=' || page AS url
    FROM r JOIN f USING (request_id) WHERE page < gap"""
)
def paginate_template(spark, sf_dir):
    """Templated addresses per language, as a stream of recorded pages that goes on when more are recorded, up to the
    first page without content."""
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("request_id"),
        (F.floor(F.col("page_id") / 8) + 1).alias("page"),
    )
    recorded, kept_at, state = (staging_path(spark, x) for x in ("recorded", "sequences", "sequences-state"))
    responses = _responses(rows, "page_id")
    for part in (F.col("page") <= 4, F.col("page") > 4):
        paging.record_pages(responses.where(part), recorded, pages_a_wave=4)
        kept = paging.run_sequences(paging.stream_pages(spark, recorded), kept_at, state)
    template = F.concat(F.lit("https://example.com/"), "request_id", F.lit("?page={page}"))
    pages = F.explode(F.from_json("body", "array<bigint>")).alias("page_id")
    return kept.select(pages, "request_id", fetch.page_url(template, F.col("page")).alias("url"))


@query(
    """
    SELECT event_id, event_id AS id, value FROM events WHERE event_type <> 'signup'
    UNION ALL SELECT event_id, -event_id - 1, value FROM events WHERE event_type = 'view'"""
)
def unwrap_payload(spark, sf_dir):
    """Event types differ in their wrapper: a list of two below ``data``, one below
    ``results``, a bare array, an object whose ``data`` is no list, and an empty ``items``."""
    events = table(spark, sf_dir, "events")
    one = F.struct(F.col("event_id").alias("id"), "value")
    two = F.struct((-F.col("event_id") - 1).alias("id"), "value")
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.to_json(F.struct(F.array(one, two).alias("data"))))
        .when(kind == "click", F.to_json(F.struct(F.array(one).alias("results"))))
        .when(kind == "purchase", F.to_json(F.array(one)))
        .when(kind == "signup", F.lit('{"items": []}'))
        .otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), "value", one.alias("data"))))
    )
    records = payload.unwrap_payload(events.select("event_id", body.alias("body")))
    return records.select(
        "event_id",
        F.variant_get("record", "$.id", "bigint").alias("id"),
        F.variant_get("record", "$.value", "double").alias("value"),
    )


_PAGE_FIELDS = {
    "title": "title",
    "first_link": "nav li a",
    "ad": "div.ad",
    "heading": "article h1",
}


def _text_sql(pattern: str) -> str:
    """First match of a pattern in the page, its entities decoded, trimmed."""
    text = f"regexp_extract(html, '{pattern}', 1, 's')"
    for entity, mark in (("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{mark}')"
    return f"trim({text}, ' ' || chr(10))"


_PAGE_SQL = f"""
    {_text_sql('<title>(.*?)</title>')} AS title,
    {_text_sql('<li><a [^>]*>(.*?)</a>')} AS first_link,
    {_text_sql('<div class="ad">(.*?)</div>')} AS ad,
    {_text_sql('<article>.*?<h1>(.*?)</h1>')} AS heading
"""


@query(f"SELECT page_id, 1 AS position, {_PAGE_SQL} FROM pages")
def scrape_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.scrape(pages, _PAGE_FIELDS)


@query(
    """
    WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>(.*?)</a></li>', 1, 's') AS links FROM pages)
    SELECT page_id, CAST(i AS INTEGER) AS position, trim(replace(links[i], '&amp;', '&')) AS link
    FROM l, unnest(generate_series(1, len(links))) AS t(i)"""
)
def scrape_containers(spark, sf_dir):
    """One record per list item of the navigation."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.scrape(pages, {"link": "a"}, container="nav li")


@query(f"SELECT page_id, {_PAGE_SQL} FROM pages")
def ingest_raw(spark, sf_dir):
    """Pages scraped, checked, landed as JSON lines and read back."""
    pages, path = table(spark, sf_dir, "pages").select("page_id", "html"), staging_path(spark, "raw")
    records = html.scrape(pages, _PAGE_FIELDS).drop("position")
    land_records(records, path)
    return files.scan_json(spark, path, records.schema).drop(files.SOURCE_FILE)


_BRONZE_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _bronze_of_lake(spark, entity, source, lake, schema):
    spec = EntitySpec(entity, source=source, fmt="csv", keys=("o_orderkey",), schema=schema)
    run = bronze.run_bronze_from_lake(spark, spec, lake, _bucket(spark, "bronze"), "shop", "20240131")
    return spark.read.parquet(run.path).select(*schema.names)


def _bucket(spark, name):
    """A folder of the shared one, as a bucket with a scheme."""
    path = staging_path(spark, name)
    return path if "://" in path else f"file://{path}"


@query(_BRONZE_ORDERS)
def ingest_csv_to_bronze(spark, sf_dir):
    """Orders in three CSV files, landed as they are and read by the bronze pass."""
    orders = table(spark, sf_dir, "orders")
    drop, lake = _bucket(spark, "csv-drop"), _bucket(spark, "lake")
    for status in ("F", "O", "P"):
        part = orders.where(F.col("o_orderstatus") == status)
        part.write.option("header", True).csv(f"{drop}/orders/orders_{status.lower()}.csv")
    ingest.ingest(spark, "csv", "orders", lake, "shop", "retail", "20240131", folder=drop)
    return _bronze_of_lake(spark, "orders", "csv", lake, orders.schema)


@query(_BRONZE_ORDERS)
def ingest_gzip_to_bronze(spark, sf_dir):
    """Orders as ``.csv.gz`` objects that a source serves chunk by chunk, downloaded by a request each and read by the bronze pass."""
    orders = table(spark, sf_dir, "orders")
    served, lake = _bucket(spark, "served"), _bucket(spark, "lake")
    orders.write.option("header", True).option("compression", "gzip").csv(served)
    objects = files.scan_files(spark, served, "*.csv.gz").select(F.col("path").alias("url"))

    def serve(method, url, headers, body, timeout):
        return 200, landing.chunks_of(url)

    ingest.ingest(spark, "api", "calendar", lake, "shop", "retail", "20240131", transport=serve, objects=objects)
    return _bronze_of_lake(spark, "calendar", "api", lake, orders.schema)


@query("SELECT * FROM customer")
def sink_json_roundtrip(spark, sf_dir):
    customer, path = table(spark, sf_dir, "customer"), staging_path(spark, "customer-json")
    sinks.write_raw_json(customer, path)
    return spark.read.schema(customer.schema).json(path)


@query(
    """
    SELECT c_acctbal AS balance, c_custkey AS key, c_mktsegment AS segment, c_name AS title FROM customer
    UNION ALL SELECT s_acctbal, s_suppkey, NULL, s_name FROM supplier"""
)
def union_sorted_fields(spark, sf_dir):
    """Two record shapes under the sorted union of their fields, through a raw CSV."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("title"),
        F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance")
    )
    both, path = sinks.union_sorted_fields(customer, supplier), staging_path(spark, "union-csv")
    sinks.write_raw_csv(both, path)
    return spark.read.schema(both.schema).option("header", True).csv(path)


@query(
    """
    SELECT 'lake/api/' || event_type || '/shop_api_' || event_type || '_' || strftime(ts, '%Y%m%d') || '.json'
             AS object_key, count(*) AS n_records
    FROM events GROUP BY 1"""
)
def raw_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    key = raw_key_column("lake", "shop", F.lit("api"), F.col("event_type"), F.col("ts"), "json")
    return events.groupBy(key.alias("object_key")).agg(F.count("*").alias("n_records"))
