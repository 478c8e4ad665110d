"""Sources to the raw tier: extract, validate, land."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow.functions.names import bucket_path, raw_key
from tierflow.operators.quality import validate_records
from tierflow.operators.sinks import EmptyInput, make_way, write_raw_csv, write_raw_json
from tierflow.sources.fetch import RetryPolicy, Transport, download, endpoint_requests, fetch, fetch_pages
from tierflow.sources.files import csv_members, empty_files, scan_files
from tierflow.sources.html import page_links, scrape
from tierflow.sources.landing import Opener, copy_objects, open_object
from tierflow.sources.payload import unparseable, unwrap_payload
from tierflow.specs import ScrapeSpec, endpoint_spec, scrape_spec
from tierflow.workspace import durable, staging_path


class InvalidRecords(ValueError):
    """Extracted records failed validation; nothing was landed."""


def land_records(
    records: DataFrame,
    path: str,
    fmt: str = "json",
    strict: bool = False,
    allow_overwrite: bool = False,
) -> DataFrame:
    """Typed records validated and landed. Returns the checks.

    Records are checked as the JSON they are landed as, with null fields
    present, like the fields of an extracted record. They are computed once: the
    checks and the landing both read the durable copy.
    """
    records = durable(records)
    payload = records.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")
    )
    checks = validate_records(payload, "payload", strict)
    failed = [r["check"] for r in checks.where("not passed").select("check").collect()]
    if failed:
        raise InvalidRecords(f"checks failed: {failed}")
    if fmt == "json":
        write_raw_json(records, path, allow_overwrite)
    elif fmt == "csv":
        write_raw_csv(records, path, allow_overwrite)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return checks


def scraped_records(pages: DataFrame, spec: ScrapeSpec) -> DataFrame:
    return scrape(pages, spec.fields, spec.container)


def land_api_entity(
    spark: SparkSession,
    entity: str,
    transport: Transport,
    bucket: str,
    prefix: str,
    domain: str,
    date: str,
    base_url: str | None = None,
    api_key: str | None = None,
    policy: RetryPolicy = RetryPolicy(),
    allow_overwrite: bool = False,
) -> str:
    """A REST entity requested, unwrapped, validated and landed as JSON lines. Returns its path.

    Responses are stored before they are read, so a lost executor sends nothing
    again; a failed request aborts the job.
    """
    requests = endpoint_requests(spark, [endpoint_spec(entity)], base_url).withColumn("page", F.lit(1))
    path = staging_path(spark, "responses")
    fetch(requests, transport, api_key, policy).write.parquet(path)
    responses = spark.read.parquet(path)
    bad = responses.where(F.col("error").isNotNull()).select("error").unionByName(
        unparseable(responses.where(F.col("error").isNull())).select(F.lit("no JSON").alias("error"))
    )
    first = bad.first()
    if first is not None:
        raise RuntimeError(f"{entity}: {first['error']}")
    payload = unwrap_payload(responses.select("body")).select(F.to_json("record").alias("payload"))
    checks = validate_records(payload, "payload")
    failed = [r["check"] for r in checks.where("not passed").select("check").collect()]
    if failed:
        raise InvalidRecords(f"checks failed: {failed}")
    target = bucket_path(bucket, raw_key(prefix, "api", entity, domain, date, "json"))
    # The records keep their own JSON text: one object per line.
    mode = "overwrite" if allow_overwrite else "errorifexists"
    payload.write.mode(mode).text(target)
    return target


def land_scraped_entity(
    spark: SparkSession,
    entity: str,
    transport: Transport,
    bucket: str,
    prefix: str,
    domain: str,
    date: str,
    base_url: str | None = None,
    fmt: str = "json",
    policy: RetryPolicy = RetryPolicy(),
    allow_overwrite: bool = False,
) -> str:
    """A scraped entity requested, parsed, validated and landed. Returns its path."""
    spec = scrape_spec(entity)
    url = spec.path if base_url else spec.default_url
    requests = spark.createDataFrame(
        [(entity, 1, "GET", url)], "request_id string, page int, method string, url string"
    ).withColumns({"url": page_links(F.col("url"), base_url), "params": F.lit(None).cast("map<string,string>")})
    path = staging_path(spark, "pages")
    fetch(requests, transport, policy=policy).write.parquet(path)
    responses = spark.read.parquet(path)
    failed = responses.where(F.col("error").isNotNull()).first()
    if failed is not None:
        raise RuntimeError(f"{entity}: {failed['error']}")
    records = scraped_records(responses.select(F.col("body").alias("html")), spec).drop("position")
    target = bucket_path(bucket, raw_key(prefix, "scraping", entity, domain, date, fmt))
    land_records(records, target, fmt, allow_overwrite=allow_overwrite)
    return target


def land_download(
    spark: SparkSession,
    entity: str,
    transport: Transport,
    bucket: str,
    prefix: str,
    domain: str,
    date: str,
    base_url: str | None = None,
    api_key: str | None = None,
    headers: Mapping[str, str] | None = None,
    policy: RetryPolicy = RetryPolicy(),
    allow_overwrite: bool = False,
    opener: Opener = open_object,
    objects: DataFrame | None = None,
) -> str:
    """A file entity downloaded and landed as the object it is, by the task that requests it. An entity of several
    ``objects`` (url) is landed as objects below its path. Returns the path; sizes and checksums are in a manifest
    (see :func:`manifest_path`)."""
    spec = endpoint_spec(entity)
    requests = endpoint_requests(spark, [spec], base_url).withColumn("page", F.lit(1))
    name = spec.path.rsplit("/", 1)[-1]
    target = bucket_path(bucket, raw_key(prefix, "api", entity, domain, date, name.split(".", 1)[-1]))
    make_way(spark, target, allow_overwrite)
    targeted = requests.withColumn("target", F.lit(target))
    if objects is not None:
        below = F.concat(F.lit(target + "/"), F.element_at(F.split(F.substring_index("url", "?", 1), "/"), -1))
        params = F.lit(None).cast("map<string,string>").alias("params")
        targeted = objects.select(F.col("url").alias("request_id"), F.lit("GET").alias("method"), "url", params, below.alias("target"))
    landed = durable(download(targeted, transport, api_key, policy, headers, opener))
    failed = landed.where(F.col("error").isNotNull()).first()
    if failed is not None:
        raise RuntimeError(f"{entity}: {failed['error']}")
    if not landed.where("n_bytes = 0").isEmpty():
        make_way(spark, target, True)
        raise EmptyInput(f"refusing to land an empty file: {entity}")
    landed.select(F.col("url").alias("path"), "target", "n_bytes", "sha256").write.mode("overwrite").parquet(manifest_path(target))
    return target


def scrape_pages(
    requests: DataFrame,
    spec: ScrapeSpec,
    transport: Transport,
    max_pages: int,
    policy: RetryPolicy = RetryPolicy(pause=1.0),
    **fetch_options,
) -> DataFrame:
    """Records of numbered pages, up to each request's first page that fails or holds none.
    Request URLs contain ``{page}``."""

    def count_records(responses: DataFrame) -> DataFrame:
        html = responses.select("request_id", "page", F.col("body").alias("html"))
        found = scraped_records(html, spec).groupBy("request_id", "page").agg(F.count("*").alias("n_items"))
        return responses.join(found, ["request_id", "page"], "left").fillna(0, subset=["n_items"])

    kept, _ = fetch_pages(
        requests, transport, max_pages=max_pages, count_items=count_records, policy=policy, **fetch_options
    )
    return scraped_records(kept.select("request_id", "page", F.col("body").alias("html")), spec)


def ingest(
    spark: SparkSession,
    source: str,
    entity: str,
    bucket: str,
    prefix: str,
    domain: str,
    date: str,
    transport: Transport | None = None,
    folder: str | None = None,
    base_url: str | None = None,
    allow_overwrite: bool = False,
    **options,
) -> str:
    """One entity of a source into the raw tier; returns the path. Records are validated,
    files are not. ``folder`` holds a folder of CSV files per entity."""
    place = dict(bucket=bucket, prefix=prefix, domain=domain, date=date, allow_overwrite=allow_overwrite)
    if source == "csv":
        return land_csv_folder(spark, entity, f"{folder.rstrip('/')}/{entity}", **place, **options)[0]
    if source == "scraping":
        return land_scraped_entity(spark, entity, transport, base_url=base_url, **place, **options)
    if source == "api":
        land = land_download if endpoint_spec(entity).file else land_api_entity
        return land(spark, entity, transport, base_url=base_url, **place, **options)
    raise ValueError(f"unknown source: {source}")


def manifest_path(target: str) -> str:
    """Where the manifest of a landed object or folder lies: beside it, out of the raw globs' reach."""
    parent, name = target.rstrip("/").rsplit("/", 1)
    return f"{parent}/_manifests/{name}"


def land_csv_folder(
    spark: SparkSession,
    entity: str,
    folder: str,
    bucket: str,
    prefix: str,
    domain: str,
    date: str,
    first_only: bool = False,
    allow_overwrite: bool = False,
    opener: Opener = open_object,
) -> tuple[str, list[str]]:
    """The CSV files of an entity's folder landed as they are, all of them under the raw key. Returns the
    key's path and the members left out: none, unless ``first_only`` takes the smallest path alone."""
    members = csv_members(spark, folder)
    left_out: list[str] = []
    if first_only:
        first, *left_out = [r["path"] for r in members.orderBy("path").collect()]
        source = first
    else:
        source = f"{folder.rstrip('/')}/*.csv"
    if members.isEmpty():
        raise FileNotFoundError(f"no CSV files below {folder}")
    target = bucket_path(bucket, raw_key(prefix, "csv", entity, domain, date, "csv"))
    return land_files(spark, source, target, allow_overwrite=allow_overwrite, opener=opener), left_out


def land_files(
    spark: SparkSession,
    source_path: str,
    target: str,
    name_glob: str | None = None,
    allow_overwrite: bool = False,
    opener: Opener = open_object,
) -> str:
    """Files of a drop folder landed byte for byte, without parsing or validation: one file as the object
    ``target``, several as objects below it. An empty file is an error. Contents are copied by
    one task for each file; sizes and checksums are in a manifest."""
    found = scan_files(spark, source_path, name_glob).select("path", "length")
    files = durable(found)
    empty = [r["path"] for r in files.where("length = 0").select("path").collect()] + empty_files(spark, source_path, name_glob or "*")
    if empty:
        raise EmptyInput(f"refusing to land empty files: {sorted(set(empty))}")
    n = files.count()
    if n == 0:
        raise EmptyInput(f"nothing to land at {source_path}")
    make_way(spark, target, allow_overwrite)
    # A member may be a folder of parts; its name goes before the part's.
    names = F.array_join(F.slice(F.split("path", "/"), -2, 2), "-")
    last = F.element_at(F.split("path", "/"), -1)
    own = F.when(F.element_at(F.split("path", "/"), -2).endswith(".csv"), names).otherwise(last)
    place = F.lit(target) if n == 1 else F.concat(F.lit(target.rstrip("/") + "/"), own)
    path = F.when(F.col("path").startswith("file:/"), F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).otherwise(F.col("path"))
    copied = copy_objects(files.select(path.alias("path"), place.alias("target")), opener)
    copied.write.mode("overwrite").parquet(manifest_path(target))
    return target
