"""REST fetches as a distributed job, and page sequences that end at their first gap."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierflow.sources.landing import Opener, open_object, store
from tierflow.sources.payload import count_records
from tierflow.specs import EndpointSpec
from tierflow.workspace import runs_on_executors, staging_path

runs_on_executors(__name__)

# Statuses worth another try, and methods that may be sent.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})
METHODS = ("GET", "POST")
MOST_TASKS = 10_000

RESPONSE_SCHEMA = "request_id string, page int, status int, body {body}, attempts int, error string"
# Transport: (method, url, headers, JSON body or None, timeout in seconds) -> (status, body),
# the body as text or, for downloads, as bytes or an iterable of chunks, which are written one by one.
Transport = Callable[[str, str, Mapping[str, str], "str | None", float], "tuple[int, str | bytes | Iterable[bytes]]"]


@dataclass(frozen=True)
class RetryPolicy:
    """``retries`` after the first attempt, with delays of ``backoff``, twice that, and so on;
    ``pause`` between two requests of one task."""

    retries: int = 3
    backoff: float = 1.0
    timeout: float = 30.0
    pause: float = 0.0


def join_url(base: str | None, endpoint: str) -> str:
    return f"{base.rstrip('/')}/{endpoint.lstrip('/')}" if base else endpoint


def with_query(url: Column, params: Column) -> Column:
    """Parameters (a map) in the order of their names behind the URL's own query and ahead of its fragment."""
    # What form encoding and URL quoting write differently.
    quoted = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))))
    added = F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit("="), quoted(p["value"]))), "&")
    ahead = F.substring_index(url, "#", 1)
    path, fragment = F.substring_index(ahead, "?", 1), F.substr(url, F.length(ahead) + 1)
    own = F.substr(ahead, F.length(path) + 2)
    query = F.concat_ws("&", F.nullif(own, F.lit("")), added)
    return F.when(added == "", url).otherwise(F.concat(path, F.lit("?"), query, fragment))


def addressed(requests: DataFrame) -> DataFrame:
    """``requests`` (method, url, params) as they are sent: the parameters of a GET are part of its ``url``."""
    method = F.upper(F.coalesce("method", F.lit("GET")))
    params = F.col("params").cast("map<string,string>")
    url = F.when(method == "POST", F.col("url")).otherwise(with_query(F.col("url"), params))
    return requests.withColumns({"method": method, "url": url, "params": params})


def page_url(template: Column, page: Column) -> Column:
    """A URL template with its ``{page}`` mark filled in."""
    return F.replace(template, F.lit("{page}"), page.cast("string"))


def endpoint_requests(
    spark: SparkSession, endpoints: list[EndpointSpec], base_url: str | None = None
) -> DataFrame:
    """One request per declared endpoint."""
    rows = [
        (e.name, "GET", join_url(base_url, e.path) if base_url else e.default_url, dict(e.params), e.file)
        for e in endpoints
    ]
    return spark.createDataFrame(
        rows,
        "request_id string, method string, url string, params map<string,string>, is_file boolean",
    )


def _send(row: Mapping, transport: Transport, headers: Mapping[str, str], policy: RetryPolicy) -> tuple:
    method, url, payload = row["method"], row["url"], None
    if method not in METHODS:
        return None, None, 0, f"unsupported method: {method}"
    if method == "POST":
        payload = json.dumps(dict(row["params"] or ()), ensure_ascii=False, sort_keys=True)
    status, text, error, attempt = None, None, None, 0
    for attempt in range(1, policy.retries + 2):
        try:
            status, text = transport(method, url, headers, payload, policy.timeout)
            error = None
        except Exception as failure:  # a dead connection is a row with an error, not a dead job
            status, text, error = None, None, f"{type(failure).__name__}: {failure}"
        if error is None and status not in RETRY_STATUSES:
            break
        if attempt <= policy.retries and policy.backoff:
            time.sleep(policy.backoff * 2 ** (attempt - 1))
    if error is None and not 200 <= status < 300:
        error = f"HTTP {status}"
    return status, text, attempt, error


def _one_row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of one row, so that one body is held at a time."""
    return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, schema.types)], schema=schema)


def fetch(
    requests: DataFrame,
    transport: Transport,
    api_key: str | None = None,
    policy: RetryPolicy = RetryPolicy(),
    parallelism: int | None = None,
    headers: Mapping[str, str] | None = None,
    as_bytes: bool = False,
) -> DataFrame:
    """Responses for ``requests`` (request_id, page, method, url, params), with a text body or
    a binary one.

    Requests are spread over the executors; each task sends its own one by one, so
    ``parallelism`` and the policy's pause bound the request rate. Failures become
    rows with an ``error``. The result re-sends when it is recomputed, so land it
    before using it twice (see :func:`fetch_pages`).
    """
    all_headers = dict(headers or {})
    if api_key:
        all_headers["Authorization"] = f"Bearer {api_key}"

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary() if as_bytes else pa.string(), pa.int32(), pa.string()]
    schema = pa.schema(list(zip(("request_id", "page", "status", "body", "attempts", "error"), kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_before = False
        for batch in batches:
            for row in batch.to_pylist():
                if sent_before and policy.pause:
                    time.sleep(policy.pause)
                yield _one_row((row["request_id"], row["page"], *_send(row, transport, all_headers, policy)), schema)
                sent_before = True

    shaped = addressed(requests).select(F.col("request_id").cast("string"), F.col("page").cast("int"), "method", "url", "params")
    # A fixed number: requests are few bytes, and adaptive execution would join them in one task.
    tasks = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    shaped = shaped.repartition(tasks, "request_id", "page")
    return shaped.mapInArrow(run, RESPONSE_SCHEMA.format(body="binary" if as_bytes else "string"))


DOWNLOADS = "request_id string, url string, target string, status int, n_bytes long, sha256 string, error string"


def download(
    requests: DataFrame,
    transport: Transport,
    api_key: str | None = None,
    policy: RetryPolicy = RetryPolicy(),
    headers: Mapping[str, str] | None = None,
    opener: Opener = open_object,
) -> DataFrame:
    """Bodies of ``requests`` written to their ``target`` by the task that requests them; a row with size and
    checksum, or an error, for each. Write the rows at once: computing them again sends again."""
    all_headers = dict(headers or {})
    if api_key:
        all_headers["Authorization"] = f"Bearer {api_key}"

    schema = pa.schema(
        [(c, pa.string()) for c in ("request_id", "url", "target")]
        + [("status", pa.int32()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                status, body, _, error = _send(row, transport, all_headers, policy)
                chunks = (body,) if isinstance(body, bytes) else body
                size, digest = (None, None) if error else store(chunks, row["target"], opener)
                yield _one_row((row["request_id"], row["url"], row["target"], status, size, digest, error), schema)

    # Each object is a task's own, up to a bound.
    shaped = addressed(requests).select("request_id", "method", "url", "params", "target")
    tasks = max(1, min(requests.count(), MOST_TASKS))
    return shaped.repartition(tasks, "request_id").mapInArrow(run, DOWNLOADS)


def first_gaps(pages: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """First page per key that is empty or failed; ``pages`` has ``page, n_items, error``."""
    gap = (F.col("n_items") == 0) | F.col("error").isNotNull()
    return pages.where(gap).groupBy(*keys).agg(F.min("page").alias("gap"))


def first_missing(pages: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """First page per key, counted from 1, that ``pages`` has no row for."""
    held = pages.select(*keys, F.col("page").cast("long").alias("page")).distinct()
    due = held.withColumn("page", F.col("page") + 1).unionByName(
        held.select(*keys).distinct().withColumn("page", F.lit(1).cast("long"))
    )
    return due.join(held, [*keys, "page"], "left_anti").groupBy(*keys).agg(F.min("page").alias("gap"))


def until_gap(rows: DataFrame, gaps: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """``rows`` on pages before their key's gap; all rows of keys without a gap."""
    kept = rows.join(gaps, list(keys), "left")
    return kept.where(F.col("gap").isNull() | (F.col("page") < F.col("gap"))).drop("gap")


def fetch_pages(
    requests: DataFrame,
    transport: Transport,
    page_param: str = "page",
    max_pages: int | None = None,
    first_wave: int = 8,
    count_items: Callable[[DataFrame], DataFrame] | None = None,
    policy: RetryPolicy = RetryPolicy(pause=0.5),
    **fetch_options,
) -> tuple[DataFrame, DataFrame]:
    """Pages 1, 2, … of every request up to its first empty or failed page.

    Pages are requested in waves of doubling width, all requests at once, so one
    long source spreads over the cluster. Each wave is landed as it arrives and
    only requests without a gap so far enter the next. A URL containing
    ``{page}`` gets the number there, others as a parameter. ``count_items`` adds
    ``n_items`` to landed responses; by default it counts JSON records. Returns the
    kept responses and the failed ones.
    """
    counted = count_items or (lambda df: df.withColumn("n_items", count_records(F.col("body"))))
    spark = requests.sparkSession
    base = staging_path(spark, "responses")
    waves: list[DataFrame] = []
    active, start, width, wave = requests, 1, first_wave, 0
    while max_pages is None or start <= max_pages:
        stop = start + width - 1 if max_pages is None else min(start + width - 1, max_pages)
        numbered = active.withColumn("page", F.explode(F.sequence(F.lit(start), F.lit(stop))))
        templated = F.contains("url", F.lit("{page}"))
        numbered = numbered.select(
            "request_id",
            "page",
            "method",
            page_url(F.col("url"), F.col("page")).alias("url"),
            F.when(templated, F.col("params"))
            .otherwise(
                F.map_concat(
                    F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, _: k != page_param),
                    F.create_map(F.lit(page_param), F.col("page").cast("string")),
                )
            )
            .alias("params"),
        )
        path = f"{base}/wave-{wave}"
        fetch(numbered, transport, policy=policy, **fetch_options).write.parquet(path)
        landed = counted(spark.read.parquet(path))
        waves.append(landed)
        active = active.join(first_gaps(landed), "request_id", "left_anti")
        if active.isEmpty():
            break
        start, width, wave = stop + 1, width * 2, wave + 1
    responses = reduce(DataFrame.unionByName, waves)
    return until_gap(responses, first_gaps(responses)), responses.where(F.col("error").isNotNull())
