from __future__ import annotations

import hashlib
import json
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from tierflow.operators.sinks import EmptyInput, TargetExists
from tierflow.plans import ingest
from tierflow.plans.bronze import run_bronze, run_bronze_from_lake
from tierflow.sources import fetch
from tierflow.specs import ENDPOINTS, SCRAPES, EntitySpec, endpoint_spec

QUICK = fetch.RetryPolicy(retries=3, backoff=0.0, pause=0.0)
REQUEST = "request_id string, page int, method string, url string, params map<string,string>"


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST)


def test_urls():
    assert fetch.join_url("http://h/api/", "/items") == "http://h/api/items"
    assert fetch.join_url(None, "http://h/items") == "http://h/items"


def test_addresses_are_what_urllib_makes(spark):
    from urllib.parse import urlencode

    params = {"limit": "100", "a b": "é&=~*-_./?#+", "": ""}
    query = urlencode(sorted(params.items()))
    urls = {"http://h/x?a=1#f": f"http://h/x?a=1&{query}#f", "http://h/x": f"http://h/x?{query}", "http://h/x?#a?b#c": f"http://h/x?{query}#a?b#c"}
    rows = [(u, 1, "get", u, params) for u in urls] + [("none", 1, "GET", "http://h/x?#f", {}), ("post", 1, "post", "http://h/x", params)]
    got = {r["request_id"]: r["url"] for r in fetch.addressed(requests(spark, *rows)).collect()}
    assert got == {**urls, "none": "http://h/x?#f", "post": "http://h/x"}


def test_get_post_and_headers(spark):
    def echo(method, url, headers, body, timeout):
        return 200, json.dumps([method, url, headers.get("Authorization"), body, timeout])

    df = requests(
        spark,
        ("g", 1, "get", "http://h/a", {"q": "x y", "b": "1"}),
        ("p", 1, "POST", "http://h/b", {"q": "é"}),
        ("d", 1, "DELETE", "http://h/c", {}),
        ("n", 1, "GET", "http://h/d", None),
    )
    got = {r["request_id"]: r for r in fetch.fetch(df, echo, "key", QUICK).collect()}
    assert json.loads(got["g"]["body"]) == ["GET", "http://h/a?b=1&q=x+y", "Bearer key", None, 30.0]
    assert json.loads(got["p"]["body"]) == ["POST", "http://h/b", "Bearer key", '{"q": "é"}', 30.0]
    assert json.loads(got["n"]["body"])[1] == "http://h/d"
    assert got["d"]["error"] == "unsupported method: DELETE" and got["d"]["attempts"] == 0


def test_retries(spark):
    def flaky(method, url, headers, body, timeout):
        seen = flaky.__dict__.setdefault("seen", {})
        seen[url] = seen.get(url, 0) + 1
        if url.endswith("once"):
            return (503, "") if seen[url] == 1 else (200, "[]")
        if url.endswith("dead"):
            raise ConnectionError("gone")
        return int(url.rsplit("/", 1)[1]), "no"

    df = requests(
        spark,
        ("once", 1, "GET", "http://h/once", {}),
        ("dead", 1, "GET", "http://h/dead", {}),
        ("404", 1, "GET", "http://h/404", {}),
        ("500", 1, "GET", "http://h/500", {}),
    )
    got = {r["request_id"]: (r["status"], r["attempts"], r["error"]) for r in fetch.fetch(df, flaky, policy=QUICK).collect()}
    assert got == {
        "once": (200, 2, None),
        "dead": (None, 4, "ConnectionError: gone"),
        "404": (404, 1, "HTTP 404"),
        "500": (500, 4, "HTTP 500"),
    }


def paged(method, url, headers, body, timeout):
    """Source ``s<n>`` has n pages; ``e`` fails on page 2; ``t`` takes its page from the path."""
    page = int(url.rsplit("=", 1)[1] if "=" in url else url.rsplit("/", 1)[1])
    name = url.split("//h/")[1].split("?")[0].split("/")[0]
    if name == "e" and page == 2:
        return 404, ""
    last = 3 if name in ("e", "t") else int(name[1:])
    return 200, json.dumps({"data": [{"page": page}] * 2 if page <= last else []})


def test_pages_until_gap(spark):
    df = requests(
        spark,
        ("s0", 1, "GET", "http://h/s0", {}),
        ("s2", 1, "GET", "http://h/s2", {"page": "9"}),
        ("s21", 1, "GET", "http://h/s21", {}),
        ("e", 1, "GET", "http://h/e", {}),
        ("t", 1, "GET", "http://h/t/{page}", {}),
        ("s1", 1, "GET", "http://h/s1", None),
    ).drop("page")
    kept, failed = fetch.fetch_pages(df, paged, first_wave=2, policy=QUICK)
    per_source = {r["request_id"]: r["n"] for r in kept.groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert per_source == {"s1": 1, "s2": 2, "s21": 21, "e": 1, "t": 3}
    assert [(r["request_id"], r["page"], r["error"]) for r in failed.collect()] == [("e", 2, "HTTP 404")]


def test_max_pages(spark):
    df = requests(spark, ("s9", 1, "GET", "http://h/s9", {})).drop("page")
    kept, _ = fetch.fetch_pages(df, paged, max_pages=4, first_wave=3, policy=QUICK)
    assert sorted(r["page"] for r in kept.collect()) == [1, 2, 3, 4]


def test_first_missing(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 2)], "request_id string, page int")
    assert {tuple(r) for r in fetch.first_missing(pages).collect()} == {("a", 3), ("b", 1)}


def test_endpoint_requests(spark):
    df = fetch.endpoint_requests(spark, [ENDPOINTS["listings"], endpoint_spec("posts")], "http://h/")
    assert {(r["request_id"], r["url"], str(r["params"])) for r in df.collect()} == {
        ("listings", "http://h/products", "{'limit': '100'}"), ("posts", "http://h/posts", "{}")
    }


def landing_options(tmp_path, **more):
    return dict(bucket=f"file://{tmp_path}", prefix="p", domain="dom", date="20240131", base_url="http://h", policy=QUICK, **more)


def test_land_api_entity(spark, tmp_path):
    def serve(method, url, headers, body, timeout):
        return 200, '{"products": [{"id": 1}, {"id": 2}]}' if "products" in url else '{"data": [{"id": 1, "x": "é"}, {"id": 2}]}'

    target = ingest.land_api_entity(spark, "posts", serve, **landing_options(tmp_path))
    assert target.endswith("p/api/posts/dom_api_posts_20240131.json")
    assert sorted((r["id"], r["x"]) for r in spark.read.json(target).collect()) == [(1, "é"), (2, None)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        ingest.land_api_entity(spark, "posts", serve, **landing_options(tmp_path))
    ingest.land_api_entity(spark, "posts", serve, **landing_options(tmp_path, allow_overwrite=True))
    run = run_bronze(spark, EntitySpec("posts"), target, str(tmp_path / "bronze"), "20240131")
    assert run.rows == 2
    # The wrapper of listings is kept: one record holding the products.
    wrapped = spark.read.json(ingest.land_api_entity(spark, "listings", serve, **landing_options(tmp_path)))
    assert wrapped.count() == 1 and wrapped.columns == ["products"]


@pytest.mark.parametrize("answer, error", [((500, ""), "HTTP 500"), ((200, "{"), "no JSON"), ((200, "[]"), "not_empty")])
def test_land_api_entity_fails(spark, tmp_path, answer, error):
    with pytest.raises(Exception, match=error):
        ingest.land_api_entity(spark, "posts", lambda *_: answer, **landing_options(tmp_path))


def test_land_scraped_entity(spark, tmp_path):
    page = '<div class="review-card"><span class="rating">5</span></div><div class="review-card"></div>'
    target = ingest.land_scraped_entity(spark, "reviews", lambda *_: (200, page), **landing_options(tmp_path))
    assert [r.asDict() for r in spark.read.json(target).collect()] == [{"rating": "5"}]
    csv = ingest.land_scraped_entity(spark, "reviews", lambda *_: (200, page), **landing_options(tmp_path, fmt="csv"))
    assert spark.read.option("header", True).csv(csv).columns == ["author", "comment", "date", "rating"]


def test_headers_and_pause(spark):
    def echo(method, url, headers, body, timeout):
        return 200, json.dumps([headers, time.monotonic()])

    df = requests(spark, *((str(i), 1, "GET", "http://h", {}) for i in range(3)))
    policy = fetch.RetryPolicy(pause=0.05)
    got = [json.loads(r["body"]) for r in fetch.fetch(df, echo, "k", policy, 1, headers={"X": "y"}).collect()]
    assert got[0][0] == {"X": "y", "Authorization": "Bearer k"}
    assert got[2][1] - got[0][1] >= 0.1


def test_ingest_routes_by_source(spark, tmp_path):
    data = b"\x1f\x8b bytes"
    options = landing_options(tmp_path)
    target = ingest.ingest(spark, "api", "reviews", transport=lambda *_: (200, data), **options)
    assert target.endswith("p/api/reviews/dom_api_reviews_20240131.csv.gz")
    assert open(target.removeprefix("file://"), "rb").read() == data
    row = spark.read.parquet(ingest.manifest_path(target)).first()
    assert (row["n_bytes"], row["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(TargetExists):
        ingest.ingest(spark, "api", "reviews", transport=lambda *_: (200, data), **options)
    with pytest.raises(EmptyInput):
        ingest.ingest(spark, "api", "calendar", transport=lambda *_: (200, b""), **options)
    with pytest.raises(RuntimeError, match="HTTP 404"):
        ingest.ingest(spark, "api", "calendar", transport=lambda *_: (404, b""), **options)
    posts = ingest.ingest(spark, "api", "posts", transport=lambda *_: (200, '[{"id": 1}]'), **options)
    assert spark.read.json(posts).count() == 1
    folder = tmp_path / "data" / "items"
    folder.mkdir(parents=True)
    (folder / "b.csv").write_text("id\n2\n")
    (folder / "a.csv").write_text("id\n1\n")
    options.pop("policy")
    landed = ingest.ingest(spark, "csv", "items", folder=str(tmp_path / "data"), **options)
    assert {p.name: p.read_bytes() for p in pathlib.Path(landed.removeprefix("file://")).iterdir()} == {"a.csv": b"id\n1\n", "b.csv": b"id\n2\n"}
    run = run_bronze_from_lake(spark, EntitySpec("items", source="csv", fmt="csv"), options["bucket"], f"file://{tmp_path}/out", "p", "20240131")
    assert run.rows == 2
    options.pop("base_url")
    first, left_out = ingest.land_csv_folder(spark, "items", str(folder), **options, first_only=True, allow_overwrite=True)
    assert open(first.removeprefix("file://"), "rb").read() == b"id\n1\n" and [p.rsplit("/", 1)[-1] for p in left_out] == ["b.csv"]
    options["base_url"] = "http://h"
    with pytest.raises(ValueError, match="ftp"):
        ingest.ingest(spark, "ftp", "x", **options)


def test_scrape_pages(spark):
    def serve(method, url, headers, body, timeout):
        page = int(url.rsplit("/", 1)[1])
        card = '<div class="review-card"><span class="rating">{}</span></div>'
        return 200, card.format(page) * 2 if page != 4 else "<p>nothing</p>"

    df = requests(spark, ("r", 1, "GET", "http://h/{page}", {})).drop("page")
    got = ingest.scrape_pages(df, SCRAPES["reviews"], serve, max_pages=9, policy=QUICK)
    assert sorted((r["page"], r["rating"]) for r in got.collect()) == [(p, str(p)) for p in (1, 2, 3) for _ in (1, 2)]


def test_land_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "calendar.csv.gz").write_bytes(b"\x1f\x8b rest")
    target = ingest.land_files(spark, str(tmp_path / "in"), str(tmp_path / "out" / "c.csv.gz"), "*.gz")
    assert open(target, "rb").read() == b"\x1f\x8b rest"
    (tmp_path / "in" / "reviews.csv.gz").write_bytes(b"")
    with pytest.raises(EmptyInput, match="reviews"):
        ingest.land_files(spark, str(tmp_path / "in"), str(tmp_path / "more"), "*.gz")


def test_the_query_of_requests_sends_them(spark):
    from tierflow.catalog import QUERIES

    got = QUERIES["fetch_requests"](spark, "/root/testdata/sf0.001").select("status", "attempts", "method").distinct().collect()
    assert [tuple(r) for r in got] == [(200, 1, "GET")]
