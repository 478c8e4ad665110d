"""Declarations of entities. No I/O happens here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class EntitySpec:
    """What the bronze pass does to one entity.

    Rules naming a column the input lacks are skipped, except ``required``
    columns. ``order`` decides which of several rows with one key survives:
    the first, in the given order, where ``-column`` sorts descending with nulls
    last. ``multi_line`` declares the layout: true for CSV with line breaks in quotes and for JSON documents
    over several lines, false for one record a line, which lets Spark split large files. By
    default CSV is taken as the latter, and each JSON file is looked at as a whole. ``row_tag`` names the element of
    an XML record.
    """

    name: str
    source: str = "api"
    fmt: str = "json"
    keys: tuple[str, ...] = ("id",)
    casts: Mapping[str, T.DataType] = field(default_factory=dict)
    trims: tuple[str, ...] = ()
    boxes: tuple[Mapping[str, tuple[float, float]], ...] = ()
    positives: tuple[str, ...] = ()
    explode_path: str | None = None
    order: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    profile: tuple[str, ...] = ()
    schema: T.StructType | None = None
    multi_line: bool | None = None
    row_tag: str | None = None


@dataclass(frozen=True)
class ScrapeSpec:
    """Fields of an HTML entity as CSS selectors, one record per container."""

    name: str
    fields: Mapping[str, str]
    container: str | None
    path: str
    default_url: str


@dataclass(frozen=True)
class EndpointSpec:
    """How an API entity is requested. ``file`` entities are landed as bytes."""

    name: str
    path: str
    default_url: str
    params: Mapping[str, str] = field(default_factory=dict)
    file: bool = False


# Columns, bounds, selectors and endpoints of the supported entities.
NYC = EntitySpec(
    name="nyc",
    source="csv",
    fmt="csv",
    casts={
        "id": T.LongType(),
        "latitude": T.DoubleType(),
        "longitude": T.DoubleType(),
        "price": T.DecimalType(10, 2),
        "minimum_nights": T.IntegerType(),
        "number_of_reviews": T.IntegerType(),
        "calculated_host_listings_count": T.IntegerType(),
        "availability_365": T.IntegerType(),
        "host_id": T.LongType(),
    },
    trims=("name", "host_name", "neighbourhood_group", "neighbourhood", "room_type"),
    boxes=({"latitude": (40.4, 41.0), "longitude": (-74.3, -73.7)},),
    positives=("price",),
    required=("price", "minimum_nights", "number_of_reviews", "availability_365"),
    profile=("price", "minimum_nights", "number_of_reviews", "availability_365"),
)

LISTINGS = EntitySpec(
    name="listings",
    casts={"id": T.IntegerType(), "price": T.DecimalType(10, 2)},
    trims=("title",),
    explode_path="products",
)

ENTITIES = {
    "nyc": NYC,
    "listings": LISTINGS,
    "posts": EntitySpec(name="posts"),
    "neighborhoods": EntitySpec(name="neighborhoods", source="scraping"),
    "productos": EntitySpec(name="productos", source="csv", fmt="csv"),
    "reviews": EntitySpec(name="reviews", fmt="csv"),
    "calendar": EntitySpec(name="calendar", fmt="csv"),
}

# Fixed values.
SCRAPES = {
    "listings": ScrapeSpec(
        name="listings",
        fields={
            "title": "h2.listing-title",
            "price": "span.price",
            "location": "div.location",
            "rating": "span.rating",
        },
        container="div.listing-card",
        path="/listings",
        default_url="https://example.com/listings",
    ),
    "reviews": ScrapeSpec(
        name="reviews",
        fields={
            "author": "span.author-name",
            "rating": "span.rating",
            "comment": "p.review-text",
            "date": "time.review-date",
        },
        container="div.review-card",
        path="/reviews",
        default_url="https://example.com/reviews",
    ),
    "neighborhoods": ScrapeSpec(
        name="neighborhoods",
        fields={
            "barrio": "td:nth-of-type(1) a",
            "superficie": "td:nth-of-type(2)",
            "habitantes": "td:nth-of-type(3)",
            "densidad": "td:nth-of-type(4)",
        },
        container="table.wikitable tbody tr",
        path="/wiki/Anexo:Barrios_de_la_ciudad_de_Buenos_Aires",
        default_url="https://es.wikipedia.org/wiki/Anexo:Barrios_de_la_ciudad_de_Buenos_Aires",
    ),
}

# Fixed values.
ENDPOINTS = {
    "listings": EndpointSpec(
        "listings", "/products", "https://dummyjson.com/products", {"limit": "100"}
    ),
    "reviews_json": EndpointSpec(
        "reviews_json", "/reviews", "https://api.example.com/v1/reviews", {"limit": "100"}
    ),
    "reviews": EndpointSpec("reviews", "/reviews.csv.gz", "/reviews.csv.gz", file=True),
    "calendar": EndpointSpec("calendar", "/calendar.csv.gz", "/calendar.csv.gz", file=True),
}


def entity_spec(name: str, source: str = "api") -> EntitySpec:
    """The declared spec, or the generic one for other entities."""
    known = ENTITIES.get(name)
    if known is not None and known.source == source:
        return known
    return EntitySpec(name=name, source=source, fmt="csv" if source == "csv" else "json")


def scrape_spec(name: str) -> ScrapeSpec:
    if name not in SCRAPES:
        raise ValueError(f"no selectors for entity: {name}")
    return SCRAPES[name]


def endpoint_spec(name: str) -> EndpointSpec:
    """The declared endpoint, or ``/{name}`` for other entities."""
    return ENDPOINTS.get(name, EndpointSpec(name, f"/{name}", f"/{name}"))
