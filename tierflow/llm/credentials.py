"""Secrets in texts, and weak candidates that become secrets beside their complementary parts.

Kinds that stand by themselves: ``assign`` (a name such as password or token, then a value of
at least 12 characters), ``access`` (an access identifier) and ``hex`` (at least 16 hexadecimal digits).
Weak kinds, reported only where parts that belong to them lie in the same scope, that is within
``scope`` code points: ``key`` (a run of 40 letters of base 64 and its padding, also right
after ``=``, with an access identifier or an endpoint), ``short`` (an assignment of
6 to 11 characters, with an access identifier or an endpoint), ``endpoint`` (a URL, with a
secret: ``assign``, ``hex`` or ``key``, or an access identifier).

Matches are found leftmost and without overlap for each kind. Positions follow from the
lengths of the matches and of what lies between them. All parts of a text are sorted by their start;
a part's nearest neighbours of each class, from running maxima of ends before it and minima of starts
after it, are the interval join: linear in the parts, whatever lies in a scope.
DataFrame operations alone do all of this; texts stay where they are, only parts are shuffled.

Null texts count as empty and have no spans; repeated rows each give a row; an empty table gives none.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of the kinds that stand by themselves; group 2 of an assignment is its value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns of weak kinds.
KEY = r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}={0,2}(?![A-Za-z0-9/+=])"
ENDPOINT = r"(?i)(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
#: All kinds, in the order of spans that begin together.
KINDS = ("assign", "access", "hex", "key", "endpoint", "short")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
SCOPE = 200
MARK = "[SECRET]"


def _matches(text: str, pattern: str, kind: str, candidate: Column) -> Column:
    """Array of a text's matches: kind, number, characters since the one before, length, length of group 2."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("gap"), value.alias("value")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"),
            F.length(x["found"]).alias("length"), F.length(x["value"]).alias("value_length"),
        ),
    )
    return F.when(candidate, rows)


def _parts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each match, and one without a kind for each text that has none."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumns({"text_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    # A plain search for a fixed string tells most texts apart from those that a pattern must look at.
    lower = F.lower("text")
    named = lower.contains(NAMES[0])
    for name in NAMES[1:]:
        named = named | lower.contains(name)
    kinds = [
        _matches("text", ASSIGN, "assign", named),
        _matches("text", ACCESS, "access", F.col("text").contains("AKIA")),
        _matches("text", HEX, "hex", F.lit(True)),
        _matches("text", KEY, "key", F.lit(True)),
        _matches("text", ENDPOINT, "endpoint", F.col("text").contains("://")),
    ]
    listed = rows.select("doc_id", "text_hash", "_row", F.flatten(F.array_compact(F.array(*kinds))).alias("part"))
    exploded = listed.repartition("doc_id", "text_hash", "_row").select("doc_id", "text_hash", "_row", F.explode_outer("part").alias("part"))
    by_kind = Window.partitionBy("doc_id", "text_hash", "_row", "part.kind").orderBy("part.nth")
    end = F.sum(F.col("part.gap") + F.col("part.length")).over(by_kind.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = F.col("part.value_length")
    kind = F.when(F.col("part.kind") != "assign", F.col("part.kind")).when(value >= 12, "assign").when(value >= 6, "short")
    placed = exploded.withColumns({"end": end, "kind": kind}).withColumn("start", F.col("end") - F.col("part.length"))
    return placed.drop("part")


def find_spans(docs: DataFrame, id_column="doc_id", text_column="text", scope=SCOPE) -> DataFrame:
    """Rows (doc_id, text_hash, spans), one for each row of ``docs``; spans are structs (start, rank, end,
    kind), sorted."""
    parts = _parts(docs, id_column, text_column)
    key = ["doc_id", "text_hash", "_row"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)

    def near(*kinds):
        """Whether a part of one of ``kinds`` lies within the scope."""
        ours = F.col("kind").isin(*kinds)
        last_end = F.max(F.when(ours, F.col("end"))).over(before)
        next_start = F.min(F.when(ours, F.col("start"))).over(after)
        behind = F.coalesce(last_end >= F.col("start") - scope, F.lit(False))
        return behind | F.coalesce(next_start <= F.col("end") + scope, F.lit(False))

    joined = parts.withColumns(
        {"by_access": near("access"), "by_secret": near("assign", "hex", "key"), "by_endpoint": near("endpoint")}
    )
    strong = F.col("kind").isin("assign", "access", "hex")
    key_found = (F.col("kind") == "key") & (F.col("by_access") | F.col("by_endpoint"))
    short_found = (F.col("kind") == "short") & (F.col("by_access") | F.col("by_endpoint"))
    endpoint_found = (F.col("kind") == "endpoint") & (F.col("by_access") | F.col("by_secret"))
    kept = strong | key_found | short_found | endpoint_found
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(kept, F.struct(F.col("start").cast("bigint").alias("start"), rank.alias("rank"), F.col("end").cast("bigint").alias("end"), "kind"))
    # collect_list passes over nulls, so that a text without spans has an empty list.
    return joined.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def written(spans: str | Column, *kinds: str) -> Column:
    """Spans as text, kind:start:end separated by commas; of ``kinds`` alone, if there are any."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _suspicious(text: Column) -> Column:
    """Whether any pattern could match: a cheap test that spares most texts the join."""
    found = text.rlike(HEX) | text.contains("AKIA") | text.contains("://")
    for name in NAMES:
        found = found | F.lower(text).contains(name)
    return F.coalesce(found, F.lit(False))


def _merged(spans: str) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    interval = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), interval(last["start"], F.greatest(last["end"], s["end"])))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), longer).otherwise(F.concat(done, interval(s["start"], s["end"])))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def redact(docs: DataFrame, id_column="doc_id", text_column="text", scope=SCOPE, mark=MARK) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``; other rows and columns as they are.

    Only texts that a pattern could match are joined with their spans, by (id, hash of the text); others stay where they are.
    """
    text = F.col(f"doc.{text_column}")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    suspicious = _suspicious(text)
    chosen = rows.where(suspicious).select("doc", F.col(f"doc.{id_column}").alias("id"), F.xxhash64(text).alias("text_hash"))
    spans = find_spans(docs.where(_suspicious(F.col(text_column))), id_column, text_column, scope).where(F.size("spans") > 0)
    spans = spans.toDF("span_id", "span_hash", "spans").dropDuplicates(["span_id", "span_hash"])
    same = F.col("id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash"))
    joined = chosen.join(spans, same, "left").withColumn("merged", _merged("spans"))
    piece = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("merged", i - 1)["end"])
    parts = F.transform("merged", lambda s, i: F.concat(piece(end_before(i), s["start"]), F.lit(mark)))
    cleaned = F.concat(F.array_join(parts, ""), piece(F.element_at("merged", -1)["end"], F.length(text)))
    redacted = joined.select(F.col("doc").withField(text_column, F.coalesce(cleaned, text)).alias("doc"))
    return rows.where(~suspicious).unionByName(redacted).select("doc.*")
