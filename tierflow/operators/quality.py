"""Counts, profiles, checks and reports. Each is one aggregation, so that a lost executor
cannot count a row twice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierflow.functions.keys import unambiguous
from tierflow.operators.joins import null_safe_join, with_group_stats
from tierflow.operators.ordered import exact_percentiles
from tierflow.operators.rules import AUDIT_COLUMNS, not_null


def distinct_keys(*keys: str) -> Column:
    """Distinct key values, with null as one of them."""
    value = F.col(keys[0]) if len(keys) == 1 else F.when(not_null(*keys), F.struct(*keys))
    missing = F.coalesce(F.max((~not_null(*keys)).cast("long")), F.lit(0))
    return F.count_distinct(value) + missing


def stage_counts(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows at each stage, one row per stage: raw, after each rule, after dedup."""
    passed = F.lit(True)
    counts = [F.count("*").alias("raw")]
    for name, rule in rules.items():
        passed = passed & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    counts.append(F.count_distinct(F.when(passed & not_null(*keys), key)).alias("deduplicated"))
    one = df.agg(*counts)
    stages = F.array(
        *(
            F.struct(F.lit(i).alias("step"), F.lit(c).alias("stage"), F.col(c).alias("n_rows"))
            for i, c in enumerate(one.columns)
        )
    )
    return one.select(F.inline(stages))


def dropped_by_rule(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows each rule removes, in rule order, then the duplicates removed last."""
    passed, previous = F.lit(True), F.lit(True)
    counts = []
    for name, rule in rules.items():
        passed = previous & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(previous & ~passed).alias(name))
        previous = passed
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    kept = passed & not_null(*keys)
    counts.append((F.count_if(kept) - F.count_distinct(F.when(kept, key))).alias("duplicate"))
    one = df.agg(*counts)
    table = F.array(
        *(F.struct(F.lit(c).alias("rule"), F.col(c).alias("n_dropped")) for c in one.columns)
    )
    return one.select(F.inline(table))


def profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per numeric column, one row each."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = []
    for c in names:
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.round(F.avg(x), digits).alias("mean"),
                F.round(F.stddev_samp(x), digits).alias("stddev"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(c)
        )
    return df.agg(*stats).select(F.inline(F.array(*(F.col(c) for c in names))))


def describe_all(df: DataFrame) -> DataFrame:
    """The classic five-line description of every numeric and string column."""
    return df.describe()


def sample_rows(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; give an order for the same rows each time."""
    return (df.orderBy(*order) if order else df).limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    """Columns of a frame: position, name, type, nullability."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean"
    )


def missing_columns(df: DataFrame, wanted: Sequence[str] = AUDIT_COLUMNS) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def quality_report(
    df: DataFrame,
    entity: str,
    date: str,
    key: str = "id",
    run_timestamp: Column | None = None,
) -> DataFrame:
    """One row on a bronze table. Only emptiness and missing audit columns lower the status."""
    missing = missing_columns(df)
    aggregates = [F.count("*").alias("bronze_count")]
    if key in df.columns:
        aggregates += [
            F.count_if(F.col(key).isNull()).alias("null_ids"),
            (F.count("*") - distinct_keys(key)).alias("duplicate_count"),
        ]
    counts = df.agg(*aggregates)
    optional = [
        F.col(c) if c in counts.columns else F.lit(None).cast("long").alias(c)
        for c in ("null_ids", "duplicate_count")
    ]
    complete = (F.col("bronze_count") > 0) & F.lit(not missing)
    return counts.select(
        F.lit(entity).alias("entity"),
        F.lit(date).alias("date"),
        (F.current_timestamp() if run_timestamp is None else run_timestamp).alias("timestamp"),
        F.when(complete, "SUCCESS").otherwise("WARNING").alias("status"),
        "bronze_count",
        F.lit(df.schema.json()).alias("bronze_schema"),
        F.array(*(F.lit(c) for c in missing)).cast("array<string>").alias("missing_audit_fields"),
        *optional,
        F.lit(None).cast("string").alias("error"),
    )


def error_report(spark: SparkSession, entity: str, date: str, error: Exception) -> DataFrame:
    """The report row of a validation that could not run, in the report's columns."""
    empty = quality_report(spark.createDataFrame([], "id int"), entity, date)
    facts = {"status": F.lit("ERROR"), "error": F.lit(str(error))}
    unknown = ("bronze_count", "bronze_schema", "missing_audit_fields", "null_ids", "duplicate_count")
    kinds = dict(empty.dtypes)
    return empty.withColumns({**facts, **{c: F.lit(None).cast(kinds[c]) for c in unknown}})


def report_json(report: DataFrame) -> DataFrame:
    """Reports as one-line JSON in a single string column."""
    return report.select(F.to_json(F.struct("*")).alias("report"))


# Fixed value: below this share of common fields a warning is raised.
LOW_CONSISTENCY = 0.5


def _payload_facts(df: DataFrame, payload: str) -> DataFrame:
    """One row of counts on a JSON column, from a single pass.

    Rows are first counted per distinct key set, so shuffles carry one row per
    set and not one per payload. A field is common if it occurs in as many objects
    as there are.
    """
    keys = F.array_sort(F.array_distinct(F.json_object_keys(payload)))
    per_set = (
        df.select(keys.alias("_keys"), F.try_parse_json(payload).isNotNull().alias("_valid"))
        .groupBy("_keys")
        .agg(F.count("*").alias("_n"), F.count_if("_valid").alias("_ok"))
    )
    own = F.when(F.col("_keys").isNull(), "other").otherwise("object")
    entries = F.concat(
        F.array(F.struct(own.alias("kind"), F.lit(None).cast("string").alias("key"))),
        F.coalesce(
            F.transform("_keys", lambda k: F.struct(F.lit("field").alias("kind"), k.alias("key"))),
            F.array(),
        ),
    )
    per_key = (
        per_set.select(F.explode(entries).alias("_e"), "_n", "_ok")
        .groupBy("_e.kind", "_e.key")
        .agg(F.sum("_n").alias("n"), F.sum("_ok").alias("ok"), F.count("*").alias("sets"))
    )
    histogram = per_key.groupBy("kind", "n").agg(
        F.count("*").alias("fields"), F.max("ok").alias("ok"), F.max("sets").alias("sets")
    )

    def of(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    facts = histogram.agg(
        of("object", "n").alias("n_objects"),
        of("other", "n").alias("_n_other"),
        (of("object", "ok") + of("other", "ok")).alias("n_valid"),
        of("object", "sets").alias("n_key_sets"),
        of("field", "fields").alias("n_fields"),
        F.max(F.when(F.col("kind") == "field", F.struct("n", "fields"))).alias("_top"),
    )
    common = F.when(F.col("_top.n") == F.col("n_objects"), F.col("_top.fields"))
    return facts.select(
        (F.col("n_objects") + F.col("_n_other")).alias("n_rows"),
        "n_objects",
        "n_valid",
        "n_key_sets",
        "n_fields",
        F.coalesce(common, F.lit(0)).cast("long").alias("n_common"),
    ).withColumn("ratio", F.coalesce(F.try_divide("n_common", "n_fields"), F.lit(0.0)))


def _consistent(strict: bool) -> Column:
    agreed = (F.col("n_key_sets") == 1) if strict else (F.col("n_common") > 0)
    return (F.col("n_rows") == 0) | ((F.col("n_objects") > 0) & agreed)


def json_validity(df: DataFrame, payload: str) -> DataFrame:
    """Rows, parseable rows and their share."""
    ok = F.try_parse_json(payload).isNotNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_valid")).select(
        "n_rows",
        "n_valid",
        F.coalesce(F.try_divide("n_valid", "n_rows"), F.lit(0.0)).alias("valid_share"),
        (F.col("n_rows") == F.col("n_valid")).alias("all_valid"),
    )


def field_consistency(df: DataFrame, payload: str, strict: bool = False) -> DataFrame:
    """One row on the top-level fields of JSON objects: all fields, fields common to every
    object, their ratio, and whether the check passes.

    Values that are no objects are skipped; input of only such values fails,
    empty input passes. ``strict`` asks for one key set throughout.
    """
    return _payload_facts(df, payload).select(
        "n_rows",
        "n_objects",
        "n_fields",
        "n_common",
        "n_key_sets",
        "ratio",
        _consistent(strict).alias("passed"),
    )


def validate_records(df: DataFrame, payload: str, strict: bool = False) -> DataFrame:
    """Every check on extracted records, one row per check plus the conjunction ``all``."""
    passed = {
        "not_empty": F.col("n_rows") > 0,
        "json_valid": F.col("n_rows") == F.col("n_valid"),
        "field_consistency": _consistent(strict),
    }
    everything = F.lit(True)
    for condition in passed.values():
        everything = everything & condition
    low = (F.col("n_objects") > 0) & (F.col("ratio") < LOW_CONSISTENCY)
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            condition.alias("passed"),
            (low & F.lit(name in ("field_consistency", "all"))).alias("warning"),
        )
        for name, condition in {**passed, "all": everything}.items()
    ]
    return _payload_facts(df, payload).select(F.inline(F.array(*rows)))


def reconcile(
    raw: DataFrame, bronze: DataFrame, key: str, compare: Sequence[str]
) -> DataFrame:
    """Raw against bronze in one row: rows and keys on both sides, keys lost and added, keys
    whose bronze values occur in no raw copy, and columns on one side only.

    Copies of a key are folded before the join, so that a hot key is one row in it.
    """
    tagged = [
        side.select(
            F.col(key).alias("_key"),
            F.sha2(unambiguous(*compare), 256).alias("_hash"),
            F.lit(is_raw).alias("_raw"),
        )
        for side, is_raw in ((raw, True), (bronze, False))
    ]
    is_raw = F.col("_raw")
    versions = (
        tagged[0].unionByName(tagged[1]).groupBy("_key", "_hash")
        .agg(F.count_if(is_raw).alias("_in_raw"), F.count_if(~is_raw).alias("_in_bronze"))
    )
    per_key = versions.groupBy("_key").agg(
        F.sum("_in_raw").alias("r"),
        F.sum("_in_bronze").alias("b"),
        F.max((F.col("_in_bronze") > 0) & (F.col("_in_raw") == 0)).alias("changed"),
    )
    r, b = F.col("r"), F.col("b")
    keyed = F.col("_key").isNotNull()
    only_raw = sorted(set(raw.columns) - set(bronze.columns))
    only_bronze = sorted(set(bronze.columns) - set(raw.columns))
    return per_key.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bronze_rows"),
        F.count_if(keyed & (r > 0)).alias("raw_keys"),
        F.count_if(keyed & (b > 0)).alias("bronze_keys"),
        F.count_if(keyed & (r > 0) & (b == 0)).alias("keys_lost"),
        F.count_if(keyed & (r == 0) & (b > 0)).alias("keys_added"),
        F.count_if(keyed & (r > 0) & F.col("changed")).alias("keys_changed"),
    ).select(
        "*",
        F.lit(",".join(only_raw)).alias("columns_only_raw"),
        F.lit(",".join(only_bronze)).alias("columns_only_bronze"),
    )


def violations_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Number of repeated key values, and of rows carrying them."""
    repeated = df.where(not_null(*columns)).groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return repeated.agg(
        F.count("*").alias("n_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    )


def violations_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null values per column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns)))
    )


def violations_relationship(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child keys, and rows, without a parent. Child rows are counted per key before the join."""
    per_key = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    orphans = per_key.join(parent, F.col(key) == F.col(parent_key), "left_anti")
    return orphans.agg(
        F.count("*").alias("n_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    )


def freshness(df: DataFrame, timestamp: str, now: Column) -> DataFrame:
    """Seconds between the latest timestamp and ``now``."""
    return df.agg(F.max(timestamp).alias("latest")).select(
        "latest", F.timestamp_diff("SECOND", F.col("latest"), now).alias("age_seconds")
    )


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column."""
    one = df.agg(
        F.count("*").alias("_rows"), *(F.count(c).alias(c) for c in columns)
    )
    share = [
        F.struct(
            F.lit(c).alias("column"),
            F.try_divide(F.col(c).cast("double"), F.col("_rows").cast("double")).alias("share"),
        )
        for c in columns
    ]
    return one.select(F.inline(F.array(*share)))


def match_share(
    df: DataFrame, truth: DataFrame, key: str, truth_key: str, value: str, truth_value: str
) -> DataFrame:
    """Accuracy and consistency: share of rows whose key joins, and whose value then agrees with
    one of the key's true values. Repeated rows of the truth count once."""
    # Rows of one key and value are counted first, and the truth is one row per key and value;
    # hot keys reach the join as few rows.
    folded = df.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    pairs = truth.where(F.col(truth_key).isNotNull()).groupBy(
        F.col(truth_key).alias("_k"), F.col(truth_value).alias("_v")
    ).agg(F.lit(True).alias("_true"))
    keys = pairs.groupBy("_k").agg(F.lit(True).alias("_known"))
    joined = folded.join(pairs, ["_k", "_v"], "left").join(keys, "_k", "left")
    n = F.sum("_n").cast("double")
    found = F.sum(F.when(F.col("_known"), F.col("_n")).otherwise(0)).cast("double")
    equal = F.sum(F.when(F.col("_true"), F.col("_n")).otherwise(0)).cast("double")
    return joined.agg(
        F.try_divide(found, n).alias("consistency"), F.try_divide(equal, n).alias("accuracy")
    )


def schema_drift(old: DataFrame, new: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """Columns and nested fields added, removed or changed in type: ``(change, path, old type, new type)``. A path names
    fields after a dot, elements of a list by ``[]``, and a map's keys and values by ``{key}`` and ``{value}``."""
    return sorted(_type_drift("", old.schema, new.schema), key=lambda change: change[1])


def _type_drift(path: str, old: T.DataType, new: T.DataType):
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        before, after = ({f.name: f.dataType for f in t.fields} for t in (old, new))
        for c in before.keys() | after.keys():
            at = f"{path}.{c}" if path else c
            if c not in before:
                yield "added", at, None, after[c].simpleString()
            elif c not in after:
                yield "removed", at, before[c].simpleString(), None
            else:
                yield from _type_drift(at, before[c], after[c])
    elif isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        yield from _type_drift(f"{path}[]", old.elementType, new.elementType)
    elif isinstance(old, T.MapType) and isinstance(new, T.MapType):
        yield from _type_drift(f"{path}{{key}}", old.keyType, new.keyType)
        yield from _type_drift(f"{path}{{value}}", old.valueType, new.valueType)
    elif old.simpleString() != new.simpleString():
        yield "type_changed", path, old.simpleString(), new.simpleString()


def schema_drift_table(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.sparkSession.createDataFrame(
        schema_drift(old, new), "change string, column string, old_type string, new_type string"
    )


def _common_type(spark: SparkSession, one: T.DataType, other: T.DataType) -> T.DataType:
    """The narrowest type that holds both: structs with the fields of both, lists and maps of what holds their contents, and text where
    there is no other."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        later = {f.name: f.dataType for f in other.fields}
        fields = [T.StructField(f.name, _common_type(spark, f.dataType, later.pop(f.name, f.dataType))) for f in one.fields]
        return T.StructType(fields + [T.StructField(name, kind) for name, kind in later.items()])
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        return T.ArrayType(_common_type(spark, one.elementType, other.elementType))
    if isinstance(one, T.MapType) and isinstance(other, T.MapType):
        return T.MapType(_common_type(spark, one.keyType, other.keyType), _common_type(spark, one.valueType, other.valueType))
    if isinstance(one, T.StringType) or isinstance(other, T.StringType):
        return T.StringType()
    both = F.coalesce(F.lit(None).cast(one), F.lit(None).cast(other)).alias("both")
    try:
        return spark.range(0).select(both).schema["both"].dataType
    except AnalysisException:
        return T.StringType()


def _as_type(column: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """A value of one type as another that :func:`_common_type` gave: fields that it lacks are null."""
    if kind == wanted:
        return column
    if isinstance(kind, T.StructType) and isinstance(wanted, T.StructType):
        own = {f.name: f.dataType for f in kind.fields}
        fields = [
            (_as_type(column.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(column, lambda x: _as_type(x, kind.elementType, wanted.elementType))
    if isinstance(kind, T.MapType) and isinstance(wanted, T.MapType):
        entry = lambda e: F.struct(
            _as_type(e["key"], kind.keyType, wanted.keyType).alias("key"), _as_type(e["value"], kind.valueType, wanted.valueType).alias("value")
        )
        return F.map_from_entries(F.transform(F.map_entries(column), entry))
    return F.to_json(column) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else column.cast(wanted)


def evolve_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both versions under the union of their columns and nested fields, missing ones null. What changed in type
    takes the wider type of the two, or text where neither is wider (JSON for nested values)."""
    before, after = ({f.name: f.dataType for f in df.schema.fields} for df in (old, new))
    common = {
        c: _common_type(old.sparkSession, before[c], after[c])
        for c in before.keys() & after.keys()
        if before[c] != after[c]
    }

    def widened(df: DataFrame, kinds: Mapping[str, T.DataType]) -> DataFrame:
        return df.withColumns({c: _as_type(F.col(c), kinds[c], t) for c, t in common.items()}) if common else df

    return widened(old, before).unionByName(widened(new, after), allowMissingColumns=True)


def zscore_outliers(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` sample deviations from their group's mean."""
    x = F.col(value)
    scored = with_group_stats(
        df, keys, F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    ).withColumn("zscore", F.try_divide(x - F.col("_mean"), F.col("_sd")))
    return scored.where(F.abs("zscore") > limit).drop("_mean", "_sd")


def iqr_outliers(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond ``factor`` quartile ranges from their group's quartiles. Quartiles are exact."""
    quartiles = exact_percentiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    fences = with_fences(quartiles, factor)
    joined = null_safe_join(df, fences, keys)
    return joined.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def with_fences(quartiles: DataFrame, factor: float, digits: int = 6) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * factor
    return quartiles.withColumns(
        {
            "low": F.round(F.col("q1") - reach, digits),
            "high": F.round(F.col("q3") + reach, digits),
        }
    )
