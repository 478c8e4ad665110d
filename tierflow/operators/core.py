"""Integration-tier operators: conformance, repair, matching, gaps and time zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow.operators.joins import join_in_blocks, left_join_spread, with_group_stats


def normalized_text(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    # Lone blanks, the usual case, do not match and need no replacing.
    return F.trim(F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " "))


def semantic_dedup(df: DataFrame, attributes: Sequence[str], earliest: str) -> DataFrame:
    """The earliest row per normalised business attributes, as ``earliest`` and ``n_copies``.

    Texts are compared by SHA-256 of their normalised whole, and only digests are
    shuffled.
    """
    parts = [F.coalesce(normalized_text(F.col(a)), F.lit("")) for a in attributes]
    digest = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return (
        df.select(earliest, digest.alias("_digest"))
        .groupBy("_digest")
        .agg(F.min(earliest).alias(earliest), F.count("*").alias("n_copies"))
        .drop("_digest")
    )


def conform(
    df: DataFrame, column: str, codes: Mapping[str, str] | DataFrame, default: str, name: str
) -> DataFrame:
    """``column`` mapped to standard codes in ``name``; unmapped values get the default and a
    flag. ``codes`` is a fixed mapping, which becomes one literal, or a table (code, standard), of which
    repeated codes give their smallest standard."""
    own = F.trim(F.upper(column))
    if isinstance(codes, DataFrame):
        listed = codes.select(F.trim(F.upper("code")).alias("_code"), "standard").where("_code IS NOT NULL")
        listed = listed.groupBy("_code").agg(F.min("standard").alias("_standard"))
        joined, mapped = df.join(listed, own == F.col("_code"), "left"), F.col("_standard")
    else:
        pairs = [F.lit(x) for pair in codes.items() for x in pair]
        joined, mapped = df, F.try_element_at(F.create_map(*pairs), own)
    flagged = joined.withColumns(
        {name: F.coalesce(mapped, F.lit(default)), f"{name}_unmapped": mapped.isNull()}
    )
    return flagged.drop("_code", "_standard")


def impute_group_mean(
    df: DataFrame, keys: Sequence[str], value: str, valid: Column, digits: int | None = 4, scale: int = 4
) -> DataFrame:
    """Invalid or missing values replaced by the mean of the group's valid ones, and flagged. Values are
    summed exactly to ``scale`` decimal places; ``digits=None`` leaves the mean unrounded."""
    kept = F.when(valid, F.col(value))
    mean = F.try_divide(
        F.sum(kept.cast(f"decimal(28,{scale})")).cast("double"), F.count(kept).cast("double")
    )
    mean = mean if digits is None else F.round(mean, digits)
    marked = with_group_stats(df.withColumn("_kept", kept), keys, mean.alias("_mean"))
    return marked.withColumns(
        {value: F.coalesce("_kept", "_mean"), f"{value}_imputed": F.col("_kept").isNull()}
    ).drop("_kept", "_mean")


def clamp(column: Column, low: float, high: float) -> Column:
    """Out-of-range values at the nearer bound; null stays null."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def _piece(text: Column, length: Column, number: Column, pieces: int) -> tuple[Column, Column]:
    """Where the piece begins (from 0) that a text of a length has under a number, and its length."""
    begin = F.floor(number * length / pieces)
    return begin, F.floor((number + 1) * length / pieces) - begin


def text_pieces(text: Column, edits: int) -> Column:
    """Hashes of a text's ``edits + 1`` pieces of even length, with their number and the text's length."""
    numbers = F.sequence(F.lit(0), F.lit(edits))

    def one(number):
        begin, size = _piece(text, F.length(text), number, edits + 1)
        return F.xxhash64(F.length(text), number, F.substring(text, begin.cast("int") + 1, size.cast("int")))

    return F.transform(numbers, one)


def probed_pieces(text: Column, edits: int) -> Column:
    """Hashes of all parts of a text that can be a piece of another one at most ``edits`` edits away: of a length
    that differs by no more, at a place that is shifted by no more. Their number does not depend on the
    text's length."""
    lengths = F.filter(
        F.sequence(F.length(text) - edits, F.length(text) + edits), lambda n: n >= 0
    )
    numbers, shifts = F.sequence(F.lit(0), F.lit(edits)), F.sequence(F.lit(-edits), F.lit(edits))

    def at(length, number, shift):
        begin, size = _piece(text, length, number, edits + 1)
        begin = begin + shift
        inside = (begin >= 0) & (begin + size <= F.length(text))
        part = F.substring(text, begin.cast("int") + 1, size.cast("int"))
        return F.when(inside, F.xxhash64(length, number, part))

    every = F.transform(
        lengths, lambda n: F.flatten(F.transform(numbers, lambda i: F.transform(shifts, lambda s: at(n, i, s))))
    )
    return F.array_distinct(F.array_compact(F.flatten(every)))


def fuzzy_match(
    left: DataFrame, right: DataFrame, block: str, name: str, max_edits: int = 2, self_match: bool = False
) -> DataFrame:
    """Distinct names of both sides, in the same block, at most ``max_edits`` edits apart, with
    the rows behind each.

    A name is cut into ``max_edits + 1`` pieces. So many edits leave one of them whole, shifted by no more than
    that, so joining pieces with the other side's parts finds every such pair without
    comparing a whole block with itself. A piece that very many names have is met in blocks of names, a task
    for each two. ``self_match`` lists each pair of one table once, without identical names.
    """

    def names(df: DataFrame, suffix: str) -> DataFrame:
        clean = df.select(F.col(block).alias("block"), normalized_text(F.col(name)).alias("name"))
        return clean.where(F.col("name").isNotNull()).groupBy("block", "name").agg(
            F.count("*").alias(f"n_{suffix}")
        ).withColumnRenamed("name", f"name_{suffix}")

    a = names(left, "a").withColumn("_piece", F.explode(text_pieces(F.col("name_a"), max_edits)))
    b = names(right, "b").withColumn("_piece", F.explode(probed_pieces(F.col("name_b"), max_edits)))
    pairs = join_in_blocks(a, b, ["block", "_piece"], "name_a", "name_b")
    if self_match:
        pairs = pairs.where(F.col("name_a") < F.col("name_b"))
    distance = F.levenshtein("name_a", "name_b")
    longest = F.greatest(F.length("name_a"), F.length("name_b"))
    return (
        pairs.drop("_piece")
        .where(distance <= max_edits)
        .distinct()
        .withColumn("distance", distance)
        .withColumn(
            "similarity",
            F.round(1 - F.try_divide(F.col("distance").cast("double"), longest.cast("double")), 6),
        )
    )


def resolve_identity(
    events: DataFrame,
    people: DataFrame,
    event_key: str,
    id_columns: tuple[str, str, str],
    mail_columns: tuple[str, str],
) -> DataFrame:
    """Events with the person found by id, else by e-mail, in ``person``, and the way it was
    found in ``matched_by``. The first names are the event's, the second the person's;
    ``id_columns`` ends with the column that identifies the person in the result.

    Each event stays one row: of several people with one id or e-mail the smallest is taken, and
    ``ambiguous`` is set."""
    own_id, person_id, person = id_columns
    own_mail, person_mail = mail_columns

    def one_each(column: str, key: str, found: str) -> DataFrame:
        return people.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(
            F.min(person).alias(found), (F.min(person) < F.max(person)).alias(f"{found}_ambiguous")
        )

    by_id, by_mail = one_each(person_id, "_id", "_by_id"), one_each(person_mail, "_mail", "_by_mail")
    found = left_join_spread(events, by_id, own_id, "_id", event_key)
    # Only events not found by id look up their e-mail.
    found = found.withColumn("_lookup", F.when(F.col("_by_id").isNull(), F.col(own_mail)))
    found = left_join_spread(found, by_mail, "_lookup", "_mail", event_key)
    return found.withColumns(
        {
            "person": F.coalesce("_by_id", "_by_mail"),
            "matched_by": F.when(F.col("_by_id").isNotNull(), "id")
            .when(F.col("_by_mail").isNotNull(), "email")
            .otherwise("none"),
            "ambiguous": F.coalesce("_by_id_ambiguous", "_by_mail_ambiguous", F.lit(False)),
        }
    ).drop("_id", "_by_id", "_by_id_ambiguous", "_mail", "_by_mail", "_by_mail_ambiguous", "_lookup")


def interpolate_days(daily: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """A row for every day between a key's first and last, missing values on the straight line
    between their neighbours. ``daily`` holds one row per key and day, so a key has no more
    rows than there are days."""
    by_day = Window.partitionBy(key).orderBy(day)
    after = F.lead(day).over(by_day)
    gaps = daily.select(
        key,
        day,
        F.col(value).alias("_from"),
        after.alias("_next_day"),
        F.lead(value).over(by_day).alias("_to"),
    )
    last_day = F.coalesce(F.date_sub("_next_day", 1), F.col(day))
    grid = gaps.withColumn("_day", F.explode(F.sequence(F.col(day), last_day)))
    offset = F.datediff("_day", day)
    length = F.datediff("_next_day", day)
    share = F.coalesce(F.try_divide(offset.cast("double"), length.cast("double")), F.lit(0.0))
    return grid.select(
        key,
        F.col("_day").alias(day),
        F.when(offset == 0, F.col("_from"))
        .otherwise(F.col("_from") + (F.col("_to") - F.col("_from")) * share)
        .alias(value),
        (offset > 0).alias("interpolated"),
    )


def to_utc(local: Column, zone: Column) -> Column:
    """Wall-clock time of a zone as wall-clock time in UTC."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def date_dimension(bounds: DataFrame, first: str, years: int = 10) -> DataFrame:
    """One row per day for ``years`` years from the year of ``first``, given in one row."""
    start = F.trunc(first, "year")
    days = bounds.select(
        F.explode(F.sequence(start, F.date_sub(F.add_months(start, 12 * years), 1))).alias("date")
    )
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.day("date").alias("day"),
        F.dayofweek("date").alias("day_of_week"),
        F.weekofyear("date").alias("week"),
        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
    )
