"""The operators of this subpackage on the test tables, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import chat, credentials, divergence, filter_audit, forest, jaccard, licenses, ngram_lm, orc_tokens, packing, prefix_bpe, quality, winnow
from tierflow.workspace import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_token_files(spark, sf_dir):
    """Token ids of all documents, written as ORC and read back."""
    path = staging_path(spark, "token-files")
    orc_tokens.write_token_files(table(spark, sf_dir, "documents"), path)
    return orc_tokens.with_checksums(orc_tokens.read_token_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op1_bloom_language_model(spark, sf_dir):
    """All documents scored by a model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(7) == 2)
    return ngram_lm.score(docs, ngram_lm.train(docs.where(~F.col("held_out"))))


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
        FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
            ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS shingles
        FROM w
    ), e AS (SELECT doc_id, unnest(shingles) AS h FROM s
    ), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT x, y FROM p JOIN s i ON x = i.doc_id JOIN s j ON y = j.doc_id
        WHERE 100 * c >= 75 * (len(i.shingles) + len(j.shingles) - c)
    ), r AS (
        SELECT doc_id, doc_id AS reached FROM documents
        UNION SELECT doc_id, t FROM r JOIN (SELECT x AS f, y AS t FROM l UNION ALL SELECT y, x FROM l) ON reached = f
    )
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id
    FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) USING (doc_id)"""
)
def op3_shingle_join(spark, sf_dir):
    """Groups of documents whose five-word shingles overlap by three quarters."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op4_winnowing(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    compared = winnow.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.written("fingerprint").alias("fingerprint"),
        winnow.written("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query()
def op5_hash_prefix_forest(spark, sf_dir):
    """The ten nearest embeddings of every hundredth one."""
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_linked_credentials(spark, sf_dir):
    """Secrets of all documents, and weak candidates beside complementary parts."""
    found = credentials.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(credentials.written("spans", "assign", "access", "hex"), 256).alias("base_sha256"),
        credentials.written("spans").alias("spans"),
    )


@query()
def op7_prefix_bpe(spark, sf_dir):
    """Ids of all documents and what they decode to, as digests."""
    return prefix_bpe.digests(table(spark, sf_dir, "documents"))


def remainder(divisor):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


@query()
def op8_dictionary_quality(spark, sf_dir):
    """Quality of all documents; labels of every fifth id, by a hash, are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


CHAT_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"


@query(
    rf"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), marked AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows
    ), pieces AS (
        SELECT *,
            CASE WHEN before IS NULL THEN '<|' || role || '|>' || chr(10)
                WHEN before = role THEN '<|+|>' ELSE '</s>' || chr(10) || '<|' || role || '|>' || chr(10) END
            || regexp_replace(text, '{CHAT_CONTROL}', '\1\\\2\3', 'g') AS piece
        FROM marked
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(piece)) + 5 AS BIGINT) AS formatted_chars
    FROM pieces GROUP BY conv_id"""
)
def op9_chat_formatting(spark, sf_dir):
    """All conversations formatted, and what reading them back gives."""
    wanted = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(wanted)
    done = chat.format_conversations(rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_learnt(F.col("formatted"), F.col("loss_spans")).alias("learnt")
    )
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return done.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op10_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a
        FROM documents
    ), g AS (SELECT DISTINCT lang, source FROM d
    ), kept AS (
        SELECT lang, term FROM (SELECT lang, unnest(list_distinct(a)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30
    ), n AS (
        SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(a) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL
    ), p AS (
        SELECT lang, source, term, coalesce(n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + 5 * v) AS p
        FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
    ), q AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
        FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN v USING (lang)
    ), rows AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
    WHERE part = 'pair' OR rank <= 50"""
)
def op11_source_divergence(spark, sf_dir):
    """How far the sources of each language differ in their words, and by which words each stands out."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(licenses.brute_force_sql())
def op12_license_index(spark, sf_dir):
    """Licence notices in all documents, by a positional index of rare words."""
    return licenses.summary(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
        FROM documents
    ), m AS (
        SELECT part, coalesce(quality, false) AS good, coalesce(toxic, false) AS toxic, [
            CASE WHEN len(w) < 100 THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
            CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 'C' END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
            CASE WHEN doc_id > first THEN 'E' END] AS fails
        FROM d LEFT JOIN (
            SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
        ) USING (doc_id)
    ), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL
    ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
    ), o AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), s AS (
        SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS now,
            string_split(filter_order[1:step - 1], '') AS earlier, string_split(filter_order[1:step], '') AS done
        FROM o, range(1, 6) r(step)
    ), x AS (
        SELECT part, filter_order, step, now,
            coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, done)), 0) AS kept,
            coalesce(sum(n) FILTER (WHERE list_contains(fails, now) AND NOT list_has_any(fails, earlier)), 0) AS removed,
            coalesce(sum(n) FILTER (WHERE list_contains(fails, now) AND list_has_any(fails, earlier)), 0) AS redundant,
            coalesce(sum(n) FILTER (WHERE list_filter(fails, lambda y: y IS NOT NULL) = [now]), 0) AS unique_fails,
            coalesce(sum(good) FILTER (WHERE list_contains(fails, now) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
            coalesce(sum(c.toxic) FILTER (WHERE list_contains(fails, now) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
        FROM c, s GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley
    FROM x"""
)
def op13_filter_interactions(spark, sf_dir):
    """What five quality filters remove from each language, in every order of them."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
