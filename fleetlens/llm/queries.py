"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.ranking import group_position, number_chunk
from fleetlens.llm import (
    byte_bpe,
    chat,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language_id,
    multiset_hash,
    ordered_neighbours,
    periodic_runs,
    resharding,
    revisits,
    simhash,
    token_index,
    toxicity,
)
from fleetlens.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(key: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5 (null: empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def bpe_digests(rows: DataFrame, ranks: str) -> DataFrame:
    return byte_bpe.round_trip(rows.select("doc_id", "text"), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op1_byte_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digests(table(spark, folder, "documents"), ranks)


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out("doc_id")))
    return language_id.predict(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The document that stays for every document."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a passage of a benchmark text, with that text."""
    found = decontaminate.contaminations(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("row")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document; learned from the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    flags = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is drawn from the labels and has 6,000 rows at most, so the texts stay in place.
    sample = F.broadcast(toxicity.draw(flags, "toxic", grades=2, most=6000))
    model = toxicity.fit_flags(toxicity.one_text(docs.join(sample, "doc_id"), "toxic"), flag="toxic")
    return toxicity.predict(docs, model).select(
        "doc_id", "severity", "grade", (F.col("grade") > 0).alias("toxic")
    )


@query("op3_chat_format")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation written with the template, and what is read back from that text."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.conversation_records(rows.unionByName(extra))
    written = chat.canonical_turns(records).select(
        "conv_id", "layout", chat.format_chat(F.col("turns")).alias("formatted")
    )
    read = written.select(
        "conv_id",
        "layout",
        "formatted",
        chat.parse_chat(F.col("formatted")).alias("turns"),
        F.transform(
            chat.loss_spans(F.col("formatted")),
            lambda s: chat.unescape(F.col("formatted").substr(s["start"] + 1, s["chars"])),
        ).alias("loss"),
    )
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


@query("op5_token_index")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document written to indexed shards and read back by key."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = work_folder(spark, "token-index")
    token_index.write_ids(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return token_index.read_documents(spark, out, kind).withColumnRenamed("key", "doc_id")


@query("op2_resharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of 32 uneven shards (by source) spread evenly over 40, and their places there."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    out = work_folder(spark, "reshard")
    old_shard = F.crc32(F.coalesce("source", F.lit(""))) % 32
    schema = resharding.write_layout(docs, f"{out}/old", old_shard, size)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    order = ["doc_id", "text_crc32"]
    stored = resharding.reshard(
        spark, f"{out}/old", f"{out}/new", 40, ["doc_id", crc], id_chunk("doc_id"), size, schema
    )
    rows = stored.select(
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(resharding.SHARD).cast("int").alias("shard"),
    )
    placed = group_position(rows, ["shard"], order, id_chunk("doc_id"), "_position")
    return placed.select(
        *rows.columns,
        (F.col("_position") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def id_chunk(key: str) -> Column:
    """Chunk of an integer id; null ids come first."""
    return F.coalesce(number_chunk(key), F.lit(-(1 << 62)))


@query(
    "op4_revisits",
    """
    WITH visit AS (
        SELECT page_id AS p, url, html, unnest(range(0, page_id % 4 + 2)) AS i FROM pages
    ), marked AS (
        SELECT *, (i = 0 AND p % 7 <> 0) OR (i = 3 AND p % 2 = 0) AS is_full,
               1700000000 + p % 1000 * 60 AS first_s,
               1700000000 + p % 1000 * 60 + i * 25200 AS s,
               CASE WHEN i = 3 THEN html || '<!-- 2 -->' ELSE html END AS body,
               regexp_replace(url, '#.*$', '') AS bare
        FROM visit
    ), split AS (
        SELECT *, md5(CASE WHEN is_full THEN body ELSE html END) AS digest,
               regexp_replace(regexp_replace(lower(regexp_extract(bare, '://([^/?]*)', 1)),
                                             '^www\\.', ''), ':(80|443)$', '')
               || regexp_replace(regexp_extract(bare, '://[^/?]*([^?]*)', 1), '/+$', '') AS place,
               list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS f
        FROM marked
    ), record AS (
        SELECT *, p * 8 + i AS record_id,
               place || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END AS u,
               CASE WHEN p % 3 = 0 THEN NULL
                    WHEN NOT is_full AND p % 11 = 0 THEN '"stale"'
                    WHEN NOT is_full AND p % 5 = 1 THEN 'W/"' || digest || '"'
                    ELSE '"' || digest || '"' END AS etag,
               CASE WHEN is_full THEN s WHEN p % 13 = 0 THEN NULL ELSE first_s END AS modified,
               strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS date
        FROM split
    ), met AS (
        SELECT a.*, b.record_id AS b_id, b.s AS b_s, b.etag AS b_etag, b.modified AS b_modified,
               b.digest AS b_digest, strlen(b.body) AS b_length,
               row_number() OVER (PARTITION BY a.record_id ORDER BY b.s DESC, b.record_id DESC) AS n
        FROM record a LEFT JOIN record b ON b.u = a.u AND b.is_full AND b.s < a.s
        WHERE NOT a.is_full
    ), judged AS (
        SELECT *, CASE WHEN b_id IS NULL THEN 'no_response'
                       WHEN etag IS NOT NULL AND b_etag IS NOT NULL
                       THEN CASE WHEN regexp_replace(etag, '^W/', '') = b_etag
                                 THEN 'resolved' ELSE 'mismatch' END
                       WHEN modified IS NULL OR b_modified IS NULL THEN 'unchecked'
                       WHEN modified = b_modified THEN 'resolved' ELSE 'mismatch' END AS outcome
        FROM met WHERE n = 1
    )
    SELECT record_id, p AS page_id, u AS canonical_url, outcome,
           CASE WHEN outcome IN ('resolved', 'unchecked') THEN b_id END AS response_id,
           CASE WHEN outcome IN ('resolved', 'unchecked') THEN b_s END AS response_s,
           CASE WHEN outcome IN ('resolved', 'unchecked') THEN b_digest END AS digest,
           CASE WHEN outcome IN ('resolved', 'unchecked') THEN b_length END AS length,
           CASE WHEN outcome IN ('resolved', 'unchecked')
                THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || b_length
                     || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || date
                     || chr(10) || 'etag: ' || coalesce(etag, b_etag, '') || chr(10) || 'server: a'
                ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10)
                     || 'date: ' || date || chr(10) || 'etag: ' || coalesce(etag, '') || chr(10)
                     || 'server: b' END AS headers
    FROM judged
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit derived from the pages with the response that it stands for."""
    found = revisits.resolve_revisits(revisits.captures(table(spark, folder, "pages")))
    lines = F.transform(
        F.map_entries("headers"),
        lambda e: F.concat(F.lower(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit(""))),
    )
    return found.select(
        "record_id",
        F.floor(F.col("record_id") / 8).alias("page_id"),
        "canonical_url",
        "outcome",
        "response_id",
        F.unix_seconds("response_ts").alias("response_s"),
        "digest",
        "length",
        F.array_join(F.array_sort(lines), "\n").alias("headers"),
    )


def with_made_run(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` edited where crc32 of the id as text is divisible by 10: from some word on, the
    words repeat a period. A null id counts as empty."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = (h % 10 == 0) & (F.size(words) > 0)
    g = F.floor(h / 10)
    n = F.size("_words").cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    made = F.concat(
        F.slice("_words", F.lit(1), a.cast("int")),
        F.transform(
            F.sequence(F.lit(0).cast("long"), n - a - 1),
            lambda i: F.element_at("_words", (a + i % p + 1).cast("int")),
        ),
    )
    return (
        rows.withColumn("_words", F.when(chosen, words))
        .withColumn(
            "text",
            F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(made, " ")),
        )
        .drop("_words")
    )


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words of every document, the longest one, and the text without repetitions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic_runs.collapse_runs(with_made_run(docs))
    # The longest run; of equal ones the first, then the one with the smallest period.
    longest = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
        )
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-F.col("_best.less") * 1000 / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_hard_negatives",
    """
    WITH clean AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
               CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM clean a JOIN clean b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positive AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n
        FROM scored WHERE same
    ), negative AS (
        SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score,
               s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                                  ORDER BY s.score DESC, s.other) AS n
        FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        WHERE p.n <= 5 AND 80 * p.positive_score <= 100 * s.score
          AND 100 * s.score <= 100 * p.positive_score
    )
    SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score
    FROM negative WHERE n <= 5
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        hard_negatives.quantized(F.col("embedding")).alias("vector"),
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op13_document_fingerprint")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    paired = ordered_neighbours.with_next(
        docs, "doc_id", ["text"], lambda rows: multiset_hash.with_fingerprints(rows)
    )
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next_text", half))
    both = paired.withColumn("edited", edited).withColumn("edited_vector", multiset_hash.vector(F.col("edited")))
    return both.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset_hash.fingerprint(F.col("vector")).alias("fingerprint"),
        multiset_hash.fingerprint(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset_hash.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
