"""Cluster documents (JSON): read, decode nodes, write.

Every scalar is decoded as text first and cast with ``try_cast``, since documents may carry a
number as text. Passwords become salted hashes; they never enter a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.ranking import number_chunk
from fleetlens.operators.nodes import node_defaults


def _last_wins(pairs: Column) -> Column:
    """A map whose keys come once: of repeated keys the last value stays, as in the managed tool."""
    keys = F.map_keys(pairs)
    entries = F.filter(
        F.map_entries(pairs),
        lambda e, i: i + F.array_position(F.reverse(keys), e["key"]) == F.size(keys),
    )
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(entries)).otherwise(pairs)


def _parsed(text: Column) -> Column:
    """Array of one struct: the text, and a map of its keys to their values as text; null for no JSON object.

    Presence, unknown keys and values all come from that one map. It is exploded, not projected:
    filters are not pushed below an explode, so each text is parsed once however many columns
    and filters use it.
    """
    parsed = F.array(F.from_json(text, "map<string,string>"))
    return F.transform(parsed, lambda d: F.struct(text.alias("_text"), _last_wins(d).alias("_d")))


def _secret_hash(secret: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), secret), 256)


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Raw documents: one per file, or one per line. ``cluster_id`` is the file (and line)."""
    raw = spark.read.text(path, wholetext=not one_per_line)
    name = F.col("_metadata.file_name")
    if one_per_line:
        name = F.concat_ws("#", name, F.xxhash64("value").cast("string"))
    return raw.select(name.alias("cluster_id"), F.col("value").alias("doc"))


def decode_documents(raw: DataFrame, engine: str, salt: str, network: str) -> DataFrame:
    """Columns of each document in ``doc``, keyed by ``cluster_id``.

    A default fills a key only when it is absent; an explicit null stays null. A missing or empty
    primary gives none, missing secondaries give an empty list. ``reject_reason`` is set for text
    that is no JSON object and for secondaries that are null or no list.
    """
    parsed = raw.select("cluster_id", F.inline(_parsed(F.col("doc"))))
    defaults = fv.document_defaults(engine, network)

    def present(key: str) -> Column:
        return F.map_contains_key("_d", key)

    def value(key: str) -> Column:
        given = F.col("_d")[key]
        if key == "use_custom_image":
            given = given.try_cast("boolean")
        if defaults.get(key) is None:
            return given
        return F.when(present(key), given).otherwise(F.lit(defaults[key]))

    secondaries, first = F.col("_d")["secondaries"], F.col("_d")["primary"]
    listed = F.from_json(secondaries, "array<string>")
    bad_list = present("secondaries") & (
        secondaries.isNull() | ~F.ltrim(secondaries).startswith("[")
    )
    primary = F.when(~F.trim(first).isin("{}", "", "0", "false", "[]"), first)
    return parsed.select(
        "cluster_id",
        *[value(key).alias(key) for key in fv.DOCUMENT_KEYS],
        _secret_hash(F.col("_d")[fv.DOCUMENT_SECRET_KEY], salt).alias("credential_hash"),
        primary.alias("primary_json"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("secondary_jsons"),
        F.when(F.col("_d").isNull(), "not a JSON object")
        .when(bad_list, "secondaries is not a list")
        .alias("reject_reason"),
    )


def load_cluster_docs(
    spark: SparkSession,
    path: str,
    engine: str,
    salt: str,
    network: str,
    one_per_line: bool = False,
) -> DataFrame:
    return decode_documents(read_documents(spark, path, one_per_line), engine, salt, network)


def check_nodes(docs: DataFrame, salt: str, network: str) -> DataFrame:
    """All node records of decoded documents, with a ``reject_reason`` for the bad ones.

    ``pos`` is 0 for the primary and counts the secondaries from 1. ``store_nodes`` keeps good and bad
    rows from one pass.
    """
    listed = (
        docs.filter(F.col("reject_reason").isNull())
        .select(
            "cluster_id",
            F.posexplode(F.concat(F.array("primary_json"), F.col("secondary_jsons"))).alias(
                "pos", "node_json"
            ),
        )
        .filter((F.col("pos") > 0) | F.col("node_json").isNotNull())
        .select(
            "cluster_id", "pos", F.inline(_parsed(F.col("node_json")))
        )
        .withColumnsRenamed({"_text": "node_json", "_d": "_n"})
        .withColumn("_keys", F.map_keys("_n"))
    )
    defaults = fv.node_record_defaults(network)

    def value(key: str) -> Column:
        given = F.col("_n")[key]
        if key in fv.NODE_INT_KEYS:
            given = given.try_cast("int")
        if key not in defaults:
            return given
        return F.when(F.map_contains_key("_n", key), given).otherwise(F.lit(defaults[key]))

    required = F.array(*[F.lit(key) for key in fv.REQUIRED_NODE_KEYS])
    known = F.array(*[F.lit(key) for key in fv.NODE_KEYS])
    missing = F.array_except(required, "_keys")
    unknown = F.array_except("_keys", known)
    bad_numbers = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("_n")[key].isNotNull() & F.col("_n")[key].try_cast("int").isNull(),
                    F.lit(key),
                )
                for key in fv.NODE_INT_KEYS
            ]
        )
    )
    reason = (
        F.when(F.col("_n").isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(~F.coalesce(F.col("_n")["role"].isin(*fv.ROLES), F.lit(False)), "invalid role")
        .when(
            ~F.coalesce(F.col("_n")["node_type"].isin(*fv.NODE_TYPES), F.lit(False)),
            "invalid node_type",
        )
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ", ")))
        .when(F.size(bad_numbers) > 0, F.concat(F.lit("not a number "), F.array_join(bad_numbers, ", ")))
    )
    return listed.select(
        "cluster_id",
        "pos",
        *[value(key).alias(key) for key in fv.NODE_KEYS if key != fv.NODE_SECRET_KEY],
        _secret_hash(F.col("_n")[fv.NODE_SECRET_KEY], salt).alias("credential_hash"),
        "node_json",
        reason.alias("reject_reason"),
    )


def decode_nodes(docs: DataFrame, salt: str, network: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of decoded documents: (good rows, rejected rows with their text and a reason).

    Good rows have their defaults filled in, as ``node_defaults`` does.
    """
    checked = check_nodes(docs, salt, network)
    good = checked.filter(F.col("reject_reason").isNull()).drop("node_json", "reject_reason")
    good = node_defaults(good).drop("effective_server_id")
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    return good, rejected.select("cluster_id", "pos", "node_json", "reject_reason")


def store_nodes(docs: DataFrame, path: str, salt: str, network: str) -> tuple[DataFrame, DataFrame]:
    """Write the nodes of decoded documents below ``path`` and read them back as ``decode_nodes`` does.

    Documents are scanned and parsed once; good and rejected rows lie in folders of their own.
    """
    bad = F.col("reject_reason").isNotNull()
    checked = node_defaults(check_nodes(docs, salt, network)).drop("effective_server_id")
    checked.withColumn("rejected", bad).write.partitionBy("rejected").parquet(path)
    stored = docs.sparkSession.read.schema(checked.schema.add("rejected", "boolean")).parquet(path)
    good = stored.filter(~F.col("rejected")).drop("node_json", "reject_reason", "rejected")
    rejected = stored.filter("rejected").select("cluster_id", "pos", "node_json", "reject_reason")
    return good, rejected


def encode_cluster_docs(clusters: DataFrame, nodes: DataFrame, width: int = 4096) -> DataFrame:
    """One JSON text per cluster with its nodes in order and nulls written out.

    Nodes become text row by row, are joined to pieces per chunk of positions, and the pieces to
    the document. Only the finished text of one document meets in a task, and that is the record
    to be written.
    """
    options = {"ignoreNullFields": "false"}
    node = F.to_json(F.struct(*[key for key in fv.NODE_KEYS if key in nodes.columns]), options)
    texts = nodes.select("cluster_id", "pos", "role", node.alias("node"))
    pieces = (
        texts.groupBy("cluster_id", "role", number_chunk("pos", width).alias("piece"))
        .agg(F.expr("listagg(node, ',') WITHIN GROUP (ORDER BY pos)").alias("node"))
        .groupBy("cluster_id")
        .agg(
            F.max(F.when(F.col("role") == fv.ROLE_PRIMARY, F.col("node"))).alias("primary"),
            F.expr(
                f"listagg(node, ',') WITHIN GROUP (ORDER BY piece) "
                f"FILTER (WHERE role = '{fv.ROLE_SECONDARY}')"
            ).alias("secondaries"),
        )
    )
    head = F.to_json(F.struct(*[key for key in fv.DOCUMENT_KEYS if key in clusters.columns]), options)
    return (
        clusters.withColumn("_head", F.rtrim(head, F.lit("}")))
        .join(pieces, "cluster_id", "left")
        .select(
            "cluster_id",
            F.concat(
                "_head",
                F.lit(',"primary":'),
                F.coalesce("primary", F.lit("null")),
                F.lit(',"secondaries":['),
                F.coalesce("secondaries", F.lit("")),
                F.lit("]}"),
            ).alias("doc"),
        )
    )


def write_cluster_docs(clusters: DataFrame, nodes: DataFrame, path: str) -> None:
    """Write the documents as text, one per line."""
    encode_cluster_docs(clusters, nodes).select("doc").write.text(path)
