"""Hash trees over key ranges: find where a copy differs from its source, and copy only that.

A leaf is a range of ``width`` consecutive keys; a node of level n + 1 covers ``fanout`` nodes of
level n. A node holds the number of its rows and two order-free hashes of them, so a parent is the
sum of its children and a table is read once for its tree. Keys are integers (for others, take
``xxhash64`` of the key as a key column). Rows without a key make a range of their own, whose number
is null at every level.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.changes import row_hash

HASHES = ("row_count", "hash_xor", "hash_sum")
NODE = "node long, row_count long, hash_xor long, hash_sum decimal(38,0)"
#: Differing stretches of keys up to this number are read by a filter that reaches the files;
#: more are read by a join with the table of ranges.
FEW_STRETCHES = 64


def floor_div(number: Column, by: int) -> Column:
    """Whole-number quotient rounded down, exact for every 64-bit number."""
    quotient = F.call_function("div", number, F.lit(by))
    below = (number < 0) & (F.pmod(number, F.lit(by)) != 0)
    return F.when(below, quotient - 1).otherwise(quotient)


def leaf_hashes(rows: DataFrame, key: str, width: int) -> DataFrame:
    """One row per key range that holds rows; combined before the shuffle, so a hot range is no load."""
    digest = row_hash(rows)
    return rows.groupBy(floor_div(F.col(key), width).alias("node")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(digest).alias("hash_xor"),
        F.sum(digest.cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"),
    )


def grow(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """All levels of the tree above ``leaves``: (level, node) with the sums of what lies below."""
    levels = [
        F.struct(F.lit(n).alias("level"), floor_div(F.col("node"), fanout**n).alias("node"))
        for n in range(height + 1)
    ]
    return (
        leaves.select(F.inline(F.array(*levels)), *HASHES)
        .groupBy("level", "node")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.bit_xor("hash_xor").alias("hash_xor"),
            F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"),
        )
    )


def store_tree(tree: DataFrame, path: str) -> DataFrame:
    """Write a tree, a folder per level with nodes in order, so that a comparison reads few of them."""
    ordered = tree.repartitionByRange("level", "node").sortWithinPartitions("level", "node")
    ordered.write.mode("errorifexists").partitionBy("level").parquet(path)
    return tree.sparkSession.read.schema(f"{NODE}, level int").parquet(path)


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """The nodes of both sides below each other; the right side's count negatively."""
    return left.withColumn("sign", F.lit(1)).unionByName(right.withColumn("sign", F.lit(-1)))


def _differing(sides: DataFrame) -> DataFrame:
    """Nodes whose count or hashes differ between the sides; a side without a node has no rows."""
    return (
        sides.groupBy("node")
        .agg(
            F.sum(F.when(F.col("sign") == 1, F.col("row_count")).otherwise(0)).alias("left_rows"),
            F.sum(F.when(F.col("sign") == -1, F.col("row_count")).otherwise(0)).alias("right_rows"),
            F.bit_xor("hash_xor").alias("_xor"),
            F.sum(F.when(F.col("sign") == 1, F.col("hash_sum")).otherwise(-F.col("hash_sum"))).alias("_sum"),
        )
        .filter("left_rows <> right_rows OR _xor <> 0 OR _sum <> 0")
        .select("node", "left_rows", "right_rows")
    )


def differing_ranges(left: DataFrame, right: DataFrame, fanout: int, height: int) -> DataFrame:
    """Leaves (node, left_rows, right_rows) that differ between two trees of the same shape.

    Compared from the top: of each level only the children of differing nodes are looked at.
    """
    sides = _sides(left, right)
    found = _differing(sides.filter(F.col("level") == height))
    for level in range(height - 1, -1, -1):
        parents = found.select(F.col("node").alias("_parent"))
        below = floor_div(F.col("node"), fanout).eqNullSafe(F.col("_parent"))
        found = _differing(sides.filter(F.col("level") == level).join(parents, below, "left_semi"))
    return found


def stretches(ranges: DataFrame, width: int) -> DataFrame:
    """Key intervals (low, high) that ``ranges`` cover, neighbours merged; the null range is left out.

    Runs of neighbours are found within blocks of ranges, so no task orders all of them; a run over
    the end of a block gives two intervals.
    """

    def edge(key: Column) -> Column:
        # The first and last range may reach over the 64-bit keys.
        low, high = (F.lit(bound).cast("decimal(38,0)") for bound in (-(1 << 63), (1 << 63) - 1))
        return F.greatest(F.least(key, high), low).cast("long")

    block = floor_div(F.col("node"), 1 << 16)
    order = Window.partitionBy("_block").orderBy("node")
    return (
        ranges.filter("node IS NOT NULL")
        .select("node", block.alias("_block"))
        .distinct()
        .withColumn("_run", F.col("node") - F.row_number().over(order))
        .groupBy("_block", "_run")
        .agg(
            edge(F.min("node").cast("decimal(38,0)") * width).alias("low"),
            edge(F.max("node").cast("decimal(38,0)") * width + (width - 1)).alias("high"),
        )
        .select("low", "high")
    )


def in_ranges(rows: DataFrame, key: str, width: int, ranges: DataFrame) -> DataFrame:
    """Rows whose key lies in one of the ranges. Few stretches of keys become a filter of the scan."""
    few = stretches(ranges, width).limit(FEW_STRETCHES + 1).collect()
    if len(few) <= FEW_STRETCHES:
        wanted = F.lit(False)
        if not ranges.filter("node IS NULL").isEmpty():
            wanted = F.col(key).isNull()
        for low, high in few:
            wanted = wanted | F.col(key).between(low, high)
        return rows.filter(wanted)
    nodes = ranges.select(F.col("node").alias("_node"))
    return rows.join(nodes, floor_div(F.col(key), width).eqNullSafe(F.col("_node")), "left_semi")


class RangedCopy:
    """A copy of a table kept by key range, brought up to date by copying only ranges that differ.

    Rows lie in ``rows/_version=v/_part=p``, a folder per range. ``ranges`` tells the version and the
    hashes of each range and only grows; the newest version of a range counts. A range is
    listed after its rows are written and read back, so what an interrupted run did not list is
    copied again and what it listed is kept. Ranges should hold some hundred megabytes.
    """

    LISTED = f"{NODE}, version long"

    def __init__(self, path: str, schema: T.StructType, key: str, width: int):
        self.path, self.schema, self.key, self.width = path, schema, key, width

    def _listed(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(self.LISTED).parquet(f"{self.path}/ranges")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.LISTED)

    def ranges(self, spark: SparkSession) -> DataFrame:
        """Leaf hashes of what the copy holds, with the version of each range."""
        newest = F.max_by(F.struct(*HASHES, "version"), "version").alias("_newest")
        held = self._listed(spark).groupBy("node").agg(newest).select("node", "_newest.*")
        return held.filter("row_count > 0")

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([*self.schema]).add("_version", "long").add("_part", "string")
        return spark.read.schema(schema).parquet(f"{self.path}/rows")

    @staticmethod
    def _part(node: Column) -> Column:
        return F.coalesce(node.cast("string"), F.lit("none"))

    def read(self, spark: SparkSession) -> DataFrame:
        held = self.ranges(spark).select(
            self._part(F.col("node")).alias("_part"), F.col("version").alias("_version")
        )
        if held.isEmpty():
            return spark.createDataFrame([], self.schema)
        return self._stored(spark).join(held, ["_part", "_version"], "left_semi").select(*self.schema.names)

    def differing(self, leaves: DataFrame) -> DataFrame:
        """Ranges in which the copy differs from the leaves of its source."""
        held = self.ranges(leaves.sparkSession).drop("version")
        return _differing(_sides(leaves, held))

    def update(self, source: DataFrame, leaves: DataFrame, steps: int = 1) -> None:
        """Copy all differing ranges of ``source``, whose leaf hashes are ``leaves``.

        The ranges are dealt to ``steps`` parts, each listed when it is done; a run that was stopped
        goes on with what is not listed. Fails if what was written is not what ``leaves`` say.
        """
        spark = source.sparkSession
        for step in range(steps):
            mine = F.pmod(F.xxhash64("node"), F.lit(steps)) == step
            todo = self.differing(leaves).filter(mine).persist()
            try:
                if not todo.isEmpty():
                    self._copy(spark, source, leaves, todo)
            finally:
                todo.unpersist()

    def _copy(self, spark: SparkSession, source: DataFrame, leaves: DataFrame, todo: DataFrame) -> None:
        version = (self._listed(spark).agg(F.max("version")).first()[0] or 0) + 1
        folder = f"{self.path}/rows/_version={version}"
        node = floor_div(F.col(self.key), self.width)
        # Rows of a range come together, and Spark splits a range that is far larger than others.
        in_ranges(source.select(*self.schema.names), self.key, self.width, todo).withColumn(
            "_part", self._part(node)
        ).hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(folder)
        back = self._stored(spark).filter(F.col("_version") == version).select(*self.schema.names)
        written = leaf_hashes(back, self.key, self.width)
        same = F.col("node").eqNullSafe(F.col("_node"))
        todo = todo.select(F.col("node").alias("_node"))
        if not _differing(_sides(leaves.join(todo, same, "left_semi"), written)).isEmpty():
            raise ValueError(f"copy at {folder} differs from its source")
        # A range without rows any more is listed with none.
        emptied = todo.join(written.select("node"), same, "left_anti").select(
            F.col("_node").alias("node"),
            F.lit(0).cast("long").alias("row_count"),
            F.lit(0).cast("long").alias("hash_xor"),
            F.lit(0).cast("decimal(38,0)").alias("hash_sum"),
        )
        written.unionByName(emptied).withColumn("version", F.lit(version).cast("long")).write.mode(
            "append"
        ).parquet(f"{self.path}/ranges")
