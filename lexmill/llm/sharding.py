"""K-d tree sharding: recursive splits at distributed weighted medians along the widest dimension.

Every row has some numeric dimensions and a weight (its bytes).  A node is split along the dimension
whose range in the node is widest against the whole table's range, at the row order (dimension, text
digest, id), where half of its weight lies before; nodes go on until they hold the weight of one leaf.
Medians are exact: a pass sums weights by at most ``FANOUT`` value ranges of every open node at once,
and the next pass looks only into the range with the median.  So only ``FANOUT`` sums per node reach the
driver, no rows move, and one table of splits (a row per node) is broadcast.

Rows of equal text lie next to each other in this order.  A cut that would fall inside such a group moves to
its nearer end, unless that misses the median by more than ``SLACK`` of a leaf (a hot group); then the group
is cut by id.

Defined cases: a NULL text weighs one byte and counts as an empty text; a NULL id sorts first; repeated rows
stay together; an empty table gives no rows; with fewer groups than leaves some leaves are empty; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, pin, read
from lexmill.operators.ranking import with_rank

FANOUT = 4096
SLACK = 0.02
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _values(spark, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    lines = ", ".join("(" + ", ".join(f"cast({v} as bigint)" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {lines} as t({names})")


class _Search:
    """The search for one node's cut: which column is refined, and what is fixed so far."""

    def __init__(self, node: int, dim: int, wanted: int, slack: float, low: int, high: int) -> None:
        self.node, self.dim, self.wanted, self.slack = node, dim, wanted, slack
        self.stage, self.low, self.high, self.fixed = 0, low, high, [0, 0]
        self.cut: tuple[int, ...] | None = None

    @property
    def shift(self) -> int:
        shift = 0
        while (self.high >> shift) - (self.low >> shift) >= FANOUT:
            shift += 1
        return shift

    def row(self) -> tuple[int, ...]:
        return self.node, self.dim, self.stage, *self.fixed, self.low, self.high, self.shift

    def take(self, sums: list) -> None:
        """Go into the value range that holds the wanted weight."""
        left = 0
        for part in sorted(sums, key=lambda r: r["range"]):
            if left + part["weight"] > self.wanted or part is sums[-1]:
                break
            left += part["weight"]
        inside = self.wanted - left
        lows, highs = part["lows"], part["highs"]
        if lows[self.stage] < highs[self.stage]:
            self.wanted, self.low, self.high = inside, lows[self.stage], highs[self.stage]
            return
        value = lows[self.stage]
        if self.stage == 2:
            self.cut = (*self.fixed, value, int(2 * inside >= part["weight"]))
            return
        if self.stage == 1 and min(inside, part["weight"] - inside) <= self.slack:
            after = 2 * inside >= part["weight"]
            self.cut = (self.fixed[0], value, MOST if after else LEAST, int(after))
            return
        self.fixed[self.stage] = value
        self.stage += 1
        self.wanted, self.low, self.high = inside, lows[self.stage], highs[self.stage]


def kd_leaves(rows: DataFrame, leaves: int) -> DataFrame:
    """Add ``shard`` (0 to leaves - 1) to rows of (dims array<long>, tie long, id long, weight long)."""
    spark = rows.sparkSession
    size = rows.select(F.size("dims")).head()
    if size is None:
        return rows.withColumn("shard", F.lit(0))
    axes = range(size[0])
    rows = pin(rows.withColumn("node", F.lit(0).cast("long")))
    spread: list[int] | None = None
    open_nodes = {0: leaves}
    while any(n > 1 for n in open_nodes.values()):
        chosen = [node for node, n in open_nodes.items() if n > 1]
        ranges = [f(F.element_at("dims", axis + 1)).alias(f"{f.__name__}{axis}") for f in (F.min, F.max) for axis in axes]
        stats = rows.where(F.col("node").isin(chosen)).groupBy("node").agg(F.sum("weight").alias("weight"), *ranges).collect()
        if spread is None:
            spread = [max(1, stats[0][f"max{axis}"] - stats[0][f"min{axis}"]) for axis in axes]
        searches = []
        for stat in stats:
            dim = max(axes, key=lambda axis: (stat[f"max{axis}"] - stat[f"min{axis}"]) / spread[axis])
            n = open_nodes[stat["node"]]
            slack = SLACK * stat["weight"] / n
            searches.append(_Search(stat["node"], dim, stat["weight"] * (n // 2) // n, slack, stat[f"min{dim}"], stat[f"max{dim}"]))
        while waiting := [search for search in searches if search.cut is None]:
            states = _values(spark, "node, dim, stage, v, t, low, high, shift", [search.row() for search in waiting])
            at = rows.join(F.broadcast(states), "node").withColumn("value", F.element_at("dims", (F.col("dim") + 1).cast("int")))
            at = at.where("(stage < 1 or value = v) and (stage < 2 or tie = t)")
            key = F.when(F.col("stage") == 0, F.col("value")).when(F.col("stage") == 1, F.col("tie")).otherwise(F.col("id"))
            at = at.withColumn("key", key).where("key between low and high")
            sums = at.groupBy("node", F.expr("shiftright(key, cast(shift as int))").alias("range")).agg(
                F.sum("weight").alias("weight"),
                *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("value", "tie", "id")),
            )
            sums = sums.select(
                "node", "range", "weight",
                F.array("min_value", "min_tie", "min_id").alias("lows"), F.array("max_value", "max_tie", "max_id").alias("highs"),
            )
            by_node: dict[int, list] = {}
            for part in sorted(sums.collect(), key=lambda r: r["range"]):
                by_node.setdefault(part["node"], []).append(part)
            for search in waiting:
                search.take(by_node[search.node])
        splits = _values(
            spark, "node, dim, right, v, t, d, with_d",
            [(s.node, s.dim, s.node + open_nodes[s.node] // 2, *s.cut) for s in searches],
        )
        value = F.element_at("dims", (F.col("dim") + 1).cast("int"))
        before_in_group = (F.col("id") < F.col("d")) | ((F.col("with_d") == 1) & (F.col("id") == F.col("d")))
        in_line = (F.col("tie") < F.col("t")) | ((F.col("tie") == F.col("t")) & before_in_group)
        before = (value < F.col("v")) | ((value == F.col("v")) & in_line)
        moved = rows.join(F.broadcast(splits), "node", "left")
        node = F.when(F.col("right").isNull() | before, F.col("node")).otherwise(F.col("right"))
        rows = pin(moved.withColumn("next", node).drop("node", "dim", "right", "v", "t", "d", "with_d").withColumnRenamed("next", "node"))
        open_nodes = {
            child: n for node, total in open_nodes.items() for child, n in ((node, total // 2), (node + total // 2, total - total // 2)) if n > 0
        }
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node")


def shard_documents(docs: DataFrame, leaves: int | None = None, leaf_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: ``leaves`` shards, or as many as hold ``leaf_bytes`` each."""
    text = as_text(text_col)
    size = F.octet_length(text).cast("long") + 1
    chars = F.length(text).cast("long")
    lines = F.length(F.regexp_replace(text, r"[^\n]+", "")).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("weight"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.array(size, chars, lines, size - 1 - chars).alias("dims"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("tie"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"),
    )
    rows = pin(rows)
    if leaves is None:
        total = rows.agg(F.sum("weight")).first()[0] or 0
        leaves = max(1, -(-total // leaf_bytes))
    placed = kd_leaves(rows, leaves).select("doc_id", F.col("weight").alias("size"), "text_crc32", "shard", "tie")
    order: list[Column] = [F.col("shard"), F.col("doc_id"), F.col("tie")]
    return with_rank(placed, order, "slot", "shard").drop("tie")


def op5_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = shard_documents(read(spark, sf_dir, "documents"), leaves=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
