"""Exact top-k search: tiled matrix products, partial selection per tile, merging in a tree.

Queries and rows are dealt into blocks of bounded size.  Each pair of a query block and a row block
is one tile: its task multiplies two matrices, a few hundred queries at a time, and keeps the best
``k`` of each query.  Lists of one query are then merged ``FAN_IN`` at a time until one is left, so
that no task gathers more than ``FAN_IN * k`` rows of a query.

Defined cases: a vector that is NULL, empty, or holds a NULL or non-finite component takes no part; a
row without id takes no part; vectors of different lengths are not compared.  An id stands for one
vector: rows with the id of the query are its own and no candidates.  Repeated rows are repeated
candidates; repeated query rows are one query (the first by vector).  Ties go to the smaller id.
Scores outside 64 bits are clipped to its ends.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import pin, read

#: Queries and rows of a tile; bounds the memory of its task, not the result.
QUERY_BLOCK = 4096
ROW_BLOCK = 16384
#: Queries multiplied at a time: 128 x 16384 products of 8 bytes are 16 MB.
STRIP = 128
FAN_IN = 16
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def quantised(column: Column, scale: int) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def usable(column: Column) -> Column:
    """No NULL, NaN or infinity inside, and not empty."""
    bad = F.exists(
        column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    return column.isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers; in doubles where these are exact."""
    with np.errstate(over="ignore"):
        bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in rows], dtype=object)
    wanted = np.array([[int(x) for x in q] for q in queries], dtype=object)
    ends = np.iinfo(np.int64)
    return np.array([[min(max(v, ends.min), ends.max) for v in line] for line in wanted @ whole.T], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        if len(tied) > k - len(chosen):
            tied = tied[np.argpartition(ids[tied], k - len(chosen) - 1)[: k - len(chosen)]]
        chosen = np.concatenate([chosen, tied])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def _tile(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple]:
    """Best rows of ``right`` for each query of ``left``."""

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)

    query_ids, queries = matrix(left)
    ids, rows = matrix(right)
    for at in range(0, len(query_ids), STRIP):
        scores = _scores(queries[at : at + STRIP], rows)
        for query, line in zip(query_ids[at : at + STRIP], scores):
            others = np.flatnonzero(ids == query)
            if len(others):
                keep = np.setdiff1d(np.arange(len(ids)), others, assume_unique=True)
                best = keep[_best(line[keep], ids[keep], k)]
            else:
                best = _best(line, ids, k)
            yield query, ids[best], line[best]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best other rows for each query row."""
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("is_query")
    )
    rows = pin(
        named.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .withColumn("vector", quantised(F.col("vector"), scale))
        .withColumn("width", F.size("vector"))
    )
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = pin(queries.withColumn("width", F.size("vector")))
    n_queries, n_rows = queries.count(), rows.count()
    query_blocks = -(-max(n_queries, 1) // QUERY_BLOCK)
    row_blocks = -(-max(n_rows, 1) // ROW_BLOCK)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("vec_id", "vector", "width", block(query_blocks).alias("q"), every(row_blocks).alias("r"))
    right = rows.select("vec_id", "vector", "width", every(query_blocks).alias("q"), block(row_blocks).alias("r"))

    def tile(query_part: pa.Table, row_part: pa.Table) -> pa.Table:
        found = []
        if query_part.num_rows and row_part.num_rows:
            found = list(_tile(query_part, row_part, k))
        sizes = [len(ids) for _, ids, _ in found]
        block_no = row_part.column("r")[0].as_py() if row_part.num_rows else 0
        return pa.table(
            {
                "query_id": np.repeat(np.array([q for q, _, _ in found], dtype=np.int64), sizes),
                "vec_id": np.concatenate([i for _, i, _ in found] or [np.empty(0, np.int64)]),
                "score": np.concatenate([s for _, _, s in found] or [np.empty(0, np.int64)]),
                "part": np.full(sum(sizes), block_no, dtype=np.int32),
            }
        )

    keys = ("width", "q", "r")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        tile, "query_id long, vec_id long, score long, part int"
    )
    best_first = (F.col("score").desc(), F.col("vec_id"))
    while row_blocks > 1:
        row_blocks = -(-row_blocks // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        merged = Window.partitionBy("query_id", "part").orderBy(*best_first)
        lists = lists.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).drop("rank")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    return lists.select("query_id", ranked.alias("rank"), "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """Top 20 of every row whose id is divisible by 20, against all rows."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
    select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
    from v a join v b on a.vec_id % 20 = 0 and b.vec_id <> a.vec_id and len(a.q) = len(b.q)
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
        vec_id, score
    from scored
)
select * from ranked where rank <= 20
"""
