"""Exact top-k inner-product search with a three-phase uniform threshold.

The components are cut into ``LISTS`` slices; a slice gives every query a list
of local scores, and a score is the sum over the lists.

1. Each list gives the query its ``DEPTH`` highest entries.  The entries seen are
   scored in full; the k-th best of these scores is a safe cutoff.
2. The cutoff goes to all lists.  An entry that reaches cutoff / LISTS in no list
   can't reach the cutoff in sum, so each list sends the entries that do.
3. Entries known in every list have their score and raise the cutoff.  Those
   that could still reach it with the lists they are missing from are
   resolved exactly; the others are dropped.

Equal vectors are searched once.  Lists are computed in blocks: a query block
meets every block of distinct vectors, as one matrix product.

Nothing that grows with the input goes through the driver: joins are told to
shuffle both sides (``merge``), since a stored table's compressed size says little
about what a broadcast of it takes.  What a phase knows of the queries goes to
their blocks first, so that pairs of blocks are never shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, written

LISTS = 2
#: Entries of a list that phase 1 gathers, as a multiple of k.
DEPTH = 8
QUERY_BLOCK, VECTOR_BLOCK = 512, 16384
LONG = 1 << 63
#: Sums of a list past a long are held at this bound (so that all lists together fit 38 digits).
WIDEST = (10 ** 38 - 1) // LISTS


def quantised(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q): floor(scale * component); vectors that are null or hold null or non-finite
    components, and rows without an id, are left out; a repeated id counts once, with its smallest vector.
    A component whose integer passes a long counts as the largest (or smallest) one."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q")))


def blocks(vectors: DataFrame, name: str, count: int) -> DataFrame:
    """(dim, b, <name>, items): the slices of (cls, q), gathered in ``count`` blocks of even size."""
    size = F.size("q")
    part = [F.slice("q", (size * F.lit(n) / LISTS).cast("int") + 1,
                    (size * F.lit(n + 1) / LISTS).cast("int") - (size * F.lit(n) / LISTS).cast("int")) for n in range(LISTS)]
    return (vectors.select(size.alias("dim"), block_of("cls", count).alias(name), "cls", F.posexplode(F.array(*part)).alias("b", "part"))
            .groupBy("dim", "b", name).agg(F.collect_list(F.struct("cls", "part")).alias("items")))


def block_of(col: str, count: int):
    return F.pmod(F.xxhash64(col, F.lit(1)), F.lit(count)).cast("int")


def pairs(queries: DataFrame, vectors: DataFrame, vector_blocks: int) -> DataFrame:
    """Every query block beside every vector block of its list."""
    return beside(queries.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)))), vectors)


def beside(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The query blocks, each meant for a vector block ``vb``, with its vectors."""
    return queries.withColumnRenamed("items", "queries").join(vectors.withColumnRenamed("items", "vectors").hint("merge"), ["dim", "b", "vb"])


def matrix(items: pa.Array, dim: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    ids = items.field("cls").to_numpy(zero_copy_only=False)
    width = dim * (b + 1) // LISTS - dim * b // LISTS
    return ids, items.field("part").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: doubles where they are exact, longs, else Python integers."""
    width = a.shape[1]
    top = max(1, width) * peak(a) * peak(b)
    if top < 1 << 24:
        return a.astype(np.float32) @ b.T.astype(np.float32)
    if top < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    if top < 1 << 61:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def peak(a: np.ndarray) -> int:
    return max(1, int(a.max(initial=0)), -int(a.min(initial=0)))


def rows_out(query: np.ndarray, cls: np.ndarray, b: int, local: np.ndarray, wide: bool) -> pa.RecordBatch:
    if wide:
        scores = pa.array([Decimal(max(-WIDEST, min(WIDEST, int(x)))) for x in local], pa.decimal128(38, 0))
    else:
        scores = pa.array(local.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(cls), pa.array(np.full(len(query), b, np.int32)), scores],
                                      names=["query", "cls", "b", "local"])


def rows_type(wide: bool) -> str:
    return f"query long, cls long, b int, local {'decimal(38,0)' if wide else 'long'}"


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (dim, b, queries, vectors, ...) as list number, ids and the block's local scores."""
    for batch in batches:
        for r in range(batch.num_rows):
            dim, b = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            qi, qm = matrix(batch.column(2)[r].values, dim, b)
            vi, vm = matrix(batch.column(3)[r].values, dim, b)
            yield batch, r, b, qi, vi, products(qm, vm)


def heads(both: DataFrame, depth: int, wide: bool) -> DataFrame:
    """Phase 1: the ``depth`` highest entries of each query in each list."""
    def run(batches):
        for _, _, b, qi, vi, s in each_pair(batches):
            n = min(depth, len(vi))
            at = np.argpartition(s, len(vi) - n, axis=1)[:, len(vi) - n:]
            yield rows_out(np.repeat(qi, n), vi[at].ravel(), b, np.take_along_axis(s, at, 1).ravel(), wide)
    found = both.select("dim", "b", "queries", "vectors").mapInArrow(run, rows_type(wide))
    best = Window.partitionBy("query", "b").orderBy(F.desc("local"), "cls")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= depth).drop("n")


def above(queries: DataFrame, vectors: DataFrame, limits: DataFrame, query_blocks: int, vector_blocks: int, wide: bool) -> DataFrame:
    """Phase 2: the entries at or over cutoff / LISTS, and at or over what the heads of the other lists leave open."""
    known = (limits.groupBy("dim", block_of("query", query_blocks).alias("qb"), "b")
             .agg(F.sort_array(F.collect_list(F.struct("query", "least"))).alias("least")))

    def run(batches):
        for batch, r, b, qi, vi, s in each_pair(batches):
            least = batch.column(4)[r].values
            ids = least.field("query").to_numpy(zero_copy_only=False)
            floor = least.field("least").to_numpy(zero_copy_only=False)[np.searchsorted(ids, qi)]
            x, y = np.nonzero(s >= floor[:, None])
            yield rows_out(qi[x], vi[y], b, s[x, y], wide)
    both = pairs(queries.join(known.hint("merge"), ["dim", "b", "qb"]), vectors, vector_blocks)
    return both.select("dim", "b", "queries", "vectors", "least").mapInArrow(run, rows_type(wide))


def resolve(queries: DataFrame, vectors: DataFrame, wanted: DataFrame, query_blocks: int, vector_blocks: int, wide: bool) -> DataFrame:
    """(query, cls, score): exact scores of the pairs ``wanted`` (dim, query, cls)."""
    asked = (wanted.groupBy("dim", block_of("query", query_blocks).alias("qb"), block_of("cls", vector_blocks).alias("vb"))
             .agg(F.collect_list(F.struct("query", "cls")).alias("asked")))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim, b = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                qi, qm = matrix(batch.column(2)[r].values, dim, b)
                vi, vm = matrix(batch.column(3)[r].values, dim, b)
                pair = batch.column(4)[r].values
                query, cls = (pair.field(k).to_numpy(zero_copy_only=False) for k in ("query", "cls"))
                qo, vo = np.argsort(qi), np.argsort(vi)
                x, y = qo[np.searchsorted(qi[qo], query)], vo[np.searchsorted(vi[vo], cls)]
                for k in range(0, len(query), 1 << 16):
                    a, c = qm[x[k:k + (1 << 16)]], vm[y[k:k + (1 << 16)]]
                    yield rows_out(query[k:k + (1 << 16)], cls[k:k + (1 << 16)], b, pairwise(a, c), wide)
    both = beside(asked.join(queries.hint("merge"), ["dim", "qb"]), vectors)
    found = both.select("dim", "b", "queries", "vectors", "asked").mapInArrow(run, rows_type(wide))
    return found.groupBy("query", "cls").agg(F.sum("local").alias("score"))


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if max(1, a.shape[1]) * peak(a) * peak(b) < 1 << 61:
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(object) * b.astype(object)).sum(axis=1)


def best(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def topk_search(df: DataFrame, is_query, k: int, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row.

    ``is_query`` is a condition on the column ``vec_id``.  Candidates are all
    rows but the query's own; ties go to the smaller vec_id; fewer than k
    candidates are all returned.  Only vectors of the same length are compared.
    See ``quantised`` for rows that take no part.  Scores are exact and
    ranks follow them: sums that may pass 61 bits are decimals, held only at 5 * 10 ** 37
    a list.  A score that passes a long is given as the largest (or smallest) one.
    """
    rows = written(quantised(df, scale, id_col, vec_col), "vectors")
    first = Window.partitionBy("q").orderBy("vec_id")
    members = (rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
               .groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    counted = rows.groupBy("q").agg(F.min("vec_id").alias("cls"), F.count("*").alias("rows"), F.count_if(is_query).alias("asks"))
    classes = written(counted.join(members.hint("merge"), "q"), "vector-classes")
    size = F.array_max(F.transform("q", lambda x: F.abs(x.cast("decimal(20,0)"))))
    total, asking, asks, top, longest = classes.agg(
        F.count("*"), F.count_if(F.col("asks") > 0), F.sum("asks"), F.max(size), F.max(F.size("q"))).first()
    wide = int(top or 0) ** 2 * max(1, longest or 0) >= 1 << 61
    vector_blocks, query_blocks = max(1, -(-total // VECTOR_BLOCK)), max(1, -(-asking // QUERY_BLOCK))
    queries = written(blocks(classes.filter("asks > 0").select("cls", "q"), "qb", query_blocks), "query-blocks")
    vectors = written(blocks(classes.select("cls", "q"), "vb", vector_blocks), "vector-blocks")
    dims = classes.filter("asks > 0").select(F.col("cls").alias("query"), F.size("q").alias("dim")).hint("merge")

    head = written(heads(pairs(queries, vectors, vector_blocks), DEPTH * (k + 1), wide), "heads")
    wanted = head.select("query", "cls").distinct().join(dims, "query")
    seen = written(resolve(queries, vectors, wanted, query_blocks, vector_blocks, wide), "seen")
    cutoff = written(best(seen, k + 1).groupBy("query").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("cutoff")), "cutoffs")
    tops = head.groupBy("query", "b").agg(F.max("local").alias("top"))
    others = tops.withColumn("all", F.sum("top").over(Window.partitionBy("query"))).join(cutoff.hint("merge"), "query")
    # a list sends what is at or over ``share``; what it leaves out is under ``left_out``
    if wide:
        share, lowest, kind = F.floor(F.col("cutoff") / F.lit(LISTS)) - 1, Decimal(-10 ** 38 + 1), "decimal(38,0)"
        left_out = share + 2
    else:  # rounded up, less what a double may be off beyond 52 bits
        share, lowest, kind = F.ceil(F.col("cutoff") / F.lit(LISTS)).cast("long") - F.shiftright(F.abs("cutoff"), 52), -LONG, "long"
        left_out = share + 2 * F.shiftright(F.abs("cutoff"), 52)
    least = F.greatest(share.cast(kind), (F.col("cutoff") - F.col("all") + F.col("top")).cast(kind))
    limits = others.select("query", "b", F.coalesce(least, F.lit(lowest)).cast(kind).alias("least")).join(dims, "query")

    entries = written(above(queries, vectors, limits, query_blocks, vector_blocks, wide).groupBy("query", "cls")
                      .agg(F.sum("local").alias("score"), F.count("*").alias("lists")), "entries")
    whole = entries.filter(F.col("lists") == LISTS).select("query", "cls", "score").unionByName(seen).distinct()
    raised = best(whole, k + 1).groupBy("query").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("raised"))
    # where a list left an entry out, it is under the cutoff's share there, or it can't reach the cutoff at all
    bound = F.col("score") + (LISTS - F.col("lists")) * left_out
    open_ = (entries.filter(F.col("lists") < LISTS).join(cutoff.hint("merge"), "query").join(raised.hint("merge"), "query")
             .filter(F.col("raised").isNull() | F.col("cutoff").isNull() | (bound >= F.col("raised")))
             .select("query", "cls").join(dims, "query").join(seen.select("query", "cls").hint("merge"), ["query", "cls"], "left_anti"))
    scored = whole.unionByName(resolve(queries, vectors, open_, query_blocks, vector_blocks, wide))

    found = best(scored, k + 1).join(classes.select("cls", "ids").hint("merge"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    found = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "q")
    named = classes.filter("asks > 0").select("q", F.col("cls").alias("query"), F.col("asks").alias("rows"))
    lists = named.select("q", "query", "rows").join(found.hint("merge"), "query").select("q", "found", "rows")
    score = F.least(F.greatest(F.col("hit.score"), F.lit(str(-LONG)).cast("decimal(38,0)")), F.lit(str(LONG - 1)).cast("decimal(38,0)"))
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (join_unique(asked, lists, "q", "rows", asks or 0)
            .select("query_id", F.posexplode(own).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (score if wide else F.col("hit.score")).cast("long").alias("score")))
