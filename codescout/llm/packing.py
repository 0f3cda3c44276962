"""Problem 7: filling containers of fixed capacity by bulk-synchronous best fit.

As many containers are opened as the sizes need at least. Each superstep range-sorts the documents without a
place and the gaps of the containers by size, over all tasks, and sweeps from the largest size down: gaps are
laid on a stack, and each document takes the gap on top, which is its successor, the smallest gap that is
large enough and that no larger document has taken. A gap of several times the largest document enters the
sweep as that many shares. Each task sweeps its own range; what is left in it, documents at its upper end and
gaps at its lower end, is matched over the borders: the tasks' counts are carried along, the i-th left document
of a range gets the gap of the i-th rank from the top of the carried stack, so no two get the same one. For the same
documents and gaps the matching is the same for every number of tasks. Then the gaps are updated, and the next
superstep begins.

When no gap takes a document, the containers with a gap give back their smallest documents for another
series of supersteps, as long as this saves a container. What is left then gets new containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescout.llm.tokenizer import TOKENIZER_DIR, encode_corpus
from codescout.session import cut

CAPACITY = 2048
#: Rows that one task sweeps, about. It decides the number of tasks, not the result.
TASK_ROWS = 50_000
#: Documents that a container with a gap gives back.
GIVEN_BACK = 3
#: Supersteps after which the gaps are written anew (until then they are summed from what was taken).
CUT_AFTER = 4
_SWEPT = "item long, piece int, size int, container_id long, is_gap boolean, part int, at long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's range, from the largest size down: rows (item, piece, size, container_id, is_gap).

    Gives each document with its container, or without one and with its rank among such documents of the task;
    then the gaps that no document took, with their height on the stack.
    """
    names = ["item", "piece", "size", "container_id", "is_gap", "part", "at"]
    part, left, stack = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        rows, owners, ranks = [], [], []
        for row, (is_gap, container) in enumerate(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if is_gap:
                stack.append(container)
                continue
            rows.append(row)
            owners.append(stack.pop() if stack else None)
            ranks.append(None if owners[-1] is not None else left)
            left += owners[-1] is None
        kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(owners, pa.int64()), pa.array([False] * len(rows), pa.bool_()), pa.array([part] * len(rows), pa.int32()), pa.array(ranks, pa.int64())], names=names)
    n = len(stack)
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(stack, pa.int64()), pa.array([True] * n, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int64())], names=names)


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, first, last, gap_part, top) from the (part, documents, gaps) that the tasks have left, in their order.

    Document i of a part, first <= i < last, takes the gap at height top - (i - first) of gap_part.
    """
    out, stack = [], []
    for part, docs, gaps in sorted(left):
        first = 0
        while first < docs and stack:
            below, height = stack.pop()
            n = min(docs - first, height)
            out.append((part, first, first + n, below, height - 1))
            first += n
            if height > n:
                stack.append((below, height - n))
        if gaps:
            stack.append((part, gaps))
    return out


def superstep(docs: DataFrame, gaps: DataFrame, largest: int, smallest: int, tasks: int) -> tuple[DataFrame, int, int, int]:
    """(item, piece, size, container_id) of every document of docs (item, piece, size), with a container where one took it.

    With it the number of documents without a container, and bounds of their sizes from above and below.
    gaps: (container_id, gap). No container gets more than its gap.
    """
    spark = docs.sparkSession
    shares = gaps.crossJoin(F.broadcast(_rows(spark, largest=[largest], smallest=[smallest]))).where("gap >= smallest")
    shares = shares.withColumn("n", F.greatest(F.floor(F.col("gap") / F.col("largest")), F.lit(1)).cast("int"))
    shares = shares.select(F.lit(None).cast("long").alias("item"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("piece"), F.floor(F.col("gap") / F.col("n")).cast("int").alias("size"), "container_id", F.lit(True).alias("is_gap"))
    pool = docs.select("item", "piece", "size", F.lit(None).cast("long").alias("container_id"), F.lit(False).alias("is_gap")).unionByName(shares)
    order = [F.desc("size"), F.desc("is_gap"), F.xxhash64("item", "container_id", "piece")]
    swept = cut(pool.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(sweep, _SWEPT))
    left = swept.where("at is not null").groupBy("part").agg(F.count_if(~F.col("is_gap")), F.count_if("is_gap"), F.max("size"), F.min("size")).collect()  # a row for each task
    segments = carried([(part, docs_left, gaps_left) for part, docs_left, gaps_left, _, _ in left])
    taken: dict[int, int] = {}
    for part, first, last, _, _ in segments:
        taken[part] = taken.get(part, 0) + last - first
    alone = [r for r in left if r[1] > taken.get(r[0], 0)]
    table = _rows(spark, **{name: [s[i] for s in segments] for i, name in enumerate(("p", "first", "last", "gap_part", "top"))})
    open_docs = swept.where("not is_gap and at is not null").select("item", "piece", "size", "part", "at")
    met = open_docs.join(F.broadcast(table), (F.col("part") == F.col("p")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")), "left")
    # A document meets the gap of its rank in one aggregation; without a gap it has a key of its own.
    place = [F.coalesce("gap_part", "part").alias("a"), F.when(F.col("gap_part").isNull(), -1 - F.col("at")).otherwise(F.col("top") - F.col("at") + F.col("first")).alias("b")]
    met = met.select(*place, "item", "piece", "size", F.lit(None).cast("long").alias("container_id"))
    free = swept.where("is_gap").select(F.col("part").cast("long").alias("a"), F.col("at").alias("b"), "item", "piece", "size", "container_id")
    over = met.unionByName(free).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("item", "piece", "size", "container_id"))).where("size is not null")
    done = swept.where("not is_gap and at is null").select("item", "piece", "size", "container_id")
    step = cut(done.unionByName(over.select("item", "piece", "size", "container_id")))
    return step, sum(r[1] - taken.get(r[0], 0) for r in alone), max((r[3] for r in alone), default=0), min((r[4] for r in alone), default=0)


def _rows(spark: SparkSession, **columns: list[int]) -> DataFrame:
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()}))


def _state(docs: DataFrame, capacity: int) -> tuple[int, int, int, int, int]:
    """Number, sum, largest and smallest size of the documents, and the number that no two share a container."""
    return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.min("size"), F.lit(0)), F.count_if(F.col("size") > capacity // 2)).first())


def _filled(gaps: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """The gaps after what the containers have taken."""
    if not taken:
        return gaps
    used = _union(taken).groupBy("container_id").agg(F.sum("size").alias("used"))
    return gaps.join(used, "container_id", "left").select("container_id", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_ids", capacity: int = CAPACITY, tasks: int | None = None) -> DataFrame:
    """(id, piece, size, container_id): each item whole in one container; no container over `capacity`.

    An item longer than the capacity comes as consecutive pieces 0, 1, ... of `capacity` and a rest, each in
    a container; every other item has the one piece 0. Sizes that are null or negative count as 0; items of
    size 0 take no room and lie in any of the containers. Repeated ids are items of their own. An empty table
    gives an empty result.
    """
    spark = sizes.sparkSession
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("int"), F.lit(0))
    pieces = F.greatest(F.ceil(size / F.lit(capacity)), F.lit(1)).cast("int")
    items = sizes.select(F.col(id_col).cast("long").alias("item"), size.alias("whole"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = cut(items.select("item", "piece", F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size")))
    docs = items.where("size > 0")
    opened = lambda low, high: spark.range(low, high).select(F.col("id").alias("container_id"), F.lit(capacity).alias("gap"))
    left, room, largest, smallest, large = _state(docs, capacity)
    containers = max(-(-room // capacity), large)
    gaps, placed, recent, before = opened(0, containers), [], [], None
    while left:
        had = left
        step, left, largest, smallest = superstep(docs, _filled(gaps, recent), largest, smallest, tasks or max(2, -(-left // TASK_ROWS)))
        docs = step.where("container_id is null").select("item", "piece", "size")
        if left < had:
            recent.append(step.where("container_id is not null"))
            placed.append(recent[-1])
            if len(recent) == CUT_AFTER:
                gaps, recent = cut(_filled(gaps, recent)), []
            continue
        gaps, recent = cut(_filled(gaps, recent)), []
        left, room, largest, smallest, large = _state(docs, capacity)
        lacking = max(-(-room // capacity), large)
        if before is None or lacking < before[0]:
            before = (lacking, containers, docs, gaps, placed)
            docs, gaps, placed = _give_back(docs, gaps, placed)
        else:  # giving back saved nothing more: new containers
            if lacking > before[0] > 0:
                lacking, containers, docs, gaps, placed = before
            gaps = cut(gaps.unionByName(opened(containers, containers + lacking)))
            containers, before = containers + lacking, (0,)
        left, room, largest, smallest, large = _state(docs, capacity)
    empty = items.where("size = 0").select("item", "piece", "size", F.pmod(F.xxhash64("item"), F.lit(max(containers, 1))).alias("container_id"))
    return _union([empty, *placed]).select(F.col("item").alias(id_col), "piece", "size", "container_id")


def _give_back(docs: DataFrame, gaps: DataFrame, placed: list[DataFrame]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The state in which each container with a gap has lost its smallest documents. A container holds at most `capacity` of them."""
    smallest = Window.partitionBy("container_id").orderBy("size", "item", "piece")
    open_ = gaps.where("gap > 0").select("container_id", F.lit(True).alias("has_gap"))
    all_placed = _union(placed).join(open_, "container_id", "left")
    ranked = cut(all_placed.where("has_gap").drop("has_gap").withColumn("nth", F.row_number().over(smallest)))
    back = ranked.where(F.col("nth") <= GIVEN_BACK)
    kept = cut(all_placed.where("has_gap is null").select("item", "piece", "size", "container_id").unionByName(ranked.where(F.col("nth") > GIVEN_BACK).select("item", "piece", "size", "container_id")))
    room = back.groupBy("container_id").agg(F.sum("size").alias("room"))
    gaps = cut(gaps.join(room, "container_id", "left").select("container_id", (F.col("gap") + F.coalesce("room", F.lit(0))).cast("int").alias("gap")))
    return cut(docs.unionByName(back.select("item", "piece", "size"))), gaps, [kept]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Containers of documents, each as long as its text is in ids; see pack()."""
    return pack(encode_corpus(docs, tokenizer_dir=tokenizer_dir, keep_ids=False), capacity=capacity)
