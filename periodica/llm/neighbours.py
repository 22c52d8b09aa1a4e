"""Approximate nearest neighbours by cosine: NN-descent builds the graph, queries walk it greedily.

Equal vectors are one node, so a vector that a third of the rows share is one node too; a node keeps as many
of its smallest ids as a result can name. The graph starts from neighbours along sorted random projections
and is refined by rounds of Spark joins: the neighbours of a node, forward and backward, meet at that node and are
proposed to each other if nearer than what they have. Similarities
are computed from the original vectors in double precision, while the graph is built and for the reported scores.

A query is a beam search: its node's neighbours are scored, the best not yet expanded are expanded by a join
with the graph, until the best ``BEAM`` are all expanded. State is a table of (query, node), one row each.

A node keeps its ``MEETING`` nearest neighbours and takes proposals nearer than the ``DEGREE``-th; its visitors meet ``ARRIVALS`` at a
time, and rounds end when at most ``SETTLED`` of the edges are new: that is what makes the search approximate. Every row is indexed; tests measure recall against brute force.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those of a length
other than the commonest; of rows that repeat an id the smallest vector counts; a null id takes no part; fewer candidates than asked
for are all returned, and a query whose walk meets too few is answered by a scan of all rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import cut

DEGREE = 20
MEETING = 36
ARRIVALS = 64
#: Rounds go on until fewer than this share of the edges is new, hops until nothing waits; the bounds only stop a fault.
SETTLED = 0.02
ROUNDS = 40
PROJECTIONS = 6
PLANES = 48
GROUPINGS = 2
LEAF = 256
STRIDE = 3
BEAM = 48
BLOCK = 500
HOPS = 60


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part, one for each id."""
    vec = F.col("embedding")
    usable = (
        rows.where(F.col("vec_id").isNotNull() & vec.isNotNull())
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vec, lambda x: x.cast("float")).alias("vec"))
        .where(
            (F.size("vec") > 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
            & F.exists("vec", lambda x: x != 0)
        )
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
        .withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)))
    )
    usable = cut(usable, "vectors")
    common = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if common is not None:
        usable = usable.where(F.size("vec") == common.n)
    return usable


def nodes(usable: DataFrame, k: int) -> DataFrame:
    """(node, vec, ids): distinct vectors, named by their smallest id, with the ``k + 1`` smallest of their ids."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = usable.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return cut(grouped.select(F.col("ids")[0].alias("node"), "vec", "ids"), "nodes")


def _with_codes(points: DataFrame, seed: int) -> DataFrame:
    """(node, code, signs, p0, p1, ...): the vector as bytes, the sides of random planes it is on, projections."""
    names = [f"p{i}" for i in range(PROJECTIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            drawn = np.random.default_rng(seed).normal(size=(x.shape[1], PROJECTIONS + PLANES))
            p = x @ drawn[:, :PROJECTIONS]
            signs = ((x @ drawn[:, PROJECTIONS:] > 0) << np.arange(PLANES)).sum(axis=1)
            # The values themselves, 32 bits each as they came: steps would make near copies of a vector tie.
            code = _matrix(batch.column("vec"), np.float32)
            columns = [batch.column("node"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(signs)]
            columns += [pa.array(p[:, i]) for i in range(PROJECTIONS)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "code", "signs", *names])

    return points.select("node", "vec").mapInArrow(run, f"node bigint, code binary, signs bigint, {', '.join(f'{n} double' for n in names)}")


def _units(codes: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(codes), np.float32).reshape(len(codes), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code_cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    return (_units(a) * _units(b)).sum(1)


def _start(coded: DataFrame) -> DataFrame:
    """(u, v, sim): for each projection the nodes that follow in its order, within a leaf of about ``LEAF`` nodes on one side of some planes,

    and for ``GROUPINGS`` more within groups drawn by hash."""
    bits = min(PLANES - 1, max(0, int(np.log2(max(1, coded.count() / LEAF)))))
    mask = F.lit((1 << bits) - 1)
    # Groups drawn by hash join what the leaves part: a node alone in all of its leaves gets edges there.
    groups = F.lit(1 << bits)
    drawn = [
        F.struct(F.lit(PROJECTIONS + i).alias("i"), F.pmod(F.xxhash64(F.lit(i), "node"), groups).alias("leaf"), F.col(f"p{i}").alias("at"))
        for i in range(GROUPINGS)
    ]
    orders = F.array(
        *drawn,
        *(
            F.struct(
                F.lit(i).alias("i"),
                F.shiftright("signs", i * (PLANES - bits) // PROJECTIONS).bitwiseAND(mask).cast("bigint").alias("leaf"),
                F.col(f"p{i}").alias("at"),
            )
            for i in range(PROJECTIONS)
        )
    )
    order = Window.partitionBy("i", "leaf").orderBy("at", "node")
    after = [
        F.struct(F.lead("node", s).over(order).alias("v"), F.lead("code", s).over(order).alias("w"))
        for s in range(1, STRIDE + 1)
    ]
    followed = coded.select("node", "code", F.inline(orders)).select(F.col("node").alias("u"), "code", F.array(*after).alias("following"))
    every = followed.select("u", "code", F.explode("following").alias("n")).where("n.v is not null")
    every = every.select("u", F.col("n.v").alias("v"), "code", F.col("n.w").alias("other"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sim = _code_cosines(batch.column("code").to_pylist(), batch.column("other").to_pylist())
                u, v = batch.column("u"), batch.column("v")
                yield pa.RecordBatch.from_arrays([u, v, pa.array(sim)], ["u", "v", "sim"])

    one_way = every.mapInArrow(run, "u bigint, v bigint, sim double")
    return one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest neighbours of each node, dealt by node once for both steps."""
    distinct = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= degree)


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, sim) and (v, u, sim), the latter as ``fresh``."""
    forward = edges.select("u", "v", "sim", F.lit(0).alias("fresh"))
    return forward.union(forward.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", F.lit(1)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, node, code, worst) sorted by ``at``: nodes that meet at one place are proposed to each other."""

    def propose(at, node, code, worst):
        bounds = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sizes = np.diff(np.append(bounds, len(at)))
        us, vs, sims = [], [], []
        for size in np.unique(sizes[sizes > 1]):
            where = bounds[sizes == size][:, None] + np.arange(size)[None, :]
            for some in np.array_split(where, max(1, len(where) * int(size) ** 2 // 2_000_000)):
                x = code[some]
                sim = x @ x.transpose(0, 2, 1)
                sim[:, np.arange(size), np.arange(size)] = -9
                take = min(DEGREE // 4, size - 1)
                best = np.argpartition(-sim, take - 1, axis=2)[:, :, :take]
                value = np.take_along_axis(sim, best, axis=2)
                ids, limit = node[some], worst[some]
                good = value > limit[:, :, None]
                group, i, j = np.nonzero(good)
                us.append(ids[group, i])
                vs.append(ids[group, best[group, i, j]])
                sims.append(value[group, i, j])
        if us:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(sims))], ["u", "v", "sim"]
            )

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("code").to_pylist()
        now = (
            batch.column("at").to_numpy(),
            batch.column("node").to_numpy(),
            _units(codes),
            batch.column("worst").to_numpy(zero_copy_only=False),
        )
        if kept is not None:
            now = tuple(np.concatenate(pair) for pair in zip(kept, now, strict=True))
        whole = int(np.searchsorted(now[0], now[0][-1]))  # the last place may go on in the next batch
        kept = tuple(x[whole:] for x in now)
        if whole:
            yield from propose(*(x[:whole] for x in now))
    if kept is not None:
        yield from propose(*kept)


def build_graph(points: DataFrame, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """(u, v, sim): ``MEETING`` near neighbours of each node of ``points`` (node, vec)."""
    coded = cut(_with_codes(points, seed), "codes")
    edges = cut(_nearest(_start(coded).withColumn("fresh", F.lit(1)), MEETING), "graph")
    code = coded.select(F.col("node").alias("u"), "code")
    # A node takes proposals that are nearer than the last neighbour it counts as near.
    last = F.max(F.when(F.col("rank") == DEGREE, F.col("sim"))).over(Window.partitionBy("u"))
    nearest_visitors = F.row_number().over(Window.partitionBy("at").orderBy(F.col("sim").desc(), "node"))
    for _ in range(rounds):
        visits = edges.join(code, "u").withColumn("worst", F.coalesce(last, F.lit(-2.0)))
        dealt = visits.select(F.col("v").alias("at"), F.col("u").alias("node"), "code", "worst", "sim").repartition("at")
        # Visitors of a place meet by ``ARRIVALS``, those alike in distance together: a hub hosts all of them.
        turn = F.floor((F.col("turn") - 1) / F.lit(ARRIVALS))
        hosted = dealt.withColumn("turn", nearest_visitors).select(F.xxhash64("at", turn).alias("at"), "node", "code", "worst")
        proposed = hosted.sortWithinPartitions("at").mapInArrow(_meet, "u bigint, v bigint, sim double").withColumn("fresh", F.lit(1))
        edges = cut(_nearest(_both_ways(edges).union(proposed), MEETING), "graph")
        if (edges.agg(F.avg("fresh")).first()[0] or 0) <= SETTLED:
            return edges
    raise RuntimeError(f"the graph did not settle in {rounds} rounds")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column("query_vec"), np.float64), _matrix(batch.column("vec"), np.float64)
        score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, node, score): the nearest nodes found for ``queries`` (query, query_vec, entry), an entry node each."""
    vectors = points.select("node", "vec")
    ways = cut(_nearest(_both_ways(graph), MEETING).groupBy("u").agg(F.collect_list("v").alias("vs")), "ways")
    keep = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")

    def scored(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(queries.select("query", "query_vec"), "query").join(vectors, "node")
        fresh = joined.select("query", "node", "query_vec", "vec").mapInArrow(_exact, "query bigint, node bigint, score double")
        return fresh.withColumn("expanded", F.lit(False))

    def ranked(state: DataFrame) -> DataFrame:
        return cut(state.withColumn("rank", F.row_number().over(keep)), "beam")

    state = ranked(scored(queries.select("query", F.col("entry").alias("node"))))
    for _ in range(HOPS):
        waiting = (F.col("rank") <= BEAM) & ~F.col("expanded")
        front = state.where(waiting).select("query", F.col("node").alias("u"))
        if front.isEmpty():
            return state.select("query", "node", "score")
        reached = front.join(ways, "u").select("query", F.explode("vs").alias("node")).repartition("query").distinct()
        fresh = scored(reached.join(state.select("query", "node").repartition("query"), ["query", "node"], "left_anti"))
        old = state.select("query", "node", "score", (F.col("expanded") | waiting).alias("expanded"))
        state = ranked(old.union(fresh))
    raise RuntimeError(f"queries still had nodes waiting after {HOPS} hops")


def _scan(short: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query, node, score): the ``k + 1`` best of all nodes for each of the queries ``short`` (query, query_vec), block by block."""
    spark, parts = short.sparkSession, []
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "node"))
    blocks = short.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, short.count() // BLOCK))))
    for block in [r.block for r in blocks.select("block").distinct().collect()]:
        some = blocks.where(F.col("block") == block).toArrow()
        ids, wanted = some.column("query").to_numpy(), _matrix(some.column("query_vec"), np.float64)
        wanted = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((ids, wanted))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, wanted = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("vec"), np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                scores = wanted @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                # All that tie with the last one wanted go on: the smallest ids win.
                last = np.sort(scores, axis=1)[:, -min(k + 1, scores.shape[1])]
                i, j = np.nonzero(scores >= last[:, None])
                node = batch.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(node[j]), pa.array(scores[i, j])], ["query", "node", "score"])

        near = points.select("node", "vec").mapInArrow(run, "query bigint, node bigint, score double")
        parts.append(cut(near.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank"), "scanned"))
    return reduce(DataFrame.union, parts)


def nearest(rows: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for each row of ``rows`` for which ``is_query`` holds."""
    usable = usable_vectors(rows)
    points = nodes(usable, k)
    graph = build_graph(points)
    asked = rows.where(is_query).select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    own = usable.join(asked, "vec_id").join(points.select("node", "vec"), "vec")
    queries = cut(own.select(F.col("vec_id").alias("query"), F.col("vec").alias("query_vec"), F.col("node").alias("entry")), "queries")
    found = search(points, graph, queries, k)
    # Queries whose walk met too few ids are answered by scanning all rows.
    reached = found.join(points.select("node", F.size("ids").alias("n")), "node").groupBy("query").agg(F.sum("n").alias("n"))
    enough = reached.where(F.col("n") > min(k, usable.count() - 1)).select("query")
    short = cut(queries.join(enough, "query", "left_anti").select("query", "query_vec"), "short")
    if not short.isEmpty():
        scanned = _scan(short, points, k)
        found = found.join(short, "query", "left_anti").union(scanned)
    members = found.join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = members.where("vec_id <> query").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
