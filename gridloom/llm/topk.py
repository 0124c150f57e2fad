"""Exact top-k inner products through a pivot-distance index.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest length, and a query gets 0 there: then the
largest inner products are the smallest distances. Each vector is keyed by its nearest pivot and its distance to it,
and blocks hold neighbours in that order, annuli of a pivot. Queries are keyed alike and come in chunks. A chunk first
searches one block of its own pivot that is nearest to its own distances, which bounds the distance of each query's k-th
result; then it expands to the annuli, of every pivot, that the triangle inequality can't rule out for all its queries,
several blocks in a group in the order of their gaps. Within a group each query stops at the blocks that its own bound,
which falls as results are found, rules out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

#: Vectors of a block and queries of a chunk at most, queries whose scores are held at once, blocks in one group (about),
#: pivots at least and at most (between, the square root of the number of blocks), rows that the pivots are chosen from
#: at most (about).
BLOCK, CHUNK, SLICE, PACK, LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 2048, 4096, 512, 16, 16, 128, 4000
#: Integers below this are exact as doubles; products of larger vectors are worked out as Python integers. Components
#: beyond GIANT keep a vector out of the pivots' geometry: it is in blocks of its own, which every query searches.
EXACT, GIANT = 1 << 53, float(1 << 40)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (array<double> of whole numbers) of the rows whose vector is whole: not null, and all its components
    finite numbers. A vector's components are floor(scale * x), or the greatest double where that is beyond doubles."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    top = F.lit(float(np.finfo(float).max))

    def floored(c):
        y = F.greatest(-top, F.least(top, c * F.lit(float(scale))))
        return F.when(F.abs(y) < F.lit(float(1 << 52)), F.floor(y).cast("double")).otherwise(y)  # beyond, all doubles are whole

    return df.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floored).alias("v"))


def giant(v) -> np.ndarray:
    """Which vectors (rows of numbers) have a component beyond GIANT."""
    return np.array([bool(len(x)) and bool(np.abs(x).max() >= GIANT) for x in v], bool)


def choose_pivots(vectors: DataFrame, pivots: int, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Rows of a sample, drawn by the digest of the id, each the farthest from those before."""
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1))).orderBy("vec_id").limit(2 * sample).collect()
    if not rows:
        rows = vectors.limit(1).collect()
    width = max((len(r["v"]) for r in rows), default=0)
    points = padded([np.array(r["v"]) for r in rows], width)
    if not len(points):
        return points
    chosen = [points[0]]
    distance = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < pivots and distance.max() > 0:
        chosen.append(points[distance.argmax()])
        distance = np.minimum(distance, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def padded(vectors, width: int) -> np.ndarray:
    """Doubles; what a shorter vector lacks is 0, and so is what a longer one has beyond width."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : min(len(v), width)] = v[:width]
    return out


def squares(vectors) -> np.ndarray:
    return np.array([float(np.dot(v, v)) for v in vectors])


def distances(vectors, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To each pivot; lift is the added component (0 for pivots), and parts of a vector beyond the pivots' width count."""
    x = padded(vectors, pivots.shape[1])
    square = squares(vectors)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None] + (lift**2)[:, None]
    return np.sqrt(np.maximum(square, 0))


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact in 64 bits; beyond, the nearest number of 64 bits."""
    width = queries.shape[1]
    most = np.abs(vectors).max(axis=1, initial=0)
    exact = width * (np.abs(queries).max(initial=0) + 1) * (most + 1) < EXACT
    out = np.zeros((len(queries), len(vectors)), np.int64)
    out[:, exact] = (queries @ vectors[exact].T).astype(np.int64)
    for j in np.flatnonzero(~exact):
        other = [int(c) for c in vectors[j]]
        for i, q in enumerate(queries):
            out[i, j] = min(max(sum(int(a) * b for a, b in zip(q, other)), LOW), HIGH)
    return out


def packed(vectors) -> tuple[bytes, bytes]:
    return np.concatenate([*vectors, np.zeros(0)]).astype("<f8").tobytes(), np.array([len(v) for v in vectors], "<i4").tobytes()


def unpacked(flat: bytes, sizes: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(flat, "<f8"), np.cumsum(np.frombuffer(sizes, "<i4"))[:-1])


def cut(batches, size: int, across: bool = False):
    """(pivots, distances, ids, vectors) of stretches of at most size rows, of one pivot each or across pivots, from frames
    sorted by pivot."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(batch["pivot"], batch["distance"], batch["vec_id"], batch["v"]):
            if held and (len(held) == size or held[0][0] != row[0] and not across):
                yield zip(*held)
                held = []
            held.append(row)
    if held:
        yield zip(*held)


class Best:
    """The k best of each query so far, ties to smaller ids, and the score that a further one must reach."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.least, self.k = ids, least.copy(), k
        self.rows = np.zeros((3, 0), np.int64)  # place of the query, score, vector

    def add(self, which: np.ndarray, found: np.ndarray, vec_ids: np.ndarray) -> None:
        """found: scores of the queries at which (rows) against the vectors vec_ids."""
        row, column = np.nonzero((found >= self.least[which][:, None]) & (vec_ids[None, :] != self.ids[which][:, None]))
        fresh = np.stack([which[row], found[row, column], vec_ids[column]])
        touched = np.isin(self.rows[0], which)
        both = np.concatenate([self.rows[:, touched], fresh], axis=1)
        both = both[:, np.lexsort((both[2], ~both[1], both[0]))]  # ~x is -x - 1: the same order, without overflow
        first = np.searchsorted(both[0], both[0])
        place = np.arange(both.shape[1]) - first
        both = both[:, place < self.k]
        full = both[:, place[place < self.k] == self.k - 1]
        self.least[full[0]] = np.maximum(self.least[full[0]], full[1])
        self.rows = np.concatenate([self.rows[:, ~touched], both], axis=1)


def search(vectors: DataFrame, k: int = 10, query_modulus: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", said: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by query_modulus, the k other rows with
    the highest integer inner products, ties to smaller ids; all others where there are fewer.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Vectors of
    unequal lengths are filled up with zeros. A row isn't a candidate for its own id; of rows that share an id each is
    a candidate for others, and as queries one of them counts. A score beyond 64 bits counts as the nearest number of
    64 bits. said, if given, gets the numbers of blocks, of chunks and of the pairs of them that were searched.
    """
    spark, store = vectors.sparkSession, common.Stores()
    schema = "query_id long, vec_id long, score long"
    rows = quantised(vectors, id_col, vector_col, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    huge = F.exists("v", lambda c: F.abs(c) >= F.lit(GIANT))
    n, n_queries, greatest = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_modulus == 0), F.max(F.when(~huge, norm))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    greatest = greatest or 0.0
    count = min(max(LEAST_PIVOTS, int((n / BLOCK) ** 0.5)), MOST_PIVOTS)
    pivots = spark.sparkContext.broadcast(choose_pivots(rows.filter(~huge), count, n))
    slack = 1e-6 * (greatest**0.5 + 1)

    def keyed(is_query: bool):
        """Nearest pivot and distance; giant vectors have the pivot -1, and so has what there are no pivots for."""

        def run(batches):
            for batch in batches:
                v = [np.asarray(x, float) for x in batch["v"]]
                pivot, distance = np.full(len(v), -1), np.zeros(len(v))
                small = np.flatnonzero(~giant(v)) if len(pivots.value) else np.zeros(0, int)
                if len(small):
                    own = [v[i] for i in small]
                    lift = np.zeros(len(own)) if is_query else np.sqrt(np.maximum(greatest - squares(own), 0))
                    d = distances(own, lift, pivots.value)
                    pivot[small], distance[small] = d.argmin(axis=1), d.min(axis=1)
                yield pd.DataFrame({"pivot": pivot, "distance": distance, "vec_id": batch["vec_id"], "v": [x.astype("<f8").tobytes() for x in v]})

        return run

    def in_stretches(name: str, size: int, across: bool):
        def run(batches):
            import uuid

            for pivot, distance, ids, raw in cut(batches, size, across):
                flat, sizes = packed([np.frombuffer(x, "<f8") for x in raw])
                ranges: dict[int, list[float]] = {}
                for p, d in zip(pivot, distance):  # sorted by both
                    ranges.setdefault(int(p), [float(d), float(d)])[1] = float(d)
                span = {"ranges": [[{"pivot": p, "low": low, "high": high} for p, (low, high) in ranges.items()]]} if across else {"pivot": pivot[0], "nearest": distance[0], "farthest": distance[-1]}
                yield pd.DataFrame({name: [uuid.uuid4().hex], **span, "ids": [np.array(ids, "<i8").tobytes()], "vs": [flat], "sizes": [sizes]})
            common.release()

        return run

    def indexed(df: DataFrame, name: str, size: int, is_query: bool) -> DataFrame:
        order = ["pivot", "distance", "vec_id"]
        rows = df.mapInPandas(keyed(is_query), "pivot int, distance double, vec_id long, v binary")
        # each chunk meets blocks of all pivots, so chunks are as few as their size allows
        dealt = rows.repartitionByRange(-(-n_queries // size), *order) if is_query and n_queries else rows.repartitionByRange(*order)
        span = "ranges array<struct<pivot: int, low: double, high: double>>" if is_query else "pivot int, nearest double, farthest double"
        kinds = f"{name} string, {span}, ids binary, vs binary, sizes binary"
        return store(dealt.sortWithinPartitions(*order).mapInPandas(in_stretches(name, size, is_query), kinds), f"topk-{name}")

    index = indexed(rows, "block", BLOCK, False)
    asked = indexed(rows.filter(F.col("vec_id") % query_modulus == 0).dropDuplicates(["vec_id"]), "chunk", CHUNK, True)
    annuli = index.select("block", "pivot", "nearest", "farthest", (F.length("ids") / 8).cast("long").alias("held"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query of one chunk in some blocks, those of its least score or more."""
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        chunk = left.iloc[0]
        qs = unpacked(chunk["vs"], chunk["sizes"])
        ids = np.frombuffer(chunk["ids"], "<i8")
        least = np.frombuffer(chunk["least"], "<i8") if chunk["least"] is not None else np.full(len(ids), LOW)
        best, free = Best(ids, least, k), giant(qs)
        free |= not len(pivots.value)
        square = np.where(free, 0, np.minimum(squares(qs), GIANT**3))
        away = distances([np.zeros(0) if f else q for q, f in zip(qs, free)], np.zeros(len(qs)), pivots.value) if len(pivots.value) else np.zeros((len(qs), 0))

        def gaps(pivot, near, far):
            return np.where(free, 0.0, np.maximum(0, np.maximum(near - away[:, pivot], away[:, pivot] - far))) if pivot >= 0 else np.zeros(len(qs))

        blocks = [(gaps(p, a, b), row) for row, (p, a, b) in enumerate(zip(right["pivot"], right["nearest"], right["farthest"]))]
        for gap, row in sorted(blocks, key=lambda x: (x[0].mean(), x[1])):
            block = right.iloc[row]
            vs, vec_ids = unpacked(block["vs"], block["sizes"]), np.frombuffer(block["ids"], "<i8")
            # |q|^2 + M^2 - 2 score is the squared distance of a result: beyond it, no block can hold a better one
            reach = np.sqrt(np.maximum(square + greatest - 2.0 * best.least, 0))
            todo = np.flatnonzero(free | (gap <= reach + slack) | (best.least == LOW))
            for start in range(0, len(todo), SLICE):
                which = todo[start : start + SLICE]
                width = max(max(len(qs[i]) for i in which), max(map(len, vs)))
                best.add(which, scores(padded([qs[i] for i in which], width), padded(vs, width)), vec_ids)
        return pd.DataFrame({"query_id": ids[best.rows[0]], "vec_id": best.rows[2], "score": best.rows[1]})

    def found(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
        """pairs: chunk, block, pack; chunks: with least."""
        groups = pairs.select(F.col("chunk").alias("of"), F.col("pack").alias("in")).distinct()
        own = chunks.join(groups, chunks["chunk"] == groups["of"]).groupBy("of", "in")
        return own.cogroup(index.join(pairs, "block").groupBy("chunk", "pack")).applyInPandas(work, schema)

    def best(rows_: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows_.withColumn("rank", place).filter(F.col("rank") <= k)

    gap = F.greatest(F.lit(0.0), F.col("nearest") - F.col("high"), F.col("low") - F.col("farthest"))
    own = asked.select("chunk", F.inline("ranges")).join(annuli, "pivot")
    # The nearest blocks of each pivot of a chunk until they hold k candidates besides a query. Blocks of equal vectors have equal gaps: a digest
    # breaks the tie, so that not all chunks start in one of them.
    nearest = Window.partitionBy("chunk", "pivot").orderBy(gap, F.xxhash64("chunk", "block"), "block")
    before = F.coalesce(F.sum("held").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = own.withColumn("before", before).filter(F.col("before") <= k).select("chunk", "block", F.lit(0).alias("pack"))
    first = store(first, "topk-first")
    start = common.stored(found(first, asked.withColumn("least", F.lit(None).cast("binary"))), "topk-start")
    bounds = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).filter("least IS NOT NULL")

    def ids_of(batches):
        for batch in batches:
            found_ids = [np.frombuffer(x, "<i8") for x in batch["ids"]]
            yield pd.DataFrame({"chunk": np.repeat(batch["chunk"].to_numpy(), list(map(len, found_ids))), "query_id": np.concatenate([*found_ids, np.zeros(0, "<i8")])})

    told = asked.select("chunk", "ids").mapInPandas(ids_of, "chunk string, query_id long").join(bounds, "query_id")
    told = told.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "least"))).alias("known"))

    def reaching(batches):
        """Each chunk with its queries' least scores and, by pivot, the least and greatest distance that any of them
        reaches. Queries without a bound become a chunk of their own, so that the others keep theirs."""
        for batch in batches:
            for row in batch.to_dict("records"):
                qs, ids = unpacked(row["vs"], row["sizes"]), np.frombuffer(row["ids"], "<i8")
                known = dict(row["known"]) if row["known"] is not None else {}
                least = np.array([known.get(i, LOW) for i in ids.tolist()], "<i8")
                free = giant(qs) | (least == LOW)
                free |= not len(pivots.value)
                for which in (np.flatnonzero(~free), np.flatnonzero(free)):
                    if not len(which):
                        continue
                    some = [qs[i] for i in which]
                    if free[which[0]]:
                        low, high = np.full(len(pivots.value), -np.inf), np.full(len(pivots.value), np.inf)
                    else:
                        d = distances(some, np.zeros(len(some)), pivots.value)
                        reach = np.sqrt(np.maximum(squares(some) + greatest - 2.0 * least[which], 0))[:, None] + slack
                        low, high = (d - reach).min(axis=0), (d + reach).max(axis=0)
                    flat, sizes = packed(some)
                    yield pd.DataFrame({
                        "origin": [row["chunk"]], "chunk": [row["chunk"] + ("-free" if free[which[0]] else "")], "ids": [ids[which].tobytes()], "vs": [flat], "sizes": [sizes],
                        "least": [least[which].tobytes()], "low": [np.append(low, -np.inf)], "high": [np.append(high, np.inf)],
                    })

    chunks = asked.join(told, "chunk", "left").select("chunk", "ids", "vs", "sizes", "known")
    kinds = "origin string, chunk string, ids binary, vs binary, sizes binary, least binary, low array<double>, high array<double>"
    chunks = store(chunks.mapInPandas(reaching, kinds), "topk-bounds")
    # the last entry is that of the pivot -1
    reach = chunks.select("origin", "chunk", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "r")).withColumn("pivot", F.when(F.col("pivot") == len(pivots.value), -1).otherwise(F.col("pivot")))
    pairs = reach.join(annuli, "pivot").filter((F.col("nearest") <= F.col("r.high")) & (F.col("farthest") >= F.col("r.low"))).select("origin", "chunk", "block")
    pairs = pairs.join(first.select(F.col("chunk").alias("origin"), "block"), ["origin", "block"], "left_anti").drop("origin")
    packs = max(1, round(index.count() / PACK))
    pairs = store(pairs.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int")), "topk-pairs")
    if said is not None:
        said |= {"blocks": index.count(), "chunks": asked.count(), "pairs": pairs.count() + first.count()}
    rest = common.stored(found(pairs, chunks.select("chunk", "ids", "vs", "sizes", "least")), "topk-rest")
    store.drop()
    return best(start.unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
