"""The queries over arrays, by name: each takes arrays from the given tables through the operators, and has the same in SQL.

Prices are taken as whole cents, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import values
from gridloom.ndarray import NDArray
from gridloom.operators import indexing, iteration, linalg, manipulation, reduction, selection, sorting, ufunc
from gridloom.sources import creation

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(sql: str):
    """Adds a function from (spark, folder) to an array, or to a DataFrame, under its name."""

    def add(function):
        @values.plan
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = function(spark, sf_dir)
            return found.to_dataframe() if isinstance(found, NDArray) else found

        QUERIES[function.__name__] = query
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def vectors(spark, sf_dir, table, key, columns):
    """Vectors of the columns (expressions) of a table whose key runs from 0, over one base."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    picked = rows.select(key, *(F.expr(c).alias(f"c{k}") for k, c in enumerate(columns)))
    return creation.from_dataframe(picked, [key], [f"c{k}" for k in range(len(columns))], (rows.count(),), check=False)


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
BALANCE = "CAST(round(c_acctbal * 100) AS BIGINT)"


def orders(spark, sf_dir, column=CENTS):
    return vectors(spark, sf_dir, "orders", "o_orderkey", [column])[0]


def order_rows(spark, sf_dir, column=CENTS):
    return orders(spark, sf_dir, column).reshape(-1, 100)


def parts(spark, sf_dir):
    return vectors(spark, sf_dir, "part", "p_partkey", ["CAST(p_size AS BIGINT)", "p_retailprice", "CAST(floor(p_retailprice) AS BIGINT)"])


def customers(spark, sf_dir):
    return vectors(spark, sf_dir, "customer", "c_custkey", [BALANCE, "CAST(c_nationkey AS BIGINT)", "c_acctbal"])


def embedding_matrix(spark, sf_dir):
    """Cells are floor(1024 x), so that products are exact."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = rows.select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", "k", F.floor(F.col("x").cast("double") * 1024).cast("bigint").alias("x"))
    return creation.from_dataframe(cells, ["vec_id", "k"], "x", (rows.count(), 64), check=False)


MATRIX_SQL = "m AS (SELECT vec_id AS i0, k - 1 AS i1, CAST(floor(1024 * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"
NAN_EVENTS = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(floor(value * 100) AS DOUBLE) END"


@register(f"SELECT o_orderkey // 100 AS i0, CAST(sum({CENTS}) AS BIGINT) AS v FROM orders GROUP BY 1")
def sum_axis1(spark, sf):
    return reduction.sum(order_rows(spark, sf), axis=1)


@register(f"SELECT o_orderkey % 100 AS i0, CAST(sum({CENTS}) AS BIGINT) AS v FROM orders GROUP BY 1")
def sum_axis0(spark, sf):
    return reduction.sum(order_rows(spark, sf), axis=0)


@register(f"SELECT CAST(sum({CENTS}) AS BIGINT) AS v FROM orders")
def sum_all(spark, sf):
    return reduction.sum(orders(spark, sf), lazy=True)


@register(f"SELECT o_orderkey // 100 AS i0, CAST(0 AS BIGINT) AS i1, min({CENTS}) AS v FROM orders GROUP BY 1")
def min_keepdims(spark, sf):
    return reduction.min(order_rows(spark, sf), axis=1, keepdims=True)


@register(f"SELECT o_orderkey % 100 AS i0, max({CENTS}) AS v FROM orders GROUP BY 1")
def max_axis0(spark, sf):
    return reduction.max(order_rows(spark, sf), axis=0)


@register(f"SELECT o_orderkey // 100 AS i0, round(CAST(sum({CENTS}) AS DOUBLE) / 100, 6) AS v FROM orders GROUP BY 1")
def mean_axis1(spark, sf):
    found = reduction.mean(order_rows(spark, sf), axis=1)
    return NDArray(found.base, F.round(found.value, 6), found.shape, float)


@register("SELECT p_partkey % 20 AS i0, round(var_pop(p_size), 6) AS v FROM part GROUP BY 1")
def var_axis0(spark, sf):
    found = reduction.var(parts(spark, sf)[0].reshape(-1, 20), axis=0)
    return NDArray(found.base, F.round(found.value, 6), found.shape, float)


@register("SELECT p_partkey % 20 AS i0, round(stddev_pop(p_size), 6) AS v FROM part GROUP BY 1")
def std_axis0(spark, sf):
    found = reduction.std(parts(spark, sf)[0].reshape(-1, 20), axis=0)
    return NDArray(found.base, F.round(found.value, 6), found.shape, float)


@register(f"SELECT o_orderkey // 100 AS i0, arg_min(o_orderkey % 100, ({CENTS}) * 1000 + o_orderkey % 100) AS v FROM orders GROUP BY 1")
def argmin_axis1(spark, sf):
    return reduction.argmin(order_rows(spark, sf), axis=1)


@register("SELECT p_partkey % 20 AS i0, arg_max(p_partkey // 20, p_size * 1000000 - p_partkey // 20) AS v FROM part GROUP BY 1")
def argmax_axis0(spark, sf):
    return reduction.argmax(parts(spark, sf)[0].reshape(-1, 20), axis=0)


@register("SELECT p_partkey // 20 AS i0, bool_or(p_size > 49) AS v FROM part GROUP BY 1")
def any_axis1(spark, sf):
    return reduction.any((parts(spark, sf)[0] > 49).reshape(-1, 20), axis=1)


@register("SELECT p_partkey // 20 AS i0, bool_and(p_size > 1) AS v FROM part GROUP BY 1")
def all_axis1(spark, sf):
    return reduction.all((parts(spark, sf)[0] > 1).reshape(-1, 20), axis=1)


@register("SELECT p_partkey // 4 AS i0, CAST(product(p_size) AS BIGINT) AS v FROM part GROUP BY 1")
def prod_axis1(spark, sf):
    return reduction.prod(parts(spark, sf)[0].reshape(-1, 4), axis=1)


@register(f"SELECT event_id // 10 AS i0, sum(x) FILTER (WHERE NOT isnan(x)) AS v FROM (SELECT event_id, {NAN_EVENTS} AS x FROM events) GROUP BY 1")
def nan_sum_ignore(spark, sf):
    return reduction.sum(vectors(spark, sf, "events", "event_id", [NAN_EVENTS])[0].reshape(-1, 10), axis=1, nan_policy="ignore")


@register(f"SELECT event_id // 10 AS i0, CASE WHEN bool_or(isnan(x)) THEN CAST('NaN' AS DOUBLE) ELSE max(x) END AS v FROM (SELECT event_id, {NAN_EVENTS} AS x FROM events) GROUP BY 1")
def nan_max_propagate(spark, sf):
    return reduction.max(vectors(spark, sf, "events", "event_id", [NAN_EVENTS])[0].reshape(-1, 10), axis=1)


@register(f"SELECT o_orderkey // 100 AS i0, o_orderkey % 100 AS i1, CAST(sum({CENTS}) OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) AS BIGINT) AS v FROM orders")
def cumsum_axis1(spark, sf):
    return reduction.cumsum(order_rows(spark, sf), axis=1)


@register(f"SELECT o_orderkey AS i0, CAST(sum({CENTS}) OVER (ORDER BY o_orderkey) AS BIGINT) AS v FROM orders")
def cumsum_flat(spark, sf):
    return reduction.cumsum(order_rows(spark, sf))


@register("SELECT p_partkey // 4 AS i0, p_partkey % 4 AS i1, CAST(product(p_size) OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS BIGINT) AS v FROM part")
def cumprod_axis1(spark, sf):
    return reduction.cumprod(parts(spark, sf)[0].reshape(-1, 4), axis=1)


@register("SELECT p_partkey AS i0, CAST(p_size AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT) + p_size - 7 AS v FROM part")
def ufunc_arithmetic(spark, sf):
    size, _, price = parts(spark, sf)
    return size * price + size - 7


@register("SELECT p_partkey AS i0, CAST(floor(p_retailprice) AS BIGINT) // p_size AS v FROM part")
def ufunc_divide_int(spark, sf):
    size, _, price = parts(spark, sf)
    return price / size


@register("SELECT c_custkey AS i0, c_acctbal / (c_nationkey - 5.0) AS v FROM customer")
def ufunc_divide_float(spark, sf):
    _, nation, balance = customers(spark, sf)
    return balance / (nation - 5.0)


@register(f"SELECT c_custkey AS i0, CAST({BALANCE} AS DOUBLE) % (c_nationkey + 1) AS v FROM customer")
def ufunc_remainder_float(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return cents.astype(float) % (nation + 1)


@register(f"SELECT c_custkey AS i0, trunc(CAST({BALANCE} AS DOUBLE) / (c_nationkey + 3)) + 0.0 AS v FROM customer")
def ufunc_trunc_divide(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return cents.astype(float) // (nation + 3.0) + 0.0


@register("SELECT p_partkey AS i0, CAST(p_size AS BIGINT) * p_size * p_size AS v FROM part")
def ufunc_power_int(spark, sf):
    return parts(spark, sf)[0] ** 3


@register(f"SELECT c_custkey AS i0, abs(-({BALANCE})) AS v FROM customer")
def ufunc_absolute_negative(spark, sf):
    return abs(-customers(spark, sf)[0])


@register("SELECT c_custkey AS i0, (c_acctbal >= 100.0 AND c_nationkey < 12) OR NOT (c_nationkey <> 20) AS v FROM customer")
def ufunc_compare_logical(spark, sf):
    _, nation, balance = customers(spark, sf)
    return ufunc.logical_or(ufunc.logical_and(balance >= 100.0, nation < 12), ufunc.logical_not(nation != 20))


@register(f"SELECT event_id AS i0, isnan({NAN_EVENTS}) AS v FROM events")
def ufunc_isnan(spark, sf):
    return ufunc.isnan(vectors(spark, sf, "events", "event_id", [NAN_EVENTS])[0])


@register(f"SELECT c_custkey AS i0, CAST({BALANCE} * 2 + c_nationkey * 3 AS DOUBLE) AS re, CAST({BALANCE} * 3 - c_nationkey * 2 AS DOUBLE) AS im FROM customer")
def ufunc_complex_multiply(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return ufunc.conj(ufunc.complex_of(cents, nation)) * (2 + 3j)


@register("WITH r AS (SELECT p_partkey // 20 AS i0, p_partkey % 20 AS i1, p_size AS x FROM part), t AS (SELECT i1, CAST(sum(x) AS BIGINT) AS s FROM r GROUP BY 1) SELECT i0, r.i1, x - s AS v FROM r JOIN t ON r.i1 = t.i1")
def ufunc_broadcast(spark, sf):
    sizes = parts(spark, sf)[0].reshape(-1, 20)
    return sizes - reduction.sum(sizes, axis=0)


@register(f"SELECT c_custkey AS i0, CASE WHEN c_nationkey < 10 THEN {BALANCE} ELSE -1 END AS v FROM customer")
def where_select(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return selection.where(nation < 10, cents, -1)


@register(f"SELECT c_custkey AS i0, CASE WHEN {BALANCE} < 0 THEN 0 WHEN {BALANCE} > 500000 THEN 500000 ELSE {BALANCE} END AS v FROM customer")
def clip_range(spark, sf):
    return selection.clip(customers(spark, sf)[0], 0, 500000)


@register("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i0, p_partkey // 20 AS v FROM part WHERE p_size > 40")
def nonzero_rows(spark, sf):
    return selection.nonzero((parts(spark, sf)[0] > 40).reshape(-1, 20))[0]


@register(f"SELECT (o_orderkey // 100 - 3) // 2 AS i0, 9 - o_orderkey % 100 // 10 AS i1, {CENTS} AS v FROM orders WHERE o_orderkey // 100 >= 3 AND (o_orderkey // 100 - 3) % 2 = 0 AND o_orderkey % 100 % 10 = 9")
def slice_steps(spark, sf):
    return order_rows(spark, sf)[3::2, ::-10]


@register(f"WITH n AS (SELECT count(*) AS n FROM orders) SELECT c_custkey AS i0, {CENTS} AS v FROM customer, n JOIN orders ON o_orderkey = (c_custkey * 7 + c_nationkey) % n")
def fancy_gather(spark, sf):
    picks = vectors(spark, sf, "customer", "c_custkey", ["c_custkey * 7 + CAST(c_nationkey AS BIGINT)"])[0]
    source = orders(spark, sf)
    return source[picks % source.size]


@register(f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, {CENTS} AS v FROM orders WHERE {CENTS} > 20000000")
def mask_gather(spark, sf):
    a = orders(spark, sf)
    return a[a > 20000000]


@register(f"WITH s AS (SELECT c_custkey * c_custkey % 997 AS i, arg_max({BALANCE}, c_custkey) AS x FROM customer GROUP BY 1) SELECT o_orderkey AS i0, coalesce(x, {CENTS}) AS v FROM orders LEFT JOIN s ON i = o_orderkey")
def scatter_last_wins(spark, sf):
    a = orders(spark, sf)
    places, new = vectors(spark, sf, "customer", "c_custkey", ["c_custkey * c_custkey % 997", BALANCE])
    return indexing.assigned(a, places, new)


@register(f"SELECT row_number() OVER (ORDER BY {CENTS}, o_orderkey) - 1 AS i0, {CENTS} AS v FROM orders")
def sort_flat(spark, sf):
    return sorting.sort(order_rows(spark, sf))


@register("SELECT p_partkey // 20 AS i0, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_size, p_partkey) - 1 AS i1, p_partkey % 20 AS v FROM part")
def argsort_axis1(spark, sf):
    return sorting.argsort(parts(spark, sf)[0].reshape(-1, 20), axis=1)


@register("SELECT row_number() OVER (ORDER BY p_size) - 1 AS i0, CAST(p_size AS BIGINT) AS v FROM (SELECT DISTINCT p_size FROM part)")
def unique_values(spark, sf):
    return sorting.unique(parts(spark, sf)[0])


@register("SELECT row_number() OVER (ORDER BY p_size) - 1 AS i0, CAST(p_size AS BIGINT) AS v, first, n FROM (SELECT p_size, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1)")
def unique_with_counts(spark, sf):
    found = sorting.unique_with(parts(spark, sf)[0].reshape(-1, 20), return_index=True, return_counts=True)
    x, first, n = found.values, found.indices, found.counts  # over one base
    return x.base.select("i0", x.value.alias("v"), first.value.alias("first"), n.value.alias("n"))


@register(f"SELECT o_orderkey AS i0, dense_rank() OVER (ORDER BY {CENTS} // 1000000) - 1 AS v FROM orders")
def unique_with_inverse(spark, sf):
    return sorting.unique_with(orders(spark, sf) // 1000000, return_inverse=True).inverse


@register("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS i0, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey + n, CAST(floor(p_retailprice) AS BIGINT) FROM part, n")
def concatenate_two(spark, sf):
    size, _, price = parts(spark, sf)
    return manipulation.concatenate([size, price])


@register("SELECT p_partkey AS i0, CAST(0 AS BIGINT) AS i1, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey, 1, CAST(floor(p_retailprice) AS BIGINT) FROM part")
def stack_two(spark, sf):
    size, _, price = parts(spark, sf)
    return manipulation.stack([size, price], axis=1)


@register(f"SELECT o_orderkey % 100 AS i0, o_orderkey // 100 % 5 AS i1, o_orderkey // 500 AS i2, {CENTS} AS v FROM orders")
def permute_view(spark, sf):
    return orders(spark, sf).reshape(-1, 5, 100).permute_axes((2, 1, 0))


@register(f"WITH {MATRIX_SQL} SELECT i0, v FROM m WHERE i0 = i1")
def diagonal_view(spark, sf):
    return linalg.diagonal(embedding_matrix(spark, sf))


@register(f"WITH {MATRIX_SQL} SELECT CAST(sum(v) AS BIGINT) AS v FROM m WHERE i1 - i0 = 2")
def trace_offset(spark, sf):
    return linalg.trace(embedding_matrix(spark, sf), 2, lazy=True)


@register(f"WITH {MATRIX_SQL} SELECT a.i1 AS i0, b.i1, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY 1, 2")
def matmul_gram(spark, sf):
    m = embedding_matrix(spark, sf)
    return m.T @ m


@register(f"WITH {MATRIX_SQL} SELECT i0, CAST(sum(v * (i1 + 1)) AS BIGINT) AS v FROM m GROUP BY 1")
def matvec(spark, sf):
    return embedding_matrix(spark, sf) @ creation.arange(spark, 1, 65)


@register("SELECT CAST(sum(CAST(p_size AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT)) AS BIGINT) AS v FROM part")
def vdot_parts(spark, sf):
    size, _, price = parts(spark, sf)
    return linalg.vdot(size, price, lazy=True)


@register("SELECT n_nationkey AS i0, r_regionkey AS i1, CAST(n_regionkey * r_regionkey AS BIGINT) AS v FROM nation, region")
def outer_keys(spark, sf):
    nation = vectors(spark, sf, "nation", "n_nationkey", ["n_regionkey"])[0]
    region = vectors(spark, sf, "region", "r_regionkey", ["r_regionkey"])[0]
    return linalg.outer(nation, region)


@register(f"WITH {MATRIX_SQL} SELECT i0, i1, CASE WHEN i1 <= i0 - 1 THEN v ELSE 0 END AS v FROM m")
def tril_matrix(spark, sf):
    return creation.tril(embedding_matrix(spark, sf), -1)


@register("SELECT r_regionkey AS i0, n_nationkey AS i1, CAST(n_regionkey AS BIGINT) AS v FROM nation, region")
def meshgrid_first(spark, sf):
    nation = vectors(spark, sf, "nation", "n_nationkey", ["n_regionkey"])[0]
    region = vectors(spark, sf, "region", "r_regionkey", ["r_regionkey"])[0]
    return creation.meshgrid(nation, region)[0]


def nations_and_regions(spark, sf):
    nation = vectors(spark, sf, "nation", "n_nationkey", ["CAST(n_regionkey AS BIGINT)"])[0]
    return nation, vectors(spark, sf, "region", "r_regionkey", ["CAST(r_regionkey AS BIGINT)"])[0]


@register("SELECT r_regionkey AS i0, CAST(sum(n_regionkey * 10 + r_regionkey) AS BIGINT) AS v FROM nation, region GROUP BY 1")
def meshgrid_sum(spark, sf):
    """Both grids repeat one vector; no cell of either is made before the sum of them."""
    x, y = creation.meshgrid(*nations_and_regions(spark, sf))
    return reduction.sum(x * 10 + y, axis=1)


@register("SELECT n_nationkey AS i0, r_regionkey AS i1, CAST(n_regionkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation, region")
def broadcast_arrays_two(spark, sf):
    nation, region = nations_and_regions(spark, sf)
    a, b = manipulation.broadcast_arrays([nation.reshape(-1, 1), region])
    return a.to_dataframe().withColumnRenamed("v", "a").join(b.to_dataframe().withColumnRenamed("v", "b"), ["i0", "i1"])


@register(f"SELECT c_custkey AS i0, CAST(sum(CASE WHEN {BALANCE} > r_regionkey * 100000 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM customer, region GROUP BY 1")
def broadcast_to_view(spark, sf):
    """A slice of a transposed broadcast view, compared with a column."""
    region = vectors(spark, sf, "region", "r_regionkey", ["CAST(r_regionkey AS BIGINT)"])[0]
    cents = customers(spark, sf)[0]
    levels = manipulation.broadcast_to(region * 100000, (cents.size * 2, region.size))
    return reduction.sum(cents.reshape(-1, 1) > levels.T[:, ::2].T, axis=1)


def first_rows(spark, cells, schema):
    """A DataFrame of what an operator gave to Python."""
    return spark.createDataFrame(list(cells), schema)


@register("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS i0, round(p_size * (100.0 * p_partkey / (n - 1)), 6) AS v FROM part, n")
def linspace_scaled(spark, sf):
    size = parts(spark, sf)[0]
    found = size * creation.linspace(spark, 0, 100, size.size)
    return NDArray(found.base, F.round(found.value, 6), found.shape, float)


@register("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS i0, round(p_size * pow(10.0, 3.0 * p_partkey / (n - 1)), 4) AS v FROM part, n")
def logspace_scaled(spark, sf):
    size = parts(spark, sf)[0]
    found = size * creation.logspace(spark, 0, 3, size.size)
    return NDArray(found.base, F.round(found.value, 4), found.shape, float)


@register("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS i0, round(p_size * pow(1000.0, p_partkey / n), 4) AS v FROM part, n")
def geomspace_scaled(spark, sf):
    size = parts(spark, sf)[0]
    found = size * creation.geomspace(spark, 1, 1000, size.size, endpoint=False)
    return NDArray(found.base, F.round(found.value, 4), found.shape, float)


@register("SELECT p_partkey AS i0, CAST(p_size * 3.0 + 7 AS DOUBLE) AS v FROM part")
def constants(spark, sf):
    size = parts(spark, sf)[0]
    n = size.size
    return size * (creation.ones(spark, n) * 3) + creation.zeros(spark, n) + creation.full(spark, n, 7)


@register("SELECT r_regionkey AS i0, i1, CAST(r_regionkey * 10 + i1 * i1 AS BIGINT) AS v FROM region, (SELECT unnest([0, 1, 2]) AS i1)")
def array_of_rows(spark, sf):
    keys = sorted(r["r_regionkey"] for r in spark.read.parquet(f"{sf}/region.parquet").collect())
    return creation.array(spark, [[10 * k, 10 * k + 1, 10 * k + 4] for k in keys])


@register("SELECT r_regionkey AS i0, CAST(r_regionkey + 5 AS BIGINT) AS v FROM region")
def array_of_scalar(spark, sf):
    keys = vectors(spark, sf, "region", "r_regionkey", ["r_regionkey"])[0].astype(int)
    return keys + creation.array(spark, 5, shape=keys.shape)


def regions_by_nation(spark, sf):
    return vectors(spark, sf, "nation", "n_nationkey", ["CAST(n_regionkey AS BIGINT)"])[0]


@register("SELECT a.n_nationkey AS i0, b.n_nationkey AS i1, CAST(CASE WHEN b.n_nationkey - a.n_nationkey = 2 THEN b.n_regionkey ELSE 0 END AS BIGINT) AS v FROM nation a, nation b")
def eye_offset(spark, sf):
    key = regions_by_nation(spark, sf)
    return creation.eye(spark, key.size, k=2, dtype=int) * key


@register("SELECT a.n_nationkey AS i0, b.n_nationkey AS i1, CAST(CASE WHEN b.n_nationkey <= a.n_nationkey - 1 THEN b.n_regionkey ELSE 0 END AS BIGINT) AS v FROM nation a, nation b")
def tri_rows(spark, sf):
    key = regions_by_nation(spark, sf)
    return creation.tri(spark, key.size, k=-1, dtype=int) * key


@register(f"WITH {MATRIX_SQL} SELECT i0, i1, CASE WHEN i1 >= i0 + 1 THEN v ELSE 0 END AS v FROM m")
def triu_matrix(spark, sf):
    return creation.triu(embedding_matrix(spark, sf), 1)


@register("SELECT a.n_nationkey AS i0, b.n_nationkey AS i1, CAST(CASE WHEN a.n_nationkey = b.n_nationkey THEN a.n_regionkey ELSE 0 END AS BIGINT) AS v FROM nation a, nation b")
def diag_vector(spark, sf):
    return creation.diag(regions_by_nation(spark, sf))


@register(f"SELECT c_custkey AS i0, {BALANCE} % 25 = c_nationkey AS v FROM customer")
def ufunc_equal(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return cents % 25 == nation


@register("SELECT c_custkey AS i0, c_acctbal <= c_nationkey * 400.0 AS v FROM customer")
def ufunc_less_equal(spark, sf):
    _, nation, balance = customers(spark, sf)
    return balance <= nation * 400.0


@register("SELECT c_custkey AS i0, c_nationkey = 5 AND c_acctbal <> 0 AS v FROM customer")
def ufunc_isinf(spark, sf):
    _, nation, balance = customers(spark, sf)
    return ufunc.isinf(balance / (nation - 5.0))


@register("SELECT c_custkey AS i0, c_nationkey <> 5 AS v FROM customer")
def ufunc_isfinite(spark, sf):
    _, nation, balance = customers(spark, sf)
    return ufunc.isfinite(balance / (nation - 5.0))


@register(f"SELECT c_custkey AS i0, CAST({BALANCE} * 2 AS DOUBLE) AS v FROM customer")
def ufunc_real(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return ufunc.real(ufunc.complex_of(cents, nation) * 2)


@register("SELECT c_custkey AS i0, CAST(c_nationkey * 2 AS DOUBLE) AS v FROM customer")
def ufunc_imag(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return ufunc.imag(ufunc.complex_of(cents, nation) * 2)


@register(f"SELECT o_orderkey // 100 AS i0, o_orderkey % 100 AS i1, CASE WHEN o_orderkey // 100 >= 2 AND o_orderkey % 10 = 3 THEN -1 ELSE {CENTS} END AS v FROM orders")
def setitem_scalar(spark, sf):
    return indexing.assigned(order_rows(spark, sf), (slice(2, None), slice(3, None, 10)), -1)


@register(f"SELECT o_orderkey // 100 AS i0, o_orderkey % 100 AS i1, CASE WHEN o_orderkey % 100 < 50 AND o_orderkey // 100 % 2 = 0 THEN o_orderkey % 100 * 2 ELSE {CENTS} END AS v FROM orders")
def setitem_slice_array(spark, sf):
    return indexing.assigned(order_rows(spark, sf), (slice(None, None, 2), slice(50)), creation.arange(spark, 0, 100, 2))


@register(f"SELECT o_orderkey AS i0, CASE WHEN {CENTS} > 20000000 THEN 20000000 ELSE {CENTS} END AS v FROM orders")
def setitem_mask(spark, sf):
    a = orders(spark, sf)
    return indexing.assigned(a, a > 20000000, 20000000)


@register("SELECT CAST(0 AS BIGINT) AS i0, p_partkey AS i1, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT 1, p_partkey, CAST(floor(p_retailprice) AS BIGINT) FROM part")
def vstack_two(spark, sf):
    size, _, price = parts(spark, sf)
    return manipulation.vstack([size, price])


@register("SELECT p_partkey // 20 AS i0, p_partkey % 20 AS i1, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey // 20, p_partkey % 20 + 20, CAST(floor(p_retailprice) AS BIGINT) FROM part")
def hstack_two(spark, sf):
    size, _, price = parts(spark, sf)
    return manipulation.hstack([size.reshape(-1, 20), price.reshape(-1, 20)])


@register("SELECT p_partkey AS i0, CAST(p_size AS BIGINT) AS v FROM part")
def squeeze_view(spark, sf):
    return parts(spark, sf)[0].reshape(1, -1, 1).view().squeeze()


@register("SELECT p_partkey // 20 AS i0, CAST(sum(p_size * (p_partkey % 20)) AS BIGINT) AS v FROM part GROUP BY 1")
def dot_vector(spark, sf):
    return linalg.dot(parts(spark, sf)[0].reshape(-1, 20), creation.arange(spark, 20))


@register("SELECT CAST(sum(p_size * floor(p_retailprice)) AS DOUBLE) AS re, CAST(sum(p_size * p_size) AS DOUBLE) AS im FROM part")
def vdot_complex(spark, sf):
    size, _, price = parts(spark, sf)
    return linalg.vdot(size.astype(complex), ufunc.complex_of(price, size), lazy=True)


@register("SELECT n_nationkey AS place, CAST(n_regionkey AS BIGINT) AS v FROM nation")
def to_list_rows(spark, sf):
    return first_rows(spark, enumerate(regions_by_nation(spark, sf).to_list()), "place long, v long")


@register("SELECT n_nationkey // 5 AS a, n_nationkey % 5 AS b, CAST(n_regionkey AS BIGINT) AS v FROM nation")
def ndenumerate_cells(spark, sf):
    cells = iteration.ndenumerate(regions_by_nation(spark, sf).reshape(5, 5))
    return first_rows(spark, ((a, b, v) for (a, b), v in cells), "a long, b long, v long")


@register("SELECT n_nationkey // 5 AS a, n_nationkey % 5 AS b, CAST(n_nationkey AS BIGINT) AS v FROM nation")
def ndindex_cells(spark, sf):
    shape = regions_by_nation(spark, sf).reshape(5, 5).shape
    return first_rows(spark, ((a, b, k) for k, (a, b) in enumerate(iteration.ndindex(shape))), "a long, b long, v long")


@register("SELECT a.n_nationkey * 5 + r_regionkey AS place, CAST(n_regionkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation a, region")
def nditer_pairs(spark, sf):
    nation, region = regions_by_nation(spark, sf), vectors(spark, sf, "region", "r_regionkey", ["CAST(r_regionkey AS BIGINT)"])[0]
    return first_rows(spark, ((k, a, b) for k, (a, b) in enumerate(iteration.nditer((nation.reshape(-1, 1), region)))), "place long, a long, b long")


@register("SELECT n_nationkey AS place, CAST(n_regionkey AS BIGINT) AS v FROM nation")
def flat_cells(spark, sf):
    return first_rows(spark, enumerate(regions_by_nation(spark, sf).reshape(5, 5).flat), "place long, v long")


@register("SELECT n_nationkey // 5 AS place, CAST(sum(n_regionkey) AS BIGINT) AS v FROM nation GROUP BY 1")
def iterated_rows(spark, sf):
    return first_rows(spark, ((k, reduction.sum(row)) for k, row in enumerate(regions_by_nation(spark, sf).reshape(5, 5))), "place long, v long")


@register("SELECT '[0] ' || string_agg(CAST(n_regionkey AS VARCHAR), ' ' ORDER BY n_nationkey) AS v FROM nation")
def text_of_vector(spark, sf):
    return first_rows(spark, [(str(regions_by_nation(spark, sf)),)], "v string")


@register("SELECT '  @ data: [' || string_agg(CAST(n_regionkey AS VARCHAR), ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey < 20) || ']' AS v FROM nation")
def text_of_handle(spark, sf):
    return first_rows(spark, [(repr(regions_by_nation(spark, sf)[:20]).splitlines()[1],)], "v string")


@register(f"SELECT {CENTS} AS v FROM orders WHERE o_orderkey = 321")
def getitem_scalar(spark, sf):
    return first_rows(spark, [(order_rows(spark, sf)[3, 21],)], "v long")


@register("SELECT p_partkey AS i0, CAST(CASE WHEN sum(p_size % 2) OVER (ORDER BY p_partkey) % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS v FROM part")
def cumprod_flat(spark, sf):
    size = parts(spark, sf)[0]
    return reduction.cumprod((1 - 2 * (size % 2)).reshape(-1, 20))


@register(f"SELECT c_custkey AS i0, CAST(sum({BALANCE}) OVER (ORDER BY c_custkey) AS DOUBLE) AS re, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) AS DOUBLE) AS im FROM customer")
def cumsum_complex(spark, sf):
    cents, nation, _ = customers(spark, sf)
    return reduction.cumsum(ufunc.complex_of(cents, nation))


@register(f"SELECT o_orderkey // 100 AS i0, CAST(sum({CENTS}) AS BIGINT) AS v FROM orders GROUP BY 1")
def sum_axes(spark, sf):
    return reduction.sum(orders(spark, sf).reshape(-1, 10, 10), axes=(1, 2))


@register("SELECT CAST(CASE WHEN sum(p_size % 2) % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS v FROM part")
def prod_flat(spark, sf):
    return reduction.prod(1 - 2 * (parts(spark, sf)[0] % 2), lazy=True)


@register(f"SELECT o_orderkey // 100 AS i0, row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY {CENTS}, o_orderkey) - 1 AS i1, {CENTS} AS v FROM orders")
def sort_axis1(spark, sf):
    return sorting.sort(order_rows(spark, sf), axis=1)


@register("SELECT row_number() OVER (ORDER BY re, im) - 1 AS i0, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im FROM (SELECT DISTINCT p_size AS re, p_partkey % 7 AS im FROM part)")
def unique_complex(spark, sf):
    size = parts(spark, sf)[0]
    return sorting.unique(ufunc.complex_of(size, creation.arange(spark, size.size) % 7))


@register("SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS v FROM part")
def astype_copy(spark, sf):
    return parts(spark, sf)[0].astype(float).copy()


@register("SELECT o_orderkey // 100 AS i0, o_orderkey % 100 AS i1, " + CENTS + " AS v FROM orders")
def checked_rows(spark, sf):
    """Through the check that each cell comes exactly once."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((F.expr("o_orderkey div 100")).alias("r"), F.expr("o_orderkey % 100").alias("c"), F.expr(CENTS).alias("x"))
    return creation.from_dataframe(rows, ["r", "c"], "x", (rows.count() // 100, 100))
