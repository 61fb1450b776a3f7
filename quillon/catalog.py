"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .operators import bloom, kernels, layout, metrics, structure, tensor
from .plans import tuning
from .plans import workloads as w
from .plans.work import new_path
from .sources import csr_binary, generators, market_format, tile_store
from .sources.matrix_market import Kind
from .streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WITH = """WITH parts AS (SELECT p_size::BIGINT AS k, p_partkey % 64 AS c, sum(floor(p_retailprice))::BIGINT AS v FROM part GROUP BY ALL),
trade AS (SELECT l_suppkey AS k, l_partkey AS c, sum(floor(l_quantity))::BIGINT AS v FROM lineitem GROUP BY ALL),
cells AS (SELECT vec_id AS n, (generate_subscripts(embedding, 1) - 1)::BIGINT AS c, round(unnest(embedding)::DOUBLE * 10000)::BIGINT AS x FROM embeddings),
sizes AS (SELECT range::BIGINT AS k FROM range(51)),
places AS (SELECT range::BIGINT AS c FROM range(64)),
grads AS (SELECT vec_id AS n, k, (vec_id * 31 + k * 17) % 13 - 6 AS g FROM embeddings, sizes)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return add


FORWARD = """, s AS (SELECT n, k, sum(v * x)::BIGINT AS o FROM parts JOIN cells USING (c) GROUP BY ALL)
SELECT e.vec_id AS n, z.k AS k, coalesce(o, 0)::BIGINT AS o FROM embeddings e CROSS JOIN sizes z LEFT JOIN s ON s.n = e.vec_id AND s.k = z.k"""
BACKWARD = """, s AS (SELECT n, c, sum(v * g)::BIGINT AS d FROM parts JOIN grads USING (k) GROUP BY ALL)
SELECT e.vec_id AS n, z.c AS c, coalesce(d, 0)::BIGINT AS d FROM embeddings e CROSS JOIN places z LEFT JOIN s ON s.n = e.vec_id AND s.c = z.c"""
UPDATE = """SELECT k, c, sum(x * g)::BIGINT AS dv FROM parts JOIN cells USING (c) JOIN grads USING (n, k) GROUP BY ALL"""


# Products


@query(FORWARD)
def spmm_fwd(spark, d):
    return kernels.forward(w.parts(spark, d), w.vectors(spark, d))


@query(FORWARD)
def spmm_fwd_vector(spark, d):
    return kernels.forward(w.parts(spark, d), w.vectors(spark, d), "vector")


@query(FORWARD)
def spmm_fwd_coordinate(spark, d):
    return kernels.forward(w.parts(spark, d), w.vectors(spark, d), "coordinate")


@query(FORWARD)
def blocked_fwd(spark, d):
    return kernels.tiled(w.parts(spark, d), w.vectors(spark, d), "long", kb=16, cb=16, nb=160, most=256)


@query(BACKWARD)
def spmm_bwd(spark, d):
    return kernels.backward(w.parts(spark, d), w.grad_vectors(spark, d))


@query(BACKWARD)
def spmm_bwd_vector(spark, d):
    return kernels.backward(w.parts(spark, d), w.grad_vectors(spark, d), "vector")


@query(BACKWARD)
def spmm_bwd_scatter(spark, d):
    return kernels.backward(w.parts(spark, d), w.grad_vectors(spark, d), "coordinate")


@query(BACKWARD)
def blocked_bwd(spark, d):
    back = kernels.tiled(w.parts(spark, d).transposed(), w.grad_vectors(spark, d), "long", kb=16, cb=16, nb=160, most=256)
    return back.select("n", F.col("k").alias("c"), F.col("o").alias("d"))


@query(UPDATE)
def sddmm_upd(spark, d):
    return kernels.update(w.parts(spark, d), w.cells(spark, d), w.grads(spark, d))


@query(UPDATE)
def sddmm_upd_vec(spark, d):
    """From vectors of the inputs and of the gradients."""
    return kernels.update_vectors(w.parts(spark, d), w.vectors(spark, d), w.grad_vectors(spark, d).withColumnRenamed("x", "g"))


@query(UPDATE)
def blocked_upd(spark, d):
    return kernels.blocked_update(w.parts(spark, d), w.cells(spark, d), w.grads(spark, d), kb=16, cb=16, nb=160)


@query(
    """, z AS (SELECT k, c, v + 2 * u.dv AS v FROM parts JOIN (SELECT k, c, sum(x * g)::BIGINT AS dv FROM parts JOIN cells USING (c) JOIN grads USING (n, k) GROUP BY ALL) u USING (k, c)),
    s AS (SELECT n, c, sum(v * g)::BIGINT AS d FROM z JOIN grads USING (k) GROUP BY ALL)
    SELECT e.vec_id AS n, p.c AS c, coalesce(d, 0)::BIGINT AS d FROM embeddings e CROSS JOIN places p LEFT JOIN s ON s.n = e.vec_id AND s.c = p.c"""
)
def step_bwd(spark, d):
    """An update of the values, and the backward product with the new ones, over one structure."""
    held, values = structure.taken_apart(w.parts(spark, d))
    values = structure.stepped(values, held.update(w.cells(spark, d), w.grads(spark, d)), 2)
    return held.backward(values, w.grad_vectors(spark, d))


@query(UPDATE)
def stored_upd(spark, d):
    """The update from inputs and gradients that are stored as tiles, bucketed alike."""
    run = uuid.uuid4().hex
    x = tile_store.store(w.vectors(spark, d), f"tiles_x_{run}", w.WIDTH, nb=160, buckets=8)
    g = tile_store.store(w.grad_vectors(spark, d), f"tiles_g_{run}", w.SIZES, nb=160, buckets=8)
    return tile_store.update(w.parts(spark, d), x, g)


@query("SELECT a.k AS i, b.k AS j, sum(a.v * b.v)::BIGINT AS v FROM parts a JOIN parts b ON a.c = b.c GROUP BY ALL")
def gemm_nt(spark, d):
    a = w.parts(spark, d).df.select(F.col("k").alias("i"), F.col("c").alias("j"), "v")
    return kernels.gemm(a, a, transpose_b=True)


@query("SELECT a.c AS i, b.c AS j, sum(a.v * b.v)::BIGINT AS v FROM parts a JOIN parts b ON a.k = b.k GROUP BY ALL")
def gemm_tn(spark, d):
    a = w.parts(spark, d).df.select(F.col("k").alias("i"), F.col("c").alias("j"), "v")
    return kernels.gemm(a, a, transpose_a=True)


@query(
    """, t AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v)::BIGINT AS v FROM parts a JOIN parts b ON a.k = b.k GROUP BY ALL),
    u AS (SELECT p.k AS i, t.j, 2 * sum(p.v * t.v) AS v FROM parts p JOIN t ON p.c = t.i GROUP BY ALL UNION ALL SELECT k, c, 3 * v FROM parts)
    SELECT i, j, sum(v)::BIGINT AS v FROM u GROUP BY ALL"""
)
def gemm_nn(spark, d):
    """2 W (W' W) + 3 W."""
    a = w.parts(spark, d).df.select(F.col("k").alias("i"), F.col("c").alias("j"), "v")
    return kernels.gemm(a, kernels.gemm(a, a, transpose_a=True), alpha=2, beta=3, c=a)


@query(", y AS (SELECT k, sum(v * (c % 7 - 3))::BIGINT AS y FROM trade GROUP BY k) SELECT s_suppkey AS k, coalesce(y, 0)::BIGINT AS y FROM supplier LEFT JOIN y ON k = s_suppkey")
def spmv(spark, d):
    m = w.trade(spark, d)
    return kernels.spmv(m, layout.axis(m.df, m.cols, "c").withColumn("x", F.col("c") % 7 - 3))


@query("SELECT n, sum(x * (c % 5 - 2))::BIGINT AS y FROM cells GROUP BY n")
def gemv(spark, d):
    a = w.vectors(spark, d)
    return kernels.gemv(a, layout.axis(a, w.WIDTH, "c").withColumn("x", F.col("c") % 5 - 2), w.WIDTH)


# Layouts


@query("SELECT k, c, v FROM trade")
def coo_from_table(spark, d):
    return w.trade(spark, d).df


@query("SELECT k - least((SELECT min(least(k, c)) FROM trade), 1) AS k, c - least((SELECT min(least(k, c)) FROM trade), 1) AS c, v FROM trade")
def coo_base_detect(spark, d):
    return layout.rebased(w.trade(spark, d).df)


@query("SELECT k, c, v FROM trade UNION ALL SELECT c, k, v FROM trade WHERE k <> c")
def coo_symmetrize(spark, d):
    return layout.symmetric(w.trade(spark, d).df)


@query("SELECT k, list(c ORDER BY c) AS cols, list(v ORDER BY c) AS vals FROM trade GROUP BY k")
def csr_rows(spark, d):
    return layout.csr_rows(w.trade(spark, d))


@query(", n AS (SELECT s_suppkey AS k, count(t.k) AS n FROM supplier LEFT JOIN trade t ON t.k = s_suppkey GROUP BY ALL) SELECT k, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS start FROM n")
def csr_rowptr(spark, d):
    return layout.row_pointer(w.trade(spark, d))


@query("SELECT k, count(*) AS n FROM trade GROUP BY k")
def row_lengths(spark, d):
    return layout.row_lengths(w.trade(spark, d))


@query("SELECT c AS k, k AS c, v FROM trade")
def csr_transpose(spark, d):
    return w.trade(spark, d).transposed().df.select("k", "c", "v")


@query("SELECT k - 20 AS k, c, v FROM parts WHERE k >= 20 AND k < 51")
def csr_slice(spark, d):
    return w.parts(spark, d).slice_rows(20, 31).df


@query("SELECT (row_number() OVER (ORDER BY k) - 1)::BIGINT AS i, k, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS start FROM (SELECT k, count(*) AS n FROM trade GROUP BY k)")
def dcsr_rows(spark, d):
    return layout.row_table(w.trade(spark, d))


@query("SELECT dense_rank() OVER (ORDER BY k)::BIGINT AS compressed_row, k + 1 AS original_row FROM (SELECT DISTINCT k FROM parts)")
def dcsr_renumber(spark, d):
    return layout.renumbered(w.parts(spark, d))


@query("SELECT s.k, p.c, coalesce(v, 0)::BIGINT AS v FROM sizes s CROSS JOIN places p LEFT JOIN parts t ON t.k = s.k AND t.c = p.c")
def densify(spark, d):
    return layout.densified(w.parts(spark, d))


@query("SELECT a.k, b.c, (a.k * 1000 + b.c)::BIGINT AS v FROM sizes a, places b WHERE (a.k, b.c) IN (SELECT (k, c) FROM parts)")
def sampled_gather(spark, d):
    m = w.parts(spark, d)
    dense = layout.axis(m.df, m.rows, "k").crossJoin(layout.axis(m.df, m.cols, "c")).withColumn("v", F.col("k") * 1000 + F.col("c"))
    return layout.sampled(dense, m)


@query("SELECT (row_number() OVER (ORDER BY c, k) - 1)::BIGINT AS pos_t, (row_number() OVER (ORDER BY k, c) - 1)::BIGINT AS pos FROM trade")
def idxmap(spark, d):
    return layout.transpose_map(w.trade(spark, d))


@query(
    """, e AS (SELECT l_suppkey AS k, l_partkey AS c, floor(l_quantity)::BIGINT AS v FROM lineitem),
    p AS (SELECT k, c, row_number() OVER (ORDER BY k, c, v) - 1 AS pos FROM e)
    SELECT (row_number() OVER (ORDER BY c, k, pos) - 1)::BIGINT AS pos_t, pos::BIGINT AS pos FROM p"""
)
def idxmap_repeats(spark, d):
    """The rows of the table as entries: places of a cell that has several."""
    return layout.transpose_map(w.sales(spark, d))


@query("SELECT k, (row_number() OVER (PARTITION BY k ORDER BY c) - 1)::BIGINT AS i, c FROM trade")
def kidx(spark, d):
    return layout.row_places(w.trade(spark, d))


@query("SELECT k, i // 100 AS piece, list(c ORDER BY c) AS cols, list(v ORDER BY c) AS vals FROM (SELECT k, c, v, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS i FROM trade) GROUP BY ALL")
def csr_pieces(spark, d):
    """Rows of more than a hundred entries are several arrays."""
    return layout.csr_pieces(w.trade(spark, d), 100)


@query("SELECT k // 16 AS kb, c // 32 AS cb, count(*) AS nnz FROM trade GROUP BY ALL")
def block_nnz(spark, d):
    return layout.block_counts(w.trade(spark, d), 16, 32)


@query("SELECT k // 16 AS kb, c // 32 AS cb, list(k % 16 ORDER BY k, c) AS lk, list(c % 32 ORDER BY k, c) AS lc, list(v ORDER BY k, c) AS vals FROM trade GROUP BY ALL")
def block_fill(spark, d):
    return layout.blocks(w.trade(spark, d), 16, 32)


@query(
    """, b AS (SELECT DISTINCT k // 16 AS kb, c // 32 AS cb FROM parts), n AS (SELECT k // 16 AS kb, c // 32 AS cb, k % 16 AS lk, count(*) AS n FROM parts GROUP BY ALL),
    f AS (SELECT b.kb, b.cb, r.range::BIGINT AS lk, coalesce(n, 0) AS n FROM b CROSS JOIN range(16) r LEFT JOIN n ON n.kb = b.kb AND n.cb = b.cb AND n.lk = r.range)
    SELECT kb, cb, lk, (sum(n) OVER (PARTITION BY kb, cb ORDER BY lk) - n)::BIGINT AS start FROM f"""
)
def block_colptr(spark, d):
    return layout.block_pointer(w.parts(spark, d), 16, 32)


@query(
    """, b AS (SELECT DISTINCT k // 8 AS br, c // 8 AS bc FROM parts)
    SELECT br * 8 + i.range AS k, bc * 8 + j.range AS c, coalesce(v, 0)::BIGINT AS v FROM b CROSS JOIN range(8) i CROSS JOIN range(8) j LEFT JOIN parts ON parts.k = br * 8 + i.range AND parts.c = bc * 8 + j.range"""
)
def block_expand(spark, d):
    return layout.block_expanded(layout.block_payloads(w.parts(spark, d), 8), 8)


@query("SELECT n, c, x, n // 160 AS tn, c // 16 AS tc, (n % 160) // 16 AS ti, c % 16 AS lc, n % 16 AS ln FROM cells")
def tile_pack(spark, d):
    return layout.tiles(w.cells(spark, d), 160, 16, 16)


@query("SELECT c AS n, n AS c, x FROM cells")
def dense_transpose(spark, d):
    return layout.dense_transposed(w.cells(spark, d))


# Files


@query("SELECT k, c FROM trade")
def csr_binary_trip(spark, d):
    """The structure of the trade as one binary file, written by all tasks and read in ranges."""
    path = f"{new_path(spark, 'trade')}.bin"
    csr_binary.write(w.trade(spark, d), path)
    return csr_binary.read(spark, path, each=1 << 16).df.select("k", "c")


@query("SELECT k, c, v::DOUBLE AS v FROM trade")
def matrix_market_trip(spark, d):
    """The trade as MatrixMarket text, written and read by its data source."""
    path = f"{new_path(spark, 'trade')}.mtx"
    market_format.write(w.trade(spark, d), path, Kind.integer)
    return market_format.read(spark, path, each=1 << 20).df


# Tensors


@query("SELECT c AS i0, n AS i1, x AS v, c + 72 * n AS \"offset\" FROM cells")
def tensor_offset(spark, d):
    """The embeddings as a tensor, in an allocation that is padded by eight."""
    return w.tensor(spark, d).padded(8, 0).with_offset().select("i0", "i1", "v", "offset")


@query("SELECT c AS i0, n AS i1, i.range::BIGINT AS i2, (c - n * i.range + 3)::BIGINT AS v FROM cells, range(3) i")
def tensor_fill(spark, d):
    n = w.read(spark, d, "embeddings").count()
    return tensor.filled(spark, (64, n, 3), F.col("i0") - F.col("i1") * F.col("i2") + 3).df


@query("SELECT n AS i, x AS v FROM cells WHERE c = 7")
def tensor_fiber(spark, d):
    return w.tensor(spark, d).fiber(1, i0=7)


@query("SELECT n, sum(abs(x))::BIGINT AS l1, sum(x * x)::BIGINT AS l2_squared, max(abs(x)) AS linf FROM cells GROUP BY n")
def norm_vec(spark, d):
    return tensor.array_norms(w.vectors(spark, d)).drop("x")


QUERIES["norm_cells"], ORACLES["norm_cells"] = lambda spark, d: tensor.vector_norms(w.cells(spark, d), ["n"]), ORACLES["norm_vec"]


@query("SELECT (SELECT max(s) FROM (SELECT sum(abs(v))::BIGINT AS s FROM trade GROUP BY c)) AS l1, (SELECT max(s) FROM (SELECT sum(abs(v))::BIGINT AS s FROM trade GROUP BY k)) AS linf, (SELECT sum(v * v)::BIGINT FROM trade) AS frobenius_squared")
def norm_mat(spark, d):
    return tensor.matrix_norms(w.trade(spark, d).df)


@query("SELECT n, c, round(x / l, 9) AS x FROM cells JOIN (SELECT n, sqrt(sum(x * x)) AS l FROM cells GROUP BY n) USING (n)")
def normalize(spark, d):
    rows = tensor.array_normalised(w.vectors(spark, d)).select("n", F.posexplode("x").alias("c", "x"))
    return rows.select("n", F.col("c").cast("long").alias("c"), F.round("x", 9).alias("x"))


@query("SELECT q.doc AS doc_key, t.name AS name FROM (SELECT DISTINCT l_orderkey % 97 AS doc FROM lineitem) q LEFT JOIN (SELECT s_nationkey AS doc, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) t ON q.doc = t.doc")
def lookup_first(spark, d):
    """A table in which the first insert of a key wins, and queries that look keys up."""
    held = layout.first_inserted(w.read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_key"), "s_suppkey", F.col("s_name").alias("name")), ["doc_key"], "s_suppkey", "name")
    asked = w.read(spark, d, "lineitem").select((F.col("l_orderkey") % 97).alias("doc_key")).distinct()
    return layout.looked_up(asked, held, ["doc_key"], "name")


# Errors, rates, generators


@query("SELECT round(sqrt(sum((x // 10 * 10 - x) * (x // 10 * 10 - x))::DOUBLE / sum(x * x)), 9) AS rel_l2, max(abs(x // 10 * 10 - x))::DOUBLE AS max_abs FROM (SELECT abs(x) AS x FROM cells)")
def rel_l2_max_abs(spark, d):
    cells = w.cells(spark, d).select("n", "c", F.abs("x").alias("v"))
    rough = cells.withColumn("v", F.floor(F.col("v") / 10).cast("long") * 10)
    return metrics.errors(cells, rough, ["n", "c"]).select(F.round("rel_l2", 9).alias("rel_l2"), "max_abs")


@query("SELECT nnz, round((1 - nnz::DOUBLE / ((SELECT count(*) FROM supplier) * (SELECT count(*) FROM part))) * 100, 9) AS sparsity FROM (SELECT count(*) AS nnz FROM trade)")
def sparsity(spark, d):
    m = w.trade(spark, d)
    return metrics.sparsity(m.df, m.rows, m.cols).select("nnz", F.round("sparsity", 9).alias("sparsity"))


@query(
    """, e AS (SELECT event_type AS label, round(value * 100)::BIGINT AS elapsed, CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS ops FROM events),
    p AS (SELECT label, count(*) AS calls, sum(elapsed)::BIGINT AS total, max(elapsed) AS most, min(elapsed) AS least, sum(ops)::BIGINT AS ops FROM e GROUP BY label),
    a AS (SELECT * FROM p UNION ALL SELECT 'Total', sum(calls)::BIGINT, sum(total)::BIGINT, sum(most)::BIGINT, sum(least)::BIGINT, sum(ops)::BIGINT FROM p)
    SELECT label, calls, total, round(total / calls, 6) AS average, most, least, round(CASE WHEN ops > 0 AND total > 0 THEN ops / total END, 9) AS rate FROM a"""
)
def profile_summary(spark, d):
    log = w.read(spark, d, "events").select(F.col("event_type").alias("label"), F.round(F.col("value") * 100).cast("long").alias("elapsed"), F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("ops"))
    return metrics.profile(log).select("label", "calls", "total", F.round("average", 6).alias("average"), "most", "least", F.round("rate", 9).alias("rate"))


@query(
    """, e AS (SELECT event_type AS label, epoch_us(ts) AS moment, CASE WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END AS kind FROM events),
    m AS (SELECT label, moment, kind, lag(moment) OVER o AS began, lag(kind) OVER o AS before FROM e WINDOW o AS (PARTITION BY label ORDER BY moment, kind)),
    b AS (SELECT label, sum(CASE WHEN kind = 'begin' THEN 1 ELSE -1 END) = 0 AS balanced FROM e GROUP BY label)
    SELECT label, moment - began AS elapsed, balanced FROM m JOIN b USING (label) WHERE kind = 'end' AND before = 'begin'"""
)
def profile_pairs(spark, d):
    log = w.read(spark, d, "events").select(F.col("event_type").alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 2 == 0, "begin").otherwise("end").alias("kind"))
    return metrics.paired(log)


@query(
    """, e AS (SELECT event_type AS label, epoch_us(ts) AS moment, CASE WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END AS kind FROM events),
    m AS (SELECT label, moment, kind, lag(moment) OVER o AS began, lag(kind) OVER o AS before FROM e WINDOW o AS (PARTITION BY label ORDER BY moment, kind))
    SELECT label, began, moment - began AS elapsed FROM m WHERE kind = 'end' AND before = 'begin'"""
)
def stream_pairs(spark, d):
    """The events as a stream of begins and ends, with timers of event time and a restart."""
    log = w.read(spark, d, "events").select(F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 2 == 0, "begin").otherwise("end").alias("kind"))
    return keyed.pairs_of(log).where("what = 'pair'").select("label", "began", "elapsed")


@query("SELECT 2 * 51 * 64 * (SELECT count(*) FROM embeddings) AS dense_ops, 2 * (SELECT count(*) FROM embeddings) * (SELECT count(*) FROM parts) AS sparse_ops")
def gops(spark, d):
    n = w.read(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    nnz = w.parts(spark, d).df.agg(F.count(F.lit(1)).alias("nnz"))
    return n.crossJoin(nnz).select((F.col("n") * (2 * w.SIZES * w.WIDTH)).alias("dense_ops"), (F.col("nnz") * F.col("n") * 2).alias("sparse_ops"))


@query(
    """, g AS (SELECT a.x AS nb, b.x AS inner_nb FROM (VALUES (16),(32),(80),(160),(320)) a(x), (VALUES (16),(32),(80),(160),(320)) b(x) WHERE NOT (b.x > a.x OR a.x % b.x <> 0)),
    s AS (SELECT (user_id % 3)::BIGINT AS file, event_type AS kernel, nb || '/' || inner_nb AS config, value AS gops FROM events, g WHERE event_id % 5 = (nb + inner_nb) % 5)
    SELECT file, 2400 AS batch, kernel, max(floor(gops))::BIGINT AS gops, max_by(config, (gops, config)) AS config FROM s GROUP BY ALL"""
)
def autotune_best(spark, d):
    """The best of a sweep whose runs are the rows of a log."""
    sizes = [16, 32, 80, 160, 320]
    grid = metrics.grid(spark, {"nb": sizes, "inner_nb": sizes}, "inner_nb > nb or nb % inner_nb <> 0")
    log = w.read(spark, d, "events").select((F.col("user_id") % 3).alias("file"), F.col("event_type").alias("kernel"), (F.col("event_id") % 5).alias("turn"), F.col("value").alias("gops"))
    runs = log.join(F.broadcast(grid), F.col("turn") == (F.col("nb") + F.col("inner_nb")) % 5)
    return metrics.best(runs.select("file", F.lit(2400).alias("batch"), "kernel", F.concat_ws("/", "nb", "inner_nb").alias("config"), "gops"))


@query(FORWARD)
def tuned_fwd(spark, d):
    """The product in the form that timed runs on samples of both sides choose."""
    forms = {k: v for k, v in tuning.forms("long").items() if k in ("blocked", "vector", "tiled-16384")}
    return tuning.tuned(w.parts(spark, d), w.vectors(spark, d), forms, sample=64)


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_suppkey <> l_partkey UNION ALL SELECT DISTINCT greatest(l_suppkey, l_partkey), least(l_suppkey, l_partkey) FROM lineitem WHERE l_suppkey <> l_partkey")
def edge_mirror_dedup(spark, d):
    e = w.read(spark, d, "lineitem").select(F.least("l_suppkey", "l_partkey").alias("s"), F.greatest("l_suppkey", "l_partkey").alias("d")).where("s <> d").distinct()
    return e.select(F.inline(F.array(F.struct(F.col("s").alias("src"), F.col("d").alias("dst")), F.struct(F.col("d").alias("src"), F.col("s").alias("dst")))))


@query(", {1} {0}".format(*generators.power_law_sql(12, 8, 8 * 8 << 12)))
def rmat_edges(spark, d):
    return generators.power_law_edges(spark, 12, 8)


@query("SELECT vec_id AS k, c, -1.0::DOUBLE + ({}) / {}::DOUBLE * 2.0::DOUBLE AS v FROM embeddings, places".format(hashing.draw_sql("0", "vec_id", "c"), float(hashing.PRIME)))
def random_dense(spark, d):
    """Seeded values for every embedding and place."""
    cells = w.read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w.WIDTH - 1).cast("long"))).alias("c"))
    return generators.random_cells(cells, seed=0)


@query(
    """, e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst, l_orderkey % 3 = 0 AS late FROM lineitem WHERE l_suppkey <> l_partkey)
    SELECT src, dst FROM e WHERE late EXCEPT SELECT src, dst FROM e WHERE NOT late"""
)
def bloom_unseen(spark, d):
    """Edges of every third order that no other order has: a filter goes before the join."""
    e = w.read(spark, d, "lineitem").select(F.least("l_suppkey", "l_partkey").alias("src"), F.greatest("l_suppkey", "l_partkey").alias("dst"), (F.col("l_orderkey") % 3 == 0).alias("late")).where("src <> dst")
    return bloom.unseen(e.where("late"), e.where("not late").select("src", "dst").distinct(), ["src", "dst"])


@query("SELECT n, c, (n * 64 + c) // 24 + ((n * 64 + c) % 24 > 0)::BIGINT AS whole, reverse(lpad(bin(c), 8, '0')) AS bits FROM (SELECT n, c FROM cells)")
def scalar_bits(spark, d):
    flat = F.col("n") * 64 + F.col("c")
    return w.cells(spark, d).select("n", "c", hashing.ceil_div(flat, 24).alias("whole"), F.lpad(F.bin(hashing.bit_reversed(F.col("c"), 8)), 8, "0").alias("bits"))
