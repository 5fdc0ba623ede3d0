"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector (three rounds of random signs and a fast Hadamard transform) and takes the axis, with its sign,
that is nearest.  A table joins two hashes to a bucket.  Every vector is stored in its bucket of each table and also asks the three
buckets that follow when the second nearest axis is taken for either hash or both.  Pairs that meet, at least one of them stored there, are
verified by their cosine in double precision; a pair that meets more than once counts where it meets first.

Equal vectors are one node with a weight before anything is hashed, so groups of copies cost nothing.  A bucket of more than
``BLOCK`` entries is dealt out as pairs of blocks, to many tasks.  Tasks hand on sums of links and a spanning forest of the links
they found, never the pairs: a dense group of near copies stays linear in what is shuffled.

The index is approximate by its nature: ``recall`` in the tests compares it with brute force.  Defined cases: null and
zero vectors and those with null or non-finite components link with nothing; vectors of different lengths never link; an
empty table gives no rows; repeated rows and ids are vectors of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.llm.common import KEY, keyed, python_ready, written
from assetflow.llm.components import components
from assetflow.session import table

TABLES, COSINE, BLOCK, SEED = 10, 0.9, 1024, 20
BUFFER = 8192  # rows of whole groups handled at once in a task


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of signs and a Hadamard transform along the rows, whose length is a power of two."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            h *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(vectors, tables, 4): the bucket of each vector, then the three it asks as well."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng([SEED, dim])
    out = np.zeros((n, tables, 4), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes = []
        for _ in range(2):
            y = rotate(padded, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(y)
            first = size.argmax(1)
            size[rows, first] = -1
            second = size.argmax(1)
            axes.append([2 * a + (y[rows, a] > 0) for a in (first, second)])
        for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
            out[:, t, k] = (axes[0][i] * (2 * d) + axes[1][j]) * 65536 * tables + (dim % 65536) * tables + t
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _entries(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and bucket, without the vector."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("vec").to_pylist()])
        for n in np.unique(sizes):
            own = batch.take(pa.array(np.flatnonzero(sizes == n)))
            for at in range(0, len(own), 1024):
                part = own.slice(at, 1024)
                b = buckets(_vectors(part.column("vec")), tables)
                each = 4 * tables
                node = np.repeat(part.column("node").to_numpy(), each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(b.ravel()), pa.array(np.tile(np.arange(each) % 4 == 0, len(part)))], names=["node", "bucket", "stored"]
                )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least node of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside runs of equal values, a bounded number at a time."""
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    stop = np.repeat(edges[1:], np.diff(edges))
    left = np.arange(len(groups))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = step = 0
    while len(left):
        step += 1
        left = left[left + step < stop[left]]
        if len(left):
            held.append((left, left + step))
            total += len(left)
        if held and (total >= 200_000 or not len(left)):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, total = [], 0


def _links(rows: pa.Table, tables: int, cosine: float) -> pa.RecordBatch:
    """Sums of links and a forest from whole groups of rows."""
    group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
    code = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]).any(1))])
    stored, block, node, weight = (rows.column(c).to_numpy() for c in ("stored", "block", "node", "weight"))
    raw = rows.column("vec").to_pylist()
    size = np.array([len(v) for v in raw])
    x = np.zeros((len(raw), size.max() // 8))
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        x[own, : n // 8] = np.frombuffer(b"".join(raw[k] for k in own), np.float64).reshape(len(own), -1)
    norm = np.sqrt((x * x).sum(1))
    same = group[:, 1] == group[:, 2]
    found = []
    for a, b in _pairs(code):
        ok = (stored[a] | stored[b]) & (same[a] | (block[a] != block[b])) & (node[a] != node[b]) & (size[a] == size[b])
        a, b = a[ok], b[ok]
        for k in range(0, len(a), 65536):
            p, q = a[k : k + 65536], b[k : k + 65536]
            near = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
            found.append((p[near], q[near]))
    a, b = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    # a pair counts only in the first table, and there in the least bucket, in which it meets
    used = np.unique(np.concatenate([a, b]))
    place = np.zeros(len(raw), np.int64)
    place[used] = np.arange(len(used))
    keep = np.ones(len(a), bool)
    first = np.full(len(a), -1, np.int64)
    sig = np.zeros((len(used), tables, 4), np.int64)
    for n in np.unique(size[used]):
        own = np.flatnonzero(size[used] == n)
        sig[own] = buckets(x[used[own], : n // 8], tables)
    for at in range(0, len(a), 65536):
        s, r = sig[place[a[at : at + 65536]]], sig[place[b[at : at + 65536]]]
        where = np.full(len(s), -1, np.int64)
        for t in range(tables):
            big = np.iinfo(np.int64).max
            both = np.where(s[:, t, 0] == r[:, t, 0], s[:, t, 0], big)
            asked = np.where((r[:, t, 1:] == s[:, t, :1]).any(1), s[:, t, 0], big)
            asks = np.where((s[:, t, 1:] == r[:, t, :1]).any(1), r[:, t, 0], big)
            here = np.minimum(np.minimum(both, asked), asks)
            where = np.where((where < 0) & (here < big), here, where)
        first[at : at + 65536] = where
    keep = first == group[a, 0]
    a, b = a[keep], b[keep]
    nodes, at = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([weight[b], weight[a]]), minlength=len(nodes)).astype(np.int64)
    fa, fb = _forest(node[a], node[b]) if len(a) else (nodes, nodes)
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(nodes), none(len(fa))]),
            pa.concat_arrays([pa.array(sums), none(len(fa))]),
            pa.concat_arrays([none(len(nodes)), pa.array(fa)]),
            pa.concat_arrays([none(len(nodes)), pa.array(fb)]),
        ],
        names=["node", "links", "a", "b"],
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) < BUFFER:
            continue
        rows = pa.Table.from_batches(held)
        group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
        last = len(rows) - int((group[::-1] == group[-1]).all(1).argmin()) if (group != group[-1]).any() else 0
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).to_batches()
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows


def _even(v: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component near 1: squares neither overflow nor vanish, and no
    digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """A row for each row of ``df``: the id, n_links, component_id and kept."""
    rows = keyed(df.select(id_col, vector), id_col)
    doubles = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(doubles, fine) & F.exists(doubles, lambda x: x != 0)
    valid = F.when(F.coalesce(good, F.lit(False)), doubles)
    own = written(rows.select(KEY, id_col, valid.alias("v")), "vectors")
    nodes = own.filter("v is not null").groupBy("v").agg(F.min(KEY).alias("node"), F.count(F.lit(1)).alias("weight"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [_even(np.asarray(v, np.float64)).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array(vecs, pa.binary())], names=["node", "weight", "vec"])

    nodes = written(python_ready(nodes).mapInArrow(pack, "node bigint, weight bigint, vec binary"), "nodes")
    hashed = lambda batches: _entries(batches, tables)
    entries = written(nodes.select("node", "vec").mapInArrow(hashed, "node bigint, bucket bigint, stored boolean"), "entries")
    # only buckets in which a pair can meet go on; large ones are dealt out by blocks
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("s")).filter("n > 1 and s > 0")
    parts = sizes.select("bucket", F.ceil(F.col("n") / BLOCK).alias("parts"))
    placed = entries.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = placed.withColumn("o", other).select(
        "bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "stored", "node"
    )
    full = dealt.join(nodes, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches):
            yield _links(part, tables, cosine)

    got = written(full.mapInArrow(link, "node bigint, links bigint, a bigint, b bigint"), "links")
    links = got.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(got.filter("a is not null").select("a", "b"))
    of_node = nodes.select("node", "weight").join(links, "node", "left").join(groups, "node", "left")
    of_key = own.filter("v is not null").join(own.filter("v is not null").groupBy("v").agg(F.min(KEY).alias("node")), "v").select(KEY, "node").join(of_node, "node")
    out = own.select(KEY, id_col).join(of_key, KEY, "left")
    first = F.coalesce("component", "node", KEY)
    names = own.select(F.col(KEY).alias("_first"), F.col(id_col).alias("component_id"))
    return out.withColumn("_first", first).join(names, "_first").select(
        id_col,
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        "component_id",
        (F.col(KEY) == F.col("_first")).alias("kept"),
    )


@llm_query("op2_embedding_dedup")
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
