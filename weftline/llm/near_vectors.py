"""Embedding near-dedup by an exact metric range join (operator 4).

Vectors of length one are within a Euclidean distance r = sqrt(2 - 2c) of each
other if their cosine is at least c. Pivots, sampled from the vectors of each
label in proportion to their number, partition the vectors: each belongs to the
cell of its nearest pivot. By the triangle inequality a vector y can only have
partners in the cell of pivot q if its distance to q exceeds that to its own
pivot by at most 2r; the bisecting hyperplane of both pivots must also be within
r of y. Such vectors are copied to that cell (of two cells, the one with the
lower number judges a pair), and all cells join independently. Inside a cell,
rows are sorted by their distance to the pivot, and only blocks whose distances
come within r are compared.

How often vectors are copied is measured on the pivots before they are used: of
their prefixes of doubling length, the longest that copies a vector to MOST_COPIES
cells on average is taken. Vectors without structure keep few cells, which are then
cut into more blocks instead of being copied everywhere.

Equal vectors of a label are one class from the start, so thousands of copies
cost one row; their links are counted by multiplicity. Large cells are cut into
blocks of a fixed size; every pair of blocks is a task group of its own, so no
group grows with the data. Cosines are compared in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do those with a null label; vectors of other
lengths only link with vectors of the same length; rows with equal vec_id and
vector are copies, linked like any other pair of rows; rows with an equal vec_id are
one vector to the components. A row with a null vec_id is a partner like any other
and connects its partners, but its component is the smallest vec_id that it reaches,
null if there is none, and it is not kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._graph import components, cut, forest, table

#: Bound of the pivots that are broadcast; beyond it cells grow and are cut into more blocks.
MOST_PIVOTS = 4096
#: Vectors of an average cell, and rows of a block of a cell.
CELL, BLOCK = 1024, 2048
#: Cells that a vector goes to on average, at most.
MOST_COPIES = 6


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe from overflow and underflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, of: np.dtype = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(of) if len(column) else np.zeros((0, 1), of)


def _classes(vectors: DataFrame) -> DataFrame:
    """(label, vector, dim, copies, node): usable vectors, equal ones once, numbered."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0.0)
    clean = vectors.where(F.coalesce(usable, F.lit(False))).select("label", F.transform(v, lambda x: x + F.lit(0.0)).alias("vector"), F.col("vec_id").cast("long").alias("vec_id"))
    # the numbers are those of the checkpoint, which makes them final
    return cut(clean.groupBy("label", "vector").agg(F.count("*").alias("copies")).select("label", "vector", F.size("vector").alias("dim"), "copies", F.monotonically_increasing_id().alias("node")))


def _reached(x: np.ndarray, p: np.ndarray, r: float) -> np.ndarray:
    """Which cells each vector goes to: its own, and those that may hold a partner.

    Of two cells that could judge a pair, the one with the lower number does.
    """
    at = np.arange(len(x))
    dots = x @ p.T
    own = dots.argmax(1)
    far = np.sqrt(np.maximum(2 - 2 * dots, 0))
    gap = np.sqrt(np.maximum(2 - 2 * (p[own] @ p.T), 0))
    reach = (dots[at, own][:, None] - dots <= (r + 1e-9) * gap) & (far - far[at, own][:, None] <= 2 * r + 1e-9)
    reach &= np.arange(len(p)) < own[:, None]
    reach[at, own] = True
    return reach


def _affordable(p: np.ndarray, r: float, most: float) -> np.ndarray:
    """The longest prefix (of doubling length) of the pivots that copies vectors to
    `most` cells on average, measured on the other pivots."""
    n = 1
    while 2 * n <= len(p):
        probe = p[2 * n :] if len(p) >= 3 * n else p[n:]
        if len(probe) and _reached(probe, p[: 2 * n], r).sum() > most * len(probe):
            break
        n *= 2
    return p if n * 2 > len(p) and _reached(p, p, r).sum() <= most * len(p) else p[:n]


def _pivots(classes: DataFrame, cell: int, r: float, most: float) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, dim): at least one, at most about one for `cell` vectors."""
    sizes = {(r.label, r.dim): r.n for r in classes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(MOST_PIVOTS).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    each = max(cell, -(-total // MOST_PIVOTS))
    hashed = F.pmod(F.xxhash64("vector"), F.lit(each))
    sample = classes.where(hashed == 0).select("label", "dim", "vector").limit(2 * MOST_PIVOTS).collect()
    out: dict[tuple, list] = {}
    for row in sorted(sample, key=lambda row: hashlib.md5(repr((row.label, row.vector)).encode()).digest()):
        out.setdefault((row.label, row.dim), []).append(row.vector)
    return {k: _affordable(_unit(np.array(v)), r, most) for k, v in out.items()}


def near_vectors(vectors: DataFrame, cosine: float = 0.98, cell: int = CELL, block: int = BLOCK, most: float = MOST_COPIES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`."""
    classes = _classes(vectors)
    r = float(np.sqrt(max(2 - 2 * cosine, 0))) + 1e-9
    pivots = _pivots(classes, cell, r, most)
    label_type = vectors.schema["label"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                p = pivots.get(key)
                step = len(rows) if p is None else max(1, (1 << 20) // len(p))
                for i in range(0, len(rows), step):
                    yield assign(batch.take(pa.array(rows[i : i + step], pa.int32())), p)

    def assign(part: pa.RecordBatch, p: np.ndarray | None) -> pa.RecordBatch:
        """The vectors of one label with each cell that they go to."""
        at = np.arange(part.num_rows)
        if p is None or len(p) == 1:
            who, cells, home = at, np.zeros(len(at), np.int32), np.ones(len(at), bool)
        else:
            x = _unit(_matrix(part.column("vector")))
            who, cells = np.nonzero(_reached(x, p, r))
            home = cells == (x @ p.T).argmax(1)[who]
        out = part.select(["label", "dim", "node", "copies", "vector"]).take(pa.array(who, pa.int32()))
        return pa.record_batch([*out.columns, pa.array(cells.astype(np.int32)), pa.array(home)], names=["label", "dim", "node", "copies", "vector", "cell", "home"])

    placed = classes.select("label", "dim", "node", "copies", "vector").mapInArrow(spread, f"label {label_type}, dim int, node long, copies long, vector array<double>, cell int, home boolean")
    placed = cut(placed)
    # each row goes to one block of its cell, and to the groups of all pairs with that block
    group = ["label", "dim", "cell"]
    sizes = placed.groupBy(*group).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("node", "vector"), F.col("blocks")).cast("int")
    dealt = placed.join(sizes.drop("n"), group).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*group, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") <= F.col("other")).alias("left"), "node", "copies", "vector", "home")

    def join(table_: pa.Table) -> pa.Table:
        x = _unit(_matrix(table_.column("vector").combine_chunks()))
        node, copies = table_.column("node").to_numpy(), table_.column("copies").to_numpy()
        home, left = np.asarray(table_.column("home")), np.asarray(table_.column("left"))
        alone = table_.column("lo")[0].as_py() == table_.column("hi")[0].as_py()
        rings = np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
        order = np.argsort(rings, kind="stable")
        x, node, copies, home, left, rings = x[order], node[order], copies[order], home[order], left[order], rings[order]
        links = np.zeros(len(x), np.int64)
        ones, twos = [], []
        for i in range(0, len(x), 256):
            j = min(i + 256, len(x))
            end = int(np.searchsorted(rings, rings[j - 1] + r + 1e-9, "right"))
            hit = x[i:j] @ x[i:end].T >= cosine
            hit &= np.arange(i, end)[None, :] > np.arange(i, j)[:, None]
            hit &= home[i:j, None] | home[None, i:end]
            if not alone:
                hit &= left[i:j, None] != left[None, i:end]
            np.add.at(links, np.arange(i, j), hit @ copies[i:end])
            links[i:end] += copies[i:j] @ hit
            a, b = np.nonzero(hit)
            ones.append(node[i + a])
            twos.append(node[i + b])
        tree = forest(np.concatenate(ones), np.concatenate(twos))
        some = np.flatnonzero(links)
        u = node[some].tolist() + [a for a, _ in tree]
        v = [None] * len(some) + [b for _, b in tree]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(links[some].tolist() + [None] * len(tree), pa.int64())})

    # links of each class by number, and a spanning forest of the links
    found = cut(dealt.groupBy(*group, "lo", "hi").applyInArrow(join, "u long, v long, n long"))
    own = vectors.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    ids = cut(own.join(classes.select("label", "vector", "node", "copies"), ["label", "vector"], "left").select("vec_id", "node", "copies"))
    # rows with an equal vec_id are one vector
    least = ids.where("vec_id is not null and node is not null").groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("z")).where("u <> z")
    same = ids.join(least, "vec_id").select("u", F.col("node").alias("v"))
    its = components(found.where("v is not null").select("u", "v").union(same)).withColumnRenamed("component", "root")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("more"))
    full = cut(ids.join(counts, "node", "left").join(its, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = full.groupBy("root").agg(F.min("vec_id").alias("component"))
    out = full.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component")))
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("more", F.lit(0)), F.lit(0))
    return out.select("vec_id", n_links.alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op4_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (SELECT vec_id, least(vec_id, COALESCE((SELECT MIN(v) FROM r WHERE u = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, (SELECT COUNT(*) FROM l WHERE u = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM c
"""
}
QUERIES = {"op4_near_vectors": op4_near_vectors}
