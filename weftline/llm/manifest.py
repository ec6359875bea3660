"""A Merkle manifest of a dataset, with a proof for each row (operator 11).

Every row is a leaf: the SHA-256 of its columns, each with its length in bytes. Leaves
are sorted into runs by group (source) and key (doc_id), and numbered: each run
numbers its own rows, and one row a run and group gives the numbers to start from.
Then trees of FAN children a node grow in tiers of LEVELS levels. In a tier the nodes
are dealt by block, FAN ** LEVELS neighbours of one tree; a task streams its blocks
in order, makes each level from the one before it, and appends all nodes to a Parquet
table that is partitioned by level. The tops of blocks are the leaves of the next
tier, so there are as many tiers as the logarithm of the largest group to the base
FAN ** LEVELS. The subroots are the leaves of one more tree, whose top is the root.

Proofs go down again: the nodes of all levels of a tier and the paths above its blocks
are dealt by block and merged in order of their coordinates, and each leaf takes its
siblings at the coordinates above it. A block's path upwards is one row, so long paths
only exist in the tasks that write them out.

No text is ever exchanged, but 32 bytes a digest. A group that a third of all rows
share is spread over runs and blocks like any other. In one task come only one row a
run (to sum up the numbers) and the rows of one block.

Defined cases: a null column counts as `-`; a null group is a group of its own, the
first, and a null key is the first of its group; rows with equal group and key come in
the order of their leaves, so repeated rows are leaves of their own with equal digests;
an empty table has no leaf, no root and no row; only the hashed columns are read, so other
columns cannot clash. Numbers and dates are hashed as Spark's text of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._graph import appended, cut, table, written

#: Children of a node, and levels of a tier.
FAN, LEVELS = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """The node store: a tree for each group, and one over their subroots.

    `trees` and `top` are lists of tiers, each (level, key, pos, hash, size, top, id,
    check) as read from its level-partitioned table; `groups` has (key, grp), `root` is
    the hexadecimal root, or None for no rows.
    """

    trees: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None
    fan: int
    levels: int


def leaf_hash(columns: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the columns, each `-` or its UTF-8 length, a colon and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _digest(texts: list[str]):
    return hashlib.sha256("".join(texts).encode())


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their run, the number of their group in it, and of the row in the group."""
    run, group, row, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        spans = pc.run_end_encode(batch.column("grp"))
        of, at, start = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64), 0
        for value, end in zip(spans.values.to_pylist(), spans.run_ends.to_pylist(), strict=True):
            if group < 0 or value != last:
                group, row, last = group + 1, 0, value
            of[start:end], at[start:end] = group, np.arange(row, row + end - start)
            row, start = row + end - start, end
        yield pa.record_batch({"run": pa.array(np.full(batch.num_rows, run, np.int32)), "s": pa.array(of), "i": pa.array(at), **{c: batch.column(c) for c in ("grp", "id", "hash", "check")}})


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with key (the number of their group), pos and size (of the group); and the groups."""
    kinds = {c: leaves.schema[c].dataType.simpleString() for c in ("grp", "id")}
    order = ["grp", "id", "hash", "tie"]
    runs = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"run int, s long, i long, grp {kinds['grp']}, id {kinds['id']}, hash binary, check binary"))
    per = cut(runs.groupBy("run", "s").agg(F.count("*").alias("n"), F.first("grp").alias("grp")))
    ahead = Window.partitionBy("grp").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("grp")))
    new = (F.col("before") == 0).cast("long")
    # one row a run: how many groups begin in it, and whether its first one began before
    each = per.groupBy("run").agg(F.sum(new).alias("begun"), F.min_by(1 - new, "s").alias("carried"))
    each = each.withColumn("groups", F.coalesce(F.sum("begun").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = written(per.join(each, "run").select("run", "s", "grp", "before", "size", (F.col("groups") + F.col("s") - F.col("carried")).alias("key")))
    placed = runs.join(plan.drop("grp"), ["run", "s"]).select("key", (F.col("before") + F.col("i")).alias("pos"), "hash", "size", "id", "check")
    return placed, plan.where("before = 0").select("key", "grp", "size")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, block) of a sorted stream."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if parts and last != (key[a], block[a]):
                yield pa.Table.from_batches(parts)
                parts = []
            last = (key[a], block[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _tier(nodes: DataFrame, first: int, fan: int, levels: int) -> DataFrame:
    """All nodes of a tier whose leaves are `nodes`, on level `first`, from its stored table."""
    width = fan**levels
    kind = nodes.schema["id"].dataType.simpleString()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            key, block, size = (rows.column(c)[0].as_py() for c in ("key", "block", "size"))
            now = [h.hex() for h in rows.column("hash").to_pylist()]
            level, pos, digests = [np.full(len(now), first, np.int32)], [rows.column("pos").to_numpy()], rows.column("hash").to_pylist()
            for k in range(1, levels + 1):
                if size <= width and len(now) == 1:
                    break
                made = [_digest(now[i : i + fan]) for i in range(0, len(now), fan)]
                now = [h.hexdigest() for h in made]
                digests += [h.digest() for h in made]
                level.append(np.full(len(now), first + k, np.int32))
                pos.append(block * fan ** (levels - k) + np.arange(len(now)))
            n, inner = len(digests), len(digests) - rows.num_rows
            top = np.zeros(n, bool)
            top[-1] = size <= width
            later = lambda c: pa.concat_arrays([rows.column(c).combine_chunks(), pa.nulls(inner, rows.column(c).type)])  # noqa: E731, B023
            yield pa.record_batch({"level": np.concatenate(level), "key": np.full(n, key), "pos": np.concatenate(pos), "hash": pa.array(digests, pa.binary()), "size": np.full(n, size), "top": top, "id": later("id"), "check": later("check")})

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / width)).repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return appended(dealt.mapInArrow(grow, f"level int, key long, pos long, hash binary, size long, top boolean, id {kind}, check binary"), "level")


def _grown(leaves: DataFrame, largest: int, fan: int, levels: int) -> list[DataFrame]:
    """The tiers of all trees over (key, pos, hash, size, id, check), of up to `largest` leaves."""
    tiers, width = [_tier(leaves, 0, fan, levels)], fan**levels
    while largest > width:
        largest = -(-largest // width)
        first = len(tiers) * levels
        above = tiers[-1].where((F.col("level") == first) & ~F.col("top")).withColumn("size", F.ceil(F.col("size") / width))
        tiers.append(_tier(above.select("key", "pos", "hash", "size", "id", "check"), first, fan, levels))
    return tiers


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """(key, hash, tier) of the tops of all trees."""
    found = [t.where("top").select("key", "hash", F.lit(i).alias("tier")) for i, t in enumerate(tiers)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", check: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The manifest of a table, one tree for each value of `group`, in the order of `key`.

    `check` may give the hexadecimal leaf of a row as it is to be verified (null: as
    hashed), such as that of a later copy.
    """
    name = lambda c: F.col(f"`{c}`")
    checked = F.unhex(check) if check is not None else F.lit(None).cast("binary")
    rows = docs.select(name(group).alias("grp"), name(key).alias("id"), F.unhex(leaf_hash([name(c) for c in columns])).alias("hash"), checked.alias("check"), F.monotonically_increasing_id().alias("tie"))
    placed, groups = _placed(written(rows))  # written, so that sampling the runs' bounds hashes no text again
    n, largest = groups.agg(F.count("*"), F.max("size")).first()
    trees = _grown(placed, largest or 0, fan, levels)
    heads = _tops(trees).select(F.lit(0).cast("long").alias("key"), F.col("key").alias("pos"), "hash", F.lit(n).cast("long").alias("size"), F.col("tier").alias("id"), F.lit(None).cast("binary").alias("check"))
    top = _grown(heads, n, fan, levels)
    root = _tops(top).first()
    return Manifest(trees, top, groups.select("key", "grp"), root.hash.hex() if root else None, fan, levels)


def _extract(tier: DataFrame, first: int, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """(key, pos, hash, id, check, path, subroot) of a tier's leaves.

    `above` has (key, block, path, subroot), the way up from the top of each block.
    A path has a step for each level: left siblings, `*`, right siblings, `/`.
    """
    kind = tier.schema["id"].dataType.simpleString()
    step = F.element_at(F.array(*[F.lit(fan ** (levels - k)) for k in range(levels + 1)]), F.col("level") - first + 1)
    nodes = tier.select("key", F.floor(F.col("pos") / step).alias("block"), "level", "pos", "hash", "size", "id", "check", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("subroot"))
    ways = above.select("key", "block", F.lit(first + levels + 1).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("long").alias("size"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("check"), "path", "subroot")
    merged = nodes.union(ways).repartition("key", "block").sortWithinPartitions("key", "block", F.desc("level"), "pos")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            level = rows.column("level").to_numpy()
            way, subroot = rows.column("path")[0].as_py(), rows.column("subroot")[0].as_py()
            begin = int(np.searchsorted(-level, -first))  # where the tier's leaves begin
            hashes = rows.column("hash").to_pylist()
            paths = [way]
            for k in sorted({int(x) for x in level[1:]}, reverse=True)[1:]:  # below the top: a node's own step, then its parent's way
                a, b = np.searchsorted(-level, [-k, -k + 1])
                now, steps = [h.hex() for h in hashes[a:b]], []
                for i, up in zip(range(0, len(now), fan), paths, strict=True):
                    run = now[i : i + fan]
                    steps += ["".join(run[:j]) + "*" + "".join(run[j + 1 :]) + "/" + up for j in range(len(run))]
                paths = steps
            leaves = rows.slice(begin)
            for i in range(0, leaves.num_rows, 512):
                part = leaves.slice(i, 512).combine_chunks()
                columns = {c: part.column(c).combine_chunks() for c in ("key", "pos", "hash", "id", "check")}
                yield pa.record_batch({**columns, "path": pa.array(paths[i : i + 512], pa.string()), "subroot": pa.array([subroot] * part.num_rows, pa.string())})

    return merged.mapInArrow(scan, f"key long, pos long, hash binary, id {kind}, check binary, path string, subroot string")


def _downwards(tiers: list[DataFrame], heads: DataFrame, fan: int, levels: int) -> DataFrame:
    """The paths of all leaves; `heads` has (key, tier, path, subroot), the way up from each tree."""
    found = None
    for t in reversed(range(len(tiers))):
        above = heads.where(F.col("tier") == t).select("key", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if found is not None:
            above = above.union(found.select("key", F.col("pos").alias("block"), "path", "subroot"))
        found = _extract(tiers[t], t * levels, above, fan, levels)
        if t:
            found = cut(found)
    return found


def fold(leaf: str, path: str) -> str:
    """The root that follows from a hexadecimal leaf and its path."""
    for step in path.split("/")[:-1]:
        left, _, right = step.partition("*")
        leaf = _digest([left, leaf, right]).hexdigest()
    return leaf


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root), a row a leaf.

    The siblings are in `path` (see _extract). folded_root is recomputed from the row's
    checked leaf, or its own where there is none, along the path.
    """
    m = manifest
    spark = m.groups.sparkSession
    none = spark.range(1).select(F.col("id").alias("key"), F.lit(len(m.top) - 1).alias("tier"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    # of the leaves of the upper tree: pos is the number of a group, id the tier of its subroot
    heads = cut(_downwards(m.top, none, m.fan, m.levels).select(F.col("pos").alias("key"), F.col("id").alias("tier"), "path", F.lower(F.hex("hash")).alias("subroot")))
    found = _downwards(m.trees, heads, m.fan, m.levels)
    kind = found.schema["id"].dataType.simpleString()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, path = [h.hex() for h in b.column("hash").to_pylist()], b.column("path")
            seen = [c.hex() if c is not None else own for c, own in zip(b.column("check").to_pylist(), leaf, strict=True)]
            yield pa.record_batch({"id": b.column("id"), "leaf": leaf, "subroot": b.column("subroot"), "path": path, "folded_root": pa.array([fold(x, p) for x, p in zip(seen, path.to_pylist(), strict=True)], pa.string())})

    done = found.mapInArrow(folded, f"id {kind}, leaf string, subroot string, path string, folded_root string")
    return done.select("id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), "path", "folded_root")


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # of half the rows the leaf of the text without its line breaks, where that is another text
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    other = leaf_hash([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    found = proofs(build_manifest(docs, check=F.when(tampered, other)))
    proof = F.sha2(F.translate("path", "*/", ""), 256)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "COALESCE(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c=text if c == "text" else c) for c in COLUMNS) + ")"
#: The siblings to the left and right of each node that has a parent, and the climb along them.
_TREE = """{0}(level, grp, pos, h, n) AS (
  SELECT 0, grp, pos, h, COUNT(*) OVER (PARTITION BY grp) FROM {0}_leaves
  UNION ALL SELECT level + 1, grp, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {0} WHERE n > 1 GROUP BY level, grp, pos // 3, n
), {0}_sides AS (
  SELECT a.level, a.grp, a.pos, COALESCE(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, COALESCE(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {0} a JOIN {0} b ON a.level = b.level AND a.grp IS NOT DISTINCT FROM b.grp AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), {0}_climb(k, level, grp, pos, folded, proof) AS (
  SELECT k, 0, grp, pos, folded, proof FROM {0}_start
  UNION ALL SELECT c.k, c.level + 1, c.grp, c.pos // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
  FROM {0}_climb c JOIN {0}_sides s ON s.level = c.level AND s.grp IS NOT DISTINCT FROM c.grp AND s.pos = c.pos
)"""
ORACLE = {
    "op11_merkle": f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), docs AS (
  SELECT *, {_LEAF('text')} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS other,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents, bits
), placed AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs
), own_leaves AS (SELECT source AS grp, i AS pos, leaf AS h FROM placed
), own_start AS (SELECT k, source AS grp, i AS pos, CASE WHEN crc % 2 = 0 THEN other ELSE leaf END AS folded, '' AS proof FROM placed
), {_TREE.format('own')}, subroots AS (SELECT grp, h, level, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i FROM own WHERE n = 1
), whole_leaves AS (SELECT 0 AS grp, i AS pos, h FROM subroots
), whole_start AS (SELECT c.k, 0 AS grp, s.i AS pos, c.folded, c.proof FROM own_climb c JOIN subroots s ON s.grp IS NOT DISTINCT FROM c.grp AND s.level = c.level
), {_TREE.format('whole')}, root AS (SELECT h, level FROM whole WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM placed p JOIN subroots s ON s.grp IS NOT DISTINCT FROM p.source JOIN whole_climb c ON c.k = p.k JOIN root r ON r.level = c.level
"""
}
QUERIES = {"op11_merkle": op11_merkle}
