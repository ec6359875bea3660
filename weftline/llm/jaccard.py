"""N-gram Jaccard join by several global token orders (operator 8).

Tokens are the hashes of word shingles. In any global order of tokens, two sets
with a Jaccard similarity of at least t share at least l tokens among the first
n - ceil(t n) + l of each, for every l; here l is about half of the unavoidable
difference, and a pair needs the smaller l of both. Candidates must pass this
filter under two orders of different kinds, and the length filter, before their
sets are compared exactly.

The first order is rare-first by counts over the whole corpus, from a count
sketch of a fixed size; the second is an order of hashes, in which frequent and
rare tokens mix. An order only decides speed: any order gives the same links.

1. One pass hashes each text's set; documents with equal sets form a class.
2. Prefix tokens of the classes are counted; those of one class are dropped, and
   then the classes with fewer left than their smallest partner could need.
3. Two linked sets share one of their very first tokens (l = 1). Such a token's
   classes are its list. In each list the classes are compared with one of them,
   the list's centre, so near copies soon form one component; each class takes
   only its most promising centre, so this costs one comparison a class.
4. Lists within one component are done; the others are grouped by their first
   class. In a group, only classes of different components are still compared: those
   of its largest component with all others, and the others with each other, in
   blocks of a fixed size, each pair of blocks in a task group of its own. There
   the filters under both orders and the lengths are intersected, and pairs that
   pass are compared exactly. A task group returns a spanning forest of its links,
   never the pairs.

Defined cases: a null or blank text has an empty set, links with nothing and is
its own component; texts of fewer words than a shingle are one token; rows with
an equal doc_id are one node with several sets; a null doc_id gets a null
component; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import _text
from weftline.llm._graph import components, cut, forest, packed, quoted, table, unpacked

#: Slots of the sketch; one byte each is broadcast, whatever the size of the corpus.
SLOTS_LOG2, PARTS = 22, 64
#: Sets of a block of a list, and rounds that compare lists with one of their classes.
BLOCK, ROUNDS = 1024, 1
#: Members of a centre that are compared in one task.
SALT = 4096
_K = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0x5BD1E9955BD1E995)


def token_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    data = _text.ascii_lower(data)
    starts, ends, of = _text.words(data, at)
    h = _text.span_hashes(data, starts, ends)
    rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _K + h[k : k + len(rolled)]
    rolled = _text.mix(rolled)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = _text.mix(np.array([whole]))[0] ^ x
            out.append(_text.mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def shared_at_least(n: np.ndarray, percent: int) -> np.ndarray:
    """The l of a set of n tokens: prefix tokens shared with a set of its size."""
    return 1 + (n - (percent * n + 99) // 100 + 1) // 2


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix tokens that a set of n tokens shares with any linked set.

    l never falls with the size, so the smallest set that may link decides.
    """
    return shared_at_least((percent * n + 99) // 100, percent)


def _prefix(tokens: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens under the order of `rank`, then of the token."""
    n = len(tokens)
    return tokens[np.argsort(rank, kind="stable")[: n - (percent * n + 99) // 100 + shared_at_least(n, percent)]] if n else tokens


def second_prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    return _prefix(tokens, _text.mix(tokens ^ _ORDER), percent)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint32)


def _sets_and_sketch(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, k1, k2) with two keys of each set, and the sketch of token counts.

    The sketch holds eight times the logarithm of the counts, a byte a slot.
    """
    part = (1 << SLOTS_LOG2) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SLOTS_LOG2, np.uint32)
        for batch, data, at in _text.groups(batches):
            sets = token_sets(data, at, words)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            np.add.at(sketch, _slots(flat), np.uint32(1))
            edge = np.concatenate(([0], np.cumsum(sizes)))
            keys = []
            for salt in (0x35, 0xC7):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_text.mix(flat ^ np.uint64(salt)), dtype=np.uint64)))
                keys.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
            m = batch.num_rows
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n": sizes, "k1": keys[0], "k2": keys[1], "part": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
        some = [(i, p) for i, p in enumerate(np.split(sketch, PARTS)) if p.any()]
        yield pa.record_batch({**{k: pa.nulls(len(some), pa.int64()) for k in ("doc_id", "n", "k1", "k2")}, "part": pa.array([i for i, _ in some], pa.int32()), "counts": pa.array([_packed(p) for _, p in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + _unpacked(counts).astype(np.int64)
        scaled = [np.minimum(np.round(8 * np.log2(1 + x)), 255).astype(np.uint8) for x in sums.values()]
        yield pa.record_batch({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in scaled], pa.binary())})

    both = cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, part int, counts binary"))
    # a fixed number of parts; each task of the pass gives one row to each at most
    added = both.where("part is not null").select("part", "counts").repartition(PARTS // 2, "part").mapInArrow(add, "part int, counts binary")
    sketch = np.zeros(1 << SLOTS_LOG2, np.uint8)
    for r in added.collect():
        sketch[r.part * part : (r.part + 1) * part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.uint8)
    return both.where("part is null").select("doc_id", "n", "k1", "k2"), sketch


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each left array shares with each right one (all distinct within an array).

    A product of 0/1 matrices over the values of both sides, some columns at a time.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    ka, kb = np.searchsorted(both, a), np.searchsorted(both, b)
    ok = ka < len(both)
    ok[ok] = both[ka[ok]] == a[ok]
    ra, ka = ra[ok], ka[ok]
    ok = kb < len(both)
    ok[ok] = both[kb[ok]] == b[ok]
    rb, kb = rb[ok], kb[ok]
    for low in range(0, len(both), columns):
        width = min(columns, len(both) - low)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = (ka >= low) & (ka < low + width)
        x[ra[here], ka[here] - low] = 1
        here = (kb >= low) & (kb < low + width)
        y[rb[here], kb[here] - low] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def _group_links(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the components of two blocks."""
    sets = {c: [x.values.to_numpy() for x in group.column(c)] for c in ("first", "tokens")}
    sets["second"] = [second_prefix(t.view(np.uint64), percent) for t in sets["tokens"]]
    n = np.array([len(t) for t in sets["tokens"]])
    node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
    left = np.asarray(group.column("left"))
    same = group.column("kind")[0].as_py() and group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
    i, j = (np.arange(len(n)), np.arange(len(n))) if same else (np.flatnonzero(left), np.flatnonzero(~left))
    out: list[tuple[int, int]] = []
    for low in range(0, len(i), BLOCK):
        rows, cols = i[low : low + BLOCK], j
        for name in ("", "first", "second", "tokens"):
            if not len(rows) or not len(cols):
                break
            a, b = n[rows][:, None], n[cols]
            if not name:
                fit = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (comp[rows][:, None] != comp[cols])
            else:
                k = shared_counts([sets[name][x] for x in rows], [sets[name][x] for x in cols])
                fit &= 100 * k >= percent * (a + b - k) if name == "tokens" else k >= np.minimum(shared_at_least(a, percent), shared_at_least(b, percent))
            # only what still has a partner goes to the next filter
            r, c = fit.any(1), fit.any(0)
            rows, cols, fit = rows[r], cols[c], fit[np.ix_(r, c)]
        if len(rows) and len(cols):
            x, y = np.nonzero(fit)
            out += forest(node[rows[x]], node[cols[y]])
    return out


def _same_id(sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that share a doc_id, if there are any."""
    if sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    member = sets.join(classes, ["n", "k1", "k2"]).select("doc_id", "node").distinct()
    least = member.groupBy("doc_id").agg(F.min("node").alias("v"))
    return cut(member.join(least, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct())


def _with_components(posts: DataFrame, links: DataFrame | None) -> DataFrame:
    """(token, node, comp) of the lists that still have several components."""
    if links is None:
        return posts.select("token", "node", F.col("node").alias("comp"))
    found = components(links).withColumnRenamed("component", "its")
    named = posts.select("token", "node").join(found, "node", "left").select("token", "node", F.coalesce("its", "node").alias("comp"))
    # cut, so that the join gets exchanges of its own and hot tokens can be split
    several = cut(named.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z").select("token"))
    return cut(named.join(several, "token"))


def _centre_links(posts: DataFrame, full: DataFrame, percent: int, seed: int) -> DataFrame:
    """Links (u, v) of each class with the most promising centre of its lists."""
    centre = cut(posts.groupBy("token").agg(F.min_by("node", F.xxhash64("node", F.lit(seed))).alias("centre"), F.min_by("comp", F.xxhash64("node", F.lit(seed))).alias("its")))
    met = posts.join(centre, "token").where("comp <> its").groupBy("node", "centre").agg(F.count("*").alias("k"))
    best = cut(met.groupBy("node").agg(F.max_by("centre", F.col("k") * 256 + F.pmod(F.col("centre"), F.lit(256))).alias("centre")))
    salts = best.groupBy("centre").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    one = full.join(best, "node").join(salts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "n", F.col("tokens").alias("a"))
    two = full.join(salts, F.col("node") == F.col("centre")).select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("m"), F.col("tokens").alias("b"))
    k = F.size(F.array_intersect("a", "b"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return cut(one.join(two, ["centre", "salt"]).where(fits).withColumn("k", k).where(100 * F.col("k") >= percent * (F.col("n") + F.col("m") - F.col("k"))).select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())


def _dealt(member: DataFrame, block: int) -> DataFrame:
    """Each class of a group in every pair of blocks that it belongs to.

    Lists with the same class first in an order of hashes are one group, as lists of
    one family of copies mostly are; so a class is in few groups. The group's largest
    component has blocks of its own, which meet those of the others (kind false); the
    others also meet each other (kind true).
    """
    first = cut(member.groupBy("token").agg(F.min_by("node", F.xxhash64("node", F.lit(-1))).alias("home")))
    member = cut(member.join(first, "token").select("home", "node", "comp").distinct())
    sizes = member.groupBy("home", "comp").agg(F.count("*").alias("c"))
    major = cut(sizes.groupBy("home").agg(F.sum("c").alias("m"), F.max("c").alias("c"), F.max_by("comp", "c").alias("major")).where("m > c"))
    blocks = major.select("home", "major", F.ceil(F.col("c") / block).cast("int").alias("ours"), F.ceil((F.col("m") - F.col("c")) / block).cast("int").alias("theirs"))
    is_major = F.col("comp") == F.col("major")
    x = member.join(blocks, "home").withColumn("mine", F.pmod(F.xxhash64("node"), F.when(is_major, F.col("ours")).otherwise(F.col("theirs"))).cast("int"))
    group = lambda kind, lo, hi, left: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), left.alias("left"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("mine")
    ours = F.transform(to("theirs"), lambda i: group(False, mine, i, F.lit(True)))
    theirs = F.transform(to("ours"), lambda i: group(False, i, mine, F.lit(False)))
    each = F.transform(to("theirs"), lambda i: group(True, F.least(mine, i), F.greatest(mine, i), mine <= i))
    return x.select("home", "node", "comp", F.explode(F.when(is_major, ours).otherwise(F.concat(theirs, each))).alias("g")).select("home", "node", "comp", "g.*")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.

    Documents link when 100 * |A and B| >= percent * |A or B|. `block` is the
    largest number of sets that one side of a task group holds on average,
    `rounds` the number of comparisons with centres before.
    """
    sets, sketch = _sets_and_sketch(docs, words)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            found = token_sets(data, at, words)
            n = np.array([len(s) for s in found], np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "need": needed(n, percent), "short": n - (percent * n + 99) // 100 + 1, "first": _lists([_prefix(s, sketch[_slots(s)], percent) for s in found])})

    # a class of equal sets is one node, named by its smallest doc_id
    classes = cut(sets.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node")))
    firsts = docs.select("doc_id", "text").mapInArrow(prefixes, "doc_id long, need long, short long, first array<long>")
    named = classes.select(F.col("node").alias("doc_id")).distinct()
    tokens = cut(firsts.join(named, "doc_id").select(F.col("doc_id").alias("node"), "need", "short", "first"))
    posts = tokens.select("node", "need", "short", F.posexplode("first").alias("at", "token")).select("node", "need", "token", (F.col("at") < F.col("short")).alias("near"))
    for _ in range(2):  # sets that are out may leave tokens of one set behind
        shared = posts.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1").select("token")
        posts = cut(posts.join(shared, "token"))
        enough = posts.groupBy("node", "need").agg(F.count("*").alias("m")).where("m >= need").select("node").distinct()
        posts = posts.join(enough, "node", "left_semi")
    posts = posts.where("near").select("token", "node").distinct()
    shared = posts.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1").select("token")
    posts = cut(posts.join(shared, "token"))
    nodes = cut(posts.select("node").distinct())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _text.groups(batches):
            found = token_sets(data, at, words)
            yield pa.record_batch({"node": batch.column("doc_id").cast(pa.int64()), "n": np.array([len(s) for s in found], np.int64), "first": _lists([_prefix(s, sketch[_slots(s)], percent) for s in found]), "tokens": _lists(found)})

    pulled = docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id").mapInArrow(whole, "node long, n long, first array<long>, tokens array<long>")
    full = cut(pulled.where("n > 0"))
    links = _same_id(sets, classes)
    for i in range(rounds):
        met = _centre_links(_with_components(posts, links), full, percent, i)
        links = met if links is None else links.union(met)
    member = _with_components(posts, links)

    def compare(group: pa.Table) -> pa.Table:
        found = _group_links(group, percent)
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    rest = cut(full.join(_dealt(member, block), "node").groupBy("home", "kind", "lo", "hi").applyInArrow(compare, "u long, v long"))
    groups = components(rest if links is None else links.union(rest)).withColumnRenamed("component", "found")
    # every class, with the components of those that have links
    out = sets.join(classes, ["n", "k1", "k2"], "left").join(groups, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "node", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of each group of linked ones.

    Rows without a doc_id stay; of rows that share the doc_id, the one with the
    smallest hash of its text stays.
    """
    found = jaccard_components(docs, words, percent)
    stay = cut(found.where("component_id = doc_id").groupBy("doc_id").count())
    kept = docs.join(stay.select("doc_id"), "doc_id", "left_semi")
    if not stay.where("count > 1").isEmpty():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        kept = kept.select("doc_id", "text", packed(docs.columns)).withColumn("at", F.row_number().over(order)).where("at = 1").select(*unpacked(docs.columns))
    return kept.select(*quoted(docs.columns)).union(docs.where("doc_id is null"))


def op8_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


ORACLE = {
    "op8_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT w.doc_id, COUNT(s.sh) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), p AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, COALESCE(MIN(r.v), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n
"""
}
QUERIES = {"op8_jaccard": op8_jaccard}
