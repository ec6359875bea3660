"""The Merkle manifest against a tree that is built by hand."""

from __future__ import annotations

import hashlib
import zlib

import pytest

pytest.importorskip("weftline.llm")

from pyspark.sql import functions as F  # noqa: E402

from weftline.llm import manifest  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, `a.b` int, POS long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def steps(levels, i, fan):
    out = []
    for now in levels[:-1]:
        a = i - i % fan
        out.append((now[a:i], now[i + 1 : a + fan]))
        i //= fan
    return out


def brute(rows, fan=3):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of each row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in of[s]], fan) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources], fan), []
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            path = steps(trees[s], i, fan) + steps(top, k, fan)
            spoilt = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "")) if spoilt else r)
            for a, b in path:
                h = digest([*a, h, *b])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest([x for a, b in path for x in a + b]), h, h == top[-1][0]))
    return out


ROWS = [(i, f"s{i % 3}", "en", i, f"text {i}\nline") for i in range(70)]
ROWS += [(100 + i, "one", None, None, "ünï\n😀" * i) for i in range(9)]  # 9 = 3 ** 2: a full tree
ROWS += [(200, None, None, None, None), (201, "", "de", 3, ""), (202, "é", "de", 3, "\n"), (203, "z", "de", 3, "x" * 300_000), (None, "s0", "de", 1, "no id\n"), (None, "s0", "de", 1, "no id\n"), (5, "s2", "en", 5, "text 5\nline"), (5, "s2", "en", 5, "another")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs(spark, levels):
    other = manifest.leaf_hash([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in manifest.COLUMNS])
    docs = table(spark, ROWS)
    made = manifest.build_manifest(docs, check=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, other), levels=levels)
    got = manifest.proofs(made).select("id", "leaf", "subroot", "root", F.sha2(F.translate("path", "*/", ""), 256), "folded_root", F.expr("folded_root = root"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(ROWS), key=repr)
    assert len(made.trees) == {1: 3, 2: 2, 7: 1}[levels]


def test_other_fan_and_columns(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(20)]
    made = manifest.build_manifest(table(spark, rows), columns=("text",), fan=2, levels=2)
    leaves = [leaf((r[4],)) for r in rows]
    assert made.root == tree([tree(leaves, 2)[-1][0]], 2)[-1][0]
    for r in manifest.proofs(made).collect():
        assert r.folded_root == r.root == manifest.fold(leaves[r.id], r.path)
        assert manifest.fold(leaf(("changed",)), r.path) != r.root


def test_no_rows(spark):
    made = manifest.build_manifest(table(spark, ROWS).limit(0))
    assert made.root is None
    assert manifest.proofs(made).collect() == []


def test_store_is_partitioned_by_level(spark):
    made = manifest.build_manifest(table(spark, ROWS))
    assert {r.level: r.n for r in made.trees[0].where("key = 1").groupBy("level").agg(F.count("*").alias("n")).collect()} == {0: 1}
    assert any("level=" in f for f in made.trees[0].inputFiles())
