"""Prompts of whole streams: every block with all tokens before it, in code and SQL."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline import plans
from weftline.plans import skeletons
from weftline.streaming import windows

KIND = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_every_block_has_its_whole_prompt(spark, tmp_path):
    """Streams longer than any context; null users, null ids and a block of them; negative ids."""
    r = random.Random(3)
    start = datetime(2026, 1, 1)
    ids = {0: [r.randrange(10**6) for _ in range(300)], 1: [7], 2: [-i for i in range(40)], 3: [None if 16 <= i < 32 or i == 50 else i for i in range(60)], None: list(range(500, 533))}
    rows = [(x, start + timedelta(seconds=i), user, "a", 1.0, "") for user, xs in ids.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/events.parquet")
    got = {(x.stream_id, x.block): (x.n, x.n_prompt, x.total, x.prompt_total) for x in skeletons.prompt_blocks(spark, str(tmp_path)).collect()}
    want = {}
    for user, xs in ids.items():
        tokens = [None if x is None else x % 512 if x >= 0 else -(-x % 512) for x in xs]
        known = lambda part: [x for x in part if x is not None]
        for at in range(0, len(tokens), 16):
            block, prompt = tokens[at : at + 16], tokens[:at]
            want[user, at // 16] = (len(block), len(prompt), sum(known(block)) if known(block) else None, sum(known(prompt)))
    assert got == want
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    sql = con.execute(f"SELECT stream_id, block, n, n_prompt, total, prompt_total FROM ({plans.oracle_sql()['prompt_blocks']})").fetchall()
    assert {x[:2]: x[2:] for x in sql} == want


def test_prompts_of_blocks_in_many_batches(spark):
    r = random.Random(4)
    streams = {s: [[r.randrange(99) for _ in range(r.choice((0, 1, 16, 700)))] for _ in range(n)] for s, n in (("a", 30), ("b", 1), (None, 12))}
    blocks = spark.createDataFrame([(s, i, t, 2 * i) for s, bs in streams.items() for i, t in enumerate(bs)], "stream_id string, block int, tokens array<int>, more int")
    step = lambda prompt: (len(prompt), sum((i + 1) * int(x) for i, x in enumerate(prompt)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = windows.over_prompts(blocks, step, ["n", "sum"])
        got = {(y.stream_id, y.block): (y.more, y.n, y.sum) for y in x.collect()}
        assert windows.over_prompts(blocks.where("block < 0"), step, ["n", "sum"]).collect() == []
        with pytest.raises(Exception, match="a token is null"):
            windows.over_prompts(blocks.withColumn("tokens", F.array(F.lit(None).cast("int"))), step, ["n", "sum"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert x.columns == ["stream_id", "block", "more", "n", "sum"]
    assert got == {(s, i): (2 * i, *step([t for b in bs[:i] for t in b])) for s, bs in streams.items() for i in range(len(bs))}
