"""Skeletons, root paths and growing prompts over embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import kinematics as K
from weftline.operators import skeleton as S
from weftline.plans._tables import FRAMES, VECTORS, frames, r6, vectors
from weftline.plans.rotation import _MAT, _MUL
from weftline.streaming import windows

PARENTS, OFFSETS = [-1, 0, 1], [[0.0, 0.0, 0.0], [0.0, 2.0, 0.5], [1.0, 0.0, -0.5]]


def _posed(spark, sf_dir):
    v = vectors(spark, sf_dir, 16)
    return v.select((F.col("vec_id") % 7).alias("seq_id"), F.col("vec_id").alias("frame"), F.slice("vec", 1, 3).alias("root"), F.slice("vec", 4, 12).alias("quats"))


def chain_positions(spark, sf_dir):
    """Global positions of a chain of three joints."""
    x = S.forward_kinematics(_posed(spark, sf_dir), PARENTS, OFFSETS)
    return x.select("seq_id", "frame", *[r6(F.get("positions", i)).alias(f"p{i}") for i in range(9)])


def chain_inverse(spark, sf_dir):
    """The same positions from rotations that are found from them; and with bones twice as long."""
    x = S.forward_kinematics(_posed(spark, sf_dir), PARENTS, OFFSETS).select("seq_id", "frame", "positions", F.slice("rotations", 1, 4).alias("heading"))
    back = S.forward_kinematics(S.inverse_kinematics(x, PARENTS, OFFSETS), PARENTS, OFFSETS).select("frame", F.col("positions").alias("back"))
    far = S.retarget(x, PARENTS, OFFSETS, [[2 * c for c in o] for o in OFFSETS], [1, 2]).select("frame", F.col("positions").alias("far"))
    both = x.join(back, "frame").join(far, "frame")
    return both.select("seq_id", "frame", *[F.round(F.get("back", i), 5).alias(f"p{i}") for i in range(9)], *[F.round(F.get("far", i), 5).alias(f"f{i}") for i in range(9)])


def root_path(spark, sf_dir):
    f = frames(spark, sf_dir).select("seq_id", "frame", (F.col("value") / 1000).alias("root_turn"), (F.col("value") / 50).alias("vx"), (F.col("event_id") % 5 / 10.0).alias("vz"), F.lit(1.5).alias("height"))
    return S.recover_root(f).select("seq_id", "frame", *[r6(F.col(c)).alias(c) for c in ("angle", "x", "y", "z")])


def pose_parts(spark, sf_dir):
    """A pose of eight channels from two parts that share one of them."""
    v = vectors(spark, sf_dir, 9)
    pose = S.whole_pose({"upper": F.slice("vec", 1, 5), "lower": F.slice("vec", 6, 4)}, {"upper": [1, 1, 0, 1, 1, 1, 0, 0], "lower": [0, 0, 1, 0, 0, 1, 1, 1]})
    return v.select("vec_id", *[r6(F.get(pose, i)).alias(f"c{i}") for i in range(8)])


def velocity_position(spark, sf_dir):
    return frames(spark, sf_dir).select("seq_id", "frame", r6(K.position("value", 0.5, 2.0)).alias("position"))


def prompt_blocks(spark, sf_dir):
    """Blocks of sixteen tokens, each with all earlier tokens as its prompt."""
    t = frames(spark, sf_dir).select(F.col("seq_id").alias("stream_id"), F.col("frame").alias("at"), (F.col("event_id") % 512).alias("token"))
    total = F.aggregate("tokens", F.lit(None).cast("long"), lambda s, v: F.coalesce(s + v, s, v))
    known = F.transform("tokens", lambda v: F.coalesce(v, F.lit(0)))  # a null adds nothing to a sum
    x = windows.token_blocks(t, 16).select("stream_id", "block", F.size("tokens").cast("long").alias("n"), total.alias("total"), known.alias("tokens"))
    x = windows.over_prompts(x, lambda prompt: (len(prompt), int(prompt.sum())), ["n_prompt", "prompt_total"])
    return x.select("stream_id", "block", "n", "n_prompt", "total", "prompt_total")


QUERIES = {f.__name__: f for f in (chain_positions, chain_inverse, root_path, pose_parts, velocity_position, prompt_blocks)}
_r = lambda x, n, k=6: f"round({x}, {k}) + 0.0 AS {n}"
_UNIT = "list_transform({v}, lambda x: x / sqrt({v}[1] * {v}[1] + {v}[2] * {v}[2] + {v}[3] * {v}[3] + {v}[4] * {v}[4]))"
_TURN = lambda q, o: [" + ".join(f"({m}) * {c}" for m, c in zip(_MAT(q)[3 * i : 3 * i + 3], o, strict=True)) for i in range(3)]
_CHAIN = f"""{VECTORS}, s AS (SELECT vec_id % 7 AS seq_id, vec_id AS frame, vec[1:3] AS root, vec[4:7] AS a, vec[8:11] AS b FROM vectors), u AS (SELECT *, {_UNIT.format(v='a')} AS q, {_UNIT.format(v='b')} AS p FROM s),
w AS (SELECT *, [{', '.join(_MUL('q', 'p'))}] AS qp FROM u), x AS (SELECT *, [{', '.join(_TURN('q', OFFSETS[1]))}] AS d1, [{', '.join(_TURN('qp', OFFSETS[2]))}] AS d2 FROM w)"""
_PLACES = lambda k, n, scale: ", ".join([_r(f"{scale} * root[{i + 1}]", f"{n}{i}", k) for i in range(3)] + [_r(f"{scale} * (root[{i + 1}] + d1[{i + 1}])", f"{n}{3 + i}", k) for i in range(3)] + [_r(f"{scale} * (root[{i + 1}] + d1[{i + 1}] + d2[{i + 1}])", f"{n}{6 + i}", k) for i in range(3)])
_BEFORE = "OVER (PARTITION BY seq_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLE = {
    "chain_positions": f"WITH {_CHAIN} SELECT seq_id, frame, {_PLACES(6, 'p', 1)} FROM x",
    "chain_inverse": f"WITH {_CHAIN} SELECT seq_id, frame, {_PLACES(5, 'p', 1)}, {_PLACES(5, 'f', 2)} FROM x",
    "root_path": f"""WITH {FRAMES}, f AS (SELECT seq_id, frame, COALESCE(SUM(value / 1000) {_BEFORE}, 0) AS angle, value / 50 AS vx, (event_id % 5) / 10.0::DOUBLE AS vz FROM frames),
g AS (SELECT *, cos(-2 * angle) * vx + sin(-2 * angle) * vz AS dx, -sin(-2 * angle) * vx + cos(-2 * angle) * vz AS dz FROM f)
SELECT seq_id, CAST(frame AS INTEGER) AS frame, {_r('angle', 'angle')}, {_r(f'COALESCE(SUM(dx) {_BEFORE}, 0)', 'x')}, 1.5::DOUBLE AS y, {_r(f'COALESCE(SUM(dz) {_BEFORE}, 0)', 'z')} FROM g""",
    "pose_parts": f"WITH {VECTORS} SELECT vec_id, " + ", ".join(_r(x, f"c{i}") for i, x in enumerate(["vec[1]", "vec[2]", "vec[6]", "vec[3]", "vec[4]", "vec[5] + vec[7]", "vec[8]", "vec[9]"])) + " FROM vectors",
    "velocity_position": f"WITH {FRAMES} SELECT seq_id, CAST(frame AS INTEGER) AS frame, {_r(f'2.0::DOUBLE + 0.5::DOUBLE * COALESCE(SUM(value) {_BEFORE}, 0)', 'position')} FROM frames",
    "prompt_blocks": f"""WITH {FRAMES}, b AS (SELECT seq_id AS stream_id, frame // 16 AS block, COUNT(*) AS n, CAST(SUM(event_id % 512) AS BIGINT) AS total FROM frames GROUP BY ALL), w AS (SELECT *, SUM(n) OVER w AS m, SUM(total) OVER w AS t FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream_id, block, n, CAST(COALESCE(m, 0) AS BIGINT) AS n_prompt, total, CAST(COALESCE(t, 0) AS BIGINT) AS prompt_total FROM w""",
}
