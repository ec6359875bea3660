"""Motion features, their inverses and mocap parameters, over embeddings as poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import rotations as R
from weftline.operators import motion as M
from weftline.plans._tables import VECTORS, r6, vectors

#: Five joints: the root, two hips (also the feet) and two shoulders.
ACROSS, FEET, JOINTS = M.Across(1, 2, 3, 4), [1, 2], 5
OFFSETS, CHAINS = [[0, 0, 0], [1, -1, 0], [-1, -1, 0], [1, 2, 0], [-1, 2, 0]], [[0, 1, 3], [0, 2, 4]]
SKELETON = [M.Joint("Hips", None, (0, 0, 0), "ZXY"), M.Joint("Spine", "Hips", (0, 2, 0.5), "XYZ"), M.Joint("Head", "Spine", (0.5, 1, 0), "YZX")]


def _poses(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select((F.col("vec_id") % 7).alias("seq_id"), F.col("vec_id").alias("frame"), F.slice("vec", 1, 3 * JOINTS).alias("positions"))


def _spread(name: str, n: int, out: str):
    return [r6(F.get(name, i)).alias(f"{out}{i}") for i in range(n)]


def rifke(spark, sf_dir):
    x = M.rifke_features(_poses(spark, sf_dir), JOINTS, FEET, ACROSS)
    return x.select("seq_id", "frame", *[r6(F.col(c)).alias(c) for c in ("root_y", "turn", "vx", "vz")], *_spread("local", 12, "p"))


def rifke_smooth(spark, sf_dir):
    """Headings smoothed as vectors; the poses come back all the same."""
    x = M.rifke_features(_poses(spark, sf_dir), JOINTS, FEET, ACROSS, sigma=1.0)
    back = M.rifke_positions(x)
    return x.join(back, ["seq_id", "frame"]).select("seq_id", "frame", r6(F.col("vx")).alias("vx"), r6(F.get("local", 0)).alias("p0"), *_spread("positions", 15, "q"))


def rifke_back(spark, sf_dir):
    x = M.rifke_positions(M.rifke_features(_poses(spark, sf_dir), JOINTS, FEET, ACROSS))
    return x.select("seq_id", "frame", *_spread("positions", 15, "p"))


def motion_vector(spark, sf_dir):
    x = M.motion_vectors(_poses(spark, sf_dir), OFFSETS, CHAINS, ACROSS, FEET, threshold=0.05, sigma=None)
    return x.select("seq_id", "frame", *[r6(F.col(c)).alias(c) for c in ("turn", "vx", "vz", "height")], *_spread("local", 12, "p"), *_spread("rotations", 24, "r"), *_spread("velocities", 15, "v"), *[F.get("contacts", i).alias(f"c{i}") for i in range(2)])


def motion_back(spark, sf_dir):
    """Positions recovered from motion vectors of bodies that stand on the floor and turn a little."""
    bones = F.array(*[F.lit(float(c)) for o in OFFSETS for c in o])
    still = _poses(spark, sf_dir).withColumn("positions", F.zip_with("positions", bones, lambda v, b: v + b))
    x = M.canonical_positions(still, JOINTS, ACROSS)
    back = M.recover_positions(M.motion_vectors(x, OFFSETS, CHAINS, ACROSS, FEET, sigma=2.0))
    return back.select("seq_id", "frame", *_spread("positions", 15, "p"))


def _rotated(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rots = F.concat(*[R.sixd_to_matrix(F.slice("vec", 6 * k + 1, 6)) for k in range(2)])
    return v.select((F.col("vec_id") % 7).alias("seq_id"), F.col("vec_id").alias("frame"), rots.alias("rots"), F.slice("vec", 13, 3).alias("trans"))


def velocity_features(spark, sf_dir):
    x = M.velocity_features(_rotated(spark, sf_dir), 2)
    return x.select("seq_id", "frame", *[r6(F.col(c)).alias(c) for c in ("height", "vx", "vy", "turned")], *_spread("poses", 12, "p"))


def velocity_back(spark, sf_dir):
    x = M.velocity_inverse(M.velocity_features(_rotated(spark, sf_dir), 2), undo=True)
    return x.select("seq_id", "frame", *_spread("rots", 18, "m"), *_spread("trans", 3, "t"))


def _tracks(spark, sf_dir):
    """Three joints' channels, in degrees."""
    names = [f"{j.name}_{a}rotation" for j in SKELETON for a in j.order] + [f"Hips_{a}position" for a in "XYZ"]
    v = vectors(spark, sf_dir)
    x = v.select((F.col("vec_id") % 7).alias("seq_id"), F.col("vec_id").alias("frame"), F.posexplode(F.slice("vec", 1, len(names))).alias("i", "value"))
    return x.select("seq_id", "frame", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("channel"), (F.col("value") * 60).alias("value"))


def mocap_positions(spark, sf_dir):
    x = M.mocap_positions(_tracks(spark, sf_dir), SKELETON)
    return x.select("seq_id", "frame", "joint", *[r6(F.col(c)).alias(c) for c in "xyz"])


def mocap_exponential(spark, sf_dir):
    x = M.mocap_exponential(_tracks(spark, sf_dir), SKELETON)
    return x.select("seq_id", "frame", "joint", *[r6(F.col(c)).alias(c) for c in ("alpha", "beta", "gamma")])


def mocap_back(spark, sf_dir):
    x = M.exponential_tracks(M.mocap_exponential(_tracks(spark, sf_dir), SKELETON), SKELETON)
    return x.select("seq_id", "frame", "channel", r6(F.col("value")).alias("value"))


QUERIES = {f.__name__: f for f in (rifke, rifke_smooth, rifke_back, motion_vector, motion_back, velocity_features, velocity_back, mocap_positions, mocap_exponential, mocap_back)}

_r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
_ORDER = "(PARTITION BY seq_id ORDER BY frame)"
_p = lambda j, a, of="vec": f"{of}[{3 * j + a + 1}]"
_side = lambda a: f"({_p(1, a)} - {_p(2, a)} + {_p(3, a)} - {_p(4, a)})"
#: Poses with what the front and the floor need: sx, sz (the front, any length), f (its size), lo and hi (feet).
_BODY = f"""{VECTORS}, b0 AS (SELECT vec_id % 7 AS seq_id, vec_id AS frame, vec[1:15] AS vec FROM vectors),
b1 AS (SELECT *, -{_side(2)} AS sx, {_side(0)} AS sz, least({_p(1, 1)}, {_p(2, 1)}) AS foot FROM b0),
b AS (SELECT *, sx / sqrt(sx * sx + sz * sz) AS fx, sz / sqrt(sx * sx + sz * sz) AS fz, MIN(foot) OVER w - ln(0.5::DOUBLE + exp(MIN(foot) OVER w - MAX(foot) OVER w)) AS ground, list_min([{', '.join(_p(j, 1) for j in range(5))}]) AS low FROM b1 WINDOW w AS (PARTITION BY seq_id))"""
_STILL = "[" + ", ".join(f"vec[{i}] + {c}" for i, c in enumerate((c for o in OFFSETS for c in o), 1)) + "] AS vec"
_rx = lambda x, z, c, s: f"(({x}) * ({c}) - ({z}) * ({s}))"
_rz = lambda x, z, c, s: f"(({x}) * ({s}) + ({z}) * ({c}))"
_STEPS = f"""c AS (SELECT *, COALESCE(vec[1] - lag(vec[1]) OVER o, 0) AS dx, COALESCE(vec[3] - lag(vec[3]) OVER o, 0) AS dz, COALESCE(atan2(fx, fz) - lag(atan2(fx, fz)) OVER o, 0) AS turn FROM b WINDOW o AS {_ORDER})"""


def _local(c: str, s: str, ground: str) -> list[str]:
    out = []
    for j in range(1, 5):
        x, z = f"{_p(j, 0)} - vec[1]", f"{_p(j, 2)} - vec[3]"
        out += [_rx(x, z, c, s), f"{_p(j, 1)} - {ground}", _rz(x, z, c, s)]
    return out


def _whole(c: str, s: str, x0: str, y0: str, z0: str) -> list[str]:
    """All joints from a place, turned by one angle: the pose itself, which inverses must give."""
    out = []
    for j in range(5):
        x, z = f"{_p(j, 0)} - {x0}", f"{_p(j, 2)} - {z0}"
        out += [_rx(x, z, c, s), f"{_p(j, 1)} - {y0}", _rz(x, z, c, s)]
    return out


_named = lambda xs, n: ", ".join(_r(x, f"{n}{i}") for i, x in enumerate(xs))
_W = [0.60653065971263342, 0.13533528323661270, 0.011108996538242306, 0.00033546262790251185]  # exp(-i * i / 2)
_G = lambda c: "(" + " + ".join([c] + [f"{w} * (COALESCE(lag({c}, {i}) OVER o, 0) + COALESCE(lead({c}, {i}) OVER o, 0))" for i, w in enumerate(_W, 1)]) + ")"
_FIRST = "first_value({}) OVER (PARTITION BY seq_id ORDER BY frame)"


def _mul(a: list[str], b: list[str]) -> list[str]:
    """The product of quaternions of SQL terms."""
    (w, x, y, z), (s, u, v, t) = a, b
    return [f"({w}*{s} - {x}*{u} - {y}*{v} - {z}*{t})", f"({w}*{u} + {x}*{s} + {y}*{t} - {z}*{v})", f"({w}*{v} - {x}*{t} + {y}*{s} + {z}*{u})", f"({w}*{t} + {x}*{v} - {y}*{u} + {z}*{s})"]


def _turning(prior: str, ups: list[tuple[int, int, str]]) -> str:
    """Steps of a WITH: q1 to q4 as unit quaternions from each bone's offset to its direction."""
    out, last = [], prior
    for a, c, name in ups:
        u = OFFSETS[c]
        v = [f"({_p(c, k)} - {_p(a, k)})" for k in range(3)]
        size = f"sqrt(({' + '.join(f'{k} * {k}' for k in v)}) * {sum(k * k for k in u)})"
        cross = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
        dot = " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True))
        out.append(f"{name}_ AS (SELECT *, [{size} + {dot}, {', '.join(cross)}] AS {name}u FROM {last})")
        out.append(f"{name} AS (SELECT *, list_transform({name}u, lambda t: t / sqrt(list_sum(list_transform({name}u, lambda k: k * k)))) AS {name}q FROM {name}_)")
        last = name
    return ", ".join(out)


def _six(before: str | None, name: str) -> list[str]:
    """Two columns of the matrix of the local rotation of a bone below another, or below the heading."""
    q = [f"{name}q[{i}]" for i in range(1, 5)]
    inverse = ["cos(h)", "0", "-sin(h)", "0"] if before is None else [f"{before}q[1]", *[f"-{before}q[{i}]" for i in (2, 3, 4)]]
    w, x, y, z = _mul(inverse, q)
    return [f"1 - 2*({y}*{y} + {z}*{z})", f"2*({x}*{y} + {w}*{z})", f"2*({x}*{z} - {w}*{y})", f"2*({x}*{y} - {w}*{z})", f"1 - 2*({x}*{x} + {z}*{z})", f"2*({y}*{z} + {w}*{x})"]


def _motion_sql() -> str:
    c, s = "cos(-2 * h)", "sin(-2 * h)"
    moved = [f"(nxt[{i}] - vec[{i}])" for i in range(1, 16)]
    velocities = [x for j in range(5) for x in (_rx(moved[3 * j], moved[3 * j + 2], c, s), moved[3 * j + 1], _rz(moved[3 * j], moved[3 * j + 2], c, s))]
    contact = lambda j: f"CAST({' + '.join(f'{m} * {m}' for m in moved[3 * j : 3 * j + 3])} < 0.05 AS INTEGER)"
    rotations = _six(None, "k1") + _six(None, "k2") + _six("k1", "k3") + _six("k2", "k4")
    return f"""WITH {_BODY}, c AS (SELECT *, CASE WHEN lag(frame) OVER o IS NULL THEN 0 ELSE -atan2(fx, fz) / 2 END AS h FROM b WINDOW o AS {_ORDER}),
d AS (SELECT *, lead(h) OVER o AS h2, lead(vec) OVER o AS nxt FROM c WINDOW o AS {_ORDER}), e AS (SELECT * FROM d WHERE h2 IS NOT NULL),
{_turning('e', [(0, 1, 'k1'), (0, 2, 'k2'), (1, 3, 'k3'), (2, 4, 'k4')])}
SELECT seq_id, frame, {_r('asin(greatest(-1, least(1, sin(h2 - h) * CASE WHEN cos(h2 - h) < 0 THEN -1 ELSE 1 END)))', 'turn')}, {_r(_rx(moved[0], moved[2], 'cos(-2 * h2)', 'sin(-2 * h2)'), 'vx')}, {_r(_rz(moved[0], moved[2], 'cos(-2 * h2)', 'sin(-2 * h2)'), 'vz')}, {_r('vec[2]', 'height')},
{_named(_local(c, s, '0'), 'p')}, {_named(rotations, 'r')}, {_named(velocities, 'v')}, {contact(1)} AS c0, {contact(2)} AS c1 FROM k4"""


#: Two matrices a, b of rotations from six numbers each, and the place t.
def _gram(k: int) -> str:
    d = [f"vec[{6 * k + i}]" for i in range(1, 7)]
    u = f"list_transform([{', '.join(d[:3])}], lambda x: x / sqrt({d[0]}*{d[0]} + {d[1]}*{d[1]} + {d[2]}*{d[2]}))"
    return f"{u} AS u{k}, [{', '.join(d[3:])}] AS w{k}"


_CROSSED = lambda a, b: f"[{a}[2]*{b}[3] - {a}[3]*{b}[2], {a}[3]*{b}[1] - {a}[1]*{b}[3], {a}[1]*{b}[2] - {a}[2]*{b}[1]]"
_ROTS = f"""{VECTORS}, g0 AS (SELECT vec_id % 7 AS seq_id, vec_id AS frame, vec[13:15] AS t, {_gram(0)}, {_gram(1)} FROM vectors),
g1 AS (SELECT *, {', '.join(f'[w{k}[i] - list_dot_product(u{k}, w{k}) * u{k}[i] for i in [1, 2, 3]] AS v{k}' for k in range(2))} FROM g0),
g2 AS (SELECT *, {', '.join(f'list_transform(v{k}, lambda x: x / sqrt(list_dot_product(v{k}, v{k}))) AS y{k}' for k in range(2))} FROM g1),
g AS (SELECT seq_id, frame, t, {', '.join(f'list_concat(list_concat(u{k}, y{k}), {_CROSSED(f"u{k}", f"y{k}")}) AS m{k}' for k in range(2))} FROM g2)"""


def _velocity_sql() -> str:
    turn = lambda m: [f"({m}[{i}] * cos(a) + {m}[{3 + i}] * sin(a))" for i in (1, 2, 3)] + [f"({m}[{3 + i}] * cos(a) - {m}[{i}] * sin(a))" for i in (1, 2, 3)]
    return f"""WITH {_ROTS}, f AS (SELECT *, {_FIRST.format('m0')} AS f0, COALESCE(t[1] - lag(t[1]) OVER o, 0) AS dx, COALESCE(t[2] - lag(t[2]) OVER o, 0) AS dy FROM g WINDOW o AS {_ORDER}),
h AS (SELECT *, atan2(sqrt((f0[8] - f0[6])**2 + (f0[3] - f0[7])**2 + (f0[4] - f0[2])**2), f0[1] + f0[5] + f0[9] - 1) AS theta FROM f),
k AS (SELECT *, theta / (2 * sin(theta)) * (f0[4] - f0[2]) + pi() / 2 AS a FROM h)
SELECT seq_id, frame, {_r('t[3]', 'height')}, {_r('dx * cos(a) + dy * sin(a)', 'vx')}, {_r('dy * cos(a) - dx * sin(a)', 'vy')}, {_r('a', 'turned')}, {_named([*turn('m0'), *[f'm1[{i}]' for i in range(1, 7)]], 'p')} FROM k"""


def _matrix(order: str, angles: list[str]) -> list[str]:
    out = None
    for axis, a in zip(order, angles, strict=True):
        c, s = f"cos(radians({a}))", f"sin(radians({a}))"
        m = {"X": ["1", "0", "0", "0", c, f"-{s}", "0", s, c], "Y": [c, "0", s, "0", "1", "0", f"-{s}", "0", c], "Z": [c, f"-{s}", "0", s, c, "0", "0", "0", "1"]}[axis]
        out = m if out is None else [f"({out[3 * r]}*{m[k]} + {out[3 * r + 1]}*{m[3 + k]} + {out[3 * r + 2]}*{m[6 + k]})" for r in range(3) for k in range(3)]
    return out


_TURNS = ", ".join(f"[{', '.join(_matrix(j.order, [f'60 * vec[{3 * i + k}]' for k in (1, 2, 3)]))}] AS m{i}" for i, j in enumerate(SKELETON))
_MOCAP = f"{VECTORS}, m AS (SELECT vec_id % 7 AS seq_id, vec_id AS frame, vec, {_TURNS}, list_transform(vec[10:12], lambda x: 60 * x) AS place FROM vectors)"
_by = lambda m, v: "[" + ", ".join(" + ".join(f"{m}[{3 * r + k + 1}] * {v[k]}" for k in range(3)) for r in range(3)) + "]"
_prod = "[" + ", ".join(" + ".join(f"m0[{3 * r + k + 1}] * m1[{3 * k + c + 1}]" for k in range(3)) for r in range(3) for c in range(3)) + "]"


def _mocap_sql() -> str:
    place = lambda name, terms: f"SELECT seq_id, frame, '{name}' AS joint, " + ", ".join(_r(" + ".join(t.format(i=i) for t in terms), c) for i, c in enumerate("xyz", 1))
    return f"""WITH {_MOCAP}, n AS (SELECT *, {_by('m0', SKELETON[1].offset)} AS d1, {_prod} AS mm FROM m), o AS (SELECT *, {_by('mm', SKELETON[2].offset)} AS d2 FROM n)
{place('Hips', ['place[{i}]'])} FROM o UNION ALL {place('Spine', ['place[{i}]', 'd1[{i}]'])} FROM o UNION ALL {place('Head', ['place[{i}]', 'd1[{i}]', 'd2[{i}]'])} FROM o"""


def _exponential_sql() -> str:
    one = lambda i, j: f"SELECT seq_id, frame, '{j.name}' AS joint, m{i} AS r FROM m"
    rows = " UNION ALL ".join(one(i, j) for i, j in enumerate(SKELETON))
    v = ["r[8] - r[6]", "r[3] - r[7]", "r[4] - r[2]"]
    return f"""WITH {_MOCAP}, e AS ({rows}), f AS (SELECT *, acos(greatest(-1, least(1, (r[1] + r[5] + r[9] - 1) / 2))) AS theta FROM e)
SELECT seq_id, frame, joint, {', '.join(_r(f'theta / (2 * sin(theta)) * ({x})', n) for x, n in zip(v, ('alpha', 'beta', 'gamma'), strict=True))} FROM f"""


_BACK_CHANNELS = " UNION ALL ".join(f"SELECT vec_id % 7 AS seq_id, vec_id AS frame, '{j.name}_{a}rotation' AS channel, {_r(f'60 * vec[{3 * i + k + 1}]', 'value')} FROM vectors" for i, j in enumerate(SKELETON) for k, a in enumerate(j.order))
ORACLE = {
    "rifke": f"WITH {_BODY}, {_STEPS} SELECT seq_id, frame, {_r('vec[2] - ground', 'root_y')}, {_r('turn', 'turn')}, {_r(_rx('dx', 'dz', 'fz', 'fx'), 'vx')}, {_r(_rz('dx', 'dz', 'fz', 'fx'), 'vz')}, {_named(_local('fz', 'fx', 'ground'), 'p')} FROM c",
    "rifke_back": f"WITH {_BODY}, c AS (SELECT *, {_FIRST.format('fx')} AS s0, {_FIRST.format('fz')} AS c0, {_FIRST.format('vec')} AS v0 FROM b) SELECT seq_id, frame, {_named(_whole('c0', 's0', 'v0[1]', 'ground', 'v0[3]'), 'p')} FROM c",
    "rifke_smooth": f"""WITH {_BODY}, g AS (SELECT * EXCLUDE (fx, fz), {_G('fx')} AS gx, {_G('fz')} AS gz, COALESCE(vec[1] - lag(vec[1]) OVER o, 0) AS dx, COALESCE(vec[3] - lag(vec[3]) OVER o, 0) AS dz FROM b WINDOW o AS {_ORDER}),
h AS (SELECT *, gx / sqrt(gx * gx + gz * gz) AS fx, gz / sqrt(gx * gx + gz * gz) AS fz FROM g), c AS (SELECT *, {_FIRST.format('fx')} AS s0, {_FIRST.format('fz')} AS c0, {_FIRST.format('vec')} AS v0 FROM h)
SELECT seq_id, frame, {_r(_rx('dx', 'dz', 'fz', 'fx'), 'vx')}, {_r(_rx('vec[4] - vec[1]', 'vec[6] - vec[3]', 'fz', 'fx'), 'p0')}, {_named(_whole('c0', 's0', 'v0[1]', 'ground', 'v0[3]'), 'q')} FROM c""",
    "motion_vector": _motion_sql(),
    "motion_back": f"""WITH {_BODY.replace('vec[1:15] AS vec', _STILL)}, c AS (SELECT *, {_FIRST.format('fx')} AS s0, {_FIRST.format('fz')} AS c0, {_FIRST.format('vec')} AS v0, MIN(low) OVER (PARTITION BY seq_id) AS floor_, lead(frame) OVER {_ORDER} AS following FROM b)
SELECT seq_id, frame, {_named(_whole('c0', 's0', 'v0[1]', 'floor_', 'v0[3]'), 'p')} FROM c WHERE following IS NOT NULL""",
    "velocity_features": _velocity_sql(),
    "velocity_back": f"WITH {_ROTS}, f AS (SELECT *, {_FIRST.format('t')} AS t0 FROM g) SELECT seq_id, frame, {_named([f'm0[{i}]' for i in range(1, 10)] + [f'm1[{i}]' for i in range(1, 10)], 'm')}, {_named(['t[1] - t0[1]', 't[2] - t0[2]', 't[3]'], 't')} FROM f",
    "mocap_positions": _mocap_sql(),
    "mocap_exponential": _exponential_sql(),
    "mocap_back": f"WITH {VECTORS} {_BACK_CHANNELS}",
}
