"""Outliers: isolation forests, and local outlier factors by neighbours from an index of pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

TREES, SAMPLE, NEIGHBOURS = 300, 256, 20
EULER = 0.5772156649015329
NODE = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def path_constant(n: float) -> float:
    """The mean depth of a leaf that still holds n rows."""
    return 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, seed: int) -> list[tuple]:
    """A tree's nodes; leaves have feature -1."""
    rng, limit, nodes = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, len(x))))), []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            nodes[at] = (at, -1, 0.0, -1, -1, len(rows), depth)
            return at
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        below = rows[:, f] <= cut
        nodes[at] = (at, f, float(cut), add(rows[below], depth + 1), add(rows[~below], depth + 1), len(rows), depth)
        return at

    add(x, 0)
    return nodes


def isolation_forest(df: DataFrame, columns: list[str], ident: str = "id", trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """ident and score (0 to 1, higher: easier to isolate). columns: numeric, nulls at 0.

    A pool of about 16 samples' rows, those whose hash is lowest, is drawn in one pass; each
    tree takes the rows of the pool whose hash with its number is lowest, and is grown in a task
    of its own. Trees have a bounded size and are sent with the scoring function.
    """
    n = df.count()
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    rows = df.select(F.col(ident).alias("id"), values.alias("x"))
    u = lambda t: F.pmod(F.xxhash64(t, "id"), F.lit(1 << 30)) / float(1 << 30)
    pool = cut(rows.where(u(F.lit(-1)) < 16 * sample / max(n, 1)))
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(u(F.col("tree")) < 2 * sample / max(1, min(n, 16 * sample)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("id").iloc[: 4 * sample].sample(n=min(sample, len(pdf)), random_state=tree)
        return pd.DataFrame([(tree, *node) for node in grow(np.array(pdf["x"].tolist(), float), tree)], columns=[c.split()[0] for c in NODE.split(", ")])

    grown = dealt.groupBy("tree").applyInPandas(build, NODE).toPandas()  # trees x 2 x sample nodes at most
    forest = [g.sort_values("node") for _, g in grown.groupby("tree")]
    packed = [tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "size", "depth")) for g in forest]
    norm = path_constant(min(sample, max(n, 2)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), float).reshape(len(x), -1)
        total = np.zeros(len(m))
        for feature, cut, left, right, size, depth in packed:
            at = np.zeros(len(m), int)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                here = at[inner]
                at[inner] = np.where(m[inner, feature[here]] <= cut[here], left[here], right[here])
            total += depth[at] + np.array([path_constant(s) for s in size])[at]
        return pd.Series(2.0 ** (-total / max(1, len(packed)) / max(norm, 1e-9)))

    return rows.select(F.col("id").alias(ident), score("x").alias("score"))


# Neighbours ------------------------------------------------------------------------------

PIVOTS, SAMPLED = 24, 2000
#: Most parts (their boxes are sent with a function), parts that a row's first look takes, and queries met with a part in one task.
MOST_PARTS, FIRST, QUERIES = 20_000, 3, 8192
#: MB of queries and of rows that meet in one task after the first look, and groups of queries, if there are parts for so many.
ASKING, HELD, GROUPS = 16, 64, 12
#: Pairs whose products are made at once, and pairs that are computed from differences at once.
PRODUCTS, PAIRS = 1 << 19, 1 << 16
FOUND = "id long, n array<struct<distance:double,other:long>>"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def spread_pivots(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before."""
    chosen, nearest = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def places(may: np.ndarray, n: int) -> np.ndarray:
    """Flat places of the n that are true; few among many are looked for by eight at a time."""
    flat = may.reshape(-1)
    if n > len(flat) >> 6:
        return np.flatnonzero(flat)
    whole = len(flat) & ~7
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at, place = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([8 * eights[at] + place, whole + np.flatnonzero(flat[whole:])])


class Nearest:
    """The k nearest others of each row, itself left out, the smaller id among equals, as parts of the others come.

    One product tells a part's rows that may lie within a row's limit, the k-th distance so far, in
    single precision if its rounding is small beside the limits; only those are computed from
    differences. limit: distances beyond which nothing is wanted.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.limit = np.full(len(x), np.inf) if limit is None else limit.copy()
        self.centre = x.mean(axis=0)
        self.scale = np.abs(x - self.centre).max() or 1.0
        z = (x - self.centre) / self.scale
        self.square = (z * z).sum(axis=1)
        self.z = {np.float64: np.column_stack([z, np.ones(len(z))])}
        self.z[np.float32] = self.z[np.float64].astype(np.float32)
        self.best = self.none = (np.empty(0, int), np.empty(0, int), np.empty(0))
        self.new: list[tuple] = []
        self.n_new = 0

    def meet(self, rows: np.ndarray, others: np.ndarray, y: np.ndarray) -> None:
        """Others (their ids and y) for some of the rows."""
        k, z = self.k, (y - self.centre) / self.scale
        half = (z * z).sum(axis=1) / 2
        z = np.column_stack([z, -half])
        rounding = (z.shape[1] + 8) * (np.sqrt(self.square.max()) + np.sqrt(2 * half.max())) ** 2
        limits = (self.limit[rows] / self.scale) ** 2
        kind = np.float32 if rounding * np.finfo(np.float32).eps <= 0.01 * np.median(limits) else np.float64
        margin, z, step = rounding * float(np.finfo(kind).eps), z.astype(kind).T, max(1, PRODUCTS // len(y))
        products, mays = (np.empty((min(step, len(rows)), len(y)), t) for t in (kind, bool))  # made once: fresh memory costs as much as comparing
        for start in range(0, len(rows), step):
            at = rows[start : start + step]
            product = np.matmul(self.z[kind][at], z, out=products[: len(at)])  # less half the square of a distance, but for the row's own square
            least = ((self.square[at] - (self.limit[at] / self.scale) ** 2) / 2 - margin).astype(kind)
            may = np.greater_equal(product, least[:, None], out=mays[: len(at)])
            n = np.count_nonzero(may)
            if n > 2 * k * len(at) and k + 1 < len(y):
                kth = np.partition(product, len(y) - 1 - k, axis=1)[:, len(y) - 1 - k]  # one more than k: a row may meet itself
                may &= product >= (kth - 2 * margin).astype(kind)[:, None]
                n = np.count_nonzero(may)
            found = places(may, n)
            for i in range(0, len(found), PAIRS):
                row, other = np.divmod(found[i : i + PAIRS], len(y))
                row = at[row]
                distance = np.sqrt(((y[other] - self.x[row]) ** 2).sum(axis=1))
                keep = (distance <= self.limit[row]) & (others[other] != self.ids[row])
                self.new.append((row[keep], others[other[keep]], distance[keep]))
                self.n_new += int(keep.sum())
                if self.n_new > max(PAIRS, 8 * len(self.ids)):
                    self.settle()

    def settle(self) -> None:
        """Keep k others of each row; its limit is the k-th."""
        row, other, distance = (np.concatenate(c) for c in zip(self.best, *self.new, strict=True))
        order = np.lexsort((other, distance, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row = order[rank < self.k], row[rank < self.k]
        self.best, self.new, self.n_new = (row, other[order], distance[order]), [], 0
        last = rank[rank < self.k] == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], distance[order][last])

    def table(self) -> pa.Table:
        self.settle()
        row, other, distance = self.best
        rows, starts = np.unique(row, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), pa.array(other, pa.int64())], ["distance", "other"])
        found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pairs)
        return pa.table({"id": pa.array(self.ids[rows], pa.int64()), "n": found})


NOTHING = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.list_(pa.struct({"distance": pa.float64(), "other": pa.int64()})))})


def matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float).reshape(len(x), -1)


def vectors(x: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(x).to_numpy().reshape(len(x), -1)


def k_nearest(found: DataFrame, k: int) -> DataFrame:
    """id, n: the k nearest of what was found, in order; a row has at most k from each task that it was in."""
    return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("n"))), 1, k).alias("n"))


def neighbours(df: DataFrame, k: int = NEIGHBOURS, block: int = 2000, probes: int | None = None, stats: dict | None = None) -> DataFrame:
    """id, other, distance: the k nearest rows of each, exactly, the smaller id among equals. df: id, x array<double>, ids distinct.

    Rows are dealt into parts of about `block` by their nearest pivot and their distance from it.
    By the triangle inequality no row of a part is nearer to another row than their distances from a
    pivot differ, so a part's box of least and greatest distances from all pivots bounds it. A row
    meets its own part, then the FIRST nearest ones, and then, with the k-th distance so found, only
    parts that may still hold something as near. For the latter, groups of parts of ASKING MB meet
    groups of HELD MB: a task holds no more however many rows there are, and a row is sent once for
    each group. Where rows do not cluster at all (many even dimensions), few parts can be left out,
    and the pairs compared grow with the square of the rows; there,
    probes takes a fixed number of nearest parts instead, which is no longer exact.

    stats, if given, gets the numbers of compared pairs (at most), of all pairs, and of rows sent to tasks after the first look.
    """
    n = df.count()
    if not n:
        return df.sparkSession.createDataFrame([], "id long, other long, distance double")
    parts = -(-n // max(block, n // MOST_PARTS))
    sample = df.select("x").orderBy(F.xxhash64("id")).limit(SAMPLED).toPandas()
    pivots = spread_pivots(matrix(sample["x"]))

    @F.pandas_udf("array<double>")
    def to_pivots(x: pd.Series) -> pd.Series:
        m = matrix(x)
        return pd.Series(list(np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1)))  # products would round far from the origin

    rows = df.select("id", "x", to_pivots("x").alias("d")).withColumn("own", F.array_min("d"))
    rows = rows.withColumn("cell", F.array_position("d", F.col("own"))).repartitionByRange(parts, "cell", "own", "id")
    rows = cut(rows.select("id", "x", "d", F.spark_partition_id().alias("part")))
    sides = [f(F.get("d", F.lit(p))).alias(f"{name}{p}") for p in range(len(pivots)) for name, f in (("low", F.min), ("high", F.max))]
    boxes = rows.groupBy("part").agg(F.count("*").alias("rows"), *sides).orderBy("part").toPandas()  # a row for each part
    numbers, sizes = boxes["part"].to_numpy(), boxes["rows"].to_numpy()
    low, high = (boxes[[f"{side}{p}" for p in range(len(pivots))]].to_numpy() for side in ("low", "high"))

    def least(d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """No row of these parts (their places in numbers) is nearer to a row with the distances d."""
        out = np.zeros((len(d), len(at)))
        for p in range(d.shape[1]):
            np.maximum(out, low[at, p] - d[:, p : p + 1], out=out)
            np.maximum(out, d[:, p : p + 1] - high[at, p], out=out)
        return out * (1 - 1e-9) - 1e-12 * (d.max(axis=1, initial=0)[:, None] + high.max())  # distances are rounded

    def bites(rows: int):
        """Slices of rows whose bounds for all parts are held at once."""
        step = max(1, (1 << 21) // len(numbers))
        return [slice(i, i + step) for i in range(0, rows, step)]

    first = FIRST if probes is None else probes

    @F.pandas_udf("array<int>")
    def nearest_parts(part: pd.Series, d: pd.Series, limit: pd.Series) -> pd.Series:
        """The first few parts that may hold a row within the limit, the nearest first."""
        out, d, everywhere = [], matrix(d), np.arange(len(numbers))
        own, limit = part.to_numpy(), limit.to_numpy()
        for rows in bites(len(d)):
            bound = least(d[rows], everywhere)
            bound[(bound > limit[rows, None]) | (numbers == own[rows, None])] = np.inf
            order = np.argsort(bound, axis=1, kind="stable")[:, :first]
            out += [numbers[i[np.isfinite(b[i])]] for i, b in zip(order, bound, strict=True)]
        return pd.Series(out)

    def unseen(d: np.ndarray, limit: np.ndarray, seen: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
        """The bounds of these parts for rows; infinite for parts that a row met before."""
        bound = least(d, at)
        row = np.repeat(np.arange(len(d)), pc.list_value_length(seen).to_numpy())
        met = np.searchsorted(numbers[at], pc.list_flatten(seen).to_numpy())
        known = (met < len(at)) & (numbers[at][np.minimum(met, len(at) - 1)] == pc.list_flatten(seen).to_numpy())
        bound[row[known], met[known]] = np.inf
        bound[bound > limit[:, None]] = np.inf
        return bound

    def inside(held: pa.Table) -> pa.Table:
        ids, x = held["id"].to_numpy(), vectors(held["x"])
        nearest = Nearest(ids, x, k)
        nearest.meet(np.arange(len(ids)), ids, x)
        return nearest.table()

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asking) or not len(held):
            return NOTHING
        nearest = Nearest(asking["id"].to_numpy(), vectors(asking["x"]), k)
        nearest.meet(np.arange(len(asking)), held["held_id"].to_numpy(), vectors(held["held_x"]))
        return nearest.table()

    def needs(asking: pa.Table) -> pa.Table:
        """The parts that a group of queries asks for."""
        wanted, everywhere = np.zeros(len(numbers), bool), np.arange(len(numbers))
        for some in bites(len(asking)):
            bite = asking.slice(some.start, some.stop - some.start)
            bound = unseen(vectors(bite["d"]), bite["limit"].to_numpy(), bite["seen"], everywhere)
            wanted |= np.isfinite(bound).any(axis=0)
        part = pa.array(numbers[wanted], pa.int32())
        return pa.table({"asker": pa.array(np.full(len(part), asking["asker"][0].as_py()), pa.int32()), "part": part})

    def meet_all(asking: pa.Table, held: pa.Table) -> pa.Table:
        """A group of queries and parts, those that may be nearest first."""
        if not len(asking) or not len(held):
            return NOTHING
        held = held.sort_by("held_part")
        part, ids, y = held["held_part"].to_numpy(), held["held_id"].to_numpy(), vectors(held["held_x"])
        here, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], len(part))
        nearest = Nearest(asking["id"].to_numpy(), vectors(asking["x"]), k, asking["limit"].to_numpy())
        bound = unseen(vectors(asking["d"]), nearest.limit, asking["seen"], np.searchsorted(numbers, here))
        for t in np.argsort(np.where(np.isfinite(bound), bound, bound[np.isfinite(bound)].max(initial=0)).mean(axis=0), kind="stable"):
            some = np.flatnonzero((bound[:, t] <= nearest.limit) & np.isfinite(bound[:, t]))
            if len(some):
                nearest.meet(some, ids[starts[t] : ends[t]], y[starts[t] : ends[t]])
        return nearest.table()

    def against(asking: DataFrame) -> DataFrame:
        """What rows (id, x, target) find in their target parts. A part meets its queries in slices of QUERIES."""
        counts = cut(asking.groupBy("target").agg(F.count("*").alias("asked")))
        if stats is not None:
            pairs = counts.join(rows.groupBy(F.col("part").alias("target")).agg(F.count("*").alias("rows")), "target")
            stats["compared"] += pairs.agg(F.sum(F.col("asked") * F.col("rows"))).first()[0] or 0
        slices = counts.select("target", F.ceil(F.col("asked") / QUERIES).cast("int").alias("slices"))
        left = asking.join(slices, "target").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        right = rows.select("id", "x", F.col("part").alias("target")).join(slices, "target").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        left, right = left.select("id", "x", "target", "slice"), right.select(*(F.col(c).alias(f"held_{c}") for c in ("id", "x", "target", "slice")))
        return left.groupBy("target", "slice").cogroup(right.groupBy("held_target", "held_slice")).applyInArrow(meet, FOUND)

    def groups(mb: int) -> int:
        """Parts of so many MB."""
        return max(1, (mb << 20) // (8 * pivots.shape[1] * max(block, n // MOST_PARTS)))

    def all_against(asking: DataFrame) -> DataFrame:
        """What rows (id, x, d, limit, seen, part) find in all parts that may hold something as near and that they did not see."""
        asking = cut(asking.withColumn("asker", (F.col("part") / min(groups(ASKING), max(1, parts // GROUPS))).cast("int")).drop("part"))
        wanted = cut(asking.select("asker", "d", "limit", "seen").groupBy("asker").applyInArrow(needs, "asker int, part int"))
        wanted = wanted.withColumn("holder", (F.col("part") / groups(HELD)).cast("int"))
        left = asking.join(wanted.select("asker", "holder").distinct(), "asker")
        right = rows.select("id", "x", "part").join(wanted, "part").select(*(F.col(c).alias(f"held_{c}") for c in ("id", "x", "part", "asker", "holder")))
        if stats is not None:
            stats["sent"] = left.count() + right.count()
        return left.groupBy("asker", "holder").cogroup(right.groupBy("held_asker", "held_holder")).applyInArrow(meet_all, FOUND)

    @F.pandas_udf("long")
    def to_meet(d: pd.Series, limit: pd.Series, seen: pd.Series) -> pd.Series:
        bound = unseen(matrix(d), limit.to_numpy(), pa.chunked_array([pa.array(seen, pa.list_(pa.int32()))]), np.arange(len(numbers)))
        return pd.Series(np.isfinite(bound) @ sizes)

    if stats is not None:
        stats |= {"all": n * n, "compared": int((sizes.astype(int) ** 2).sum())}
    limit = F.coalesce(F.when(F.size("n") >= k, F.element_at("n", k)["distance"]), F.lit(float("inf"))).alias("limit")
    best = cut(k_nearest(rows.groupBy("part").applyInArrow(inside, FOUND), k))
    asked = cut(rows.join(best, "id", "left").select("id", "x", "d", "part", nearest_parts("part", "d", limit).alias("first")))
    found = against(asked.select("id", "x", F.explode("first").alias("target")))
    best = cut(k_nearest(best.unionByName(found), k))
    if probes is None:
        rest = asked.join(best, "id", "left").select("id", "x", "d", "part", limit, F.concat(F.array("part"), "first").alias("seen"))
        if stats is not None:
            stats["compared"] += rest.agg(F.sum(to_meet("d", "limit", "seen"))).first()[0]
        best = k_nearest(best.unionByName(all_against(rest)), k)
    return best.select("id", F.inline("n")).select("id", "other", "distance")


def lof(df: DataFrame, k: int = NEIGHBOURS, **how) -> DataFrame:
    """id, lof (1 is usual, more is outlying), by joins over each row's k neighbours. df: id, x array<double>."""
    near = cut(neighbours(df, k, **how))  # read by three branches
    reach_of = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(reach_of.select(F.col("id").alias("other"), "k_distance"), "other").withColumn("reach", F.greatest("distance", "k_distance"))
    density = reach.groupBy("id").agg((1 / (F.avg("reach") + 1e-10)).alias("density"))
    of_other = density.select(F.col("id").alias("other"), F.col("density").alias("other_density"))
    return near.join(of_other, "other").groupBy("id").agg(F.avg("other_density").alias("mean")).join(density, "id").select("id", (F.col("mean") / F.col("density")).alias("lof"))
