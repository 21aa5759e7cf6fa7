"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import map_rows, stage_table

#: Rows of one local kd-tree, rows of its buckets, and queries of one block.
CHUNK, BUCKET, QUERIES = 8192, 64, 4096
#: Projected neighbours that are verified before the first stopping test, and twice as many before each next one.
STEP = 64
#: Against rounding: a share of the largest squared norm within which distances count as equal.
EPS = 1e-9
#: Rows that are so many powers of two longer than the median one, and rows and queries whose squares come near the limits of
#: a double, aren't searched by projections but compared one by one.
LONG, SAFE = 2.0, 480.0
#: Their leaf.
APART = -1


def chi_square_quantile(p: float, dims: int) -> float:
    """The p-quantile of chi-square with an even number of degrees of freedom, by bisection."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def box_gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return (away * away).sum(axis=1)


class Tree:
    """A kd-tree: points split at the median of their widest side until ``leaves`` boxes are left."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, child, child; ~n is leaf n
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        d = points.shape[1]
        self.root = self._grow(points, np.arange(len(points)), leaves, np.full(d, -np.inf), np.full(d, np.inf))

    def _grow(self, points, rows, leaves, low, high) -> int:
        part = points[rows]
        wide = np.ptp(part, axis=0) if len(rows) else np.zeros(points.shape[1])
        dim = int(wide.argmax())
        value = float(np.median(part[:, dim])) if len(rows) else 0.0
        left = part[:, dim] <= value
        if leaves < 2 or wide[dim] == 0 or left.all():
            self.low.append(low)
            self.high.append(high)
            self.rows.append(rows)
            return ~(len(self.low) - 1)
        n = len(self.splits)
        self.splits.append((dim, value, 0, 0))
        below, above = high.copy(), low.copy()
        below[dim] = above[dim] = value
        a = self._grow(points, rows[left], leaves // 2, low, below)
        b = self._grow(points, rows[~left], leaves - leaves // 2, above, high)
        self.splits[n] = (dim, value, a, b)
        return n

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, walk = np.empty(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while walk:
            node, rows = walk.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                dim, value, a, b = self.splits[node]
                left = points[rows, dim] <= value
                walk += [(a, rows[left]), (b, rows[~left])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        return box_gaps(np.array(self.low), np.array(self.high), point)


class Lift:
    """Inner product as distance, then projected: rows get one more coordinate sqrt(M - |x|^2), M the largest squared
    norm; a query is scaled to squared norm M and gets 0. Its squared distance to a row is then 2 M - 2 scale score.
    The axes are Gaussian (2-stable) ones made orthogonal, so that projected over true squared distance is spread
    as chi-square with as many degrees of freedom as axes, or less wide in few dimensions: the test errs to the safe side."""

    def __init__(self, width: int, most: float, dims: int, seed: int):
        dims = max(2, min(dims, width + 1) // 2 * 2)
        self.width, self.most = width, most
        frame = np.linalg.qr(np.random.default_rng(seed).standard_normal((width + 1, dims)))[0]
        self.axes = frame * math.sqrt(width + 1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes[:-1] + np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None] * self.axes[-1]

    def scale(self, q: np.ndarray) -> np.ndarray:
        """By how much each query is scaled."""
        return np.sqrt(self.most / (q * q).sum(axis=-1))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * self.scale(q)[..., None]) @ self.axes[:-1]

    def reach(self, stop: float, scale: float, score: float) -> float:
        """Squared projected distance at which a row that beats ``score`` has become unlikely."""
        return stop * max(2 * self.most - 2 * scale * score, 0) + EPS * stop * self.most


class Chunk:
    """A kd-tree over the projections of distinct vectors, each with its ids: ``ids[offsets[n]:offsets[n + 1]]``. Rows are
    kept in the order of the tree's buckets."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, offsets: np.ndarray, lift: Lift):
        low = lift.rows(x)
        tree = Tree(low, -(-len(x) // BUCKET))
        order = np.concatenate(tree.rows)
        self.ids, self.lift = ids, lift
        self.x, self.low = x[order], low[order]
        self.squares = (self.low * self.low).sum(axis=1)
        self.begins, self.many = offsets[:-1][order], np.diff(offsets)[order]
        self.sizes = np.array([len(r) for r in tree.rows])
        self.boxes = [np.array([f(low[r], axis=0) for r in tree.rows]) for f in (np.min, np.max)]

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        many = self.many[rows]
        shift = np.repeat(self.begins[rows] - (np.cumsum(many) - many), many)
        return self.ids[shift + np.arange(len(shift))]

    def within(self, boxes: np.ndarray, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``boxes`` (a mask) within ``reach`` of a projected query, nearest first, and how far away."""
        if boxes.all():
            away = self.squares - 2 * (self.low @ p) + p @ p
            rows = np.flatnonzero(away < reach)
            away = away[rows]
        else:
            rows = np.flatnonzero(np.repeat(boxes, self.sizes))
            away = self.squares[rows] - 2 * (self.low[rows] @ p) + p @ p
            rows, away = rows[away < reach], away[away < reach]
        order = np.argsort(away, kind="stable")
        return rows[order], away[order]

    def find(self, q: np.ndarray, need: int, stop: float, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the ``need`` best ids that score ``bound`` or more, and how many vectors were verified.
        Buckets whose box comes near enough give their rows' projected distances; rows are verified in that order,
        until the next lies beyond the reach of the ``need``-th best score so far."""
        scale, p = float(self.lift.scale(q)), self.lift.queries(q)
        ids, scores, seen, limit = np.empty(0, np.int64), np.empty(0), 0, bound
        slack = EPS * math.sqrt(self.lift.most * float(q @ q))  # fast products differ from exact ones by rounding
        gaps = box_gaps(*self.boxes, p)
        done = np.zeros(len(gaps), bool)
        open_ = gaps < (self.lift.reach(stop, scale, limit) if limit > -np.inf else np.inf)
        if limit == -np.inf:  # the nearest buckets give a first bound
            near = np.argsort(gaps, kind="stable")
            open_[near[int(np.searchsorted(np.cumsum(self.sizes[near]), 4 * need)) + 1 :]] = False
        while (open_ & ~done).any():
            rows, away = self.within(open_ & ~done, p, self.lift.reach(stop, scale, limit) if limit > -np.inf else np.inf)
            done |= open_
            at, step = 0, max(STEP, need)
            while at < len(rows):
                reach = self.lift.reach(stop, scale, limit) if limit > -np.inf else np.inf
                take = rows[at : at + int(np.searchsorted(away[at : at + step], reach))]
                if not len(take):
                    break
                seen += len(take)
                at, step = at + step, 2 * step
                take = take[self.x[take] @ q >= limit - slack]
                s = dot(self.x[take], q)
                take, s = take[s >= limit], s[s >= limit]
                if not len(take):
                    continue
                ids = np.concatenate((ids, self.ids_of(take)))
                scores = np.concatenate((scores, np.repeat(s, self.many[take])))
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                once = np.sort(np.unique(ids, return_index=True)[1])[:need]
                ids, scores = ids[once], scores[once]
                if len(ids) == need:
                    limit = max(limit, float(scores[-1]))
            open_ = gaps < (self.lift.reach(stop, scale, limit) if limit > -np.inf else np.inf)
        return ids, scores, seen


def dot(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal results whatever stands around them."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        return (rows * q).sum(axis=1)


def compare_all(x: np.ndarray, ids: np.ndarray, many: np.ndarray, q: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As Chunk.find, by comparing every vector; for vectors whose squares a double can't hold."""
    s, ids = np.repeat(dot(x, q), many), ids
    order = np.lexsort((ids, -s))
    ids, s = ids[order], s[order]
    once = np.sort(np.unique(ids, return_index=True)[1])[:need]
    return ids[once], s[once], len(x)


def measure(x: np.ndarray) -> tuple[float, float]:
    """The logarithm to base 2 of a vector's length, also where squares would overflow or vanish, and its squared length."""
    most = float(np.abs(x).max())
    with np.errstate(over="ignore", under="ignore"):
        part = x / most
        return math.log2(most) + 0.5 * math.log2(float((part * part).sum())), float((x * x).sum())


def valid(v: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, every: int = 20, k: int = 20, dims: int = 32, confidence: float = 0.83, sample: int = 16_384, seed: int = 7, count_verified: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the ``k`` other vec_ids of largest
    inner product found among all rows, nearest first, ties to the smaller vec_id.

    Vectors are lifted and projected to ``dims`` dimensions (see Lift). The kd-tree over projections is fitted on
    about ``sample`` distinct vectors (chosen by their hash; their projections alone reach the driver) and indexes
    every row; its leaves are cut into chunks of about 8,192 vectors, each with a kd-tree of its own in its task.
    A query first searches its home leaf: projected neighbours are verified one after the other by exact inner
    products, until a row that beats the k-th best so far has, at the next projected distance, a chance under
    1 - ``confidence`` by the chi-square test. The k-th score found bounds which other leaves it visits, under the
    same test. Nothing is capped: ``confidence`` alone governs recall, which tests measure against brute force.

    Equal vectors are searched and verified once: a vector keeps its k + 1 smallest vec_ids, as no other of them can be
    among a query's first k. So a vector that a third of all rows share costs what any other costs.

    Long vectors (over four times the median length) would make all others look alike once lifted, and squares of very
    large or small components leave a double's range: such rows are compared with every query one by one, in blocks,
    and such queries with every row, so each gets the scores of plain double arithmetic. Scores that are no number come last.

    Repeated vec_ids: each counts once in a query's result, with its best score; a query takes the least of its
    vectors, and all rows of its own vec_id count as its own. Vectors null, empty, zero or with null or non-finite
    components, null vec_id, and vectors of another than the commonest length take no part. Fewer candidates than
    ``k``: all of them. Empty table: no rows. Other columns, whatever their names, are not read.
    ``count_verified`` adds ``verified``: how many distinct vectors the query's search compared whole.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
    small = v.schema["x"].dataType.elementType == FloatType()  # floats are kept as such and computed as doubles
    v = v.withColumn("x", F.transform("x", lambda x: x.cast("double"))).where(F.col("vec_id").isNotNull() & valid(F.col("x")))
    kind = np.dtype("<f4" if small else "<f8")

    def measured(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [np.array(x, float) for x in b["x"]]
            lengths = [measure(x) for x in rows]
            yield {"vec_id": b["vec_id"], "d": [len(x) for x in rows], "log": [n for n, _ in lengths], "square": [n for _, n in lengths], "x": [x.astype(kind).tobytes() for x in rows]}

    v = stage_table(map_rows(v, measured, "vec_id long, d int, log double, square double, x binary"), "measured")
    found = v.groupBy("d").agg(F.count("*").alias("n"), F.percentile_approx("log", 0.5).alias("middle")).orderBy(F.desc("n"), "d").first()
    if found is None:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double" + ", verified long" * count_verified)
    width, count, middle = found
    v = v.where(F.col("d") == width)
    plain = (F.abs("log") < SAFE) & (F.col("log") <= middle + LONG)
    most = v.agg(F.max(F.when(plain, F.col("square")))).first()[0]
    lift = Lift(width, most or 1.0, dims, seed)
    stop = chi_square_quantile(confidence, lift.axes.shape[1])
    need = k + 1
    matrix = lambda blobs: np.frombuffer(b"".join(blobs), kind).reshape(-1, width).astype(float)

    def project(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"p": lift.rows(matrix(b["x"])).tolist()}

    drawn = v.where(plain).where(F.pmod(F.xxhash64("x"), F.lit(max(1, count // sample))) == 0).select("x")
    some = sorted(r.p for r in map_rows(drawn, project, "p array<double>").distinct().collect())
    points = np.array(some, float).reshape(-1, lift.axes.shape[1])
    top = Tree(points, max(1, min(-(-count // CHUNK), sample // 16)))

    def assign(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            plain = np.array(b["plain"], bool)
            leaf = np.full(len(plain), APART)
            leaf[plain] = top.leaf_of(lift.rows(matrix(b["x"])[plain]))
            yield {"vec_id": b["vec_id"], "leaf": leaf, "safe": b["safe"], "x": b["x"]}

    marked = v.select("vec_id", "x", plain.alias("plain"), (F.abs("log") < SAFE).alias("safe"))
    rows = stage_table(map_rows(marked, assign, "vec_id long, leaf long, safe boolean, x binary").distinct(), "vectors")
    nth = F.row_number().over(W.partitionBy("x").orderBy("vec_id"))  # cut to k + 1 a vector before the shuffle, too
    kinds = rows.withColumn("nth", nth).where(F.col("nth") <= need).groupBy("x", "leaf").agg(F.collect_list("vec_id").alias("ids"))
    kinds = stage_table(kinds, "leaves")
    chunks = {r.leaf: -(-r.n // CHUNK) for r in kinds.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(z) for p in d.items() for z in p]), F.col("leaf"))
    kinds = kinds.withColumn("chunk", F.pmod(F.xxhash64("x"), lookup(chunks)))

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "safe")).alias("q")).select("vec_id", "q.*")
    leaders = queries.groupBy("x", "safe").agg(F.min("vec_id").alias("leader"))
    members = stage_table(queries.join(leaders, "x").select(F.col("vec_id").alias("query_id"), "leader"), "members")

    def at_home(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            q, safe = matrix(b["x"]), np.array(b["safe"], bool)
            home = np.full(len(q), APART)
            home[safe] = top.leaf_of(lift.queries(q[safe]))
            out: dict[str, list] = {n: [] for n in ("leader", "leaf", "q", "safe", "bound")}
            for leader, blob, s, leaf in zip(b["leader"], b["x"], safe.tolist(), home.tolist(), strict=True):
                for at in {leaf, APART} if s else chunks:
                    for name, value in zip(out, (leader, at, blob, s, -math.inf), strict=True):
                        out[name].append(value)
            yield out

    ask = "leader long, leaf long, q binary, safe boolean, bound double"
    asked = stage_table(map_rows(leaders.select("leader", "x", "safe"), at_home, ask), "home")

    def visit(asked: DataFrame) -> DataFrame:
        """(leader, vec_id, score, verified) of searches (leader, leaf, q, safe, bound) against their leaves; bound is a score to
        reach. A row without vec_id tells what a visit verified."""
        load = {r.leaf: -(-r.n // QUERIES) for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        load |= {n: 0 for n in chunks if n not in load}
        blocks, parts = lookup(load), F.coalesce(lookup(chunks), F.lit(0))
        held = kinds.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("leaf", "chunk", "block", "x", "ids")
        put = asked.where(parts > 0).withColumn("block", F.pmod(F.xxhash64("leader", F.lit(1)), blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))

        def run(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(data) or not len(asks):
                return pd.DataFrame({"leader": [], "vec_id": [], "score": [], "verified": []})
            many = np.array([len(i) for i in data["ids"]])
            x, ids = matrix(data["x"].tolist()), np.concatenate(data["ids"].tolist())
            asks = asks.sort_values("leader")
            searched = data["leaf"].iloc[0] != APART and asks["safe"].any()
            chunk = Chunk(x, ids, np.concatenate(([0], np.cumsum(many))), lift) if searched else None
            got = [chunk.find(q, need, stop, bound) if searched and safe else compare_all(x, ids, many, q, need) for q, safe, bound in zip(matrix(asks["q"].tolist()), asks["safe"], asks["bound"], strict=True)]
            n = [len(g[0]) for g in got]
            hits = pd.DataFrame({"leader": np.repeat(asks["leader"].to_numpy(), n), "vec_id": pd.array(np.concatenate([g[0] for g in got]), "Int64"), "score": np.concatenate([g[1] for g in got]), "verified": 0})
            told = pd.DataFrame({"leader": asks["leader"].to_numpy(), "vec_id": pd.array([None] * len(asks), "Int64"), "score": 0.0, "verified": [g[2] for g in got]})
            return pd.concat([hits, told])

        keys = ["leaf", "chunk", "block"]
        return put.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda a, d: run(d, a), "leader long, vec_id long, score double, verified long")

    def best(rows: DataFrame, owner: str, most: int) -> DataFrame:
        order = F.desc(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")))
        place = F.row_number().over(W.partitionBy(owner).orderBy(order, "vec_id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= most)

    def scores(found: DataFrame) -> DataFrame:
        return found.where("vec_id IS NOT NULL").groupBy("leader", "vec_id").agg(F.max("score").alias("score"))

    near = stage_table(visit(asked), "near")
    bounds = best(scores(near), "leader", need).where(F.col("rank") == need).select("leader", F.col("score").alias("found"))
    told = asked.where(F.col("safe") & (F.col("leaf") != APART)).join(bounds, "leader", "left").select("leader", "q", F.col("leaf").alias("was"), F.coalesce("found", F.lit(float("-inf"))).alias("found"))

    def abroad(batches: Iterator[dict]) -> Iterator[dict]:
        known = np.array(sorted(n for n in chunks if n != APART), np.int64)
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("leader", "leaf", "q", "safe", "bound")}
            q = matrix(b["q"])
            for leader, blob, was, bound, p, scale in zip(b["leader"], b["q"], b["was"], b["found"], lift.queries(q), lift.scale(q), strict=True):
                gaps = top.gaps(p)
                for leaf in known[gaps[known] <= lift.reach(stop, scale, bound)].tolist():
                    if leaf != was:
                        for n, value in zip(out, (leader, leaf, blob, True, bound), strict=True):
                            out[n].append(value)
            yield out

    others = stage_table(map_rows(told, abroad, ask), "abroad")
    everything = stage_table(near.unionByName(visit(others)), "found") if count_verified else near.unionByName(visit(others))
    kept = best(scores(everything), "leader", need).drop("rank")
    out = best(members.join(kept, "leader").where("vec_id <> query_id"), "query_id", k)
    if count_verified:
        out = out.join(everything.groupBy("leader").agg(F.sum("verified").alias("verified")), "leader")
    return out.select("query_id", "rank", "vec_id", "score", *["verified"] * count_verified)
