"""Embedding near-dedup by a pivot-permutation index.

Reference vectors (pivots) are a bounded sample, chosen by hash. A vector is described by the ordered list of its nearest
pivots and posted under each pair of them, which is an inverted list of vectors that share two pivots; two vectors that
share at least two meet in one list or more. All vectors of a list are compared by exact cosine in double precision, in
blocks, and a pair is counted only in the list of the two least pivots it shares. More vectors get more pivots, so that
lists stay short. Equal vectors are one class, which is posted once.

A large group of near copies draws many pivots, which are about equally near to all its members, so that their order says
nothing. Of pivots at a cosine of ``APART`` or more only the first stays. One that stood for many is the centre of a ball:
vectors this near to it are at home there and posted once, under it, and so are guests, which are all others that can link
with one at home by the triangle inequality of angles. No pair of a vector that has a home is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import common as C
from nearfield.llm.components import components

#: Nearest pivots that describe a vector; it is posted under each pair of them.
NEAREST = 6
#: Pivots: as many as this times the square root of the number of different vectors, between the bounds.
PIVOTS_PER_ROOT, FEWEST, MOST = 1.0, 16, 4096
BLOCK = 512
#: Cosine below which two pivots are kept apart, and at which a vector is at home in a ball.
APART = 0.6
#: So many pivots dropped for one make it the centre of a ball.
CROWD = 8
NOWHERE = 1 << 40


def valid(v: Column) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(table: list[list[float]]) -> list[np.ndarray]:
    """Vectors in double precision, each divided by its norm; scaled first, so that no square overflows."""
    out = []
    for x in table:
        v = np.array(x, np.float64)
        v /= np.abs(v).max()
        out.append(v / np.sqrt((v * v).sum()))
    return out


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first; equally near ones by number."""
    sim = vectors @ pivots.T
    k = min(nearest, sim.shape[1])
    part = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return part.astype(np.int64)


def spread(drawn: list[list[float]]) -> tuple[list[list[float]], list[bool]]:
    """Of the vectors drawn those that no earlier one is near to, and whether each stood for so many that it is crowded."""
    units = _unit(drawn)
    stays: dict[int, list[int]] = {}
    stood = [0] * len(drawn)
    for i, v in enumerate(units):
        kept = stays.setdefault(len(v), [])
        sim = np.stack([units[j] for j in kept]) @ v if kept else np.zeros(0)
        if len(sim) and sim.max() >= APART:
            stood[kept[int(sim.argmax())]] += 1
        else:
            kept.append(i)
    order = sorted(i for kept in stays.values() for i in kept)
    return [drawn[i] for i in order], [stood[i] >= CROWD for i in order]


def fit(classes: DataFrame, n: int, per_root: float) -> tuple[list[list[float]], list[bool]]:
    """The pivots, spread out of a sample of bounded size, the same in each run, and which are centres of balls."""
    want = int(min(MOST, max(FEWEST, per_root * n**0.5)))
    return spread([r[0] for r in classes.orderBy(F.xxhash64(F.lit(5), "c1"), "c1", "c2").limit(want).select("v").collect()])


def reach(least: float) -> float:
    """Cosine to a centre down to which a vector can link with one at home there."""
    angle = np.arccos(APART) + np.arccos(np.clip(least, -1, 1))
    return float(np.cos(angle)) - 1e-9 if angle < np.pi else -2.0


def _kind(classes: DataFrame) -> str:
    """How vectors travel: in the precision they came in."""
    return "<f4" if classes.schema["v"].dataType.elementType.typeName() == "float" else "<f8"


def _postings(classes: DataFrame, pivots: list[list[float]], crowded: list[bool], nearest: int, least: float) -> DataFrame:
    """(gid, rep, n, home, near, v): a row for each pair of a vector's nearest pivots, unless it has a home, and for each ball.

    home is the number of a ball's centre, or NOWHERE; gid is negative for balls.
    """
    given = classes.sparkSession.sparkContext.broadcast(pivots)  # MOST vectors at most
    kind = _kind(classes)
    balls, far = np.flatnonzero(crowded), reach(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = given.value
        made: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(lo, 512) for lo in range(0, whole.num_rows, 512)):
                units = _unit(b.column(2).to_pylist())
                rows, gids, nears, home = [], [], [], np.full(len(units), NOWHERE)
                for i, v in enumerate(units):
                    d = len(v)
                    if d not in made:  # a pivot of another length serves as far as it goes
                        p = np.array([(x + [0.0] * d)[:d] for x in raw], np.float64)
                        made[d] = p / np.maximum(np.sqrt((p * p).sum(axis=1)), 1e-300)[:, None]
                dims = np.array([len(v) for v in units])
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    x = np.stack([units[i] for i in at])
                    near = np.sort(describe(x, made[d], nearest), axis=1)
                    k, m = near.shape[1], len(raw)
                    if len(balls):
                        sim = x @ made[d][balls].T
                        inside = sim.max(axis=1) >= APART
                        home[at[inside]] = balls[sim[inside].argmax(axis=1)]
                        who, ball = np.nonzero(sim >= far)
                        rows.append(at[who]), gids.append(-1 - (balls[ball] * 65536 + min(d, 65535))), nears.append(near[who])
                        at, near = at[~inside], near[~inside]
                    if k < 2:
                        rows.append(at), gids.append(np.full(len(at), min(d, 65535))), nears.append(near)
                        continue
                    for x in range(k):
                        for y in range(x):
                            rows.append(at), gids.append((near[:, y] * m + near[:, x]) * 65536 + min(d, 65535)), nears.append(near)
                row, gid = np.concatenate(rows), np.concatenate(gids)
                flat = np.concatenate([x.ravel() for x in nears])
                cut = C.offsets_of(np.concatenate([np.full(len(x), x.shape[1]) for x in nears]))
                packed = [np.array(x, kind).tobytes() for x in b.column(2).to_pylist()]
                take = pa.array(row)
                yield pa.record_batch(
                    [pa.array(gid), b.column(0).take(take), b.column(1).take(take), pa.array(home[row]), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat)), pa.array(packed, pa.binary()).take(take)],
                    ["gid", "rep", "n", "home", "near", "v"],
                )

    return C.map_arrow(classes.select("rep", "n", "v"), run, "gid long, rep long, n long, home long, near array<long>, v binary")


def _links(postings: DataFrame, n_pivots: int, least: float, kind: str) -> DataFrame:
    """(rep, links, root): per unit, vectors linked to a class in pairs this list owns, and the least class reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.grouped(batches, 2):
            bounds = C.group_bounds(t, 2)
            rep, n, side, gid, home = (t.column(x).to_numpy() for x in ("rep", "n", "side", "gid", "home"))
            vs, nears = t.column("v").to_pylist(), t.column("near").to_pylist()
            out: list[tuple] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                order = a + np.argsort(rep[a:b], kind="stable")
                ball = (-1 - int(gid[a])) >> 16 if gid[a] < 0 else None
                if ball is not None and not (home[a:b] == ball).any():
                    continue  # guests meet elsewhere
                x = np.stack([np.frombuffer(vs[i], kind) for i in order]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                link = x @ x.T >= least
                if ball is not None:  # a pair belongs to the least home of its two
                    link &= np.minimum.outer(home[order], home[order]) == ball
                np.fill_diagonal(link, False)
                if (s := side[order]).any():
                    link &= s[:, None] != s[None, :]
                hit = np.flatnonzero(link.any(axis=1))
                if not len(hit):
                    continue
                link, order = link[np.ix_(hit, hit)], order[hit]
                root = C.roots(link)
                if ball is not None:
                    out += zip(rep[order].tolist(), (link @ n[order]).tolist(), rep[order[root]].tolist(), strict=True)
                    continue
                # a pair belongs to the list of the two least pivots it shares: none may be shared below the second
                pair = int(gid[a]) >> 16
                first, second = pair // n_pivots, pair % n_pivots
                below = np.zeros((len(order), max(second, 1)), np.float32)
                for i, r in enumerate(order.tolist()):
                    below[i, [p for p in nears[r] if p < second and p != first]] = 1
                used = np.flatnonzero(below.any(axis=0))
                below = below[:, used]
                owned = link & ~((below @ below.T) > 0)
                count = owned @ n[order]
                out += zip(rep[order].tolist(), count.tolist(), rep[order[root]].tolist(), strict=True)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "links", "root"])

    whole = C.units(postings.select("gid", "rep", "n", "home", "near", "v"), "gid", BLOCK)
    return C.map_arrow(whole.select("gid", "u", "side", "rep", "n", "home", "near", "v").repartition("gid", "u").sortWithinPartitions("gid", "u"), run, "rep long, links long, root long")


def judge(vectors: DataFrame, least: float = 0.95, nearest: int = NEAREST, per_root: float = PIVOTS_PER_ROOT) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; rows link at cosine ``least`` or more.

    Vectors that are null, zero or hold a null or non-finite component link with nothing, nor do vectors of different
    lengths with each other; a row with a null id links with nothing and is not kept; rows that share an id are rows of
    their own in n_links and one node in components; equal vectors link; other columns are not read; an empty table gives
    no rows.
    """
    C.bound_batches(vectors.sparkSession)
    v = F.col("embedding")
    fit_for = valid(v) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.when(fit_for, F.xxhash64(F.lit(1), v)).alias("c1"), F.when(fit_for, F.xxhash64(F.lit(2), v)).alias("c2"), F.when(fit_for, v).alias("v"))
    classes = C.settle(rows.where("c1 is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    pivots, crowded = fit(classes, classes.count(), per_root)
    found = C.settle(_links(_postings(classes, pivots, crowded, nearest, least), len(pivots), least, _kind(classes)))
    linked = components(found.where("rep != root").select("rep", "root").distinct())
    count = found.groupBy("rep").agg(F.sum("links").alias("links")).select(F.col("rep").alias("r"), "links")
    of = (
        classes.select("c1", "c2", "rep", "n")
        .join(count, F.col("rep") == F.col("r"), "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found"), F.coalesce("component", "rep").alias("least"))
    )
    component = F.coalesce("least", "vec_id")
    return rows.join(of, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")), "left").select(
        "vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
