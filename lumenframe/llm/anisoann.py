"""Maximum inner product search with score-aware anisotropic quantisation.

Rows are stored under fine partitions by direction.  What is left of a vector
after its partition's centre is cut into small sub-vectors of 16 codewords each.
Codewords and codes minimise a loss that weighs the part of the error parallel to
the vector more than the orthogonal part, since only the former changes large
inner products.  A query looks into the partitions with the largest expected
inner products, scans their four-bit codes through look-up tables, and the best
of the scan are ranked again by exact inner products in doubles.

How many partitions a query looks into is learnt from the sample: as many as hold
the wanted share of the nearest rows that took no part in fitting.  Clustered
vectors need few, and denser tables need a smaller part of their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

CODES = 16
ROWS, QUERIES, CHUNK = 4096, 2048, 512
CODEBOOK_ROWS = 8_000


@dataclass
class Codec:
    unit: np.ndarray  # (partitions, dim) directions
    reach: np.ndarray  # (partitions,) mean inner product of a partition's rows with its direction
    words: np.ndarray  # (parts, CODES, width)
    weight: float
    blur: float = 0.0  # standard error of a scanned product with a query of length 1
    probe: int = 1  # partitions that a query looks into

    @property
    def centres(self) -> np.ndarray:
        return self.unit * self.reach[:, None]

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.words.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Partition of each row: the nearest direction."""
        return np.concatenate([np.zeros(0, np.int64)] + [(x[i : i + 4096] @ self.unit.T).argmax(axis=1) for i in range(0, len(x), 4096)])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Partitions of each query, the most promising first."""
        return np.argsort(-((queries @ self.unit.T) * self.reach), axis=1, kind="stable")

    def _error(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.maximum(np.linalg.norm(x, axis=1), 1e-30)
        return self.parts(x - self.centres[home]), self.parts(x / length[:, None])

    def encode(self, x: np.ndarray, home: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(rows, parts) codes by coordinate descent on the anisotropic loss."""
        sub, unit = self._error(x, home)
        codes = np.empty(sub.shape[:2], np.uint8)
        for m in range(sub.shape[1]):
            codes[:, m] = ((sub[:, m, None] - self.words[m]) ** 2).sum(axis=2).argmin(axis=1)
        residual = sub - self.words[np.arange(sub.shape[1]), codes]
        along = (residual * unit).sum(axis=(1, 2))
        for _ in range(rounds):
            for m in range(sub.shape[1]):
                rest = along - (residual[:, m] * unit[:, m]).sum(axis=1)
                r = sub[:, m, None] - self.words[m]
                cost = (r**2).sum(axis=2) + (self.weight - 1) * (rest[:, None] + np.einsum("nkw,nw->nk", r, unit[:, m])) ** 2
                codes[:, m] = cost.argmin(axis=1)
                residual[:, m] = sub[:, m] - self.words[m][codes[:, m]]
                along = rest + (residual[:, m] * unit[:, m]).sum(axis=1)
        return codes

    def decoded(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        back = self.words[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
        return back[:, : self.unit.shape[1]] + self.centres[home]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs of parts, 256): one look-up for two four-bit codes."""
        one = np.einsum("qmw,mkw->qmk", self.parts(queries), self.words).astype(np.float32)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES)


def paired(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return codes[:, ::2].astype(np.intp) * CODES + codes[:, 1::2]


def scan(tables: np.ndarray, who: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """(queries in ``who``, rows) sums of look-ups, in pieces of a bounded number of them."""
    _, m, n = tables.shape
    flat, step = tables.ravel(), max(1, (1 << 20) // max(len(who) * m, 1))
    base = who[:, None, None] * (m * n) + np.arange(m) * n
    return np.concatenate([flat.take(base + pairs[i : i + step]).sum(axis=2) for i in range(0, len(pairs), step)], axis=1)


def _means(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=x[:, i], minlength=len(centres)) for i in range(x.shape[1])], axis=1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _directions(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    """Unit vectors of ``k`` groups of rows with like directions."""
    x = _unit(x).astype(np.float32)
    unit = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ unit.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.stack([np.bincount(near, weights=x[:, i], minlength=len(unit)) for i in range(x.shape[1])], axis=1)
        some = np.linalg.norm(total, axis=1) > 1e-9
        unit[some] = _unit(total[some])
    return unit.astype(np.float64)


def fit(sample: np.ndarray, partitions: int, width: int, weight: float, rounds: int = 6, seed: int = 5) -> Codec:
    """Directions, then codebooks by turns: codes for the codewords, and the codewords that are best for the codes."""
    rng = np.random.default_rng(seed)
    parts = -(-sample.shape[1] // width)
    unit = _directions(sample, partitions, rng)
    codec = Codec(unit, np.zeros(len(unit)), np.zeros((parts, CODES, width)), weight)
    home = codec.home(sample)
    n = np.bincount(home, minlength=len(unit))
    codec.reach = np.bincount(home, weights=(sample * unit[home]).sum(axis=1), minlength=len(unit)) / np.maximum(n, 1)
    # the few codewords are learnt from a part of the sample
    some = rng.permutation(len(sample))[:CODEBOOK_ROWS]
    sample, home = sample[some], home[some]
    sub, along_unit = codec._error(sample, home)
    for m in range(parts):
        own = _means(sub[:, m], CODES, rng)
        codec.words[m, : len(own)] = own
        codec.words[m, len(own) :] = own[0] if len(own) else 0
    for _ in range(rounds):
        codes = codec.encode(sample, home, 1)
        residual = sub - codec.words[np.arange(parts), codes]
        along = (residual * along_unit).sum(axis=(1, 2))
        for m in range(parts):
            u, x, c = along_unit[:, m], sub[:, m], codes[:, m]
            rest = along - (residual[:, m] * u).sum(axis=1)
            # sum of (I + (weight - 1) u u') c = x + (weight - 1) (rest + x.u) u over the rows of a codeword
            outer = np.einsum("ni,nj->nij", u, u).reshape(len(u), -1)
            push = x + (weight - 1) * (rest + (x * u).sum(axis=1))[:, None] * u
            n = np.bincount(c, minlength=CODES)
            a = np.stack([np.bincount(c, weights=outer[:, i], minlength=CODES) for i in range(outer.shape[1])], axis=1)
            b = np.stack([np.bincount(c, weights=push[:, i], minlength=CODES) for i in range(width)], axis=1)
            for k in np.flatnonzero(n):
                lhs = np.eye(width) * n[k] + (weight - 1) * a[k].reshape(width, width)
                codec.words[m, k] = np.linalg.solve(lhs, b[k])
            residual[:, m] = x - codec.words[m][c]
            along = rest + (residual[:, m] * u).sum(axis=1)
    error = sample - codec.decoded(codec.encode(sample, home), home)
    codec.blur = float(np.sqrt((error**2).sum(axis=1).mean() / sample.shape[1]))
    return codec


def depth(codec: Codec, queries: np.ndarray, rows: np.ndarray, nearest: int, recall: float) -> int:
    """Partitions to look into, so that this share of the queries' nearest ``rows`` is met.

    Neither must have taken part in fitting.  A query that is one of the rows
    does not count as its own neighbour.
    """
    if not len(queries) or not len(rows):
        return len(codec.unit)
    home = codec.home(rows)
    places = []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        score = q @ rows.T
        score[(q[:, None, :1] == rows[None, :, :1])[:, :, 0] & np.isclose(score, (q**2).sum(axis=1)[:, None], rtol=1e-12)] = -np.inf
        m = min(nearest, len(rows))
        top = np.argpartition(-score, m - 1, axis=1)[:, :m]
        place = np.argsort(codec.order(q), axis=1)
        found = np.take_along_axis(place, home[top], axis=1)
        places.append(found[np.isfinite(np.take_along_axis(score, top, axis=1))])
    places = np.sort(np.concatenate(places))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1 if len(places) else len(codec.unit)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero, and holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    recall: float = 0.93,
    slack: float = 2.0,
    width: int = 2,
    weight: float = 4.0,
    sample: int = 48_000,
    crowd: int = 8,
) -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` largest inner products among all other rows.

    Columns ``query_id``, ``rank`` (from 1), id, ``score``; largest first, ties to
    the smaller id.  The codec is fitted on at most about ``sample`` rows drawn by
    a hash, a quarter of which is held back to learn how many partitions reach
    ``recall`` of the nearest rows; every row is indexed.  There is a partition
    for each ``crowd`` rows of the fitted sample.  Of a tile, all rows whose scan
    comes within ``slack`` standard errors of the k-th best are ranked exactly.

    Nulls: rows with a null id, and vectors that are null, zero or hold null, NaN
    or infinite numbers, take no part; neither do vectors of another length than
    the most frequent one (the shorter on ties), which have no inner product with
    the rest.  Rows that repeat an id are candidates each; a query never meets a
    row of its own id, and a repeated query id is answered from its least vector.
    Equal vectors have equal scores.  Fewer than ``k`` candidates: all are
    returned.  Other columns are not looked at, whatever their names.  An empty
    table: no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = usable(vectors.filter(F.col(id_col).isNotNull()), vector_col).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim, n = dims["d"], dims["count"]
    rows = rows.filter(F.size("v") == dim)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("aniso"), "id"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)) + 1).select("id", "v").toArrow().sort_by("id")
    drawn = _matrix(drawn.column("v").combine_chunks(), dim) if drawn.num_rows else np.ones((1, dim))
    held_back = np.arange(len(drawn)) % 4 == 3
    train = drawn[~held_back]
    codec = fit(train, max(1, len(train) // crowd), width, weight)
    # the k nearest of n rows are as near as this many nearest of the rows held back
    apart = drawn[held_back]
    codec.probe = depth(codec, apart[:1000], apart, max(1, round(k * len(apart) / n)), recall)
    shared = spark.sparkContext.broadcast(codec)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dim)
            home = c.home(x)
            packed = [r.tobytes() for r in c.encode(x, home)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(home.astype(np.int32)), pa.array(packed, pa.binary())], ["id", "v", "p", "codes"])

    indexed = saved(rows.mapInArrow(index, "id long, v array<double>, p int, codes binary"), "index")
    held = {r["p"]: r["count"] for r in indexed.groupBy("p").count().collect()}  # one number a partition
    # Partitions that lie close together share a group of about ROWS rows; a larger one is a group by itself.
    near = _directions(codec.unit, max(1, int(len(codec.unit) ** 0.5)), np.random.default_rng(7))
    full = n / -(-n // ROWS)
    group_of, filled, g = np.zeros(len(codec.unit), np.int64), 0, 0
    for p in np.argsort((codec.unit @ near.T).argmax(axis=1), kind="stable").tolist():
        if filled and filled + held.get(p, 0) / 2 > full:
            filled, g = 0, g + 1
        group_of[p] = g
        filled += held.get(p, 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ask = np.sort(c.order(_matrix(batch.column("v"), dim))[:, : c.probe], axis=1)
            which = group_of[ask]
            at, groups, wants = [], [], []
            for i in range(len(ask)):
                order = np.argsort(which[i], kind="stable")
                own, first = np.unique(which[i][order], return_index=True)
                at += [i] * len(own)
                groups += own.tolist()
                wants += [w.astype(np.int32) for w in np.split(ask[i][order], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(groups, pa.int32()), pa.array(wants, pa.list_(pa.int32()))],
                ["id", "v", "g", "wants"],
            )

    asked = indexed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    sent = saved(asked.mapInArrow(send, "id long, v array<double>, g int, wants array<int>"), "sent")
    load = {r["g"]: r["count"] for r in sent.groupBy("g").count().collect()}
    size = np.bincount(group_of, weights=[held.get(p, 0) for p in range(len(group_of))])
    # at most a row a partition, and there are fewer of these than sampled rows
    cuts = F.broadcast(spark.createDataFrame([(g, max(1, round(size[g] / ROWS)), max(1, -(-load.get(g, 0) // QUERIES))) for g in np.unique(group_of).tolist()], "g int, nr int, nq int"))
    homes = F.broadcast(spark.createDataFrame([(p, int(g)) for p, g in enumerate(group_of)], "p int, g int"))
    # Rows and queries of a group meet in tiles of bounded size on both sides.
    r_tiles = indexed.join(homes, "p").join(cuts, "g").select("id", "v", "codes", "p", "g", F.pmod(F.xxhash64("id"), "nr").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
    q_tiles = sent.join(cuts, "g").select("id", "v", "wants", "g", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("j"))

    def tile(right: pa.Table, left: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if right.num_rows and left.num_rows:
            c = shared.value
            right = right.combine_chunks().sort_by("id")
            x, ids = _matrix(right.column("v").combine_chunks(), dim), right.column("id").to_numpy()
            # equal vectors are scanned once, and unfolded in the order of their ids
            _, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
            home = right.column("p").to_numpy()[first]
            by_home = np.argsort(home, kind="stable")
            first, home = first[by_home], home[by_home]
            rank = np.empty(len(by_home), np.int64)
            rank[by_home] = np.arange(len(by_home))
            back = rank[back.ravel()]
            members = np.argsort(back, kind="stable")
            count = np.bincount(back)
            starts = np.cumsum(count) - count
            codes = right.column("codes").combine_chunks().take(pa.array(first)).to_pylist()
            u, pairs = x[first], paired(np.frombuffer(b"".join(codes), np.uint8).reshape(len(first), -1))
            inside, edges = np.unique(home, return_index=True)
            edges = np.r_[edges, len(home)]
            centres = c.centres[inside]
            place = np.full(len(c.unit), -1)
            place[inside] = np.arange(len(inside))
            q, qids = _matrix(left.column("v").combine_chunks(), dim), left.column("id").to_numpy()
            wants = left.column("wants").to_pylist()
            for lo in range(0, len(q), CHUNK):
                part, names = q[lo : lo + CHUNK], qids[lo : lo + CHUNK]
                asks = np.zeros((len(part), len(inside)), bool)
                for i, w in enumerate(wants[lo : lo + CHUNK]):
                    own = place[w]
                    asks[i, own[own >= 0]] = True
                tables, base = c.tables(part), (part @ centres.T).astype(np.float32)
                rough = np.full((len(part), len(u)), -np.inf, np.float32)
                for g in np.flatnonzero(asks.any(axis=0)):
                    who = np.flatnonzero(asks[:, g])
                    rough[who, edges[g] : edges[g + 1]] = scan(tables, who, pairs[edges[g] : edges[g + 1]]) + base[who, g, None]
                # all that the codes can't tell from the k-th best; one more for the query itself
                least = min(k + 1, len(u))
                edge = np.partition(rough, len(u) - least, axis=1)[:, len(u) - least] - slack * c.blur * np.linalg.norm(part, axis=1)
                qi, ui = np.nonzero((rough >= edge[:, None]) & np.isfinite(rough))
                score = np.concatenate([np.zeros(0)] + [(part[qi[i : i + 65536]] * u[ui[i : i + 65536]]).sum(axis=1) for i in range(0, len(qi), 65536)])
                some = np.minimum(count[ui], k + 1)
                pick = np.repeat(starts[ui] - np.cumsum(some) + some, some) + np.arange(some.sum())
                qi, score, name = np.repeat(qi, some), np.repeat(score, some), ids[members[pick]]
                other = name != names[qi]
                qi, score, name = qi[other], score[other], name[other]
                order = np.lexsort((name, -score, qi))
                qi, score, name = qi[order], score[order], name[order]
                begin = np.searchsorted(qi, np.arange(len(part)))
                best = np.arange(len(qi)) - begin[qi] < k
                out.append((names[qi[best]], name[best], score[best]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("query_id", "id", "score"))})

    keys = ["g", "i", "j"]
    found = r_tiles.groupBy(*keys).cogroup(q_tiles.groupBy(*keys)).applyInArrow(tile, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
