"""Exact top-k by inner product over integer vectors.

Vectors are dealt by range on descending length (Euclidean norm), so blocks hold vectors of like length, longest first.
A rotation by the eigenvectors of the summed outer products (the right singular vectors of all rows) moves most of a dot
product into its first terms. The longest vectors give every query a first k-th best score, and with it the least length a candidate must have:
pairs of blocks without one are left out of the join. The others meet query block by query block, longest candidates first, so what a block of queries has found
bounds what follows: a block is left as soon as length times length falls below the k-th best score, and a pair is left if its first rotated terms plus the
Cauchy-Schwarz bound on the others do. What remains is scored in exact integers; only a query block's best k leave a task.

Defined cases. Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. A component that is no long
once scaled, and a score among the best that is none, are errors. Only vectors of equal length in components are compared; empty ones score 0. A query never meets rows of its own
id. Repeated candidate rows count each; an id that repeats among the queries is asked once, with its smallest vector. Ties go to the smaller id. Fewer
than k candidates give fewer rows. Extra columns are ignored; an empty table gives no rows. The ``TURNED`` most frequent numbers of components, up to ``ROOM`` numbers in
their matrices, have a rotation and first scores; vectors of others are met in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a candidate block, queries of a query block, vectors scored for the first thresholds.
BLOCK, QUERIES, HEAD = 4096, 1024, 2048
#: Numbers of components that get a rotation, at most, and the numbers in all their matrices and longest rows.
TURNED, ROOM = 16, 1 << 24


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, d, norm, v array<long>) of the rows that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = table.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))

    def whole_number(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component of a vector is too large for a long")).cast("long"))

    ints = whole.select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole_number).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return ints.select("id", F.size("v").alias("d"), norm.alias("norm"), "v")


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each of the most frequent numbers of components the eigenvectors of the summed outer products, strongest first."""
    sizes, chosen = vectors.where("d > 0").groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(TURNED).collect(), []
    room = ROOM
    for r in sizes:
        need = r["d"] * (r["d"] + min(HEAD, r["n"]))
        if need <= room:
            room -= need
            chosen.append(r["d"])
    if not chosen:
        return {}

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _matrices(b.column(0), b.column(1)):
                total[d] = total.get(d, 0) + x.T.astype(float) @ x.astype(float)
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()])], names=["d", "m"])

    own = vectors.where(F.col("d").isin(chosen)).select("d", "v")
    rows = own.mapInArrow(products, "d int, m array<double>").select("d", F.posexplode("m").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x")).collect()
    grams: dict[int, np.ndarray] = {}
    for r in rows:
        grams.setdefault(r["d"], np.zeros(r["d"] ** 2))[r["i"]] = r["x"]
    return {d: np.linalg.eigh(g.reshape(d, d))[1][:, ::-1] for d, g in grams.items()}


def _matrices(sizes: pa.Array, lists: pa.Array):
    """(d, matrix) for each number of components in a batch."""
    n, flat, at = sizes.to_numpy(), lists.flatten().to_numpy(), lists.offsets.to_numpy()
    at = at - at[0]
    for d in np.unique(n):
        yield int(d), flat[(at[:-1][n == d][:, None] + np.arange(d))]


def _blocks(batches, most: int):
    """Rows (id, d, norm, v), in order -> packed blocks of equal d, with the length of the first row."""
    ids, vs, have, norm = [], [], None, 0.0

    def pack():
        return pa.RecordBatch.from_arrays(
            [pa.array([have], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.stack(vs).astype("<i8").tobytes()], pa.binary()), pa.array([norm])],
            names=["d", "ids", "vs", "norm"],
        )

    for b in batches:
        at, flat = b.column(3).offsets.to_numpy(), b.column(3).flatten().to_numpy()
        at = at - at[0]
        for i, (key, d, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
            if ids and (d != have or len(ids) == most):
                yield pack()
                ids, vs = [], []
            if not ids:
                have, norm = d, size
            ids.append(key)
            vs.append(flat[at[i] : at[i + 1]])
    if ids:
        yield pack()


class Search:
    """The best k of candidate blocks for a block of queries; ``floor`` holds scores that are known to be reached."""

    def __init__(self, ids, q: np.ndarray, rotation: np.ndarray | None, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k, self.rotation = ids, q, k, np.eye(q.shape[1]) if rotation is None else rotation
        self.head = max(1, q.shape[1] // 4)
        self.norm = np.sqrt((q.astype(float) ** 2).sum(1))
        self.turned = q @ self.rotation
        self.rest = np.sqrt((self.turned[:, self.head :] ** 2).sum(1))
        self.floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)

    def exact(self, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.norm.max(initial=0) * np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0) < 2**62:
            return np.einsum("pd,pd->p", self.q[i], x[j])
        return np.array([sum(int(a) * int(b) for a, b in zip(self.q[p], x[r])) for p, r in zip(i, j)], dtype=object)

    def reach(self) -> float:
        """The least length of a candidate that may be among the best of any query here."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.floor > 0, self.floor / self.norm, -np.inf)
        return float(least.min(initial=np.inf)) * (1 - 1e-9)

    def offer(self, ids: np.ndarray, x: np.ndarray, step: int = 512) -> None:
        order = np.argsort(-(x.astype(float) ** 2).sum(1), kind="stable")
        ids, x = ids[order], x[order]
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        for a in range(0, len(x), step):
            n = norm[a : a + step]
            live = np.flatnonzero(self.norm * n[0] * (1 + 1e-9) >= self.floor)
            if not len(live):
                break  # later vectors are shorter still
            part = x[a : a + step]
            turned = part @ self.rotation
            rest = np.sqrt((turned[:, self.head :] ** 2).sum(1))
            bound = self.turned[live, : self.head] @ turned[:, : self.head].T + np.outer(self.rest[live], rest)
            slack = 1e-7 * np.outer(self.norm[live], n) + 1e-6
            own = ids[a : a + step][None, :] == self.ids[live][:, None]
            p, j = np.nonzero((bound + slack >= self.floor[live][:, None]) & ~own)
            if not len(p):
                continue
            score = self.exact(live[p], part, j)
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(p)]):
                i = live[p[s]]
                old_score, old_ids = self.best[i]
                sc, key = np.concatenate([old_score, score[s:e]]), np.r_[old_ids, ids[a : a + step][j[s:e]]]
                keep = np.lexsort((key, -sc))[: self.k] if sc.dtype != object else np.array(sorted(range(len(sc)), key=lambda r: (-sc[r], key[r])))[: self.k]
                self.best[i] = (sc[keep], key[keep])
                if len(keep) == self.k:
                    self.floor[i] = max(self.floor[i], float(sc[keep[-1]]))


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` that ``is_query`` holds for, against all others."""
    vectors = integer_vectors(table, id_col, vector_col, scale)
    turn = rotations(vectors)
    head: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if turn:  # the HEAD longest rows of each number of components that has a rotation
        longest = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("norm"), "id"))
        rows = vectors.where(F.col("d").isin(list(turn))).withColumn("r", longest).where(F.col("r") <= HEAD).select("d", "id", "v").collect()
        for d in turn:
            own = [r for r in rows if r["d"] == d]
            head[d] = (np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64))

    def asked(batches):
        for block in _blocks(batches, QUERIES):
            d = block.column(0)[0].as_py()
            ids, q = _unpack(block, 0)
            s = Search(ids, q, turn.get(d), k)
            if d in head:
                s.offer(*head[d])
            yield pa.RecordBatch.from_arrays([*block.columns[:3], pa.array([s.floor.astype("<f8").tobytes()], pa.binary()), pa.array([s.reach()])], names=["d", "ids", "vs", "floor", "reach"])

    own = integer_vectors(table.where(is_query), id_col, vector_col, scale)
    once = own.groupBy("id").agg(F.min("v").alias("v"))
    once = once.select("id", F.size("v").alias("d"), F.lit(0.0).alias("norm"), "v")
    queries = once.sortWithinPartitions("d", "id").mapInArrow(asked, "d int, ids binary, vs binary, floor binary, reach double")
    order = [F.col("d"), F.desc("norm"), F.col("id")]
    blocks = vectors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _blocks(it, BLOCK), "d int, ids binary, vs binary, norm double")
    # Blocks meet blocks: each query block goes to every group of candidate blocks once.
    groups = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = queries.select("d", F.col("ids").alias("q_ids"), F.col("vs").alias("q"), "floor", "reach", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    blocks, queries = blocks.repartition(groups, "d", "g"), queries.repartition(groups, "d", "g")
    pairs = blocks.join(queries, (blocks["d"] == queries["d"]) & (blocks["g"] == queries["g"]) & (blocks["norm"] >= queries["reach"]))
    pairs = pairs.select(blocks["d"], "ids", "vs", "q_ids", "q", "floor", F.xxhash64("q_ids").alias("key"), "norm").sortWithinPartitions("d", "key", F.desc("norm"))

    def best(s: Search):
        n = [len(sc) for sc, _ in s.best]
        scores = [x for sc, _ in s.best for x in sc.tolist()]
        if any(x >= 2**63 for x in scores):
            raise OverflowError("a score is too large for a long")
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate([key for _, key in s.best])), pa.array([max(x, -(2**63)) for x in scores], pa.int64())], names=["query_id", "vec_id", "score"])

    def met(batches):
        s = held = None
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                ids, x = _unpack(row, 0)
                if held != (asks := row.column(3)[0].as_py()):
                    if s:
                        yield best(s)
                    held = asks
                    q_ids, q = _unpack(row, 2)
                    s = Search(q_ids, q, turn.get(row.column(0)[0].as_py()), k, np.frombuffer(row.column(5)[0].as_py(), "<f8").copy())
                s.offer(ids, x)
        if s:
            yield best(s)

    found = pairs.select("d", "ids", "vs", "q_ids", "q", "floor").mapInArrow(met, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack(row, at: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.column(at + 1)[0].as_py(), "<i8")
    return ids, np.frombuffer(row.column(at + 2)[0].as_py(), "<i8").reshape(len(ids), -1)
