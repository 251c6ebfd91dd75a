"""Near-duplicate vectors by product quantisation, with exact rerank.

Vectors equal in every component collapse to one first. The rest go to coarse inverted lists by label; a
list's members keep the code of their residual in each subspace and the length of what the code misses.
Every vector is also a query: it probes each list whose boundary (the hyperplane between that list's centre
and its own) is no further than half a link's length, gets table-lookup distances to the members' codes, drops
members that the triangle inequality rules out, and takes the exact cosine of the others in double precision.
Linked vectors on two sides of a boundary have distances to it that add up to a link's length at most, so one
of them probes the other's list whatever the vectors' distribution. A link counts for both ends, once if both
probe. A block of links leaves as a spanning star of each of its components, never as all pairs.

A list with many members or queries is split in blocks of ``BLOCK`` on both sides; no group of vectors is
gathered whole. The index is fitted on at most ``SAMPLE_BYTES`` of vectors, those with the smallest hash; the number
of lists grows with the root of the table's size. Vectors of another length than the commonest take part in it
with their first components or padded with zeros, which brings no two of them further apart, so the bounds hold.
Single-precision components travel as such and are compared in double precision.

Edge cases: a vector that is null, empty, zero or has null or non-finite components, and one whose label is
null, links with nothing: n_links 0, itself as component, kept. Vectors of different lengths never link. A null vec_id has a null component and is kept; repeated ids share the
links of their vectors. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.stream import groups
from strandline.llm.work import Scratch, components, lean

SAMPLE_BYTES, MAX_LISTS, BLOCK, CODEBOOK, SUB_DIM = 32 << 20, 8192, 2048, 64, 8


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, max(1, len(x)), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centres and a codebook for each subspace of the residuals, over unit vectors."""

    def __init__(self, x: np.ndarray, n_lists: int):
        self.dim = x.shape[1]
        self.centres = _kmeans(x, n_lists, 1)
        res = x - self.centres[_nearest(x, self.centres)]
        self.cuts = np.linspace(0, self.dim, max(1, self.dim // SUB_DIM) + 1).astype(int)
        self.books = [_kmeans(np.ascontiguousarray(res[:, a:b]), CODEBOOK, 2 + i) for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]
        self.gap = np.sqrt(np.maximum(0, ((self.centres[:, None, :] - self.centres[None]) ** 2).sum(2))) if len(self.centres) <= 512 else None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes, and the distance from its coded place."""
        own = _nearest(x, self.centres)
        res = x - self.centres[own]
        codes = np.stack([_nearest(np.ascontiguousarray(res[:, a:b]), k) for a, b, k in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        back = np.hstack([k[codes[:, i]] for i, k in enumerate(self.books)])
        return own, codes, np.sqrt(((res - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """The lists that each vector probes, its own among them: of two within ``radius``, one probes the other's."""
        d2 = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)
        gap = self.gap[own] if self.gap is not None else np.sqrt(np.maximum(0, ((self.centres**2).sum(1)[own, None] - 2 * self.centres[own] @ self.centres.T + (self.centres**2).sum(1))))
        near = d2 - d2[np.arange(len(x)), own][:, None] <= gap * radius + 1e-12
        near[np.arange(len(x)), own] = True
        return [np.flatnonzero(r) for r in near]

    def distances(self, q: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from each q to the coded places of a list's members, by table lookup."""
        res = q - self.centres[lst]
        out = np.zeros((len(q), len(codes)))
        for i, (a, b, k) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            r = res[:, a:b]
            table = (r * r).sum(1)[:, None] - 2 * r @ k.T + (k * k).sum(1)
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(0, out))


_VEC = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("vec", pa.binary())])


def _vectors(df: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, dim, vec): the components' bytes, null if the vector can't link."""

    @lean
    def run(batches):
        for b in batches:
            out, dims = [], []
            labels = b.column(2)
            for v, lab in zip(b.column(1), labels, strict=True):
                x = None
                if v.is_valid and lab.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    n2 = float(x @ x) if np.isfinite(x).all() else 0.0
                    if not (n2 > 0 and np.isfinite(n2)):
                        x = None
                out.append(None if x is None else x.astype(kind).tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), labels, pa.array(dims, pa.int64()), pa.array(out, pa.binary())], schema=_VEC)

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")).mapInArrow(run, "vec_id long, label long, dim long, vec binary")


def _doubles(table: pa.Table, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in table["vec"].to_pylist()]).astype(np.float64)


def _in_index(x: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of any length in the index's space."""
    x = x / np.sqrt((x * x).sum(1))[:, None]
    return np.ascontiguousarray(x[:, :dim]) if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


_PLACED = pa.schema([("label", pa.int64()), ("dim", pa.int64()), ("list", pa.int64()), ("role", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("miss", pa.float64()), ("home", pa.int64()), ("probed", pa.binary()), ("vec", pa.binary())])
_FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n_links", pa.int64())])


def link(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings(vec_id, embedding, label)``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    vecs = scratch.save(_vectors(embeddings, kind).withColumn("key", F.sha2("vec", 256)), "vectors")
    reps = scratch.save(vecs.where("vec is not null").groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "distinct")
    shape = reps.groupBy("dim").agg(F.count("*").alias("n"))
    shape = shape.agg(F.sum("n").alias("n"), F.max_by("dim", F.struct("n", "dim")).alias("dim")).first()
    dim, total = shape["dim"], shape["n"]
    if not total:
        return vecs.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    wanted = max(256, min(SAMPLE_BYTES // (8 * dim), int(32 * np.sqrt(total))))
    sample = reps.where(F.col("dim") <= 2 * dim).orderBy("key", "label", "dim").limit(wanted).select("dim", "vec").toArrow()
    x = np.concatenate([_in_index(_doubles(sample.filter(pc.equal(sample["dim"], d)), kind), dim) for d in sorted(set(sample["dim"].to_pylist()))])
    index = spark.sparkContext.broadcast(Index(x, int(max(1, min(MAX_LISTS, len(x) // 4, np.sqrt(total))))))
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    @lean
    def place(batches):
        ix = index.value
        for b in batches:
            t = pa.Table.from_batches([b])
            for d in sorted(set(t["dim"].to_pylist())):
                part = t.filter(pc.equal(t["dim"], d))
                n = part.num_rows
                x = _in_index(_doubles(part, kind), dim)
                own, codes, miss = ix.encode(x)
                probes = ix.probes(x, own, radius)
                at = np.repeat(np.arange(n), [len(p) for p in probes])
                take = np.concatenate([np.arange(n), at])
                rows = part.take(pa.array(take))
                lists = np.concatenate([own, *probes]).astype(np.int64)
                role = np.concatenate([np.zeros(n, np.int64), np.ones(len(at), np.int64)])
                coded = [c.tobytes() for c in codes]
                probed = [p.astype(np.int32).tobytes() for p in probes]
                is_member = (role == 0).tolist()
                yield from pa.Table.from_arrays(
                    [rows["label"], rows["dim"], pa.array(lists), pa.array(role), rows["rep"], rows["n"], pa.array([coded[i] if k else None for i, k in zip(take.tolist(), is_member, strict=True)], pa.binary()), pa.array(miss[take]), pa.array(own[take].astype(np.int64)), pa.array([probed[i] if k else None for i, k in zip(take.tolist(), is_member, strict=True)], pa.binary()), rows["vec"]],
                    schema=_PLACED,
                ).combine_chunks().to_batches()

    placed = scratch.save(reps.select("label", "dim", "rep", "n", "vec").mapInArrow(place, "label long, dim long, list long, role long, rep long, n long, codes binary, miss double, home long, probed binary, vec binary"), "placed")
    cell = ("label", "dim", "list")
    load = placed.groupBy(*cell).agg(F.count_if(F.col("role") == 0).alias("m"), F.count_if(F.col("role") == 1).alias("q")).where("m > 0")
    load = load.select(*cell, F.ceil(F.col("m") / BLOCK).alias("bm"), F.ceil(F.col("q") / BLOCK).alias("bq"))
    dealt = placed.join(load, list(cell))
    own_block = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("bm")).otherwise(F.col("bq")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("bq")).otherwise(F.col("bm")) - 1))
    dealt = dealt.withColumn("own", own_block).withColumn("other", other)
    dealt = dealt.withColumn("cell", F.xxhash64(*cell, F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))))
    dealt = dealt.select("cell", "label", "dim", "list", "role", "rep", "n", "codes", "miss", "home", "probed", "vec").repartition("cell").sortWithinPartitions("cell", "label", "dim", "list", "role", "rep")

    @lean
    def compare(batches):
        ix = index.value
        for g in groups(batches, 4):
            role = g["role"].to_numpy()
            m, q = g.filter(pa.array(role == 0)), g.filter(pa.array(role == 1))
            if not m.num_rows or not q.num_rows:
                continue
            mx, mid, mn = _doubles(m, kind), m["rep"].to_numpy(), m["n"].to_numpy()
            mlen = np.sqrt((mx * mx).sum(1))
            codes = np.stack([np.frombuffer(c, np.uint8) for c in m["codes"].to_pylist()])
            miss = m["miss"].to_numpy()
            qx, qid, qn, home = _doubles(q, kind), q["rep"].to_numpy(), q["n"].to_numpy(), q["home"].to_numpy()
            qlen = np.sqrt((qx * qx).sum(1))
            lst, qz = g["list"][0].as_py(), _in_index(qx, dim)
            linked = np.zeros((len(qid), len(mid)), bool)
            for i in range(0, len(qid), 512):
                may = ix.distances(qz[i : i + 512], lst, codes) <= radius + miss
                a, b = np.nonzero(may)
                for j in range(0, len(a), 1 << 16):
                    u, v = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)]
                    cos = np.einsum("ij,ij->i", qx[u], mx[v]) / (qlen[u] * mlen[v])
                    ok = cos >= threshold
                    linked[u[ok], v[ok]] = True
            linked &= qid[:, None] != mid[None]
            count = linked @ mn
            # a member that doesn't probe the query's list meets it only here
            back = np.zeros(len(mid), np.int64)
            for j in np.flatnonzero(linked[home != lst].any(0)).tolist():
                at = np.flatnonzero(linked[:, j])
                back[j] = qn[at[~np.isin(home[at], np.frombuffer(m["probed"][j].as_py(), np.int32))]].sum()
            rq, rm = qid.copy(), mid.copy()
            while linked.any():
                big = np.iinfo(np.int64).max
                nq = np.minimum(rq, np.where(linked, rm[None], big).min(1))
                nm = np.minimum(rm, np.where(linked, nq[:, None], big).min(0))
                if (nq == rq).all() and (nm == rm).all():
                    break
                rq, rm = nq, nm
            keep = linked.any(1)
            keep_m = linked.any(0) & ((rm != mid) | (back > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([qid[keep], mid[keep_m]])), pa.array(np.concatenate([rq[keep], rm[keep_m]])), pa.array(np.concatenate([count[keep], back[keep_m]]))], schema=_FOUND)

    found = scratch.save(dealt.mapInArrow(compare, "node long, root long, n_links long"), "found")
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    per_rep = reps.select("label", "dim", "key", "rep", F.col("n").alias("copies")).join(links, F.col("rep") == F.col("node"), "left").drop("node").join(comp, F.col("rep") == F.col("node"), "left")
    per_rep = scratch.save(per_rep.select("label", "dim", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "reps")
    out = vecs.select("vec_id", "label", "dim", "key").join(per_rep, ["label", "dim", "key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
