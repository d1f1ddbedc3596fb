"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprint: majority vote of the XXH64 of word shingles (exact, whole text).
2. Correlated bits are grouped into partitions (greedy on the bit correlation
   matrix, which is summed over all distinct fingerprints).
3. Every partition value's candidate counts at radius 0..max_radius come from a
   histogram over all fingerprints; a dynamic programme gives each fingerprint
   unequal thresholds t_i >= -1 with sum tau - m + 1 that minimise its expected
   candidates.  Two fingerprints within tau must agree within t_i in some
   partition i, so probing loses no link.  Four partitions of 16 bits or two of
   32, whichever costs less for the number of fingerprints: wide ones need more
   probes, but their candidates stay few where 16 bits no longer tell apart.
4. Probes meet the index in key-sorted streams, pairs are verified by popcount,
   and each batch sends on only a spanning forest, never all pairs of a group.
   Index buckets over ``chunk`` rows are split and hot probe values salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import bound_batches, slices
from loomwork.llm.graph import connected_components, spanning_forest
from loomwork.scratch import Scratch

BITS = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a text's lower-cased (A-Z) word shingles, repeats included."""
    if not text:
        return 0
    # bytes.lower and bytes.split touch A-Z and \x20 \x09-\x0D only
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    n = max(1, len(parts) - words + 1)
    width = min(words, len(parts))
    digest = xxhash.xxh64_digest
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 16384):
        j = min(n, i + 16384)
        raw = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[i:j], starts[i + width : j + width])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(x, words) for x in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def group_bits(co: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partition the bits so that strongly correlated ones share a partition.

    ``co[i, j]`` counts rows with bits i and j set.  Greedy: a partition starts
    from the most correlated free pair and takes the free bit with the highest
    mean |correlation| until it is full.
    """
    p = np.diag(co) / max(n, 1)
    cov = co / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out, width = set(range(len(co))), [], len(co) // parts
    for _ in range(parts):
        f = sorted(free)
        sub = corr[np.ix_(f, f)]
        i, _ = np.unravel_index(np.argmax(sub), sub.shape)
        own = [f[i]]
        while len(own) < width:
            rest = sorted(free - set(own))
            own.append(rest[int(np.argmax(corr[np.ix_(rest, own)].mean(1)))])
        out.append(sorted(own))
        free -= set(own)
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """[rows, parts]: each fingerprint's bits of each partition, packed."""
    out = np.zeros((len(fp), len(groups)), np.int64)
    for k, bits in enumerate(groups):
        for j, b in enumerate(bits):
            out[:, k] |= (((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)).astype(np.int64)
    return out


def ball_counts(hist: np.ndarray, radius: int) -> np.ndarray:
    """[radius + 1, values]: rows within each Hamming radius of each value.

    One pass per bit adds, for every distance, the rows on the other side.
    """
    width = int(np.log2(len(hist)))
    at = np.zeros((radius + 1, len(hist)))
    at[0] = hist
    idx = np.arange(len(hist))
    for b in range(width):
        other = at[:, idx ^ (1 << b)]
        at[1:] += other[:-1]
    return np.cumsum(at, axis=0)


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds [rows, parts] of least cost with the given sum.

    ``cost[rows, parts, t + 1]`` is what threshold t costs, t from -1.  Dynamic
    programme over the partitions with the running sum as its state.
    """
    rows, parts, kinds = cost.shape
    base, width = parts, parts + parts * (kinds - 2) + 1  # sums run from -parts
    best = np.full((rows, width), np.inf)
    best[:, base] = 0
    choice = np.zeros((parts, rows, width), np.int8)
    for k in range(parts):
        new = np.full((rows, width), np.inf)
        for t in range(-1, kinds - 1):
            src = best[:, max(0, -t) : width - max(0, t)] + cost[:, k, t + 1][:, None]
            dst = slice(max(0, t), width - max(0, -t))
            better = src < new[:, dst]
            new[:, dst] = np.where(better, src, new[:, dst])
            choice[k][:, dst] = np.where(better, t, choice[k][:, dst])
        best = new
    out = np.zeros((rows, parts), np.int64)
    at = np.full(rows, base + total)
    for k in reversed(range(parts)):
        out[:, k] = choice[k][np.arange(rows), at]
        at = at - out[:, k]
    return out


def _bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        co = np.zeros((BITS, BITS))
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            co += bits.T @ bits
            co_n[0] += len(fp)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(co[i, j].astype(np.int64), co_n[0]))], names=["cell", "n"]
        )
        co_n[0] = 0

    co_n = [0]
    rows = fps.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 2,081 rows
    co, total = np.zeros((BITS, BITS)), 0
    for cell, n in zip(rows["cell"], rows["n"]):
        if cell < 0:
            total = int(n)
        else:
            co[cell // BITS, cell % BITS] = co[cell % BITS, cell // BITS] = n
    return co, total


def _histogram(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    size = 1 << len(groups[0])

    def run(batches):
        hist = np.zeros((len(groups), size), np.int64)
        for b in batches:
            v = part_values(np.asarray(b.column("fp")).view(np.uint64), groups)
            for k in range(len(groups)):
                hist[k] += np.bincount(v[:, k], minlength=size)
        flat = hist.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "n"])

    rows = fps.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # parts * 2^width rows at most
    flat = np.zeros(len(groups) * size, np.int64)
    flat[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return flat.reshape(len(groups), size)


PAIR_COST = 0.02  # comparing a candidate, against sending a probe


def expected_cost(n: int, parts: int, tau: int) -> float:
    """Probes and candidates of a fingerprint among n even ones, at the cheapest thresholds of the right sum."""
    width, total = BITS // parts, tau - parts + 1
    ball = [0.0, *accumulate(float(math.comb(width, r)) for r in range(max(total, 0) + parts))]  # radius -1, 0, 1, ...
    cost = [0.0 if t == 0 else b + PAIR_COST * b * n / 2.0**width for t, b in enumerate(ball)]
    best = {0: 0.0}
    for _ in range(parts):
        new: dict[int, float] = {}
        for at, c in best.items():
            for t in range(-1, len(cost) - 1):
                if c + cost[t + 1] < new.get(at + t, math.inf):
                    new[at + t] = c + cost[t + 1]
        best = new
    return best[total]


class Partitions:
    """Values, expected candidates and splits of partitions made of whole 16-bit groups.

    Counts come from the groups' histograms; a partition of several groups is
    taken to have them independent, which affects costs but never results.
    """

    def __init__(self, groups: list[list[int]], hist: np.ndarray, parts: int, radius: int, chunk: int):
        self.joined, self.parts, self.radius, self.chunk = len(groups) // parts, parts, radius, chunk
        self.groups, self.hist, self.n = groups, hist, max(float(hist[0].sum()), 1.0)
        self.width = sum(map(len, groups[: self.joined]))
        near = np.stack([ball_counts(h, radius) for h in hist])
        self.shell = np.diff(near, axis=1, prepend=0).astype(np.float32)  # group, radius, value
        self.masks = [np.array([sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(self.width), r)], np.int64) for t in range(radius + 1)]

    def split(self, k: int, values: np.ndarray) -> list[np.ndarray]:
        return [(values >> (16 * j)) & 0xFFFF for j in range(self.joined)]

    def values(self, fp: np.ndarray) -> np.ndarray:
        """[rows, parts]"""
        v = part_values(fp, self.groups).reshape(len(fp), self.parts, self.joined)
        return (v << (16 * np.arange(self.joined))).sum(2)

    def near(self, k: int, values: np.ndarray) -> np.ndarray:
        """[radius + 1, rows]: expected fingerprints within each radius of the values."""
        total = None
        for j, v in enumerate(self.split(k, values)):
            own = self.shell[k * self.joined + j][:, v]
            if total is None:
                total = own
            else:
                total = np.stack([sum(total[a] * own[r - a] for a in range(r + 1)) for r in range(self.radius + 1)]) / self.n
        return np.cumsum(total, axis=0)

    def present(self, k: int, values: np.ndarray) -> np.ndarray:
        """False where no fingerprint has the value; such probes need not travel."""
        return np.logical_and.reduce([self.hist[k * self.joined + j][v] > 0 for j, v in enumerate(self.split(k, values))])

    def spread(self, k: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of the index rows of each value, and salts of its probes."""
        at = self.near(k, values)
        chunks = np.maximum(1, np.ceil(at[0] / self.chunk)).astype(np.int64)
        return chunks, np.maximum(1, -(-at[min(1, self.radius)].astype(np.int64) // (16 * chunks * self.chunk)))


def linked(fps: DataFrame, scratch: Scratch, tau: int = 4, parts: int | None = None, max_radius: int | None = None, chunk: int = 4096) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``tau`` bits.

    ``fps(fp long)`` holds distinct fingerprints.  The edges span the same
    components as all links, without listing all pairs of a dense group.
    ``parts`` is 1, 2 or 4; if not given, 2 or 4 by the expected cost.
    """
    spark = fps.sparkSession
    co, n = _bit_counts(fps)
    parts = parts or min((4, 2), key=lambda p: expected_cost(n, p, tau))
    total = tau - parts + 1
    max_radius = max_radius or max(2, -(-total // parts))
    if parts not in (1, 2, 4) or parts * max_radius < total:
        raise ValueError("parts must be 1, 2 or 4, and max_radius reach tau - parts + 1")
    groups = group_bits(co, n, 4)
    plan = spark.sparkContext.broadcast(Partitions(groups, _histogram(fps, groups), parts, max_radius, chunk))  # 4 * 2^16 counts

    def probe(batches):
        p = plan.value
        for b in batches:
            raw = np.asarray(b.column("fp"))
            fp = raw.view(np.uint64)
            values = p.values(fp)
            mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            cost = np.zeros((len(fp), p.parts, len(p.masks) + 1), np.float32)
            for k in range(p.parts):
                cost[:, k, 1:] = p.near(k, values[:, k]).T + [len(m) / PAIR_COST if p.joined > 1 else len(m) for m in p.masks]
            limits = allocate(cost, total)
            for k in range(p.parts):
                yield _rows(k, p, values[:, k], raw, mixed, index=True)
                for t, m in enumerate(p.masks):
                    who = np.flatnonzero(limits[:, k] == t)
                    step = max(1, 400_000 // len(m))
                    for lo in range(0, len(who), step):
                        w = who[lo : lo + step]
                        v = (values[w, k][:, None] ^ m[None, :]).ravel()
                        keep = p.present(k, v)
                        yield _rows(k, p, v[keep], np.repeat(raw[w], len(m))[keep], np.repeat(mixed[w], len(m))[keep], index=False)

    rows = fps.mapInArrow(probe, "key long, side int, fp long").repartition("key").sortWithinPartitions("key", "side")

    def match(batches):
        tail_key, tail = None, np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            key, side, fp = (np.asarray(b.column(c)) for c in ("key", "side", "fp"))
            fp = fp.view(np.uint64)
            ikey, ifp = key[side == 0], fp[side == 0]
            if tail_key is not None and tail_key == key[0]:
                ikey, ifp = np.concatenate([np.full(len(tail), tail_key), ikey]), np.concatenate([tail, ifp])
            pkey, pfp = key[side == 1], fp[side == 1]
            found = list(_verified(ikey, ifp, pkey, pfp, tau))
            if found:
                a, c = spanning_forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["u", "v"])
            tail_key = key[-1]
            tail = ifp[ikey == tail_key]

    return scratch.save(rows.mapInArrow(match, "u long, v long"), "links")


def _rows(k, p, values, raw, mixed, index):
    """Index rows go to one chunk and every salt, probes to one salt and every chunk."""
    c, s = p.spread(k, values)
    own, spread = (c, s) if index else (s, c)
    mine = (mixed % own.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(values)), spread)
    other = np.arange(len(at)) - np.repeat(np.cumsum(spread) - spread, spread)
    block = mine[at] * s[at] + other if index else other * s[at] + mine[at]
    key = ((k << 32 | values[at]) << 24) | block
    side = np.full(len(at), 0 if index else 1, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(raw[at])], names=["key", "side", "fp"])


def _verified(ikey, ifp, pkey, pfp, tau, most=1 << 20):
    """Forests of the verified links, made from at most ``most`` pairs at a time."""
    if not len(ikey) or not len(pkey):
        return
    lo = np.searchsorted(ikey, pkey, "left")
    n = np.searchsorted(ikey, pkey, "right") - lo
    pfp, lo, n = pfp[n > 0], lo[n > 0], n[n > 0]
    ends = np.cumsum(n)
    i = 0
    while i < len(pfp):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        cnt = n[i:j]
        at = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(lo[i:j], cnt)
        a, b = np.repeat(pfp[i:j], cnt), ifp[at]
        ok = (np.bitwise_count(a ^ b) <= tau) & (a != b)
        if ok.any():
            yield spanning_forest(a[ok], b[ok])
        i = j


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, tau: int = 4, parts: int | None = None
) -> DataFrame:
    """(id, fp, component): documents linked by fingerprints within ``tau`` bits.

    ``component`` is the smallest id reachable.  Null and word-free texts have
    fingerprint zero and link like any other; texts under ``words`` words are
    one shingle; repeated rows share fingerprint and component; a null id is
    kept and never names a component unless all its members are null.  Extra
    columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.save(fingerprints(docs, id_col, text_col, words), "fp")
    classes = scratch.save(own.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    links = linked(classes.select("fp"), scratch, tau, parts)
    roots = connected_components(links, scratch)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = scratch.save(named.join(lows, "root").select("fp", "component"), "named")
    return own.join(named, "fp").select("id", "fp", "component")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
