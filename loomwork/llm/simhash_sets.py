"""SimHash near copies with a stated similarity of shingle sets.

The SimHash operator's second interface: documents are linked that share
``least`` of their word shingles (exact Jaccard), for which 64 bits are too few.

1. Texts with equal shingle sets form a class.  A class has one long SimHash
   fingerprint, the majority vote of its shingles' hashes, in ``parts``
   partitions of ``width`` bits.
2. By the pigeonhole principle two fingerprints that differ in fewer bits than
   there are partitions agree in one whole partition; pairs of similarity
   ``least`` differ in more bits, but each partition agrees with probability
   p^width, p = 1 - acos(2 s / (1 + s)) / pi, so the number of partitions is
   chosen for a chance of ``miss`` that none does.  The width follows the number
   of documents, so that a bucket has some tens of chance members at any size.
   Correlated bits share a partition.
3. Every fingerprint has a threshold t >= -1 for each partition, with sum 0: it
   is in the bucket of its own value, and asks there (0 or more), also in those
   of the values within t bits (probes), or not at all (-1).  A dynamic programme
   finds the thresholds of least expected cost from the counts of all buckets.
   Fingerprints that differ in fewer bits than there are partitions still meet;
   a threshold of 1 meets over twice as many similar sets as one of 0, so that
   a sum of 0 misses no more of them than thresholds that are all 0.
4. Members of a bucket are compared by 128 more bits, and close ones verified by
   their exact shingle sets: first each member with its smallest close leader;
   then all close pairs of buckets that are not connected so far.  So a large
   group of copies costs about one verification a member, and no close pair is
   left out.  Buckets of over ``CHUNK`` members are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import bound_batches, slices
from loomwork.llm.graph import connected_components
from loomwork.llm.simhash import PAIR_COST, allocate, ball_counts, group_bits
from loomwork.scratch import Scratch, settle

SKETCH = 128
#: A pair of similarity 0.8 differs in 19.4 of the 128 bits, give or take 4.1, so that 1e-4 of such pairs are over
#: this; unrelated ones in 64, give or take 5.7.
CLOSE = 34
CHUNK = 8192
#: Fingerprints that the grouping of the bits is fitted on, and bits of a histogram; both affect costs, never results.
FITTED, CELL_BITS = 16384, 12
INDEX, BOTH, PROBE = 0, 1, 2
#: Partitions in which a bucket with many close pairs names leaders; the others leave its members to the second round.
LEADING = 16
#: Pairs of the second round are verified tile by tile: texts of about two BLOCKs of a bucket's members.
BLOCK, TILE = 256, ["key", "chunk", "i", "j"]
PAIRS = "u long, v long, key long, chunk long, i long, j long"


def agreement(least: float) -> float:
    """The chance that a fingerprint bit is equal in two sets of that similarity."""
    return 1 - math.acos(2 * least / (1 + least)) / math.pi


def layout(rows: int, least: float, miss: float) -> tuple[int, int]:
    """(width, parts) of the partitions for so many documents."""
    width = max(8, math.ceil(math.log2(max(rows, 2))) - 6)
    return width, math.ceil(math.log(miss) / math.log1p(-(agreement(least) ** width)))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's lower-cased (A-Z) word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    width = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])], np.uint64))


def vote(own: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a shingle set in ``words`` times 64 bits: 1 if set in over half of the shingles' hashes."""
    votes = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(own), 255):  # as many as a byte can count
        z = own[i : i + 255, None] + salt[None, :]  # 64-bit finaliser of independent words
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        votes += np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(own))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(id, th, cid, n, sig): text hash, class, number of shingles, sketch and fingerprint."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    long = -(-(bits + SKETCH) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(x, words) for x in b.column("text").to_pylist()]
            cid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            cols = [b.column("id"), b.column("th"), pa.array(cid), pa.array([len(s) for s in sets], pa.int64()), pa.array([vote(s, long).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "cid", "n", "sig"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, th long, cid long, n long, sig binary")


class Plan:
    """Partitions of a fingerprint's bits, and thresholds by the counts of their buckets.

    ``order`` lists the bits, partition by partition.  Counts of partitions of
    over CELL_BITS bits come from histograms of their parts, which are taken to
    be independent; that affects costs, never results.
    """

    def __init__(self, order: np.ndarray, width: int, pair_cost: float = PAIR_COST):
        self.order, self.width, self.parts, self.pair_cost = order, width, len(order) // width, pair_cost
        self.joined = -(-width // CELL_BITS)
        self.bits = -(-width // self.joined)
        self.flips = 1 << np.arange(width)

    def count(self, cells: np.ndarray, n: np.ndarray) -> Plan:
        """Takes the counts of the cells that ``cells`` gives."""
        hist = np.zeros(self.parts * self.joined << self.bits)
        hist[cells] = n
        hist = hist.reshape(self.parts, self.joined, -1)
        self.rows = max(float(hist[0, 0].sum()), 1.0)
        self.most = np.array([[ball_counts(h, 1)[1] for h in hs] for hs in hist])
        self.shell = np.array([[np.diff(ball_counts(h, 1), axis=0, prepend=0) for h in hs] for hs in hist], np.float32)  # part, piece, radius, value
        return self

    def values(self, sig: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """[rows, parts] values of the partitions and [rows, 2] sketches."""
        raw = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(sig), -1)
        bits = np.unpackbits(raw[:, SKETCH // 8 :], axis=1)[:, self.order].reshape(len(sig), self.parts, self.width)
        return bits.astype(np.int64) @ self.flips, raw[:, : SKETCH // 8].copy().view(np.int64)

    def near(self, values: np.ndarray) -> np.ndarray:
        """[rows, parts, 2]: expected members of the buckets within 0 and 1 bits."""
        part = np.arange(self.parts)
        same, next_ = np.ones(values.shape), np.zeros(values.shape)
        for j in range(self.joined):
            v = (values >> (self.bits * j)) & ((1 << self.bits) - 1)
            a, b = self.shell[part, j, 0, v], self.shell[part, j, 1, v]
            if j:
                a, b = a / self.rows, b / self.rows
            same, next_ = same * a, same * b + next_ * a
        return np.stack([same, same + next_], axis=2)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """What the members and probes of the buckets can be at most: those within one bit in each piece of the value."""
        part, values = keys >> self.width, keys & ((1 << self.width) - 1)
        return np.min([self.most[part, j, (values >> (self.bits * j)) & ((1 << self.bits) - 1)] for j in range(self.joined)], axis=0)

    def limits(self, values: np.ndarray) -> np.ndarray:
        """[rows, parts]: thresholds of least cost with sum 0."""
        cost = np.zeros((*values.shape, 3))
        cost[:, :, 1:] = self.pair_cost * self.near(values)
        cost[:, :, 2] += self.width  # rows of the probes; the bucket of the own value has one anyway
        out = np.zeros(values.shape, np.int64)
        # no exchange of a partition for a probed one gains where the largest bucket costs less than the cheapest probes
        gain = np.flatnonzero(cost[:, :, 1].max(1) > (cost[:, :, 2] - cost[:, :, 1]).min(1))
        if len(gain):
            out[gain] = allocate(cost[gain], 0)
        return out


def _order(classes: DataFrame, width: int, parts: int) -> np.ndarray:
    """The bits in partitions of correlated ones, fitted on up to about FITTED classes by their hash."""
    every = -(-classes.count() // FITTED)
    some = classes.where((F.col("n") > 0) & (F.pmod("cid", F.lit(max(every, 1))) == 0)).select("sig").repartition(1)
    total = width * parts

    def run(batches):
        co, n = np.zeros((total, total), np.float32), 0
        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(raw[:, SKETCH // 8 :], axis=1)[:, :total].astype(np.float32)
                co += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(total)), pa.array(np.concatenate(group_bits(co.astype(float), n, parts)))], names=["at", "bit"])

    got = some.mapInArrow(run, "at long, bit long").toArrow()  # one row a bit
    return np.asarray(got["bit"])[np.argsort(np.asarray(got["at"]))] if len(got) else np.arange(total)


def _counted(classes: DataFrame, plan: Plan) -> Plan:
    """The plan with the counts of all classes."""
    pieces = np.arange(plan.joined) * plan.bits

    def run(batches):
        hist = np.zeros(plan.parts * plan.joined << plan.bits, np.int64)
        base = np.arange(plan.parts * plan.joined).reshape(plan.parts, plan.joined) << plan.bits
        for b in batches:
            if b.num_rows:
                v = plan.values(b.column("sig"))[0][:, :, None] >> pieces
                hist += np.bincount((base + (v & ((1 << plan.bits) - 1))).ravel(), minlength=len(hist))
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[at])], names=["cell", "n"])

    found = classes.where("n > 0").select("sig").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2^CELL_BITS a piece at most
    return plan.count(np.asarray(found["cell"]), np.asarray(found["n"]))


def _asked(classes: DataFrame, shared) -> DataFrame:
    """(cid, n, sig, limits): every class with words and its thresholds, a byte each."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                t = shared.value.limits(shared.value.values(c.column("sig"))[0]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array([r.tobytes() for r in t], pa.binary())], names=["cid", "n", "sig", "limits"])

    return classes.where("n > 0").select("cid", "n", "sig").mapInArrow(run, "cid long, n long, sig binary, limits binary")


def _places(plan: Plan, sig: pa.Array, limits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bucket keys and roles of the buckets that fingerprints are in or probe, and all sketches."""
    values, sketch = plan.values(sig)
    t = np.frombuffer(b"".join(limits.to_pylist()), np.int8).reshape(values.shape)
    base = np.arange(plan.parts) << plan.width
    i, k = np.nonzero(t > 0)
    probed = (base[k] + values[i, k])[:, None] ^ plan.flips
    at = np.append(np.repeat(np.arange(len(values)), plan.parts), np.repeat(i, plan.width))
    role = np.append(np.where(t.ravel() < 0, INDEX, BOTH), np.full(probed.size, PROBE)).astype(np.int32)
    return at, np.append((base + values).ravel(), probed.ravel()), role, sketch


def _members(classes: DataFrame, shared, whole: bool = False) -> DataFrame:
    """(key, cid, root, s0, s1, role): every class (cid, root, n, sig, limits) in each of its buckets; ``whole``: (n, sig) besides."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                at, keys, role, sketch = _places(shared.value, c.column("sig"), c.column("limits"))
                cols = [keys, *(x[at] for x in (np.asarray(c.column("cid")), np.asarray(c.column("root")), sketch[:, 0], sketch[:, 1])), role]
                more = [c.column(x).take(pa.array(at)) for x in names[6:]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *more], names=names)

    schema = "key long, cid long, root long, s0 long, s1 long, role int" + ", n long, sig binary" * whole
    names = [x.split()[0] for x in schema.split(", ")]
    return classes.where("n > 0").select("cid", "root", "n", "sig", "limits").mapInArrow(run, schema)


def _chunked(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the number of chunks of their bucket, and their own chunk."""
    rows = rows.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))


def _hot(classes: DataFrame, shared) -> DataFrame:
    """(key, chunks) of the buckets with over CHUNK members and probes."""
    most = CHUNK

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys, n = np.unique(_places(shared.value, b.column("sig"), b.column("limits"))[1], return_counts=True)
                big = shared.value.bound(keys) > most
                yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(n[big])], names=["key", "n"])

    counts = classes.where("n > 0").select("sig", "limits").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal (key, chunk), of rows that come sorted by these."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(c)) for c in names]
        cuts = (np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            part = [c[lo:hi] for c in cols]
            if held and (held[-1][0][0] != part[0][0] or held[-1][1][0] != part[1][0]):
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)]: whether sketches (uint64 pairs) are close."""
    apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
    return apart <= CLOSE


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[len(a), len(b)]: whether one of the two is in the bucket and the other asks there."""
    return (a[:, None] != b[None, :]) | (a[:, None] == BOTH)


def close_pairs(cid: np.ndarray, sketch: np.ndarray, role: np.ndarray, leading: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Close pairs (u < v) of a bucket sorted by cid, all of them if few.

    If many, each member with one smaller close one where ``leading``, else none;
    the third result then names the members of which pairs may be left out.
    """
    none = np.zeros(0, np.int64)
    if len(cid) <= 512:
        near = np.triu(_near(sketch, sketch) & _meet(role, role), 1)
        i, j = np.nonzero(near)
        if len(i) <= len(cid):
            return cid[i], cid[j], none
        own = np.flatnonzero(near.any(0) & leading)
        return cid[near[:, own].argmax(0)], cid[own], cid[near.any(0) | near.any(1)]
    if not leading:
        return none, none, cid
    left, us, vs = np.arange(len(cid)), [], []
    while len(left) > 1:
        near = (_near(sketch[left[:1]], sketch[left[1:]]) & _meet(role[left[:1]], role[left[1:]]))[0]
        got = left[1:][near]
        us.append(np.full(len(got), cid[left[0]]))
        vs.append(cid[got])
        left = left[1:][~near]
    return np.concatenate(us), np.concatenate(vs), cid


def _first_pairs(rows: DataFrame, width: int) -> DataFrame:
    """(u, v): close pairs; a null v marks a class that may have more."""

    def run(batches):
        held, more, n = [], [], 0
        for key, _, cid, s0, s1, role in _buckets(batches, ["key", "chunk", "cid", "s0", "s1", "role"]):
            if len(cid) > 1:
                u, v, open_ = close_pairs(cid, np.stack([s0, s1], axis=1).view(np.uint64), role, key[0] >> width < LEADING)
                held.append((u, v))
                more.append(open_)
                n += len(u) + len(open_)
            if n > 1 << 18:
                yield batch(held, more)
                held, more, n = [], [], 0
        if held:
            yield batch(held, more)

    def batch(held, more):
        # the same pairs come from many buckets
        pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*held)], axis=1), axis=0)
        open_ = np.unique(np.concatenate(more))
        null = np.append(np.zeros(len(pairs), bool), np.ones(len(open_), bool))
        return pa.RecordBatch.from_arrays([pa.array(np.append(pairs[:, 0], open_)), pa.array(np.append(pairs[:, 1], open_), mask=null)], names=["u", "v"])

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "cid").mapInArrow(run, "u long, v long")


def _limit(least: float, bits: int) -> tuple[float, float]:
    """Bits in which the whole fingerprints of similar sets differ at most: of sets under a dozen shingles, and others.

    Sets of a dozen shingles and more differ in 1 - ``agreement`` of the bits;
    the smallest ones (four of five shingles) in up to 1.24 times that.  Four and
    a half standard deviations are allowed on top.
    """
    p = 1 - agreement(least)
    return tuple(q * bits + 4.5 * math.sqrt(q * (1 - q) * bits) for q in (min(0.5, 1.24 * p), p))


def _cross(sketch, root, cid, role, n, sig, a, b, least):
    """Batches of close pairs between rows a and b with different roots, whose whole fingerprints are no further apart than similar sets'."""
    whole = np.frombuffer(b"".join(sig), np.uint64).reshape(len(sig), -1)
    limit = _limit(least, 64 * whole.shape[1])
    step = max(1, (1 << 20) // max(len(b), 1))
    for lo in range(0, len(a), step):
        x = a[lo : lo + step]
        differ = (root[x][:, None] != root[b][None, :]) & _meet(role[x], role[b])
        if differ.any():
            i, j = np.nonzero(differ & _near(sketch[x], sketch[b]))
            for at in range(0, len(i), 1 << 15):
                p, q = x[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]]
                few, many = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
                d = np.bitwise_count(whole[p] ^ whole[q]).sum(1, dtype=np.int64)
                keep = (d <= np.where(few < 12, *limit)) & (few >= many * least - 1e-9)
                if keep.any():
                    u, v = cid[p[keep]], cid[q[keep]]
                    yield np.minimum(u, v), np.maximum(u, v)


def _batch(found):
    """(u, v) and the tile of texts that verifies each: its bucket, there a block of u's and one of v's."""
    rows = np.concatenate([np.stack(np.broadcast_arrays(u, v, key, chunk, u % blocks, v % blocks), axis=1) for u, v, key, chunk, blocks in found])
    rows = rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]]  # the same pairs come from many buckets
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["u", "v", *TILE])


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with one of its tiles."""
    return pairs.groupBy("u", "v").agg(F.min(F.struct(*TILE)).alias("t")).select("u", "v", "t.*")


def _cross_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(u, v) and their tile: close pairs of a bucket chunk in different components; ``rows`` are whole members with their roots."""

    def run(batches):
        held, n = [], 0
        for key, chunk, cid, root, s0, s1, *own in _buckets(batches, ["key", "chunk", "cid", "root", "s0", "s1", "role", "n", "sig"]):
            if (root != root[0]).any():
                # members outside the largest component, against all
                roots, count = np.unique(root, return_counts=True)
                few = np.flatnonzero(root != roots[count.argmax()])
                for pair in _cross(np.stack([s0, s1], axis=1).view(np.uint64), root, cid, *own, few, np.arange(len(cid)), least):
                    held.append((*pair, key[0], chunk[0], -(-len(cid) // BLOCK)))
                    n += len(pair[0])
            if n > 1 << 18:
                yield _batch(held)
                held, n = [], 0
        if held:
            yield _batch(held)

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, PAIRS)


def _hot_pairs(rows: DataFrame, least: float) -> DataFrame:
    """The same for buckets of several chunks: pairs across chunks.

    Members outside a bucket's largest component go to all its chunks; each
    chunk compares its members with them.
    """
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "most")
    open_ = rows.join(split, "key")
    few = open_.where("root != most").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cid", "root", "s0", "s1", "role", "n", "sig")
    both = few.union(open_.select("key", "chunk", F.lit(1).alias("side"), "cid", "root", "s0", "s1", "role", "n", "sig"))

    def run(batches):
        for key, chunk, side, cid, root, s0, s1, *own in _buckets(batches, ["key", "chunk", "side", "cid", "root", "s0", "s1", "role", "n", "sig"]):
            for pair in _cross(np.stack([s0, s1], axis=1).view(np.uint64), root, cid, *own, np.flatnonzero(side == 0), np.flatnonzero(side == 1), least):
                yield _batch([(*pair, key[0], chunk[0], -(-len(cid) // BLOCK))])

    return both.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, PAIRS)


def _alike(pairs: DataFrame, classes: DataFrame, least: float, bits: int) -> DataFrame:
    """(u, v, d): the pairs whose whole fingerprints differ in d bits, no more than similar sets do."""
    limit = _limit(least, bits)
    sides = pairs
    for s in ("u", "v"):
        sides = sides.join(classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")), s)
    # a set of n shingles has no partner under least * n of them
    sides = sides.where((F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * least - 1e-9) & (F.col("n_u") > 0))

    def run(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint64).reshape(b.num_rows, -1) for x in ("sig_u", "sig_v"))
                d = np.bitwise_count(a ^ c).sum(1, dtype=np.int64)
                keep = pa.array(d <= np.where(np.asarray(b.column("n")) < 12, *limit))
                yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep), pa.array(d).filter(keep)], names=["u", "v", "d"])

    return sides.select("u", "v", F.least("n_u", "n_v").alias("n"), "sig_u", "sig_v").mapInArrow(run, "u long, v long, d long")


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, text) of the classes in ``wanted``."""
    wanted = wanted.distinct().join(classes, "cid").select("cid", F.col("low.id").alias("id"), F.col("low.th").alias("th"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).join(wanted, ["id", "th"])
    return texts.select("cid", "text").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """The ``pairs(u, v)`` of classes with similarity ``least`` or more."""
    scratch = Scratch(docs.sparkSession, "pairs")
    left = scratch.save(pairs.select("u", "v"), "left")
    texts = scratch.save(_texts(left.select(F.explode(F.array("u", "v")).alias("cid")), classes, docs, id_col, text_col), "texts")
    both = left.join(texts.select(F.col("cid").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("cid").alias("v"), F.col("text").alias("text_v")), "v")

    def exact(batches):
        last: dict[int, np.ndarray] = {}  # a hub's set serves the rows that follow it
        for b in slices(batches, "text_u"):
            keep = []
            for u, v, a, c in zip(*(b.column(x).to_pylist() for x in ("u", "v", "text_u", "text_v"))):
                if len(last) > 64:
                    last.clear()
                for k, t in ((u, a), (v, c)):
                    if k not in last:
                        last[k] = shingle_set(t, words)
                keep.append(similar(last[u], last[v], least))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])

    return scratch.save(both.select("u", "v", "text_u", "text_v").mapInArrow(exact, "u long, v long"), "links")


def _verified_tiles(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """The same for ``pairs`` with their tiles: a text goes to its tiles, however many pairs it has there."""
    scratch = Scratch(docs.sparkSession, "pairs")
    left = scratch.save(pairs, "left")
    members = left.select("u", *TILE).distinct().union(left.select("v", *TILE).distinct()).distinct().withColumnRenamed("u", "cid")
    members = scratch.save(members, "members")
    texts = scratch.save(_texts(members.select("cid"), classes, docs, id_col, text_col), "texts")
    sent = members.join(texts, "cid").select(*TILE, F.lit(0).alias("kind"), F.col("cid").alias("u"), F.lit(0).cast("long").alias("v"), "text")
    both = sent.union(left.select(*TILE, F.lit(1), "u", "v", F.lit(None).cast("string")))

    def exact(batches):
        at, sets = None, {}
        for b in slices(batches, "text"):
            keep = []
            for *tile, kind, u, v, text in zip(*(c.to_pylist() for c in b.columns)):
                if tile != at:
                    at, sets = tile, {}
                if not kind:
                    sets[u] = shingle_set(text, words)
                keep.append(bool(kind) and similar(sets[u], sets[v], least))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])

    rows = both.repartition(*TILE).sortWithinPartitions(*TILE, "kind")
    return scratch.save(rows.mapInArrow(exact, "u long, v long"), "links")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, miss: float = 1e-4, pair_cost: float = PAIR_COST
) -> DataFrame:
    """(id, component): rows linked by shingle similarity of ``least`` or more.

    ``component`` is the smallest id reachable.  A pair of exactly ``least``
    shares no bucket with probability ``miss``, a nearer one less.  ``pair_cost``
    is what comparing a candidate costs against sending a probe.  Null and
    word-free texts form one class, texts under ``words`` words are one shingle;
    rows with a null id are left out.  Extra columns are ignored, an empty table
    gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    docs = docs.where(F.col(id_col).isNotNull())
    width, parts = layout(docs.count(), least, miss)
    scratch = Scratch(docs.sparkSession, "simhashsets")
    own = scratch.save(_signed(docs, id_col, text_col, words, width * parts), "own")
    classes = own.groupBy("cid").agg(F.min(F.struct("id", "th")).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.save(classes, "classes")
    plan = _counted(classes, Plan(_order(classes, width, parts), width, pair_cost))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    settle(docs.sparkSession)  # some hundred jobs follow
    placed = scratch.save(_asked(classes, shared), "placed")
    hot = scratch.save(_hot(placed, shared), "hot")
    rows = _chunked(_members(placed.withColumn("root", F.col("cid")), shared), hot)
    found = scratch.save(_first_pairs(rows.drop("root"), width), "found")
    pairs = found.where("v is not null").select("u", "v").distinct()
    args = (classes.select("cid", "low"), docs, id_col, text_col, words, least)
    bits = 64 * -(-(width * parts + SKETCH) // 64)

    pairs = scratch.save(_alike(pairs, classes, least, bits), "alike")
    star = scratch.save(pairs.groupBy("v").agg(F.min(F.struct("d", "u"))["u"].alias("u")).select("u", "v"), "star")
    links = _verified(star, *args)
    settle(docs.sparkSession)
    roots = scratch.save(connected_components(links, scratch), "roots")
    settle(docs.sparkSession)
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    rest = rest.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v").join(star, ["u", "v"], "left_anti")
    rooted = placed.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    open_ = found.where("v is null").select(F.col("u").alias("cid")).distinct()
    more = _cross_pairs(_chunked(_members(rooted.join(open_, "cid", "left_semi"), shared, True), hot), least)
    if hot.limit(1).count():
        more = more.union(_hot_pairs(_chunked(_members(rooted, shared, True).join(hot.select("key"), "key", "left_semi"), hot), least))
    # a pair that the first round has left open is a tile of its own, unless a bucket of the second has it too
    alone = rest.select("u", "v", F.lit(1 << 62).alias("key"), F.lit(0).cast("long").alias("chunk"), F.col("u").alias("i"), F.col("v").alias("j"))
    links = links.unionByName(_verified_tiles(_once(more.union(alone)), *args))
    settle(docs.sparkSession)

    roots = connected_components(links, Scratch(docs.sparkSession, "simhashsets"))
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.col("low.id").alias("low"), F.coalesce("root", "cid").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = scratch.save(named.join(lows, "root").select("cid", "component"), "named")
    return own.join(named, "cid").select("id", "th", "component")
