"""N-gram Jaccard join by vertical partitioning.

The distinct word shingles of a text are hashed and ordered by hash: the global n-gram order. That order is
cut into fragments, the same for all texts of a length class and more of them than the shingles that two
linked texts of the class can differ in. So linked texts have at least so many whole fragments in common, and
only texts that do become candidates. Candidate classes are then verified exactly: within blocks of bounded
size the order is cut into fragments again, each fragment's partial overlaps are counted for all pairs at once
(a product of 0/1 matrices), and the counts are summed per pair.

Texts with equal shingle sets are one node throughout, so copies cost nothing beyond one row each. Sets are told
apart by 128 bits; a node is named by 64 of them, and sets that share these get names of their own.

Defined results: null and empty text has an empty set, n_shingles 0, and links with nothing; fewer words than
the shingle width make one shingle of the whole sequence; a null doc_id takes part and shows only as null;
repeated rows are copies of each other (one output row per input row); an empty table gives no rows; columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_text, connected_components, discard, lean, small_side, stored, width
from .kernels import SPACED, U, binary, mix, rolling

FLUSH = 500_000  # signatures, or pairs, that a task holds before it hands them on
SENT = 100_000  # of them in a batch
RUN = 32  # members of a run that are paired one by one
BLOCK = 1024  # texts of one side of a verified block
SLICE = 4096  # shingles of one verified fragment
SALT = 16  # tasks that a run of equal signatures is tied in
MOST_CLASHES = 100_000  # sets with another one's digest; more would mean a broken hash
GRAMS = 8_000_000  # shingles of one side of a verified block
PART = 8_000_000  # signatures of a partition, on average


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for i, j, cut in SPACED.texts(column):
        h, at = cut.h, cut.at
        whole = rolling(h, k)
        for r in range(j - i):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield rolling(h[a:b], b - a)
            else:
                yield np.empty(0, U)


def digests(u: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs; of the first only `bits` count."""
    if not len(u):
        return 0, 0
    two = [int(mix(np.array([x.sum(dtype=U) + U(len(u))], U))[0]) for x in (mix(u), mix(u ^ U(0xA0761D6478BD642F)))]
    return _signed(two[0] & ((1 << bits) - 1)), _signed(two[1])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Nodes:
    """The long that stands for a set: the first half of its digest, but for the few sets that share it with another one."""

    def __init__(self, bits: int = 64, other: dict[tuple[int, int], int] | None = None):
        self.bits, self.other = bits, other or {}

    def of(self, u: np.ndarray) -> int:
        two = digests(u, self.bits)
        return self.other.get(two, two[0])


def bounds(share: int, upto: int = 1 << 40) -> list[int]:
    """Starts of the length buckets: linked lengths lie in one bucket or in neighbours."""
    out = [1]
    while out[-1] < upto:
        out.append(-(-out[-1] * 100 // share))
        if out[-1] == out[-2]:
            out[-1] += 1
    return out


def differing(most: int, share: int) -> int:
    """Most shingles by which two linked sets differ, neither longer than `most`."""
    s = 2 * most
    return (100 - share) * s // (100 + share)


def fragments(u: np.ndarray, starts: list[int], share: int) -> tuple[np.ndarray, int]:
    """Signatures of the set's fragments, of its class with the next bucket and with the one before; and how many
    of them a linked set has in common with it at least: the fragments with shingles, less those that can differ.
    """
    n, out, m, need = len(u), [], mix(u ^ U(0x5851F42D4C957F2D)), 255
    j = bisect_right(starts, n) - 1
    for c in (j - 1, j):
        if c < 0:
            continue
        most = differing(starts[c + 2] - 1, share)
        g = most + most // 4 + 3
        f = ((u >> U(32)) * U(g)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        own = f[first]
        salt = U((c * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        sums = np.add.reduceat(m, first)
        out.append(mix(sums ^ mix(own + salt)))
        need = min(need, max(1, len(own) - most))
        if len(own) <= most:  # so few that two such sets may have only empty fragments in common
            out.append(mix(mix(np.setdiff1d(np.arange(g, dtype=U), own) + salt)))
    return np.concatenate(out), need


def _stats(k: int, bits: int):
    def run(batches):
        for b in batches:
            n, d, c = [], [], []
            for u in text_sets(b.column("text"), k):
                n.append(len(u))
                two = digests(u, bits)
                d.append(two[0])
                c.append(two[1])
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, d, c))], ["doc_id", "n", "digest", "check"])

    return run


def packed(sig: np.ndarray, need: np.ndarray, far: np.ndarray) -> np.ndarray:
    """55 bits of a signature, what its text needs, and whether it is far, as one long. Signatures that then look alike only
    make more candidates.
    """
    return ((sig & ~U(0x1FF)) | (need.astype(U) << U(1)) | far.astype(U)).view(np.int64)


def _signatures(k: int, share: int, nodes: Nodes, run: int):
    """(sig, id): each distinct set of a task with its signatures, packed.

    Of the sets of a task that share a signature the first run + 1 go where all of the signature meet, enough to tell
    that the run is long; the others (far) need meet nobody and are dealt by themselves, so no signature fills a task.
    """
    starts = bounds(share)

    def flush(ids, found):
        many = [len(x) for x, _ in found]
        i, s, m = np.repeat(np.array(ids, np.int64), many), np.concatenate([x for x, _ in found]), np.repeat(np.array([x for _, x in found], np.uint8), many)
        order = np.argsort(s, kind="stable")
        i, s, m = i[order], s[order], m[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        far = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s)))) > run
        p = packed(s, m, far)
        for at in range(0, len(s), SENT):
            yield pa.record_batch([pa.array(p[at : at + SENT]), pa.array(i[at : at + SENT])], ["sig", "id"])

    def each(batches):
        ids, sigs, held, seen = [], [], 0, set()
        for b in batches:
            for u in text_sets(b.column("text"), k):
                if not len(u) or (d := nodes.of(u)) in seen:
                    continue
                seen.add(d)
                ids.append(d)
                sigs.append(fragments(u, starts, share))
                held += len(sigs[-1][0])
                if held >= FLUSH:
                    yield from flush(ids, sigs)
                    ids, sigs, held = [], [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if ids:
            yield from flush(ids, sigs)

    return each


class Pairs:
    """Pairs that share signatures, counted until they are handed on, and the members of long runs."""

    def __init__(self):
        self.a, self.b, self.need, self.far, self.held = [], [], [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.need.append(need)
        self.held += len(a)

    def taken(self) -> pa.RecordBatch:
        a, b, need = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.a, self.b, self.need))
        ids, sigs, needs = (np.concatenate([np.empty(0, np.int64), *(f[c] for f in self.far)]) for c in range(3))
        self.__init__()
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(a)))
        most = np.maximum.reduceat(need, at) if len(at) else need
        cols = (a[at], ids), (b[at], sigs), (np.zeros(len(at), bool), np.ones(len(ids), bool)), (n, np.ones(len(ids), np.int64)), (most, needs)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], ["src", "dst", "long", "n", "need"])


def _runs(run: int):
    """What the runs of equal signatures say, with `need`, the fragments that a linked pair shares at least.

    All members of a short run are paired: (src, dst, n times). A member of a long run is named with its
    signature instead: (src, the signature as dst, long). Rows come sorted; only the run that is not over at the end
    of a stretch is kept, and of a long one nothing.
    """

    def stretches(batches):
        some, held = [], 0
        for b in batches:
            p = b.column("sig").to_numpy()
            some.append((p >> 9, b.column("id").to_numpy(), (p >> 1) & 255, (p & 1).astype(bool)))
            held += b.num_rows
            if held >= SENT:
                yield [np.concatenate(x) for x in zip(*some, strict=True)]
                some, held = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*some, strict=True)]

    def each(batches):
        out, open_, long = Pairs(), None, None  # the run that goes on; the signature of a long one that does

        def settle(sig, ids, need, far):
            """All runs of these rows are over."""
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            wide = (size > run) | np.logical_or.reduceat(far, first)
            within, wide, size = np.arange(len(sig)) - np.repeat(first, size), np.repeat(wide, size), np.repeat(size, size)
            for step in range(1, min(run, int(size.max(initial=1)))):
                at = np.flatnonzero(~wide & (within + step < size))
                at = at[ids[at] != ids[at + step]]
                a, b = ids[at], ids[at + step]
                out.add(np.minimum(a, b), np.maximum(a, b), np.maximum(need[at], need[at + step]))
            out.far.append((ids[wide], sig[wide], need[wide]))
            out.held += int(wide.sum())

        for sig, ids, need, far in stretches(batches):
            if open_ is not None:
                sig, ids, need, far = (np.concatenate(x) for x in zip(open_, (sig, ids, need, far), strict=True))
            once = np.ones(len(sig), bool)  # copies of a set come from several tasks
            once[1:] = (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1])
            if not once.all():
                far = np.logical_or.reduceat(far, np.flatnonzero(once))
                sig, ids, need = sig[once], ids[once], need[once]
            if long is not None and (more := sig == long).any():
                out.far.append((ids[more], sig[more], need[more]))
                out.held += int(more.sum())
                sig, ids, need, far = sig[~more], ids[~more], need[~more], far[~more]
            open_ = None
            if len(sig):
                last = int(np.searchsorted(sig, sig[-1]))
                long = None
                if len(sig) - last > run or far[last:].any():
                    long, last = sig[-1], len(sig)  # what is still to come of it is known to be long
                if last:
                    if long is not None:
                        far = far | (sig == long)
                    settle(sig[:last], ids[:last], need[:last], far[:last])
                if last < len(sig):
                    open_ = sig[last:], ids[last:], need[last:], far[last:]
            if out.held >= FLUSH:
                yield out.taken()
        if open_ is not None:
            settle(*open_)
        yield out.taken()

    return each


def _candidates(found: DataFrame) -> DataFrame:
    """(src, dst, long): the pairs that can share as many fragments as they need.

    A pair shares what it has in common in short runs, and in long ones at most what each of the two has in
    long runs at all. With something in a short run it is checked as a pair. With nothing there both need
    enough long runs; such texts are tied to the least one of each of their runs.
    """
    long = found.where("long").groupBy(F.col("src").alias("node"), F.col("dst").alias("sig")).agg(F.max("need").alias("need"))  # copies name it more than once
    count = stored(long.groupBy("node").agg(F.count("*").alias("m"), F.max("need").alias("need")), "runs")
    left, right = count.select(F.col("node").alias("src"), F.col("m").alias("m1")), count.select(F.col("node").alias("dst"), F.col("m").alias("m2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    short = found.where("not long").groupBy("src", "dst").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    short = short.join(left, "src", "left").join(right, "dst", "left").where(F.col("n") + F.least(zero("m1"), zero("m2")) >= F.col("need"))
    able = long.join(count.where("m >= need").select("node"), "node", "left_semi")
    # a run may hold a large part of all texts: it meets its least one in SALT tasks
    low = able.groupBy("sig").agg(F.min("node").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    able = able.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    tied = able.join(low, ["sig", "salt"]).where("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst")).distinct()
    return short.select("src", "dst", F.lit(False).alias("long")).unionByName(tied.withColumn("long", F.lit(True)))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs: partial counts by fragment of the order, summed."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(u) for u in x]) for x in (left, right))
    shared = np.intersect1d(a, b)  # the order, without shingles of one side alone
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(shared), SLICE):
        part = shared[at : at + SLICE]
        sides = []
        for h, r, n in ((a, ra, len(left)), (b, rb, len(right))):
            c = np.searchsorted(part, h)
            hit = c < len(part)
            hit[hit] = part[c[hit]] == h[hit]
            m = np.zeros((n, len(part)), np.float32)
            m[r[hit], c[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _verified(share: int):
    """Links of the texts dealt to a task: as edges to the least text that a text is linked with, and for each text
    the rows of the other texts that it is linked with. Pairs that meet in a block of wide texts as well count there.
    """

    def links(ids, sets, copies, wide, ids2, sets2, copies2, wide2):
        n, n2 = np.array([len(u) for u in sets]), np.array([len(u) for u in sets2])
        o = overlaps(sets, sets2)
        near = 100 * o >= share * (n[:, None] + n2[None, :] - o)
        counted = near & (ids[:, None] != ids2[None, :]) & ~(wide[:, None] & wide2[None, :])
        many, many2 = counted @ copies2, copies @ counted
        label, label2 = ids, ids2
        big = np.iinfo(np.int64).max
        while True:  # least label over the links, until nothing moves
            a = np.minimum(label, np.where(near, label2[None, :], big).min(1))
            b = np.minimum(label2, np.where(near, a[:, None], big).min(0))
            if (a == label).all() and (b == label2).all():
                return [(ids, label, many), (ids2, label2, many2)]
            label, label2 = a, b

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["key", "side", "one", "wide", "digest", "copies", "grams"]).to_pydict()
        groups: dict[int, tuple[dict, dict]] = {}
        for r, c in enumerate(rows["key"]):
            groups.setdefault(c, ({}, {}))[rows["side"][r]][rows["digest"][r]] = r
        got = [(np.empty(0, np.int64),) * 3]
        for sides in groups.values():
            take = []
            for m in sides:
                at = [m[d] for d in sorted(m)]
                column = lambda c, t, at=at: np.array([rows[c][r] for r in at], t)
                take.append((column("digest", np.int64), [np.frombuffer(rows["grams"][r], U) for r in at], column("copies", np.int64), column("wide", bool)))
            if any(rows["one"][r] for m in sides for r in m.values()):  # the texts of one block meet each other
                got += links(*take[0], *take[0])[:1]
            elif take[0][1] and take[1][1]:
                got += links(*take[0], *take[1])
        dst, src, many = (np.concatenate([g[k] for g in got]) for k in range(3))
        some = (src != dst) | (many > 0)
        return pa.table({"src": src[some], "dst": dst[some], "links": many[some]})

    return run


def _grams(k: int, nodes: Nodes):
    def run(batches):
        seen = set()  # repeated rows of a candidate: one from each task is enough
        for b in batches:
            sets, keep = list(text_sets(b.column("text"), k)), []
            for u, d in zip(sets, b.column("digest").to_pylist(), strict=True):
                keep.append(d not in seen and len(u) > 0 and nodes.of(u) == d)
                if keep[-1]:
                    seen.add(d)
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column("digest"), b.column("copies"), binary(sets)], ["digest", "copies", "grams"]).filter(keep)

    return run


def _dealt(pairs: DataFrame, cand: DataFrame, lengths: DataFrame, parts: int, block: int) -> DataFrame:
    """(digest, key, side, one, wide, task): the verification that each candidate takes part in.

    A class of at most `block` texts meets in one task. A larger one is cut into blocks: a pair from a short run
    goes to the task of its two blocks, and texts of long runs meet all blocks of such texts. one: both blocks of
    the key are the same. wide: a text of a pair's task that meets all blocks too; two such texts count there.
    Classes of long texts (lengths: digest, n) have smaller blocks, of GRAMS shingles at most or one text.
    """
    nodes = cand.select(F.col("node").alias("digest"), F.col("label").alias("cls")).join(lengths, "digest")
    size = nodes.groupBy("cls").agg(F.count("*").alias("size"), F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.floor(F.lit(GRAMS) / F.max("n")))).alias("block"))
    sized = stored(nodes.join(size, "cls").select("digest", "cls", "size", "block", "n"), "sized")
    whole = sized.where("size <= block").select("digest", F.col("cls").alias("key"), F.lit(0).alias("side"), F.lit(True).alias("one"), F.lit(False).alias("wide"))
    wide = sized.where("size > block").drop("n")

    blocks = F.ceil(F.col("size") / F.col("block"))
    i, j = F.pmod(F.xxhash64("src"), blocks), F.pmod(F.xxhash64("dst"), blocks)
    sparse = pairs.where("not long").join(wide.withColumnRenamed("digest", "src"), "src").select("src", "dst", "cls", i.alias("i"), j.alias("j"))
    key = F.xxhash64("cls", F.least("i", "j"), F.greatest("i", "j"), F.lit("pair"))
    two = F.array(F.struct(F.col("src").alias("digest"), (F.col("i") > F.col("j")).cast("int").alias("side")), F.struct(F.col("dst").alias("digest"), (F.col("j") > F.col("i")).cast("int").alias("side")))
    sparse = sparse.select(key.alias("key"), (F.col("i") == F.col("j")).alias("one"), F.explode(two).alias("t")).select("t.digest", "key", "t.side", "one").distinct()

    long = pairs.where("long")
    long = stored(long.select(F.col("src").alias("digest")).unionByName(long.select(F.col("dst").alias("digest"))).distinct().join(wide, "digest"), "long")
    sparse = sparse.join(long.select("digest", F.lit(True).alias("wide")), "digest", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    count = long.groupBy("cls").agg(F.ceil(F.count("*") / F.max("block")).alias("n"))
    dense = long.join(count, "cls").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dense = dense.select("digest", F.xxhash64("cls", F.least("own", "other"), F.greatest("own", "other"), F.lit("block")).alias("key"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("one"), F.lit(False).alias("wide"))
    # small verifications share a task, of about GRAMS shingles or less
    tasks = max(parts, int(sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 4 // GRAMS))
    small = F.pmod(F.xxhash64("key"), F.lit(tasks).cast("long"))
    return whole.unionByName(sparse).withColumn("task", small).unionByName(dense.withColumn("task", F.col("key")))


def _nodes(sets: DataFrame, bits: int) -> tuple[Nodes, DataFrame]:
    """How sets (digest, check) are named, and the names (digest, check, node) of those that share their digest with another.

    Among 10**11 sets some hundreds share 64 bits, so these few are all that is ever gathered.
    """
    spark = sets.sparkSession
    many = sets.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    clash = sorted(tuple(r) for r in sets.join(many, "digest").select("digest", "check").limit(MOST_CLASHES + 1).collect())
    if len(clash) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} sets share a digest")
    other: dict[tuple[int, int], int] = {}
    turn = 0
    while len(other) < len(clash):
        turn += 1
        new = {x: _signed(int(mix(np.array([(x[1] + turn * 0x9E3779B97F4A7C15) % (1 << 64)], U))[0])) for x in clash if x not in other}
        table = spark.createDataFrame(list(new.values()), "long").withColumnRenamed("value", "digest")
        used = {r[0] for r in sets.join(F.broadcast(table), "digest", "left_semi").select("digest").collect()} | set(other.values())  # at most MOST_CLASHES
        for x, v in new.items():
            if v not in used:
                other[x] = v
                used.add(v)
    names = spark.createDataFrame([(*x, v) for x, v in other.items()], "digest long, check long, node long")
    return Nodes(bits, other), names


def _named(rows: DataFrame, nodes: Nodes, names: DataFrame) -> DataFrame:
    """rows with the node of their (digest, check) as digest."""
    if not nodes.other:
        return rows.drop("check")
    rows = rows.join(F.broadcast(names), ["digest", "check"], "left")  # at most MOST_CLASHES rows
    return rows.withColumn("digest", F.coalesce("node", "digest")).drop("check", "node")


def _classes(docs: DataFrame, k: int, share: int, run: int, block: int, bits: int) -> tuple[DataFrame, DataFrame, Nodes]:
    """(doc_id, n, digest) of every row, (digest, copies, low, label, links) of every set that is not empty, and the naming."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = stored(texts.mapInArrow(lean(_stats(k, bits)), "doc_id long, n long, digest long, check long"), "sets")
    sets = stored(stats.where("n > 0").groupBy("digest", "check").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("n")), "classes")
    nodes, names = _nodes(sets, bits)
    stats, sets = _named(stats, nodes, names), _named(sets, nodes, names)
    grams_all = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(width(spark), int(grams_all * 5 * (100 - share) / (100 + share) * 100 / share) // PART)
    rows = texts.mapInArrow(lean(_signatures(k, share, nodes, run)), "sig long, id long")
    rows = rows.repartition(parts, F.expr("if(sig & 1 = 1, id, shiftright(sig, 9))")).sortWithinPartitions("sig", "id")  # far ones by their id
    found = stored(rows.mapInArrow(lean(_runs(run)), "src long, dst long, long boolean, n long, need long"), "found")
    pairs = stored(_candidates(found), "pairs")
    discard(found)
    cand = connected_components(pairs.select("src", "dst"))
    dealt = stored(_dealt(pairs, cand, sets.select("digest", "n"), width(spark) * 8, block), "dealt")

    none = F.lit(-(1 << 63))
    members = stored(cand.select(F.col("node").alias("digest")).join(sets, "digest").select("digest", "copies", F.coalesce("low", none).alias("low")), "candidates")
    rows = texts.select(F.coalesce("doc_id", none).alias("low"), "text")
    # rows of one doc_id with other texts fall to the digest test; repeated rows meet in their task
    grams = rows.join(small_side(members, members.count()), "low").select("text", "digest", "copies").mapInArrow(lean(_grams(k, nodes)), "digest long, copies long, grams binary")
    sent = grams.join(small_side(dealt, dealt.count()), "digest").select("task", "key", "side", "one", "wide", "digest", "copies", "grams")
    near = stored(sent.groupBy("task").applyInArrow(_verified(share), "src long, dst long, links long"), "near")
    for done in (pairs, dealt, members):
        discard(done)
    linked = near.groupBy(F.col("dst").alias("digest")).agg(F.sum("links").alias("links"))
    top = connected_components(near.select("src", "dst")).withColumnRenamed("node", "digest")
    return stats, sets.join(top, "digest", "left").join(linked, "digest", "left").select("digest", "copies", "low", F.coalesce("label", "digest").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), nodes


def jaccard_components(docs: DataFrame, k: int = 4, share: int = 85, run: int = RUN, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, copies: the links 100 * intersection >= share * union.

    n_links counts the other rows that a row links with directly, copies the rows with its very set. run: members of
    a signature's run that are paired one by one; block: texts of one side of a verified block; bits: of the first
    half of a set's digest. All three only deal out the work, they drop nothing.
    """
    stats, classes, _ = _classes(docs, k, share, run, block, bits)
    lows = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = stored(classes.join(lows, "label").select("digest", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies"), "classes")
    out = stats.where("n > 0").join(classes, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "copies")
    alone = stats.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(alone)


def _digest_of(k: int, nodes: Nodes):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([nodes.of(u) if len(u) else None for u in text_sets(texts, k)], pa.int64())

    return run


def keep_one(docs: DataFrame, k: int = 4, share: int = 85, run: int = RUN, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the smallest doc_id (null last), then of the
    smallest set digest; of repeated rows one. Rows with an empty set all stay.
    """
    stats, classes, nodes = _classes(docs, k, share, run, block, bits)
    many = classes.groupBy("label").agg(F.sum("copies").alias("n")).where("n > 1").select("label")
    rows = stored(stats.where("n > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("rows_")).join(classes.select("digest", "label").join(many, "label"), "digest"), "members")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("f"))
    marked = rows.join(first, "label").select("doc_id", "digest", "rows_", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("digest") == F.col("f.digest"))).alias("kept"))
    marked = stored(marked.where("not kept or rows_ > 1").select(F.col("doc_id").alias("id_"), F.col("digest").alias("other_"), "kept"), "marked")
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    digest = by_text(_digest_of(k, nodes), "long")
    seen = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(c).alias(names[c]) for c in docs.columns]).alias("row_"), digest.alias("digest_"))
    joined = seen.join(small_side(marked, marked.count()), F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest_") == F.col("other_")), "left")
    out = joined.where("kept is null").select("row_").unionByName(joined.where("kept").dropDuplicates(["id", "digest_"]).select("row_"))
    return out.select(*[F.col(f"row_.{names[c]}").alias(c) for c in docs.columns])
