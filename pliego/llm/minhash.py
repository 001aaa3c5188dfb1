"""MinHash near-deduplication with a multi-index Hamming join.

A document's set is its distinct word shingles.  Its signature holds ``HASHES``
codes of 16 bits, one for each minimum; codes of two documents differ with
probability 1 - (similarity).  Linked documents differ in at most ``radius``
codes but for a chance of ``MISS`` a link (binomial tail, exact), so the join
has to find all pairs of signatures within that radius.

* Pigeonhole: the codes are cut into ``radius // 2 + 1`` chunks, so two signatures
  within the radius have a chunk with one differing code at most.
* Allowed errors: each chunk gives one key for each code left out.  Signatures
  with at most one error in a chunk share a key of it: ``HASHES`` keys a document.
* Equal sets are one representative.  A key's members are compared with the
  smallest one.  Where that does not bring all into one class, the strangers are
  held against all members of the smallest one's class that they share a key with,
  and against each other: once a class, not once a key.
* Classes of signatures within the radius are then held against the full sets:
  chunks of a class with its smallest member, then what that member does not
  reach against all chunks.  Each group gives a spanning set of confirmed links.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_digest

from .common import bitmap_of, held_in, join_unique, slices, text_key, written
from .simhash import components

#: Codes of a signature.
HASHES = 96
#: Chance that a link at the similarity itself is out of the radius.
MISS = 1e-9
SEED = 42
#: Shingles whose hashes are worked on at a time.
AT_ONCE = 2048
#: Members of a chunk, and shingles of its sets.
BUCKET = 2048
SHINGLES = 1 << 20

_rng = np.random.default_rng(20240607)
MULTIPLY = (_rng.integers(0, 1 << 32, (HASHES, 1), np.uint32) | np.uint32(1))
ADD = _rng.integers(0, 1 << 32, (HASHES, 1), np.uint32)
#: Odd multipliers of the key of a chunk, one for each code.
SPREAD = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
del _rng


def radius(percent: int, hashes: int = HASHES, miss: float = MISS) -> int:
    """Codes that may differ: the smallest number a link of ``percent`` exceeds with a chance of ``miss`` at most."""
    p, left = 1 - percent / 100, 1.0
    for r in range(hashes):
        left = sum(comb(hashes, i) * p ** i * (1 - p) ** (hashes - i) for i in range(r + 1, hashes + 1))
        if left <= miss:
            return r
    return hashes


def shingle_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased, words end at ASCII white space.

    Fewer words than a shingle: one shingle of all of them.  No words: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.frombuffer(xxh64_digest(joined, SEED), ">u8").astype(np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    raw = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:])])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """uint16[HASHES]: 16 bits of the minimum of each hash function over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), AT_ONCE):
        np.minimum(low, (MULTIPLY * x[k:k + AT_ONCE] + ADD).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tk, n, set, sig) of every row: set size, 128-bit key of the set, signature; both null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, key, sig = [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, shingle)
                n.append(len(s))
                key.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sig, pa.binary())], names=["doc_id", "tk", "n", "set", "sig"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return rows.mapInArrow(run, "doc_id long, tk long, n long, set binary, sig binary")


# ------------------------------------------------------------- multi-index join

def codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_keys(sigs: np.ndarray, radius: int) -> np.ndarray:
    """int64[n, HASHES]: for each code the key of its chunk without that code."""
    hashes = sigs.shape[1]
    chunks = radius // 2 + 1
    of = np.arange(hashes) * chunks // hashes
    # a code's term is random, so a chunk's sum of terms tells its codes apart
    terms = mixed((sigs.astype(np.uint64) + np.uint64(1)) * SPREAD[:hashes])
    starts = np.searchsorted(of, np.arange(chunks))
    sums = np.add.reduceat(terms, starts, axis=1)
    return mixed((sums[:, of] - terms) ^ SPREAD[:hashes]).view(np.int64)


def bands(reps: DataFrame, radius: int, bitmap=None) -> DataFrame:
    """(key, rep): the keys of each representative; with a (broadcast) bitmap those that it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64) if bitmap else None
        for b in slices(batches):
            keys = chunk_keys(codes(b.column(1)), radius)
            rep = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            keys = keys.ravel()
            if bitmap:
                held = held_in(bits, keys.view(np.uint64))
                keys, rep = keys[held], rep[held]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep)], names=["key", "rep"])
    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def within(pairs: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) whose signatures (a, b) differ in ``radius`` codes at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = (codes(b.column(2)) != codes(b.column(3))).sum(axis=1)
                near = pa.array(far <= radius)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["u", "v"])
    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected: each member is held once against those not reached yet.

    ``linked(i, left)`` gives those of ``left`` that are linked with i.
    """
    out, left = [], np.arange(n)
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = linked(i, left)
            if len(hit):
                left = np.setdiff1d(left, hit, assume_unique=True)
                out += [(i, j) for j in hit.tolist()]
                todo += hit.tolist()
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Whole groups of rows that agree in the first ``keys`` columns (rows come sorted by them), small groups together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for whole in batches:
        for k in range(0, whole.num_rows, most):
            b = whole.slice(k, most)
            held.append(b)
            rows += b.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held)
            last = np.ones(rows, bool)
            for c in range(keys):
                x = table.column(c).to_numpy()
                last &= x == x[-1]
            cut = int(np.argmax(last))
            if cut:
                yield table.slice(0, cut).to_batches()
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield held


def groups_of(parts: list[pa.RecordBatch], keys: int) -> tuple[pa.Table, list[tuple[int, int]]]:
    table = pa.Table.from_batches(parts)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in range(keys):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new).tolist()
    return table, list(zip(starts, [*starts[1:], table.num_rows]))


def signature_links(members: DataFrame, radius: int) -> DataFrame:
    """Spanning links (u, v) of the groups (home, i, j) of (rep, sig) by signature distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, 3, BUCKET):
            table, groups = groups_of(part, 3)
            reps = table.column(3).to_numpy()
            sigs = codes(table.column(4))
            found = []
            for lo, hi in groups:
                s = sigs[lo:hi]
                found += [(lo + a, lo + b) for a, b in spanning(
                    hi - lo, lambda i, left: left[(s[left] != s[i]).sum(axis=1) <= radius])]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(reps[at[:, 0]]), pa.array(reps[at[:, 1]])], names=["u", "v"])
    rows = members.select("home", "i", "j", "rep", "sig")
    return rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "rep").mapInArrow(run, "u long, v long")


def dealt(rows: DataFrame, group: str, strange: Column, weight: Column) -> DataFrame:
    """``rows`` with chunk pairs (i, j) of their group: each pair of chunks of which one holds rows where ``strange``.

    A chunk has about ``BUCKET`` rows and ``SHINGLES`` of ``weight`` at most.
    """
    rows = rows.withColumn("strange", strange).withColumn("weight", weight)

    def chunks(which: Column) -> Column:
        n = F.ceil(F.count(F.when(which, 1)) / BUCKET)
        w = F.ceil(F.coalesce(F.sum(F.when(which, F.col("weight"))), F.lit(0)) / SHINGLES)
        return F.greatest(n, w).cast("int")
    sizes = rows.groupBy(group).agg(chunks(F.col("strange")).alias("cs"), chunks(~F.col("strange")).alias("cr"))
    own = F.when(F.col("strange"), F.pmod(F.xxhash64("rep", F.lit(11)), F.col("cs"))).otherwise(
        F.col("cs") + F.pmod(F.xxhash64("rep", F.lit(11)), F.col("cr"))).cast("int")
    last = F.when(F.col("strange"), F.col("cs") + F.col("cr")).otherwise(F.col("cs")) - 1
    return (rows.join(sizes.filter("cs > 0"), group).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))


def near_links(reps: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect all representatives (rep, sig) within ``radius`` codes."""
    shared = written(bands(reps, radius).groupBy("key").agg(
        F.min("rep").alias("center"), F.max("rep").alias("top"), F.count("*").alias("n")).filter("center < top").drop("top"), "shared")
    # most keys have one member: those stay where they are
    sent = reps.sparkSession.sparkContext.broadcast(bitmap_of(shared, "key", shared.count()))
    members = written(bands(reps, radius, sent).join(shared, "key"), "members")
    sig = reps.select("rep", "sig")
    pairs = members.filter("rep > center").select(F.col("center").alias("u"), F.col("rep").alias("v")).distinct()
    first = written(within(pairs.join(sig.toDF("u", "a"), "u").join(sig.toDF("v", "b"), "v"), radius), "links")
    # members with one label are linked with the same centre, so they are connected
    label = first.groupBy(F.col("v").alias("rep")).agg(F.min("u").alias("label"))
    named = written(members.filter("n > 2").join(label, "rep", "left")
                    .select("key", "rep", F.coalesce("label", "rep").alias("label")), "named")
    open_keys = (named.groupBy("key").agg(F.min(F.struct("rep", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .filter("lo < hi").select("key", F.col("c.label").alias("home")))
    # strangers meet the members of a centre's class once, however many keys they share with them
    rest = written(named.join(open_keys, "key").select("home", "rep", (F.col("label") != F.col("home")).alias("apart")).distinct(), "open")
    rest = dealt(rest, "home", F.col("apart"), F.lit(0)).select("home", "i", "j", "rep")
    return first.unionByName(signature_links(rest.join(sig, "rep"), radius))


# ------------------------------------------------------------- full sets

def links_of_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of sets with 100 * intersection >= percent * union, by an inverted index of the group."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (int(size.sum()) - both) else []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    edge = np.concatenate(([0], np.cumsum(size)))

    def linked(i: int, left: np.ndarray) -> np.ndarray:
        mine = ids[edge[i]:edge[i + 1]]
        n = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))[left]
        return left[100 * both >= percent * (size[i] + size[left] - both)]
    return spanning(len(sets), linked)


def confirmed(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Confirmed links (u, v) of the groups (class, i, j) of (rep, text), and (u, null) for members that they
    do not connect with the class's smallest one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, 3, 256):
            table, groups = groups_of(part, 3)
            first, reps = table.column(0).to_numpy(), table.column(3).to_numpy()
            texts = table.column(4)
            u, v = [], []
            for lo, hi in groups:
                sets = [shingle_set(texts[k].as_py(), shingle) for k in range(lo, hi)]
                reached = {lo} if reps[lo] == first[lo] else set()  # rows come by rep: the smallest member is first
                for a, b in links_of_sets(sets, percent) if hi - lo > 1 else ():
                    u.append(reps[lo + a])
                    v.append(reps[lo + b])
                    if lo + a in reached:
                        reached.add(lo + b)
                apart = [reps[k] for k in range(lo, hi) if k not in reached]
                u += apart
                v += [None] * len(apart)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    rows = rows.select("class", "i", "j", "rep", "text")
    return rows.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j", "rep").mapInArrow(run, "u long, v long")


def set_links(docs: DataFrame, reps: DataFrame, near: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (u, v) confirmed on full sets that connect what is linked within the classes of ``near``."""
    classes = components(near).select(F.col("node").alias("rep"), F.col("root").alias("class"))
    classes = classes.unionByName(classes.select(F.col("class").alias("rep"), "class").distinct())
    members = reps.select("rep", "tk", "n").join(classes, "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_key().alias("tk"), "text")
    # a class's members hold their text; rows that repeat both id and text count once
    members = written(texts.join(members, ["rep", "tk"]).groupBy("rep", "tk", "class", "n").agg(F.first("text").alias("text")),
                      "class-texts")
    sizes = members.groupBy("class").agg(
        F.greatest(F.ceil(F.count("*") / BUCKET), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("chunks"))
    placed = members.join(sizes, "class")
    # chunks of a class, each with the class's smallest member
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int")
    where = F.when(F.col("rep") == F.col("class"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    inner = placed.withColumn("i", F.explode(where)).withColumn("j", F.lit(0))
    first = written(confirmed(inner, percent, shingle), "links")
    links = first.filter("v IS NOT NULL")
    large = placed.filter("chunks > 1").drop("chunks")
    if large.isEmpty():
        return links
    apart = first.filter("v IS NULL").select(F.col("u").alias("rep"), F.lit(True).alias("apart")).distinct()
    named = large.join(apart, "rep", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    rest = confirmed(dealt(named, "class", F.col("apart"), F.col("n")), percent, shingle)
    return links.unionByName(rest.filter("v IS NOT NULL"))


def minhash_groups(docs: DataFrame, percent: int = 85, shingle: int = 3) -> DataFrame:
    """(doc_id, tk, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets; component_id is the smallest doc_id reachable, itself
    included.  Texts without words have an empty set and no links.  A null
    doc_id takes no part in links and gets a null component_id.  Repeated rows
    are kept; rows that share a doc_id share its links where that id is the
    smallest of their sets.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is 51 to 100")
    r = radius(percent)
    rows = written(sketches(docs, shingle), "sketches")
    reps = written(rows.filter("doc_id IS NOT NULL AND set IS NOT NULL").groupBy("set").agg(
        F.min(F.struct("doc_id", "tk")).alias("m"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.count("*").alias("rows")).select("set", F.col("m.doc_id").alias("rep"), F.col("m.tk").alias("tk"), "n", "sig", "rows"),
        "representatives")
    near = written(near_links(reps, r), "near")
    comp = components(set_links(docs, reps, near, percent, shingle))
    named = reps.select("set", "rep", "rows").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set", F.coalesce("root", "rep").alias("component_id"), "rows")
    rows = rows.select("doc_id", "tk", F.col("n").alias("n_shingles"), "set")
    out = join_unique(rows.filter("set IS NOT NULL"), named, "set", "rows", rows.count())
    empty = rows.filter("set IS NULL").withColumn("component_id", F.col("doc_id"))
    return out.unionByName(empty).select(
        "doc_id", "tk", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
