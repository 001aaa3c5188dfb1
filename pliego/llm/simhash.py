"""SimHash near-deduplication with bit-sliced comparison.

A document's fingerprint is the majority, bit by bit, of the XXH64 hashes of
its word shingles.  Fingerprints that differ in at most ``max_distance`` bits
are linked; the groups are the connected components of the links.

* Fingerprints: one pass over the texts in Arrow workers, 24 bytes kept per document.
* Candidates: the 64 bits are cut into ``max_distance + 2`` blocks; two linked
  fingerprints agree in at least two of them, so they meet under one key of
  two blocks.  Only distinct fingerprints take part, so exact copies cost nothing.
* Comparison: bit planes of a bucket are stored vertically (one bit of 64
  fingerprints per machine word).  Carry-save counters add up 64 distances per
  word operation, and words whose 64 distances all exceed the radius are
  abandoned.  Each bucket gives a spanning set of links, never all its pairs;
  a bucket over ``BUCKET`` fingerprints is compared in pairs of chunks.
* Components: large-star / small-star rounds on the links, each round written
  to the shared folder.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import join_unique, slices, text_key, written

SEED = 42
#: Shingle hashes that are counted at a time (64 bytes of work memory each).
AT_ONCE = 1 << 15
#: Fingerprints of a bucket, or of a chunk of a larger bucket, compared in one group.
BUCKET = 4096
#: Groups up to this size are compared many at a time, by neighbour offset.
SMALL = 48


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text; A-Z are lower-cased, words end at ASCII white space.

    Fewer words than a shingle: one shingle of all of them.  No words: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    total = np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        m = min(n, k + AT_ONCE)
        raw = b"".join([xxh64_digest(joined[s:e], SEED)
                        for s, e in zip(starts[k:m].tolist(), ends[k + shingle - 1:m + shingle - 1].tolist())])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text key, fingerprint) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [signed(fingerprint(t, shingle)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())],
                                             names=["doc_id", "tk", "fp"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return rows.mapInArrow(run, "doc_id long, tk long, fp long")


# ------------------------------------------------------------- bit planes

def to_planes(fps: np.ndarray) -> np.ndarray:
    """uint64[n] -> uint64[64, ceil(n / 64)]: word k of plane p holds bit p of fingerprints 64k..64k+63."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(diff, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes at distance ``radius`` or less, as packed words.

    ``diff(p, at)`` gives plane p of the differing bits for the words ``at``;
    ``alive`` marks the lanes that count.
    """
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    alive = alive[at]
    width = radius.bit_length()
    count = [np.zeros_like(alive) for _ in range(width)]
    over = np.zeros_like(alive)

    def add(x: np.ndarray, weight: int) -> None:
        for k in range(weight, width):
            count[k], x = count[k] ^ x, count[k] & x
        over[:] |= x

    p = 0
    while p < 64 and len(at):
        for _ in range(4):  # carry-save: three planes become a sum and a carry plane
            if p + 2 < 64:
                a, b, c = diff(p, at), diff(p + 1, at), diff(p + 2, at)
                ab = a ^ b
                add(ab ^ c, 0)
                add((a & b) | (ab & c), 1)
                p += 3
            elif p < 64:
                add(diff(p, at), 0)
                p += 1
        alive &= ~over
        keep = alive != 0
        if 2 * np.count_nonzero(keep) < len(keep):  # abandon words without a lane in reach
            at, alive, over = at[keep], alive[keep], over[keep]
            count = [c[keep] for c in count]
    # exact test: the counters hold 0 .. 2^width - 1
    more, same = over, np.full_like(alive, ~np.uint64(0))
    for k in reversed(range(width)):
        bit = radius >> k & 1
        if not bit:
            more = more | (same & count[k])
        same = same & (count[k] if bit else ~count[k])
    out[at] = alive & ~more
    return out


def lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def packed(mask: np.ndarray) -> np.ndarray:
    words = -(-len(mask) // 64)
    full = np.zeros(words * 64, bool)
    full[:len(mask)] = mask
    return np.packbits(full, bitorder="little").view(np.uint64)


def shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """Lane i of the result is lane i + by of ``plane``."""
    w, s = divmod(by, 64)
    out = np.zeros_like(plane)
    out[:len(plane) - w] = plane[w:]
    if s:
        up = np.zeros_like(plane)
        up[:len(plane) - w - 1] = plane[w + 1:]
        out = (out >> np.uint64(s)) | (up << np.uint64(64 - s))
    return out


def link_small(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions inside many small groups (``group`` ascending)."""
    planes, found_a, found_b = to_planes(fps), [], []
    by = 1
    while by < len(fps):
        same = np.zeros(len(fps), bool)
        same[:-by] = group[:-by] == group[by:]
        if not same.any():
            break
        moved = [None] * 64

        def diff(p, at):
            if moved[p] is None:
                moved[p] = planes[p] ^ shifted(planes[p], by)
            return moved[p][at]
        hit = lanes(near(diff, packed(same), radius))
        found_a.append(hit)
        found_b.append(hit + by)
        by += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def link_large(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one group: each fingerprint is compared once with those not reached yet."""
    planes, n = to_planes(fps), len(fps)
    full = ~np.uint64(0)
    left = packed(np.ones(n, bool))
    found_a, found_b = [], []
    for seed in range(n):
        if not left[seed >> 6] >> np.uint64(seed & 63) & np.uint64(1):
            continue
        left[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        todo = [seed]
        while todo and left.any():
            i = todo.pop()
            mine = int(fps[i])
            hit = near(lambda p, at: planes[p][at] ^ (full if mine >> p & 1 else np.uint64(0)), left, radius)
            left &= ~hit
            new = lanes(hit)
            found_a.append(np.full(len(new), i))
            found_b.append(new)
            todo += new.tolist()
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, fp, rep) sorted by group -> links (u, v) between representatives."""
    rest: tuple[np.ndarray, ...] | None = None

    def out(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, i, j, fp, rep = cols
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        fps = fp.view(np.uint64)
        a, b = [], []
        small = np.flatnonzero((size > 1) & (size <= SMALL))
        if len(small):
            x, y = link_small(fps[small], group[small], radius)
            a.append(small[x])
            b.append(small[y])
        for g in np.unique(group[size > SMALL]):
            lo, hi = np.searchsorted(group, [g, g + 1])
            x, y = link_large(fps[lo:hi], radius)
            a.append(lo + x)
            b.append(lo + y)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["u", "v"])

    for batch in batches:
        cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if rest is not None:
            cols = tuple(np.concatenate(x) for x in zip(rest, cols))
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = int(np.argmax(last))
        rest = tuple(x[cut:] for x in cols)
        if cut:
            yield from out(tuple(x[:cut] for x in cols))
    if rest is not None and len(rest[0]):
        yield from out(rest)


def band_keys(radius: int):
    """Array of keys of a fingerprint ``fp``: the number of a pair of blocks with the two blocks' bits."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def block(k: int):
        bits = edges[k + 1] - edges[k]
        return F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(*[F.xxhash64(F.lit(n), block(a), block(b)) for n, (a, b) in enumerate(combinations(range(blocks), 2))])


def links(reps: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect the representatives (fp, rep) of near fingerprints."""
    bands = reps.select("fp", "rep", F.explode(band_keys(radius)).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    members = (bands.join(shared, "key").withColumn("chunks", chunks).withColumn("own", own)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep"))
    return (members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp", "rep")
            .mapInArrow(lambda it: compare(it, radius), "u long, v long"))


# ------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating large-star and small-star steps; each round is written to the
    shared folder.  Ends when a round leaves the set of edges as it was.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = written(small, "small-star")
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if new == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def simhash_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, tk, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, itself included.
    Null or empty texts have fingerprint 0 and link like any other; a null
    doc_id takes no part in links and gets a null component_id; repeated rows
    are kept and share fingerprint and component.
    """
    if max_distance < 1 or max_distance > 6:
        raise ValueError("max_distance is 1 to 6")
    fps = written(fingerprints(docs, shingle), "fingerprints")
    reps = written(fps.filter("doc_id IS NOT NULL").groupBy("fp")
                   .agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "representatives")
    comp = components(links(reps.select("fp", "rep"), max_distance))
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id"), "rows")
    total = fps.count()
    return join_unique(fps, named, "fp", "rows", total).select(
        "doc_id", "tk", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id.

    Of rows with that same doc_id the one with the smallest text key stays;
    rows with a null doc_id all stay.  Columns are those of ``docs``.
    """
    groups = written(simhash_groups(docs, shingle, max_distance), "groups").filter("doc_id IS NOT NULL")
    best = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "tk")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("_pliego_id"), F.col("b.tk").alias("_pliego_tk"))
    marked = groups.groupBy("doc_id", "tk").agg(F.count("*").alias("copies"))
    marked = marked.join(best, (marked["doc_id"] == best["_pliego_id"]) & (marked["tk"] == best["_pliego_tk"]), "left")
    marked = written(marked.select(F.col("doc_id").alias("_pliego_id"), F.col("tk").alias("_pliego_tk"),
                                   F.col("_pliego_id").isNotNull().alias("_pliego_keep"), "copies"), "kept")
    drop = marked.filter(~F.col("_pliego_keep")).select("_pliego_id", "_pliego_tk")
    same = (F.col("doc_id").cast("long") == F.col("_pliego_id")) & (text_key() == F.col("_pliego_tk"))
    kept = docs.join(drop, same, "left_anti")
    again = marked.filter("_pliego_keep AND copies > 1").select("_pliego_id", "_pliego_tk")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_anti")
    twice = kept.join(again, same, "left_semi")
    return once.unionByName(twice.withColumn("_pliego_tk", text_key()).dropDuplicates(["doc_id", "_pliego_tk"]).drop("_pliego_tk"))
