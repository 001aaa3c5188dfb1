"""Exact substring dedup by recompression.

A word is removed if a window of ``WINDOW`` words of its document covers it
whose word sequence starts anywhere else as well.

Texts are compressed in rounds: runs of one symbol, and pairs of a left and a
right symbol, get a new name.  Names and sides are hashes of content, so they
are the same everywhere.  What a symbol is depends on the words in its reach
only; equal windows therefore see the same symbols in the same places.  Every
window picks as its anchor, of the symbols on the highest level whose reach it
covers, the one with the lowest hash: one anchor for a good dozen of words.

1. Anchors are counted by the content of their reach; shared ones reveal repeats.
   With each goes a hash of the whole stretch that its windows cover: anchors of
   equal stretches are verified at once, however many they are.
2. Anchors of equal reach but different stretches are at the ends of repeats.  Of
   each stretch one document hashes its windows, which are compared one by one.
3. Documents get the windows found, and drop the words under them.

Shuffled are anchors, the compressed texts (twice) and the windows at the ends
of repeats; never pairs of places, and no list grows with the number of copies.
Contents count as equal if two independent 64-bit hashes are.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, written
from .spans import BASES, hashes, mixed, prefix_sums

WINDOW = 35
#: Naming rounds; runs are named in the first of ``RUNS_EVERY``, because their bounds cost reach.
ROUNDS, RUNS_EVERY = 3, 3
#: Bytes of text that a task works on at once (a longer text stands alone).
PART_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts one behind the other: 64-bit hashes with a text's end between texts, and which are ends.

    Returns (symbols, words per text, position of each text's first word).
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = SPACE[raw]
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(first, bounds))
    names = hashes(prefix_sums(raw.astype(np.uint64) + np.uint64(1), BASES[0]), BASES[0], first, end)
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(first)) + text + 1  # an end mark before every text, one at the last
    out = mixed(np.arange(len(first) + len(texts) + 1, dtype=np.uint64) + np.uint64(1 << 40))
    out[at] = names
    start = np.concatenate(([0], np.cumsum(counts)))[:-1] + np.arange(len(texts)) + 1
    return out, counts, start


def named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mixed(mixed(a + np.uint64(salt)) * np.uint64(BASES[1]) + b)


class Level:
    """Symbols of one round: their names, first words, and reach (the words that fix them)."""

    def __init__(self, name: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.name, self.first, self.left, self.right = name, first, left, right

    def runs(self, salt: int) -> Level:
        """Runs of one symbol become one; to know where a run ends its neighbours must be known."""
        new = np.concatenate(([True], self.name[1:] != self.name[:-1]))
        at = np.flatnonzero(new)
        if len(at) == len(self.name):
            size = np.ones(len(at), np.int64)
        else:
            size = np.diff(np.append(at, len(self.name)))
        name = np.where(size > 1, named(self.name[at], size.astype(np.uint64), salt), self.name[at])
        last = at + size - 1
        left = self.left[np.maximum(at - 1, 0)]
        right = self.right[np.minimum(last + 1, len(self.name) - 1)]
        return Level(name, self.first[at], left, right)

    def pairs(self, salt: int) -> Level:
        """A left symbol and a right one behind it become one; sides are bits of the names' hashes."""
        is_left = mixed(self.name + np.uint64(salt)) >> np.uint64(63) == 0
        opens = np.zeros(len(self.name), bool)
        opens[:-1] = is_left[:-1] & ~is_left[1:]
        follows = np.concatenate(([False], opens[:-1]))
        at = np.flatnonzero(~follows)
        pair = opens[at]
        nxt = np.minimum(at + 1, len(self.name) - 1)
        name = np.where(pair, named(self.name[at], self.name[nxt], salt + 1), self.name[at])
        # a lone right symbol needs its left neighbour known, a lone left one its right neighbour
        left = np.where(is_left[at], self.left[at], self.left[np.maximum(at - 1, 0)])
        right = np.where(pair | is_left[at], self.right[nxt], self.right[at])
        return Level(name, self.first[at], left, right)


def levels(symbols: np.ndarray) -> list[Level]:
    n = len(symbols)
    at = np.arange(n)
    out = [Level(symbols, at, at, at + 1)]
    for r in range(ROUNDS):
        base = out[-1].runs(3 * r + 11) if r % RUNS_EVERY == 0 else out[-1]
        out.append(base.pairs(3 * r + 12))
    return out


def lowest(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where in lo..hi (both included) the lowest value stands, the leftmost of equal ones."""
    step = np.arange(len(value))
    tables, width = [step], 1
    while 2 * width <= int((hi - lo).max(initial=0)) + 1:
        a = tables[-1]
        b = a[np.minimum(np.arange(len(a)) + width, len(a) - 1)]
        tables.append(np.where(value[a] <= value[b], a, b))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k, t in enumerate(tables):
        own = np.flatnonzero(level == k)
        a, b = t[lo[own]], t[hi[own] - (1 << k) + 1]
        out[own] = np.where(value[a] <= value[b], a, b)
    return out


def anchors(symbols: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, left, right, key): the windows that start at words lo..hi share an anchor.

    All are positions in ``symbols``; left..right is the anchor's reach, and key
    hashes its name, its level and where in the reach it stands.
    """
    windows = np.maximum(counts - WINDOW + 1, 0)
    total = int(windows.sum())
    text = np.repeat(np.arange(len(counts)), windows)
    begin = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + start[text]
    level_of, symbol_of = np.zeros(total, np.int64), np.zeros(total, np.int64)
    todo = np.arange(total)
    table = levels(symbols) if total else []
    for n in reversed(range(len(table))):
        lv = table[n]
        lo = np.searchsorted(lv.left, begin[todo])
        hi = np.searchsorted(lv.right, begin[todo] + WINDOW, "right") - 1
        seen = lo <= hi
        got = todo[seen]
        level_of[got], symbol_of[got] = n, lowest(mixed(lv.name), lo[seen], hi[seen])
        todo = todo[~seen]
        if not len(todo):
            break
    new = np.ones(total, bool)
    new[1:] = (level_of[1:] != level_of[:-1]) | (symbol_of[1:] != symbol_of[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(new)
    lo, hi, lev, sym = begin[cut], begin[np.append(cut[1:], total)[:len(cut)] - 1], level_of[cut], symbol_of[cut]
    left, right, key = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64), np.zeros(len(cut), np.uint64)
    for n in np.unique(lev):
        own = np.flatnonzero(lev == n)
        lv = table[n]
        left[own], right[own] = lv.left[sym[own]], lv.right[sym[own]]
        key[own] = named(lv.name[sym[own]], (lv.first[sym[own]] - left[own]).astype(np.uint64), 101 + int(n))
    return text[cut], lo, hi, left, right, key


class Sums:
    """Hashes of word stretches."""

    def __init__(self, symbols: np.ndarray):
        self.of = [prefix_sums(symbols, b) for b in BASES]

    def one(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hashes(self.of[which], BASES[which], start, end)


ROWS = "h long, s long, doc_id long, th int, at long"
#: An anchor's place in one number: first window, how many windows, and the reach's start behind the first window.
COUNT_BITS, OFFSET_BITS = 6, 6


def place(lo: np.ndarray, hi: np.ndarray, left: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return ((lo - begin) << (COUNT_BITS + OFFSET_BITS)) | ((hi - lo) << OFFSET_BITS) | (left - lo)


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and reach start, counted from the document's first word."""
    lo = at >> (COUNT_BITS + OFFSET_BITS)
    return lo, lo + (at >> OFFSET_BITS & (1 << COUNT_BITS) - 1), lo + (at & (1 << OFFSET_BITS) - 1)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of about ``PART_BYTES`` of text."""
    for k in range(0, batch.num_rows, 1024):
        group = batch.slice(k, 1024)
        texts = [x or b"" for x in group.column(column).cast(pa.binary()).to_pylist()]
        start, size = 0, 0
        for n, t in enumerate(texts):
            if size and size + len(t) > PART_BYTES:
                yield group.slice(start, n - start), texts[start:n]
                start, size = n, 0
            size += len(t)
        yield group.slice(start), texts[start:]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> a row per anchor: reach hash, stretch hash, document and place."""
    for b in batches:
        for part, texts in parts(b, 2):
            symbols, counts, start = word_hashes(texts)
            text, lo, hi, left, right, key = anchors(symbols, counts, start)
            if not len(lo):
                continue
            sums = Sums(symbols)
            reach = mixed(sums.one(0, left, right) ^ key)
            shape = ((left - lo) << 6 | (hi - lo)).astype(np.uint64)
            whole = mixed(sums.one(1, lo, hi + WINDOW) + shape)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([signed(reach), signed(whole), part.column(0).take(rows), part.column(1).take(rows),
                                              pa.array(place(lo, hi, left, start[text]))], names=["h", "s", "doc_id", "th", "at"])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, list of (h, at), packed text) -> (h, w, doc_id, th, start): the windows of a document's open anchors."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for r in range(b.num_rows):
            ends = b.column(2)[r].values
            symbols, _, start = word_hashes([unpack.decompress(b.column(3)[r].as_py())])
            lo, hi, left = placed(ends.field("at").to_numpy(zero_copy_only=False))
            n = hi - lo + 1
            which = np.repeat(np.arange(len(lo)), n)
            first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            at = first + int(start[0])
            content = mixed(Sums(symbols).one(1, at, at + WINDOW) + (left[which] - first).astype(np.uint64))
            rows = pa.array(np.full(len(at), r))
            yield pa.RecordBatch.from_arrays([ends.field("h").take(pa.array(which)), signed(content), b.column(0).take(rows), b.column(1).take(rows),
                                              pa.array(first)], names=["h", "w", "doc_id", "th", "start"])


def kept_words(text: bytes, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[int, int, str, str]:
    """(words, words removed, digest of the kept ones, kept text); windows that start at lo..hi go."""
    words = text.split()
    keep = words
    if lo is not None:
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, hi + WINDOW, -1)
        keep = [w for w, depth in zip(words, np.cumsum(change[:-1]).tolist()) if not depth]
    out = b" ".join(keep)
    return len(words), len(words) - len(keep), hashlib.sha256(out).hexdigest(), out.decode("utf-8", "replace")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text as bytes): th tells texts of a repeated id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"))


def packed_texts(docs: DataFrame) -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                data = [pack.compress(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["doc_id", "th", "packed"])
    return keyed(docs).mapInArrow(run, "doc_id long, th int, packed binary")


def with_texts(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` joined to a list per document; the lists are the side that is hashed, texts are not sorted."""
    side = lists.select(F.col("doc_id").alias("in_doc"), F.col("th").alias("in_th"), "list").hint("shuffle_hash")
    return texts.join(side, F.col("doc_id").eqNullSafe(F.col("in_doc")) & F.col("th").eqNullSafe(F.col("in_th")), how)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at): places of anchors, or of single windows, all of whose windows are repeats."""
    found = keyed(docs).mapInArrow(anchor_rows, ROWS)
    names = written(found.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).filter("n > 1"), "shared-anchors")
    total = names.agg(F.sum("n")).first()[0] or 0
    named_ = names.select("h", (F.col("lo") != F.col("hi")).alias("several"), "n")
    shared = written(join_unique(found, named_, "h", "n", total).filter("several IS NOT NULL"), "shared")
    # one stretch: repeated as a whole; several: those that occur more than once are
    mixed_ = shared.filter("several").select(F.struct("h", "s").alias("hs"), "doc_id", "th", "at")
    kinds = written(mixed_.groupBy("hs").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("rep")), "stretches")
    again = join_unique(mixed_, kinds.select("hs", (F.col("n") > 1).alias("again"), "n"), "hs", "n", total).filter("again")
    whole = shared.filter("NOT several").select("doc_id", "th", "at").unionByName(again.select("doc_id", "th", "at"))
    # the ends of repeats: the windows of one occurrence of each stretch
    lists = (kinds.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(F.struct(F.col("hs.h").alias("h"), F.col("rep.at").alias("at"))).alias("list")))
    windows = with_texts(packed_texts(docs), lists, "inner").select("doc_id", "th", "list", "packed")
    windows = written(windows.mapInArrow(window_rows, "h long, w long, doc_id long, th int, start long")
                      .select(F.struct("h", "w").alias("hw"), "doc_id", "th", "start"), "end-windows")
    here = F.struct("doc_id", "th", "start")
    twice = (windows.groupBy("hw").agg(F.count("*").alias("n"), F.min(here).alias("lo"), F.max(here).alias("hi"))
             .filter("lo <> hi").select("hw", "n", F.lit(True).alias("twice")))
    single = join_unique(windows, written(twice, "repeated-windows"), "hw", "n", total).filter("twice")
    start = F.shiftleft("start", COUNT_BITS + OFFSET_BITS).alias("at")
    return whole.unionByName(single.select("doc_id", "th", start))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    kept is the text of the words that stay, joined by one space.  Null and
    empty texts have no words; repeated rows repeat each other; rows with a null
    doc_id count like others.
    """
    lists = written(marks(docs).groupBy("doc_id", "th").agg(F.collect_set("at").alias("list")), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for spans, data in zip(part.column(1), part.column(2).to_pylist()):
                    if spans.values is not None:
                        lo, hi, _ = placed(spans.values.to_numpy(zero_copy_only=False))
                        rows.append(kept_words(unpack.decompress(data), lo, hi))
                    else:
                        rows.append(kept_words(unpack.decompress(data), None, None))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return (with_texts(packed_texts(docs), lists, "left").select("doc_id", "list", "packed")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"))
