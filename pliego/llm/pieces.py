"""SentencePiece encoding and decoding as a relational lattice.

Encoding of a set of words: every substring of bounded length that may be a piece
is exploded and joined to the piece table (broadcast; it is as large as the
vocabulary), edges are grouped by word, and Viterbi is folded over those of many
words at once in Arrow batches: the segmentation with the highest sum of piece
scores.  Characters without a piece fall back to bytes.

Texts are encoded through their distinct words.  A word here is a unit that no
piece crosses: white-space marks with the run of Latin letters, or of other
characters, behind them.  Units that a bounded sample shows to be frequent are
solved first and broadcast (at most ``FREQUENT``); the other units of all
documents go through the lattice once each and return to their documents by a
shuffle.  Documents travel as unit numbers, about two bytes a word.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import slices, without, written
from .spans import BASES, hashes, prefix_sums

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = re.compile(rf"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}]+)|{MARK}+")
#: Units that are solved before and broadcast, at most (about 20 bytes each).
FREQUENT = 1 << 19
#: Documents in which the frequent units are counted, about.
SAMPLE_DOCS = 50_000
#: Words that one task of the lattice solves, about; and how many more tasks than shuffle
#: partitions solve the rare ones.  Small tasks keep the sort of their edges small.
WORDS_AT_ONCE, RARE_TASKS = 1 << 14, 4
#: Characters of text that a task works on at once.
PART_CHARS = 1 << 18
#: Below the lowest piece score: what a character without a piece costs.
UNKNOWN_PENALTY = 10.0
#: Words whose edges Viterbi is folded over at once.
FOLDED = 1 << 12
#: Bytes of packed unit numbers that are put together at once, about.
PART_CODES = 1 << 16
#: Offset that keeps packed ids positive: a character without a piece is -1 minus its code point.
SHIFT = 1 << 21


@dataclass
class Vocabulary:
    """Pieces in id order, their scores, the ids that encoding uses, and the byte pieces."""
    pieces: list[str]
    scores: list[float]
    normal: list[int]
    byte_ids: list[int]

    @classmethod
    def read(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        crossing = [pieces[i] for i in normal if UNIT.findall(pieces[i]) != [pieces[i]]]
        if crossing:
            raise ValueError(f"pieces cross the bounds of units: {crossing[:5]}")
        return cls(pieces, [m.get_score(i) for i in ids], normal, byte_ids)

    @cached_property
    def longest(self) -> int:
        return max(len(self.pieces[i]) for i in self.winning)

    @cached_property
    def unknown_score(self) -> float:
        return min(self.scores[i] for i in self.normal) - UNKNOWN_PENALTY

    @cached_property
    def edge_scores(self) -> np.ndarray:
        """Scores by id; the last one is that of a character without a piece."""
        return np.array([*self.scores, self.unknown_score])

    @cached_property
    def winning(self) -> list[int]:
        """The normal ids less those that their own parts outscore: these are in no best segmentation."""
        score = {self.pieces[i]: self.scores[i] for i in self.normal}

        def in_parts(piece: str) -> float:
            best = [0.0] + [float("-inf")] * len(piece)
            for end in range(1, len(best)):
                for start in range(end == len(piece), end):
                    if (s := score.get(piece[start:end])) is not None:
                        best[end] = max(best[end], best[start] + s)
            return best[-1]
        return [i for i in self.normal if in_parts(self.pieces[i]) <= self.scores[i]]

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, id, key): the pieces that win; a join on a long is faster than one on strings."""
        rows = [(self.pieces[i], i) for i in self.winning]
        return spark.createDataFrame(rows, "name string, id int").withColumn("key", F.xxhash64("name"))

    def spelled(self, ids: list[int]) -> list[int]:
        """Ids with a negative one (a character without a piece) as its bytes."""
        if min(ids, default=0) >= 0:
            return ids
        return [x for i in ids for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])]

    @cached_property
    def octets(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces in a row, and where each id's start (one more at the end)."""
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        usable = set(self.normal)
        parts = [of_byte.get(i, p.replace(MARK, " ").encode() if i in usable else b"") for i, p in enumerate(self.pieces)]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids, without the mark in front."""
        flat, start = self.octets
        raw = ragged(flat, start, ids)[0].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def units(text: str | None) -> list[str]:
    """A text as units: spaces become marks, one mark goes in front.  Empty text: none."""
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def ragged(flat: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start[i]:start[i + 1]]`` for i in ``at``, one behind the other, and their lengths."""
    first = start[at]
    size = start[at + 1] - first
    before = np.cumsum(size) - size
    kind = np.int32 if len(flat) < 1 << 31 and (not len(size) or before[-1] + size[-1] < 1 << 31) else np.int64
    index = np.repeat((first - before).astype(kind), size)
    index += np.arange(len(index), dtype=kind)
    return flat[index], size


# ---------------------------------------------------------------- lattice

def word_key():
    """Two columns that stand for a word: 128 bits sort and group faster than strings."""
    return [F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(1), "word").alias("h2")]


#: Buckets of the tables of lengths.
BUCKETS = 1 << 16


def possible_lengths(vocabulary: Vocabulary):
    """Column: lengths (as bits) that a piece ending at ``last`` in ``word`` may have, by its last two or four characters.

    Most substrings are no pieces; these need not be cut out and looked up.
    Endings share buckets, so a length too many is possible, one too few is not.
    """
    tables = {2: np.zeros(BUCKETS, np.int64), 4: np.zeros(BUCKETS, np.int64)}
    for i in vocabulary.winning:
        piece = vocabulary.pieces[i]
        tail = 4 if len(piece) >= 4 else 2
        if len(piece) > 1:
            tables[tail][crc32(piece[-tail:].encode("utf-8", "surrogatepass")) % BUCKETS] |= 1 << len(piece)

    def looked_up(tail: int):
        table = F.split(F.lit(",".join(map(str, tables[tail].tolist()))), ",").cast("array<bigint>")
        bucket = F.crc32(F.expr(f"substring(word, last - {tail - 1}, {tail})").cast("binary")).bitwiseAND(F.lit(BUCKETS - 1))
        return F.when(F.col("last") >= tail, F.get(table, bucket.cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return looked_up(2).bitwiseOR(looked_up(4))


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, carried, ids) for distinct non-empty words (h1, h2, word, carried): the segmentation of the highest score.

    Of equal scores the one whose last differing piece is longest wins.  A
    character without a piece has -1 minus its code point as id; ``ids`` has
    three bytes for each.  ``word`` and ``carried`` ride along on the edge of the
    first character, and ``words`` is partitioned by its key, so nothing is
    shuffled here.

    An edge is packed as where it ends, its length, and its id.  Pieces are
    joined by a hash, which is faster than by strings, and then compared.
    """
    longest = vocabulary.longest
    if longest > 31:
        raise ValueError("pieces of over 31 characters")
    ends = words.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("last"))
    ends = ends.withColumn("lengths", possible_lengths(vocabulary))
    first = (F.col("last") == 1) & (F.col("size") == 1)
    parts = (ends.select("*", F.explode(F.sequence(F.lit(1), F.least("last", F.lit(longest)))).alias("size"))
             .filter((F.col("size") == 1) | (F.expr("shiftright(lengths, size)").bitwiseAND(F.lit(1)) == 1))
             .select("h1", "h2", F.when(first, F.col("word")).alias("word"), F.when(first, F.col("carried")).alias("carried"),
                     "last", "size", F.expr("substring(word, last - size + 1, size)").alias("piece"))
             .withColumn("key", F.xxhash64("piece")))
    number = F.coalesce(F.when(F.col("name") == F.col("piece"), F.col("id")), F.when(F.col("size") == 1, -1 - F.ascii("piece"))) + SHIFT
    step = F.shiftleft(F.col("last").cast("long"), 29) + F.shiftleft(F.col("size").cast("long"), 24) + number
    edges = (parts.join(F.broadcast(vocabulary.table(words.sparkSession)), "key", "left")
             .select("h1", "h2", "word", "carried", step.alias("edge")).filter("edge IS NOT NULL"))
    grouped = edges.groupBy("h1", "h2").agg(F.first("word", ignorenulls=True).alias("word"), F.first("carried", ignorenulls=True).alias("carried"),
                                            F.collect_list("edge").alias("edges"))
    scores = vocabulary.edge_scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, FOLDED):
            edges = b.column(2)
            size = pa.compute.list_value_length(edges).to_numpy()
            edge = in_order(edges.flatten().to_numpy(), size)
            found, sizes = best_paths(edge >> 29, edge >> 24 & 31, (edge & 0xFFFFFF) - SHIFT, np.cumsum(size) - size, scores)
            offsets = np.cumsum([0, *3 * sizes]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(three_bytes(found))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], names=["word", "carried", "ids"])
    out = T.StructType([words.schema["word"], words.schema["carried"], T.StructField("ids", T.BinaryType())])
    return grouped.select("word", "carried", "edges").mapInArrow(run, out)


def in_order(edge: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edges of words one behind the other, ``size`` of each, sorted within their word."""
    word = np.repeat(np.arange(len(size)), size)
    if (np.diff(edge)[np.diff(word) == 0] > 0).all():
        return edge
    return edge[np.lexsort((edge, word))]


def best_paths(last: np.ndarray, size: np.ndarray, ids: np.ndarray, first: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best segmentation of each word, one behind the other, and how many each has.

    Edges are those of one word after another from ``first`` on, by their end
    and then their length; all ends of one distance are settled at once.
    """
    behind = np.append(first[1:], len(last))
    length = last[behind - 1]
    base = np.cumsum(length + 1) - (length + 1)
    end = np.repeat(base, behind - first) + last  # places of all words in a row, one more than its characters for each
    start = end - size
    score = scores[np.maximum(ids, -1)]
    order = np.argsort(last, kind="stable")
    best, came = np.zeros(int(length.sum()) + len(length)), np.zeros(int(length.sum()) + len(length), np.int64)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(last))))
    for p in range(1, len(bounds) - 1):
        here = order[bounds[p]:bounds[p + 1]]
        to = end[here]
        sums = best[start[here]] + score[here]
        head = np.flatnonzero(np.diff(to, prepend=-1))
        top = np.maximum.reduceat(sums, head)
        best[to[head]] = top
        equal = np.flatnonzero(sums == np.repeat(top, np.diff(head, append=len(to))))
        final = np.append(to[equal[1:]] != to[equal[:-1]], True)  # the longest of equal ones
        came[to[equal[final]]] = here[equal[final]]
    steps, word, at = [], np.arange(len(first)), base + length
    while len(word):
        edge = came[at]
        steps.append((word, ids[edge]))
        at = start[edge]
        go = at > base[word]
        word, at = word[go], at[go]
    sizes = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(first))
    out, place = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes)
    for w, x in steps:
        place[w] -= 1
        out[place[w]] = x
    return out, sizes


def three_bytes(ids: np.ndarray) -> bytes:
    return ids.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def of_three_bytes(raw: np.ndarray) -> np.ndarray:
    raw = raw.reshape(-1, 3).astype(np.int32)
    return ((raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]) ^ 0x800000) - 0x800000


def octets_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls in a row, and where each row's start (one more at the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


# ------------------------------------------------------- documents as units

class Frequent:
    """Units that are known in advance, most frequent first: their hashes and ids in arrays.

    A unit is found by the leading bits of its hash; the rest of its 128 bits
    is compared.
    """

    def __init__(self, words: pa.StringArray, ids: pa.BinaryArray, vocabulary: Vocabulary):
        self.count = len(words)
        flat, offsets = octets_of(ids)
        self.ids, sizes = spelled(of_three_bytes(flat), vocabulary)
        self.start = np.concatenate(([0], np.cumsum(sizes)))[offsets // 3].astype(np.int32)
        self.octets = None
        found = [word_hashes(words.slice(k, WORDS_AT_ONCE).to_pylist()) for k in range(0, self.count, WORDS_AT_ONCE)]
        h1, h2 = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2, self.number = h1[order], h2[order], order.astype(np.int32)
        self.__setstate__(self.__getstate__())

    def __getstate__(self) -> dict:
        """What is broadcast: ids and lengths in few bytes, and nothing that follows from the rest."""
        small = np.uint16 if self.ids.max(initial=0) < 1 << 16 else np.int32
        sizes = np.diff(self.start)
        return {"count": self.count, "ids": self.ids.astype(small), "sizes": sizes.astype(np.uint8 if sizes.max(initial=0) < 256 else np.int32),
                "h1": self.h1, "h2": self.h2, "number": self.number}

    def __setstate__(self, state: dict) -> None:
        self.count, self.h1, self.h2, self.number = (state[k] for k in ("count", "h1", "h2", "number"))
        self.ids = state["ids"].astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(state["sizes"], dtype=np.int64))).astype(np.int32)
        self.lead = max(1, self.count.bit_length())
        self.bucket = np.searchsorted(self.h1 >> np.uint64(64 - self.lead), np.arange((1 << self.lead) + 1, dtype=np.uint64)).astype(np.int32)
        self.octets = None

    def text(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """The decoded bytes of all units, and where each unit's start; made once per worker."""
        if self.octets is None:
            flat, sizes = ragged(*vocabulary.octets, self.ids)
            self.octets = flat, np.concatenate(([0], np.cumsum(sizes)))[self.start].astype(np.int32)
        return self.octets

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 if it is not among these."""
        out = np.full(len(h1), -1, np.int64)
        lead = (h1 >> np.uint64(64 - self.lead)).astype(np.int64)
        at, end = self.bucket[lead].astype(np.int64), self.bucket[lead + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = (self.h1[here] == h1[todo]) & (self.h2[here] == h2[todo])
            out[todo[hit]] = self.number[here[hit]]
            at[todo] += 1
            todo = todo[~hit]
            todo = todo[at[todo] < end[todo]]
        return out


def spelled(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with each negative one (a character without a piece) as its bytes; and how many each became."""
    kinds, at = np.unique(ids, return_inverse=True)
    lists = [vocabulary.spelled([int(i)]) for i in kinds]
    flat = np.array([i for x in lists for i in x], np.int32)
    return ragged(flat, np.cumsum([0, *map(len, lists)]), at)


def unit_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = points.astype(np.uint64) + np.uint64(1)
    return tuple(hashes(prefix_sums(values, b), b, start, end) for b in BASES)


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([0, *map(len, words)])
    return unit_hashes(points, end[:-1], end[1:])


#: Sort of a code point: 1 Latin letter, 2 the mark, 0 all else.
SORTS = np.zeros(0x2582, np.int8)
SORTS[[n for n in range(0x250) if re.match(f"[{LATIN}]", chr(n))]] = 1
SORTS[ord(MARK)] = 2


def split_units(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty texts with marks, one behind the other; code points, and the starts of units and of texts."""
    joined = "".join([MARK + t for t in texts]).replace(" ", MARK)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    sort = SORTS[np.minimum(points, 0x2581)]
    sort[points > 0x2581] = 0
    new = np.ones(len(points), bool)
    # a mark opens a unit unless a mark is before it; so does a change of sort behind another character
    new[1:] = (sort[1:] != sort[:-1]) & (sort[:-1] != 2)
    new[first] = True
    return joined, points, np.flatnonzero(new), first


def packed(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative numbers below 2^28, seven bits a byte, low bits first; and how many bytes each takes."""
    more = [numbers >> 7 * k > 0 for k in range(1, 5)]
    lanes = np.stack([(numbers >> 7 * k & 127) | (more[k] << 7) for k in range(4)], axis=1).astype(np.uint8)
    used = np.stack([np.ones(len(numbers), bool), *more[:3]], axis=1)
    return lanes[used].tobytes(), used.sum(axis=1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127) << 7 * place, first)


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            found: dict[str, int] = {}
            for t in b.column(0).slice(k, 512).to_pylist():
                for u in units(t):
                    found[u] = found.get(u, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def frequent_units(docs: DataFrame, vocabulary: Vocabulary, most: int, sample_docs: int) -> Frequent:
    """At most ``most`` units of a sample of documents, solved by the lattice.

    Which units these are decides what is shuffled, never what comes out.
    """
    total = docs.count()
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, sample_docs / max(1, total)))
    counts = written(docs.filter(share).select("text").mapInArrow(count_units, "word string, n long")
                     .groupBy("word").agg(F.sum("n").alias("n")), "unit-counts")
    room, least = most, None
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if words > room:
            break
        room, least = room - words, n
    if least is None:
        return Frequent(pa.array([], pa.string()), pa.array([], pa.binary()), vocabulary)
    chosen = counts.filter(F.col("n") >= least)
    tasks = max(1, (most - room) // WORDS_AT_ONCE)
    solved = lattice(chosen.select(*word_key(), "word", F.col("n").alias("carried")).repartition(tasks, "h1", "h2"), vocabulary)
    rows = written(solved, "frequent-units").toArrow().combine_chunks()
    rows = rows.take(pa.compute.sort_indices(rows, [("carried", "descending"), ("word", "ascending")]))
    return Frequent(*[rows.column(c).combine_chunks() for c in ("word", "ids")], vocabulary)


def numbered(texts: list[str | None], known: Frequent, pack: bool = True) -> list[tuple[bytes, list[str]]]:
    """Per text its packed unit numbers, if asked for, and its rare units: their numbers go on behind the frequent ones."""
    out: list[tuple[bytes, list[str]]] = [(b"", [])] * len(texts)
    full = [n for n, t in enumerate(texts) if t]
    if not full:
        return out
    joined, points, start, first = split_units([texts[n] for n in full])
    end = np.append(start[1:], len(points))
    number = known.find(*unit_hashes(points, start, end))
    text = np.searchsorted(first, start, "right") - 1
    rares: list[dict[str, int]] = [{} for _ in full]
    at = np.flatnonzero(number < 0)
    number[at] = [rares[t].setdefault(joined[a:b], known.count + len(rares[t]))
                  for t, a, b in zip(text[at].tolist(), start[at].tolist(), end[at].tolist())]
    if not pack:
        for k, n in enumerate(full):
            out[n] = (b"", list(rares[k]))
        return out
    data, sizes = packed(number)
    cut = np.concatenate(([0], np.cumsum(sizes)))[np.append(np.searchsorted(text, np.arange(len(full))), len(number))].tolist()
    for k, n in enumerate(full):
        out[n] = (data[cut[k]:cut[k + 1]], list(rares[k]))
    return out


def parts(lengths: list[int], most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` characters together."""
    start, total = 0, 0
    for n, size in enumerate(lengths):
        if total and total + size > most:
            yield start, n
            start, total = n, 0
        total += size
    if start < len(lengths):
        yield start, len(lengths)


def as_units(docs: DataFrame, frequent, rare: bool) -> DataFrame:
    """Documents as units: (doc_id, th, tk, codes), their packed unit numbers, or (doc_id, th, tk, rare),
    their units that aren't frequent.

    Number n below the count of frequent units is a frequent unit, another the
    document's rare unit of the rest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                group = b.slice(lo, 512)
                texts = group.column(3).to_pylist()
                for k, m in parts([len(t or "") for t in texts]):
                    rows = numbered(texts[k:m], frequent.value, not rare)
                    part = group.slice(k, m - k)
                    last = pa.array([r for _, r in rows], pa.list_(pa.string())) if rare else pa.array([pack.compress(c) for c, _ in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], last], names=["doc_id", "th", "tk", "rare" if rare else "codes"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), F.xxhash64("text").alias("tk"), "text")
    return rows.mapInArrow(run, "doc_id long, th int, tk long, " + ("rare array<string>" if rare else "codes binary"))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, frequent: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every row of ``docs`` (doc_id, text).

    round_trip: the decoded ids equal the text.  Null and empty texts have no
    ids and make the round trip; repeated rows give repeated results; a null
    doc_id is kept.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or Vocabulary.read()
    docs = docs.select("doc_id", "text")
    known = spark.sparkContext.broadcast(frequent_units(docs, vocabulary, frequent, sample_docs))
    rare = as_units(docs, known, rare=True).select("doc_id", "th", F.posexplode("rare").alias("place", "word"))
    tasks = RARE_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = (rare.repartition(tasks, F.xxhash64("word")).select("*", *word_key()).groupBy("h1", "h2")
             .agg(F.first("word").alias("word"), F.collect_list(F.struct("doc_id", "th", "place")).alias("carried")))
    back = (lattice(words, vocabulary).select(F.inline("carried"), "ids")
            .repartition("doc_id", "th")  # flat rows are smaller than lists that are put together before the shuffle
            .groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "ids")).alias("solved"))
            .select(F.col("doc_id").alias("in_doc"), F.col("th").alias("in_th"), "solved"))
    joined = as_units(docs, known, rare=False).join(back, F.col("doc_id").eqNullSafe(F.col("in_doc")) & F.col("th").eqNullSafe(F.col("in_th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, unpack = known.value, zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                group = b.slice(lo, 512)
                codes = [unpack.decompress(c) for c in group.column(2).to_pylist()]
                for k, m in parts([len(c) for c in codes], PART_CODES):
                    part = group.slice(k, m - k)
                    ids, at, text, text_at = solved_texts(codes[k:m], base, part.column(3), vocabulary)
                    sizes, ends = np.diff(at), text_at.tolist()
                    same = [xxh64_intdigest(text[i:j], 42) == tk & (1 << 64) - 1 or not n and tk == 42  # 42: a null text
                            for i, j, n, tk in zip(ends, ends[1:], sizes.tolist(), part.column(1).to_pylist())]
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
                                                     names=["doc_id", "ids", "n_tokens", "round_trip"])
    return joined.select("doc_id", "tk", "codes", "solved").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def solved_texts(codes: list[bytes], base: Frequent, solved: pa.ListArray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """The ids of documents, one behind the other, and where each one's start; the same for what they decode to.

    ``solved`` holds a document's rare units as (place, ids); null: it has none.
    """
    numbers = unpacked(b"".join(codes))
    ends = np.cumsum([0, *map(len, codes)])
    last = np.flatnonzero(np.frombuffer(b"".join(codes), np.uint8) < 128)
    unit_at = np.searchsorted(last, ends)  # first unit of each document
    doc = np.repeat(np.arange(len(codes)), np.diff(unit_at))
    rare = numbers >= base.count
    ids, octets, sizes, octet_sizes = known_and_own(numbers, rare, doc, base, solved, vocabulary)
    at, octet_at = (np.concatenate(([0], np.cumsum(x)))[unit_at] for x in (sizes, octet_sizes))
    # the mark in front of a text is no part of it
    lead = np.flatnonzero(octets[octet_at[:-1][octet_at[1:] > octet_at[:-1]]] == 32)
    full = np.flatnonzero(octet_at[1:] > octet_at[:-1])[lead]
    keep = np.ones(len(octets), bool)
    keep[octet_at[full]] = False
    less = np.zeros(len(codes) + 1, np.int64)
    less[full + 1] = 1
    return ids, at, octets[keep].tobytes(), octet_at - np.cumsum(less)


def known_and_own(numbers: np.ndarray, rare: np.ndarray, doc: np.ndarray, base: Frequent, solved: pa.ListArray,
                  vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and decoded bytes of all units in a row, and how many of each a unit has; the rare units of document ``doc`` are its own."""
    if not rare.any():
        (ids, sizes), (octets, octet_sizes) = ragged(base.ids, base.start, numbers), ragged(*base.text(vocabulary), numbers)
        return ids, octets, sizes, octet_sizes
    rows = solved.flatten()
    of = np.repeat(np.arange(len(solved)), pa.compute.fill_null(pa.compute.list_value_length(solved), 0).to_numpy())
    place, found = rows.flatten()
    place = place.to_numpy()
    flat, offsets = octets_of(found)
    flat, offsets = of_three_bytes(flat), offsets // 3
    if (flat < 0).any():
        flat, spelled_sizes = spelled(flat, vocabulary)
        offsets = np.concatenate(([0], np.cumsum(spelled_sizes)))[offsets]
    room = np.zeros(len(solved), np.int64)
    np.maximum.at(room, of, place + 1)
    first = np.cumsum(room) - room
    slot = np.zeros(int(room.sum()), np.int64)
    slot[first[of] + place] = np.arange(len(place))  # a repeated row holds the same again
    mine, where = np.zeros(len(numbers), np.int64), np.where(rare, 0, numbers)
    mine[rare] = slot[first[doc[rare]] + numbers[rare] - base.count]
    octets, octet_sizes = ragged(*vocabulary.octets, flat)
    octet_offsets = np.concatenate(([0], np.cumsum(octet_sizes)))[offsets]
    (ids, sizes), (text, text_sizes) = merged(rare, (flat, offsets, mine), (base.ids, base.start, where)), \
        merged(rare, (octets, octet_offsets, mine), (*base.text(vocabulary), where))
    return ids, text, sizes, text_sizes


def merged(second: np.ndarray, one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``one`` (flat, start, which) where ``second`` is set, else of ``other``, in order; and their lengths."""
    (flat_a, start_a, at_a), (flat_b, start_b, at_b) = one, other
    if not len(flat_b):
        return ragged(flat_a, start_a, at_a)
    first = np.where(second, start_a[at_a] + len(flat_b), start_b[at_b])
    size = np.where(second, start_a[at_a + 1] + len(flat_b), start_b[at_b + 1]) - first
    at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    from_a = at >= len(flat_b)
    out = np.empty(len(at), flat_a.dtype)
    out[from_a], out[~from_a] = flat_a[at[from_a] - len(flat_b)], flat_b[at[~from_a]]
    return out, size


def decode(df: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of its ids; null ids give null, an input column of that name is replaced."""
    vocabulary = vocabulary or Vocabulary.read()
    base = without(df, "decoded")
    at, names = base.columns.index(ids_col), [*base.columns, "decoded"]

    def run(batches):
        for b in batches:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)
    return base.mapInArrow(run, base.withColumn("decoded", F.lit("")).schema)
