"""Phrase collocations: Misra-Gries summaries find what may be frequent, a second pass counts it exactly.

* First pass, one round for each phrase length.  Tasks count the 64-bit hashes of
  their n-grams; the counts are dealt out by hash, and each hash partition is
  merged into a Misra-Gries summary.  Its capacity exceeds the partition's mass
  divided by the threshold, so every n-gram at or over the threshold survives.
  A longer n-gram is looked at only where its parts have survived: none can be
  more frequent than its parts.
* Survivors become a bitmap of bounded size.  What passes it by chance costs a row
  in the second pass and nothing else.
* Second pass: n-grams that pass the bitmaps are counted as phrases, exactly.
* Score: each candidate's cuts are joined with the counts of their parts.

Texts are worked on as bytes in numpy: no word becomes a Python object but for
the phrases of the second pass.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, first_of_each, held_in, written

#: Counters of a summary and hash counts that a task holds before it sends them on.
CAPACITY = 1 << 18
HELD = 1 << 21
#: Bytes of text worked on at a time (a longer text is one part).
PART = 1 << 19
#: Phrases of a task in the second pass.
PHRASES = 1_500_000

BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
CLASS = np.zeros(256, np.uint8)
CLASS[list(BLANK)] = 1
CLASS[list(BREAK)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(77)
#: Two independent hashes of a word: the sum of a random value for each byte times a random value for its place.
VALUE = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[:, 65:91] = VALUE[:, 97:123]
VALUE[:, CLASS > 0] = 0
PLACES = 4096
PLACE = _rng.integers(0, 1 << 63, (2, PLACES), np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the words of an n-gram.
FIRST, REST = _rng.integers(0, 1 << 63, (2, 2), np.uint64) * np.uint64(2) + np.uint64(1)
del _rng


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of the texts that lie one after the other in ``buf``; text k begins at ``edges[k]``."""

    def __init__(self, buf: np.ndarray, edges: np.ndarray):
        kind = CLASS[buf]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = edges[:-1][(edges[:-1] > 0) & (edges[:-1] < len(buf))]
        first[at] |= word[at]
        last[at - 1] |= word[at - 1]
        self.buf, self.start, self.end = buf, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(edges[1:], self.start, side="right")
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        #: Whether word k + 1 follows word k within a piece.
        self.follows = (self.text[1:] == self.text[:-1]) & (breaks[self.start[1:]] == breaks[self.end[:-1] - 1])

    def hashes(self, which: int, salt: np.ndarray) -> list[np.ndarray]:
        """Hashes of 1-, 2- and 3-grams by the place of their first word; ``salt`` is a number of each text."""
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * 3
        zero = self.start[0]
        starts = self.start - zero
        n = len(self.buf) - zero
        place = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
        one = np.add.reduceat(VALUE[which][self.buf[zero:]] * PLACE[which][place & (PLACES - 1)], starts)
        one = mixed(one ^ salt[self.text])
        two = mixed(one[:-1] * FIRST[which] + one[1:] * REST[which])
        three = mixed(two[:-1] * FIRST[which] + one[2:] * REST[which] + np.uint64(1))
        return [one, two, three]

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each place on lie within a piece."""
        ok = np.ones(max(0, len(self.start) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.follows[j:j + len(ok)]
        return ok


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.RecordBatch]]:
    """The words of the batches' texts (last column) and their rows, some ``PART`` bytes at a time."""
    for b in batches:
        col = b.column(b.num_columns - 1).cast(pa.large_string())
        edges = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PART, side="right")) - 1)
            yield Words(data[edges[lo]:edges[hi]], edges[lo:hi + 1] - edges[lo]), b.slice(lo, hi - lo)
            lo = hi


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts[order], at)


class MisraGries:
    """Mergeable summary of counted keys.

    ``lost`` is what may be missing from any count.  Each decrement takes its
    amount from more than ``capacity`` counters, so with a capacity over mass /
    threshold ``lost`` stays below the threshold and each key at or over it
    keeps a counter.  Where the mass is larger than planned (a very frequent
    key), the summary grows instead of losing as much as the threshold.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.lost = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(self.capacity, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        self.keys, self.counts = summed(np.concatenate([self.keys, *(k for k, _ in self.new)]),
                                        np.concatenate([self.counts, *(c for _, c in self.new)]))
        self.new, self.waiting = [], 0
        if len(self.keys) > 2 * self.capacity:
            n = len(self.keys) - self.capacity - 1
            less = int(np.partition(self.counts, n)[n])  # the (capacity + 1)-th largest
            less = min(less, self.threshold - 1 - self.lost)
            if less > 0:
                keep = self.counts > less
                self.keys, self.counts = self.keys[keep], self.counts[keep] - less
                self.lost += less

    def survivors(self) -> np.ndarray:
        """Keys whose count may reach the threshold."""
        self.merge()
        return self.keys[self.counts + self.lost >= self.threshold]


def hash_counts(docs: DataFrame, words: int, bitmaps) -> DataFrame:
    """(h, c): hashes of the n-grams whose parts are in the bitmaps, counted within tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [np.frombuffer(b, np.uint64) for b in (bitmaps.value if bitmaps else [])]
        held, rows = [], 0

        def merged():
            return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def out(keys, counts):
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)].view(np.int64)),
                                                  pa.array(counts[k:k + (1 << 16)])], names=["h", "c"])
        for part, b in parts(batches):
            grams = part.hashes(0, b.column(0).to_numpy().view(np.uint64))
            ok = part.whole(words)
            if words > 1 and len(ok):
                x = held_in(below[words - 2], grams[words - 2])
                ok &= x[:-1] & x[1:]
            keys = np.sort(grams[words - 1][ok]) if len(ok) else np.zeros(0, np.uint64)
            if not len(keys):
                continue
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            held.append((keys[at], np.diff(at, append=len(keys))))
            rows += len(at)
            if rows > HELD:
                held = [merged()]
                rows = len(held[0][0])
                if 2 * rows > HELD:
                    yield from out(*held[0])
                    held, rows = [], 0
        if held:
            yield from out(*merged())
    return docs.mapInArrow(run, "h long, c long")


def survivors(counts: DataFrame, partitions: int, threshold: int, capacity: int) -> DataFrame:
    """(h): hashes that may occur ``threshold`` times, by a Misra-Gries summary of each hash partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = MisraGries(capacity, threshold)
        for b in batches:
            s.add(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
        x = s.survivors().view(np.int64)
        for k in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)])], names=["h"])
    return counts.repartition(partitions, "h").mapInArrow(run, "h long")


def frequent_hashes(docs: DataFrame, max_words: int, threshold: int) -> list[bytes]:
    """A bitmap for each phrase length that holds every n-gram of ``threshold`` occurrences or more."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-size // (4 * threshold * CAPACITY)))  # a word and its blank are about six bytes, so mass / threshold < capacity
    maps: list[bytes] = []
    for words in range(1, max_words + 1):
        sent = spark.sparkContext.broadcast(maps) if maps else None
        left = written(survivors(hash_counts(docs, words, sent), partitions, threshold, CAPACITY), f"frequent-{words}")
        maps = [*maps, bitmap_of(left, "h", left.count())]
        if sent:
            sent.unpersist()
    return maps


class Phrases:
    """Counts of phrases within a task; two 64-bit hashes tell phrases apart, their words are kept once."""

    def __init__(self):
        self.x, self.g = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.count, self.row = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.phrases: list[bytes] = []
        self.kinds: list[tuple[np.ndarray, int]] = []  # langs and number of words, in the order of phrases
        self.others: Counter = Counter()

    def add(self, x: np.ndarray, g: np.ndarray, langs: np.ndarray, words: int, phrases) -> None:
        """``phrases(k)`` gives the phrases of the occurrences k; ``langs`` are all occurrences' langs by number."""
        order = np.argsort(x, kind="stable")
        x, g = x[order], g[order]
        at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (g[1:] != g[:-1]))))
        n = np.diff(at, append=len(x))
        x, g, where = x[at], g[at], order[at]
        again = np.concatenate(([False], x[1:] == x[:-1]))
        place = np.searchsorted(self.x, x)
        near = np.minimum(place, max(0, len(self.x) - 1))
        known = self.x[near] == x if len(self.x) else np.zeros(len(x), bool)
        same = known & (self.g[near] == g) & ~again if len(self.x) else known
        self.count[near[same]] += n[same]
        odd = np.flatnonzero((known & ~same) | again)  # another phrase of the same first hash
        for k, phrase in zip(odd.tolist(), phrases(where[odd])):
            self.others[int(langs[where[k]]), phrase, words] += int(n[k])
        new = np.flatnonzero(~known & ~again)
        rows = np.arange(len(self.phrases), len(self.phrases) + len(new), dtype=np.int32)
        self.phrases += phrases(where[new])
        self.kinds.append((langs[where[new]].astype(np.int32), words))
        self.x, self.g = np.insert(self.x, place[new], x[new]), np.insert(self.g, place[new], g[new])
        self.count, self.row = np.insert(self.count, place[new], n[new]), np.insert(self.row, place[new], rows)

    def flush(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        count = np.empty(len(self.phrases), np.int64)
        count[self.row] = self.count
        lang = np.concatenate([np.zeros(0, np.int32), *(k for k, _ in self.kinds), [k for k, _, _ in self.others]]).astype(np.int32)
        words = np.concatenate([np.zeros(0, np.int32), *(np.full(len(k), w) for k, w in self.kinds), [w for _, _, w in self.others]]).astype(np.int32)
        count = np.concatenate((count, np.array([*self.others.values()], np.int64)))
        phrases = self.phrases + [p for _, p, _ in self.others]
        self.__init__()
        table = pa.array(names, pa.string())
        for k in range(0, len(phrases), 1 << 16):
            some = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([table.take(pa.array(lang[some])), pa.array(phrases[some], pa.binary()),
                                              pa.array(words[some]), pa.array(count[some])], names=["lang", "b", "words", "c"])


def phrase_counts(docs: DataFrame, maps: list[bytes], threshold: int) -> DataFrame:
    """(lang, phrase, words, f) of phrases that occur ``threshold`` times or more, and of each lang with words 0 the number of all its words."""
    sent = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [np.frombuffer(b, np.uint64) for b in sent.value]
        counts, total = Phrases(), Counter()
        numbers: dict[str, int] = {}
        for part, b in parts(batches):
            salt = b.column(0).to_numpy().view(np.uint64)
            number = np.array([numbers.setdefault(x, len(numbers)) for x in b.column(1).to_pylist()], np.int32)
            langs = number[part.text]
            low = LOWER[part.buf].tobytes()
            for k, n in zip(*np.unique(langs, return_counts=True)):
                total[int(k)] += int(n)
            # words with one space between them are one stretch of the text
            spaced = np.zeros(len(part.start), bool)
            spaced[:-1] = (part.start[1:] - part.end[:-1] == 1) & (part.buf[part.end[:-1]] == 32) if len(spaced) else False
            left, right = part.hashes(0, salt), part.hashes(1, salt)
            before = None
            for words, bitmap in enumerate(bitmaps, 1):
                ok = part.whole(words)
                if not len(ok):
                    break
                if before is not None:
                    ok &= before[:-1] & before[1:]
                before = ok = ok & held_in(bitmap, left[words - 1])
                at = np.flatnonzero(ok)

                def phrases(k: np.ndarray) -> list[bytes]:
                    i = at[k]
                    out = [low[s:e] for s, e in zip(part.start[i].tolist(), part.end[i + words - 1].tolist())]
                    plain = np.ones(len(i), bool)
                    for j in range(words - 1):
                        plain &= spaced[i + j]
                    for n in np.flatnonzero(~plain).tolist():
                        first = i[n]
                        out[n] = b" ".join([low[s:e] for s, e in zip(part.start[first:first + words].tolist(), part.end[first:first + words].tolist())])
                    return out
                if len(at):
                    counts.add(left[words - 1][at], right[words - 1][at], langs[at], words, phrases)
            if len(counts.phrases) > PHRASES:
                yield from counts.flush([*numbers])
        names = [*numbers]
        yield from counts.flush(names)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in total], pa.string()), pa.array([b""] * len(total), pa.binary()),
                                          pa.array([0] * len(total), pa.int32()), pa.array([*total.values()], pa.int64())],
                                         names=["lang", "b", "words", "c"])
    rows = docs.mapInArrow(run, "lang string, b binary, words int, c long")
    return (rows.groupBy("lang", F.col("b").cast("string").alias("phrase"), "words").agg(F.sum("c").alias("f"))
            .filter((F.col("words") == 0) | (F.col("f") >= threshold)))


#: floor(1000000 * a * a / (l * r)) in whole numbers: the products are decimals of up to 38 digits.
SCORE = ("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div "
         "(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


def cut_scores(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each candidate with its lowest-scoring cut, ties to the smallest."""
    phrases = counts.filter("words > 0")
    cand = phrases.filter("words > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    sides = [F.struct(F.lit(k).alias("cut"), F.lit(left).alias("left"), F.concat_ws(
        " ", F.slice(split, 1, k) if left else F.slice(split, k + 1, max_words)).alias("part"))
        for k in range(1, max_words) for left in (True, False)]
    rows = (cand.withColumn("s", F.explode(F.array(*sides))).select("lang", "phrase", "words", "a", "s.*")
            .filter("cut < words"))
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    which = [(k, left) for k in range(1, max_words) for left in (True, False)]
    wide = rows.join(part, ["lang", "part"]).groupBy("lang", "phrase", "words", "a").agg(
        *[F.max(F.when((F.col("cut") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")
          for k, left in which])
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(SCORE.format(l=f"l{k}", r=f"r{k}")).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, max_words)]
    best = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    return wide.withColumn("best", best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def outer_only(scored: DataFrame, max_words: int, percent: int) -> DataFrame:
    """``scored`` without phrases inside a longer candidate that has ``percent`` of their occurrences or more."""
    split = F.split("phrase", " ")
    inside = F.array(*[F.when(F.col("words") >= F.lit(max(n + k, n + 1)), F.concat_ws(" ", F.slice(split, k + 1, n)))
                       for n in range(2, max_words) for k in range(max_words - n + 1)])
    longer = (scored.filter("words > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
              .filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(percent) * F.col("a"), F.lit(False))
    return scored.join(longer, ["lang", "phrase"], "left").filter(~covered).drop("longer")


def collocations(docs: DataFrame, top: int = 2000, max_words: int = 3, threshold: int = 10, percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of 2 to ``max_words`` words.

    A null lang counts as ``und``, a null text as empty.  A-Z are lower-cased;
    pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs.
    Repeated rows count each time.  Other columns are ignored.  A lang without
    a phrase of ``threshold`` occurrences has no rows, an empty table neither.
    """
    if max_words not in (2, 3):
        raise ValueError("max_words is 2 or 3")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(F.xxhash64(lang).alias("salt"), lang.alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    maps = frequent_hashes(docs.select("salt", "text"), max_words, threshold)
    counts = written(phrase_counts(docs, maps, threshold), "phrase-counts")
    scored = written(cut_scores(counts, max_words), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_of_each(written(outer_only(scored, max_words, percent), "phrases"), "lang", "phrase", order, top, "rank")
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
