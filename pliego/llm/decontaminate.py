"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, units after numbers and names
(capitalised words inside a sentence) are typed placeholders and all other
words are lower-cased.  Windows of five tokens of benchmark items and documents
are joined on their hash.  Windows that match keep what stood in their slots:
along one alignment an item's value must always become the same value of the
document, or the windows that hold it don't count.  A document holds an item if
at least 0.8 of the item's windows count, as they are or re-parameterised.

Whether a word is a name shows only in its capital, which a copy in lower case,
in capitals or at the start of a sentence lacks.  With ``any_case`` windows with
names are hashed a second time, the names as plain lower-cased words, and a
window matches if either form does; a name matched so stands for itself.

What holds no word says little: a window of slots only counts where its values
are the item's own, or where the item's other windows along the alignment bear
it out.  An item of fewer tokens than a window has no template: it is one window
of plain words, held by the documents with just these tokens in a row.

Documents are read in one pass of Arrow workers; a fixed-size bitmap of the
benchmark's window hashes keeps all other windows out of the shuffle.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import text_key, written

WINDOW = 5
SIMILARITY = 0.8
#: Bits of the prefilter (2 MB), whatever the size of the benchmark.
FILTER_BITS = 24
#: Distinct tokens a task keeps the hashes of.
CACHE = 150_000
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
# Units that are typed after a number.
UNITS = frozenset("""mm cm dm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers
mg g kg t lb lbs oz ton tons gram grams kilogram kilograms ml cl l liter liters litre litres gallon gallons
ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
cent cents dollar dollars usd euro euros eur pound pounds gbp percent degree degrees
w kw mw v a hz khz mhz ghz b kb mb gb tb""".split())
END, LITERAL, NUMBER, UNIT, NAME = range(5)
MARK = np.array([xxh64_intdigest(f"\0{n}", 1) for n in range(5)], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT = "\x1f"


class Tokens(dict):
    """Token -> number; its hash and sort stand in arrays that grow."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.sorts = np.zeros(1 << 12, np.int8)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0] in ".!?\n":
            sort = END
        elif token[0].isdigit() or not token[0].isalpha():
            sort = NUMBER
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            sort = NAME
        else:
            sort = UNIT if low in UNITS else LITERAL
        n = self[token] = len(self.words)
        self.words.append(low)
        if n == len(self.sorts):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.sorts = np.concatenate((self.sorts, np.zeros_like(self.sorts)))
        self.hashes[n] = xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 0)
        self.sorts[n] = sort
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def canonical(texts: list[str | None], tokens: Tokens, inside: bool = False):
    """Tokens of many texts in a row: (text number, token number, sort).

    ``inside``: a text's first word counts as one inside a sentence.
    """
    lists = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    number = np.fromiter((tokens[w] for ws in lists for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(lists)), sizes)
    sort = tokens.sorts[number]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))[:len(doc)]
    after_end = np.concatenate(([False], sort[:-1] == END))[:len(doc)]
    start = after_end if inside else after_end | first
    keep = sort != END
    doc, number, sort, start, first = (x[keep] for x in (doc, number, sort, start, first))
    after_number = np.concatenate(([False], (sort[:-1] == NUMBER) & (doc[1:] == doc[:-1])))[:len(doc)]
    low_unit = np.isin(sort, (NAME, LITERAL, UNIT)) & after_number
    if low_unit.any():  # "Km" after a number is a unit as well
        at = np.flatnonzero(low_unit)
        sort[at[[tokens.words[n] in UNITS for n in number[at].tolist()]]] = UNIT
    sort[(sort == UNIT) & ~after_number] = LITERAL
    sort[(sort == NAME) & start] = LITERAL
    return doc, number, sort


def windows(doc: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``size`` tokens of one text start, and the hash of each window."""
    n = len(doc) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = total * BASE + hashes[k:k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    return at, mixed(total[at])


def forms(doc: np.ndarray, number: np.ndarray, sort: np.ndarray, tokens: Tokens, size: int,
          any_case: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows with typed names and, for ``any_case``, those that differ when names are words.

    Each time their positions, their hashes and which tokens are slots.  Windows
    of short items have no slots.
    """
    words, slot = tokens.hashes[number], (sort != LITERAL) & (size == WINDOW)
    at, typed = windows(doc, np.where(slot, MARK[sort], words), size)
    yield at, typed, slot
    if any_case and slot.any():
        slot = slot & (sort != NAME)
        _, plain = windows(doc, np.where(slot, MARK[sort], words), size)
        new = plain != typed
        yield at[new], plain[new], slot


def values(number: np.ndarray, slot: np.ndarray, tokens: Tokens, at: int, size: int) -> str:
    return SLOT.join([tokens.words[number[k]] for k in range(at, at + size) if slot[k]])


def item_windows(batches: Iterator[pa.RecordBatch], any_case: bool = False) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, at, size, hash, slots, names, bare, n, n_worded): a row per window and form.

    names: the window's names where they are words of the form, else null.
    bare: all tokens are numbers, units or names; n_worded: windows that aren't bare.

    The first window is given twice if it opens with a capital: an item may
    stand behind a word that ends no sentence.  An item of fewer tokens than a
    window is one window.
    """
    for b in batches:
        tokens, rows = Tokens(), []
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for item, text in zip(ids, texts):
            seen = set()
            for inside in (False, True):
                doc, number, sort = canonical([text], tokens, inside)
                size = min(WINDOW, len(doc))
                if not size:
                    continue
                if not inside:
                    bare = [size == WINDOW and bool((sort[p:p + size] != LITERAL).all()) for p in range(len(doc) - size + 1)]
                for at, hs, slot in forms(doc, number, sort, tokens, size, any_case):
                    named = (sort != LITERAL) & ~slot & (size == WINDOW)
                    for p, h in zip(at.tolist(), hs.view(np.int64).tolist()):
                        if (p, h) not in seen and not (inside and p):
                            seen.add((p, h))
                            rows.append((item, p, size, h, values(number, slot, tokens, p, size),
                                         values(number, named, tokens, p, size) or None,
                                         size == WINDOW and bool((sort[p:p + size] != LITERAL).all()), len(bare), bare.count(False)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
                names=["item_id", "item_at", "size", "hash", "item_slots", "item_names", "bare", "item_windows", "item_worded"])


def document_windows(docs: DataFrame, bitmap: bytes, sizes: list[int], any_case: bool = False) -> DataFrame:
    """(doc_id, tk, doc_at, hash, doc_slots) of the windows whose hash is in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        tokens = Tokens()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                if len(tokens) > CACHE:
                    tokens = Tokens()
                part = b.slice(k, 128)
                doc, number, sort = canonical(part.column(2).to_pylist(), tokens)
                first = np.searchsorted(doc, doc)
                for size, (at, hs, slot) in ((n, x) for n in sizes for x in forms(doc, number, sort, tokens, n, any_case)):
                    where = (hs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    hit = bits[where >> 3] >> (where & 7).astype(np.uint8) & 1 == 1
                    at, hs = at[hit], hs[hit]
                    if len(at):
                        rows = pa.array(doc[at])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(rows), part.column(1).take(rows), pa.array(at - first[at]), pa.array(hs.view(np.int64)),
                             pa.array([values(number, slot, tokens, p, size) for p in at.tolist()], pa.string())],
                            names=["doc_id", "tk", "doc_at", "hash", "doc_slots"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return rows.mapInArrow(run, "doc_id long, tk long, doc_at long, hash long, doc_slots string")


def filter_bitmap(items: DataFrame) -> bytes:
    """Bitmap of the leading bits of the window hashes, put together by Spark in pieces of 4 KB."""
    lead = F.shiftrightunsigned("hash", 64 - FILTER_BITS) + 1  # bit 0 of bucket 1 stands for the value 1
    rows = (items.groupBy(F.bitmap_bucket_number(lead).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(lead)).alias("bits")).collect())
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = r["bits"]
    return bytes(out)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, any_case: bool = False) -> DataFrame:
    """(doc_id, tk, item_id, n_windows, item_windows, n_changed): a row per document and item it holds.

    n_windows: the item's windows that count; n_changed: those of them whose
    slots hold other values than the item's.  Items with the same text go under
    the smallest item_id.  Null or empty texts hold nothing; of repeated
    documents (same doc_id and text) there is one row; a null doc_id is kept.
    any_case: names match in other letter cases as well.

    An item of fewer than WINDOW tokens is held by a document with the same
    tokens in a row, in any letter case, and never re-parameterised.  A window
    of slots only with other values than the item's counts if as many worded
    windows count along its alignment as there are such windows, and at least
    ``similarity`` of the item's worded ones.
    """
    texts = (benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
             .groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).select("item_id", "text"))
    items = written(texts.mapInArrow(lambda batches: item_windows(batches, any_case), "item_id long, item_at long, size int, hash long, "
                                     "item_slots string, item_names string, bare boolean, item_windows long, item_worded long"), "benchmark-windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    hits = document_windows(docs, filter_bitmap(items), sizes, any_case).join(items.drop("size"), "hash")
    named = {c: F.concat_ws(SLOT, F.nullif(c, F.lit("")), "item_names") for c in ("item_slots", "doc_slots")}
    hits = hits.withColumns(named).drop("item_names")
    hits = written(hits.withColumn("shift", F.col("doc_at") - F.col("item_at")).drop("hash"), "window-hits")
    along = ["doc_id", "tk", "item_id", "shift"]
    slots = (hits.filter("item_slots <> ''")
             .select(*along, F.explode(F.arrays_zip(F.split("item_slots", SLOT).alias("i"), F.split("doc_slots", SLOT).alias("d"))).alias("s"))
             .groupBy(*along, F.col("s.i").alias("value")).agg(F.min("s.d").alias("lo"), F.max("s.d").alias("hi"))
             .filter("lo <> hi")
             .groupBy(*along).agg(F.collect_set("value").alias("broken"))
             .select(*[F.col(c).alias(f"in_{c}") for c in along], "broken"))
    same = [F.col(c).eqNullSafe(F.col(f"in_{c}")) for c in along]
    sound = (hits.join(slots, same, "left")
             .filter(F.col("broken").isNull() | ~F.arrays_overlap(F.split("item_slots", SLOT), F.col("broken"))))
    if not items.filter("bare").isEmpty():
        backed = (sound.filter(~F.col("bare")).groupBy(*along, "item_windows", "item_worded").agg(F.countDistinct("item_at").alias("n"))
                  .filter((F.col("n") >= F.lit(similarity) * F.col("item_worded")) & (F.col("n") >= F.col("item_windows") - F.col("item_worded")))
                  .select(*[F.col(c).alias(f"in_{c}") for c in along]))
        sound = sound.drop(*slots.columns)
        weak = F.col("bare") & (F.col("item_slots") != F.col("doc_slots"))
        sound = sound.filter(~weak).unionByName(sound.filter(weak).join(backed, same, "left_semi"))
    per_window = sound.groupBy("doc_id", "tk", "item_id", "item_windows", "item_at").agg(
        F.min((F.col("item_slots") != F.col("doc_slots")).cast("int")).alias("changed"))
    return (per_window.groupBy("doc_id", "tk", "item_id", "item_windows")
            .agg(F.count("*").alias("n_windows"), F.sum("changed").cast("long").alias("n_changed"))
            .filter(F.col("n_windows") >= F.lit(similarity) * F.col("item_windows"))
            .select("doc_id", "tk", "item_id", "n_windows", "item_windows", "n_changed"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as before."""
    found = contamination(docs, benchmark, similarity, any_case=True).select(
        F.col("doc_id").alias("_pliego_id"), F.col("tk").alias("_pliego_tk")).distinct()
    found = written(found, "contaminated")
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_pliego_id")) & (text_key() == F.col("_pliego_tk")), "left_anti")
