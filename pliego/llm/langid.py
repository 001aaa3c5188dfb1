"""Language ID with segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public
vocabulary.  The probability of a word is the sum over all its segmentations
into pieces, by the forward algorithm; a text's is the product over its words.
Piece probabilities are fitted by expectation maximisation: each round counts,
in Arrow workers, the expected uses of every piece over all segmentations
(forward-backward), and sums them by language and piece.

Words are runs of letters, lower-cased, with a mark in front; a run over
``SEGMENT`` letters is scored in consecutive segments of that length.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, first_of_each, slices, written

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: Longest piece that can occur in a segment, marks included: no letter piece of the vocabulary is left out.
MAX_PIECE = SEGMENT = 32
#: Documents per language that the model is fitted on (the lowest of a hash order).
FIT_DOCS = 3000
ROUNDS = 3
#: Added to every expected count.
SMOOTHING = 0.05
#: Distinct words a task keeps the scores of.
CACHE = 150_000
UNKNOWN = "und"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_pieces(path: str | None = None) -> list[str]:
    """Letter pieces of the vocabulary, lower-case."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    out = {p for p in map(model.id_to_piece, range(model.get_piece_size()))
           if len(p) <= MAX_PIECE and p == p.lower() and WORD.fullmatch(p.removeprefix(MARK) or MARK + "1")}
    return sorted(out)


class Lattice:
    """Piece look-ups for many words at once, by a trie of the pieces read backwards."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        chars = sorted({c for p in pieces for c in p} | {MARK})
        if len(chars) > 4094:
            raise ValueError("more than 4094 characters in the vocabulary")
        self.code = {c: n + 1 for n, c in enumerate(chars)}
        step: dict[int, int] = {}  # state and character -> state
        piece = [-1]  # of a state
        for n, p in enumerate(pieces):
            state = 0
            for c in reversed(p):
                key = state << 12 | self.code[c]
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                state = step[key]
            piece[state] = n
        self.keys = np.array(sorted(step), np.int64)
        self.states = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        #: number of the stand-in for a character without a piece of its own
        self.other = len(pieces)

    def edges(self, words: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """edges[j][l-1]: words, ascending, whose l characters ending at j+1 are a piece, and the piece.

        All words have the same length.  Every character has an edge: its own piece or the stand-in.
        """
        n, size = len(words), len(words[0])
        get = self.code.get
        codes = np.fromiter((get(c, 4095) for w in words for c in w), np.int64, n * size).reshape(n, size)
        out = []
        for j in range(size):
            row: list[tuple[np.ndarray, np.ndarray]] = []
            live, state = np.arange(n), np.zeros(n, np.int64)
            for back in range(j + 1):
                key = state << 12 | codes[live, j - back]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
                state = self.states[at[ok]]
                if back == 0:
                    ids = np.full(n, self.other)
                    ids[ok] = np.where(self.piece[state] >= 0, self.piece[state], self.other)
                    row.append((live, ids))
                    live = live[ok]
                else:
                    live = live[ok]
                    ends = self.piece[state] >= 0
                    row.append((live[ends], self.piece[state[ends]]))
                if not len(live):
                    break
            out.append(row)
        return out


def forward(edges: list[list[tuple[np.ndarray, np.ndarray]]], probs: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: per word and language, the summed probability of the first j characters.

    ``probs`` has a row per piece, one for the stand-in, and a last row of zeros.
    """
    alpha = [np.ones((len(edges[0][0][0]), probs.shape[1]))]
    for j, row in enumerate(edges):
        a = alpha[j] * probs[row[0][1]]
        for back, (at, ids) in enumerate(row[1:], 1):
            if len(at):
                a[at] += alpha[j - back][at] * probs[ids]
        alpha.append(a)
    return alpha


def backward(edges: list[list[tuple[np.ndarray, np.ndarray]]], probs: np.ndarray) -> list[np.ndarray]:
    size, n = len(edges), len(edges[0][0][0])
    beta = [np.zeros((n, probs.shape[1])) for _ in range(size)] + [np.ones((n, probs.shape[1]))]
    for j in reversed(range(size)):
        for back, (at, ids) in enumerate(edges[j]):
            beta[j - back][at] += probs[ids] * beta[j + 1][at]
    return beta


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Blocks of words of one length: their positions and themselves."""
    groups: dict[int, list[int]] = {}
    for n, w in enumerate(words):
        groups.setdefault(len(w), []).append(n)
    for at in groups.values():
        for k in range(0, len(at), 8192):
            part = at[k:k + 8192]
            yield np.array(part), [words[n] for n in part]


def log_scores(words: list[str], lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    for at, group in by_length(words):
        out[at] = np.log(forward(lattice.edges(group), probs)[-1])
    return out


def segments(word: str) -> list[str]:
    """The marked word; a long one in parts of at most ``SEGMENT`` characters."""
    w = MARK + word
    return [w] if len(w) <= SEGMENT else [w[k:k + SEGMENT] for k in range(0, len(w), SEGMENT)]


@dataclass
class Model:
    """Languages, ascending, and the probability of each piece (row) in each (column)."""
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray

    def scorer(self) -> Callable[[list[str | None]], list[tuple[str, float]]]:
        """Function from texts to (language, its posterior probability); keeps scores of words seen."""
        if not self.languages:
            return lambda texts: [(UNKNOWN, 0.0)] * len(texts)
        lattice = Lattice(self.pieces)
        seen: dict[str, int] = {}
        table = np.zeros((0, len(self.languages)))

        def each(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal table
            if len(seen) > CACHE:
                seen.clear()
                table = table[:0]
            split = [WORD.findall(t.lower()) if t else [] for t in texts]
            new = list(dict.fromkeys(w for ws in split for w in ws if w not in seen))
            if new:
                parts = [segments(w) for w in new]
                flat = log_scores([p for ps in parts for p in ps], lattice, self.probs)
                first = np.cumsum([0, *map(len, parts[:-1])])
                table = np.concatenate([table, np.add.reduceat(flat, first, axis=0)])
                start = len(seen)
                seen.update(zip(new, range(start, start + len(new))))
            out = []
            for ws in split:
                if not ws:
                    out.append((UNKNOWN, 0.0))
                    continue
                total = table[np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(np.argmax(total))
                out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
            return out
        return each


def held_out():
    """True for the fifth of the documents that is never learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = FIT_DOCS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """Model from documents (doc_id, text, lang) that aren't held out and have a language.

    Fitted on at most ``per_language`` documents of each, chosen by a hash of
    doc_id; of those the whole texts count.  No such document: a model
    without languages.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    usable = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = written(first_of_each(written(usable.select("doc_id", "lang").distinct(), "usable"), "lang", "doc_id",
                                   [F.xxhash64("doc_id"), F.col("doc_id")], per_language), "sample")
    words = (usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
             .mapInArrow(count_words, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = written(words, "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    probs = np.zeros((len(pieces) + 2, len(languages)))
    probs[:-1] = 1 / (len(pieces) + 1)
    for _ in range(rounds if languages else 0):
        probs = maximised(expected(spark, words, languages, pieces, probs), probs.shape)
    return Model(languages, pieces, probs)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, lang, text) -> (lang, marked word or segment, how often in the batch)."""
    for b in slices(batches):
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            for w in WORD.findall(text.lower()):
                found[lang, w] = found.get((lang, w), 0) + 1
        rows = [(lang, s, n) for (lang, w), n in found.items() for s in segments(w)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(3)], names=["lang", "word", "n"])


def expected(spark: SparkSession, words: DataFrame, languages: list[str], pieces: list[str],
             probs: np.ndarray) -> list[tuple[int, int, float]]:
    """(language, piece, expected uses): one row per pair at most, so bounded by the vocabulary."""
    number = {x: n for n, x in enumerate(languages)}

    def run(batches):
        lattice = Lattice(pieces)
        total = np.zeros(probs.shape)
        for b in batches:
            langs = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            counts = b.column(2).to_numpy()
            for at, group in by_length(b.column(1).to_pylist()):
                edges = lattice.edges(group)
                alpha, beta = forward(edges, probs), backward(edges, probs)
                own = langs[at]
                weight = counts[at] / alpha[-1][np.arange(len(at)), own]
                for j, row in enumerate(edges):
                    for back, (rows, ids) in enumerate(row):
                        lang = own[rows]
                        use = alpha[j - back][rows, lang] * probs[ids, lang] * beta[j + 1][rows, lang] * weight[rows]
                        np.add.at(total, (ids, lang), use)
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[piece, lang])],
                                         names=["lang", "piece", "uses"])
    return [tuple(r) for r in words.mapInArrow(run, "lang long, piece long, uses double")
            .groupBy("lang", "piece").agg(F.sum("uses")).collect()]


def maximised(uses: list[tuple[int, int, float]], shape: tuple[int, int]) -> np.ndarray:
    probs = np.zeros(shape)
    probs[:-1] = SMOOTHING
    for lang, piece, n in uses:
        probs[piece, lang] += n
    return probs / probs.sum(axis=0)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the language's posterior probability, equal priors).

    A text that is null or has no letter gets ``und`` and 0; of equal scores the
    first language in order wins.  Only the text is read.
    """
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        score = model.scorer()

        def each(texts):
            rows: list[tuple[str, float]] = []
            for k in range(0, len(texts), 256):
                rows += score(texts[k:k + 256])
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
        return each
    return add_columns(df, text_col, new, make)


def accepted(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df`` whose text has a language; columns as before.

    A model without languages rejects only texts without a letter.
    """
    at = df.columns.index("text")

    def run(batches):
        score = model.scorer()
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            if model.languages:
                keep = [lang != UNKNOWN for k in range(0, len(texts), 256) for lang, _ in score(texts[k:k + 256])]
            else:
                keep = [bool(t and WORD.search(t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))
    return df.mapInArrow(run, df.schema)
