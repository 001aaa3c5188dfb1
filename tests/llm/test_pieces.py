"""The relational lattice against a plain Viterbi; decoding against the library."""
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pliego.llm import pieces as P


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary.read()


def plain(word, vocab, score):
    """Best segmentation of a word: ids, a character without a piece as its bytes."""
    best, back = [0.0], [None]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - 16), end):
            piece = word[start:end]
            if piece in score:
                s, i = score[piece]
            elif end - start == 1:
                s, i = vocab.unknown_score, -1 - ord(piece)
            else:
                continue
            if top is None or best[start] + s > top[0]:
                top = (best[start] + s, start, i)
        best.append(top[0])
        back.append(top[1:])
    ids, at = [], len(word)
    while at:
        at, i = back[at]
        ids.append(i)
    return vocab.spelled(ids[::-1])


def table(vocab):
    return {vocab.pieces[i]: (vocab.scores[i], i) for i in vocab.normal}


def plain_text(text, vocab, score):
    return plain(P.MARK + text.replace(" ", P.MARK), vocab, score) if text else []


def encoded(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in P.encode(df, **kw).collect()}


TEXTS = ["Hello world", "  two  spaces ", "a\nb\t c", "", None, "naïve Übergröße — 東京 \U0001F600!", "x" * 700 + " y", "\n", " ",
         "12,345.67 (it's)", "▁ mark ▁▁", "Th▁x", "wh " * 300, "ﷺ\u0000 ​"]


@pytest.mark.parametrize("frequent,sample", [(P.FREQUENT, P.SAMPLE_DOCS), (0, 10), (5, 100)])
def test_equals_plain_viterbi_whatever_is_frequent(spark, vocab, frequent, sample):
    score = table(vocab)
    got = encoded(spark, TEXTS, frequent=frequent, sample_docs=sample)
    for n, t in enumerate(TEXTS):
        assert got[n].ids == plain_text(t, vocab, score), t
        assert got[n].n_tokens == len(got[n].ids)
        assert got[n].round_trip == (P.MARK not in (t or "")), t  # the mark itself decodes to a space


def test_library_decodes_the_ids(spark):
    import public_tokenizers
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.VOCABULARY))
    texts = [t for t in TEXTS if t and P.MARK not in t]
    got = encoded(spark, texts)
    assert [lib.decode(got[n].ids) for n in range(len(texts))] == texts


def test_whole_table_equals_brute_force(spark, sf_dir, vocab):
    from pliego.llm.queries import QUERIES
    score, memo = table(vocab), {}
    rows = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = []
        for u in P.units(d.text):
            if u not in memo:
                memo[u] = plain(u, vocab, score)
            want += memo[u]
        assert rows[d.doc_id].ids == want and rows[d.doc_id].round_trip


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_units_put_together_give_the_text(text):
    assert "".join(P.units(text)) == (P.MARK + text.replace(" ", P.MARK) if text else "")
    texts = [t for t in (text, " a", text + "  ") if t]
    joined, _, start, _ = P.split_units(texts)
    cut = [*start.tolist(), len(joined)]
    assert [joined[a:b] for a, b in zip(cut, cut[1:])] == [u for t in texts for u in P.units(t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**28 - 1), max_size=50))
def test_packed_numbers(numbers):
    data, sizes = P.packed(np.array(numbers, np.int64))
    assert P.unpacked(data).tolist() == numbers and sizes.sum() == len(data)


def test_odd_rows(spark, vocab):
    rows = [(1, "same id", 1), (1, "other text of that id qzx", 2), (None, "no id qzxv", 3), (2, "rep zzqx", 4), (2, "rep zzqx", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = P.encode(df, frequent=3, sample_docs=1).collect()
    score = table(vocab)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in out) == sorted((d or 0, tuple(plain_text(t, vocab, score))) for d, t, _ in rows)
    assert all(r.round_trip for r in out)
    assert P.encode(df.limit(0)).count() == 0
    back = P.decode(P.encode(df.filter("text IS NOT NULL")))
    assert sorted(r.decoded for r in back.collect()) == sorted(t for _, t, _ in rows if t)


def test_no_possible_length_is_left_out(spark):
    """At every end of a word the lengths of all pieces that end there are among those looked up."""
    v = P.Vocabulary.read()
    names = {v.pieces[i] for i in v.winning}
    words = ["▁international", "▁a", "x", "▁Straßenbahnen", "▁ééé", "12345", "▁the", "▁" * 40, "▁naïvement日本"] + sorted(names)[::400]
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("last"))
    loose = 0
    for r in df.select("word", "last", P.possible_lengths(v).alias("m")).collect():
        real = {n for n in range(2, min(r["last"], 31) + 1) if r.word[r["last"] - n:r["last"]] in names}
        got = {n for n in range(2, r["last"] + 1) if r.m >> n & 1}
        assert real <= got
        loose += len(got) - len(real)
    assert loose < 3 * sum(map(len, words))


def test_fold_takes_edges_in_any_order(vocab):
    """Many words folded at once equal a plain Viterbi, and ids survive their three bytes."""
    score = table(vocab)
    names = {vocab.pieces[i]: i for i in vocab.winning}
    words = ["▁international", "▁a", "x", "日本", "\U0001F600", "▁Straßenbahnen", "x" * 300, "▁" * 40] + sorted(names)[::300]
    rng, edges, sizes = np.random.default_rng(1), [], []
    for w in words:
        own = [(end << 29) + (n << 24) + names.get(w[end - n:end], -1 - ord(w[end - n])) + P.SHIFT
               for end in range(1, len(w) + 1) for n in range(1, min(end, vocab.longest) + 1) if n == 1 or w[end - n:end] in names]
        edges.append(rng.permutation(np.array(own, np.int64)))
        sizes.append(len(own))
    size = np.array(sizes)
    edge = P.in_order(np.concatenate(edges), size)
    ids, counts = P.best_paths(edge >> 29, edge >> 24 & 31, (edge & 0xFFFFFF) - P.SHIFT, np.cumsum(size) - size, vocab.edge_scores)
    ids = P.of_three_bytes(np.frombuffer(P.three_bytes(ids), np.uint8))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [vocab.spelled(x.tolist()) for x in got] == [plain(w, vocab, score) for w in words]


def test_no_edge_goes_through_an_interpreted_fold(spark, vocab):
    """Edges are joined on a long and folded in batches; a lambda for each edge took most of the time."""
    words = spark.createDataFrame([("▁the", 1)], "word string, carried int").select(*P.word_key(), "word", "carried")
    plan = P.lattice(words, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key" in plan and "lambda" not in plan
    assert spark.createDataFrame([], words.schema).transform(lambda d: P.lattice(d, vocab)).count() == 0


def test_documents_are_put_together_in_batches(spark, vocab):
    """Documents of one batch keep apart: with and without rare units, empty ones between, spaces in front."""
    score = table(vocab)
    texts = ["common words", "", "qzxv common", None, " common", "  qzxv", "zzqx qzxv zzqx", "common", "\U0001F600 zzqx", " "] * 60
    for frequent in (0, 2, 1000):
        got = encoded(spark, texts, frequent=frequent, sample_docs=1000)
        assert [got[n].ids for n in range(len(texts))] == [plain_text(t or "", vocab, score) for t in texts]
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
