"""Held-out texts inside a training corpus: suffix arrays of the corpus, searched for every test suffix.

A word is a longest run of ASCII letters or digits; case is ignored. Each partition of the corpus is a shard, worked
off in stretches of about STRETCH bytes of whole documents. A stretch's words become numbers of the test vocabulary
(0: in no test text; it ends every match), and its suffix array holds the positions in runs of at least MIN_WORDS
test words, in the order of their whole suffixes. Leaving out the others loses nothing, since a match has test words only,
and keeps the arrays small; for other tests they are built anew, in one pass over the corpus.

Every test suffix is binary-searched in the array. What is found is a range of the array for a range of the sorted test
suffixes that begin alike. A pair that the word before both carries on belongs to a longer match, so only pairs that
differ before are looked at, AT_ONCE at a time, and extended to their full length: a passage that many tests and
documents share costs one pair for each of its matches, not one for each of its words. The longest match of a document
and test item is reported with its place, and affected documents are removed.

The test texts go to the executors in blocks of at most TEST_BYTES, all of which are searched in the same pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
STRETCH = 4_000_000
TEST_BYTES = 32_000_000
MAX_TEST_BYTES = 1_000_000_000
AT_ONCE = 1 << 18
SCHEMA = "doc_id bigint, eval_id bigint, n_words int, doc_word int, eval_word int"
_word = re.compile(rb"[a-z0-9]+")


def words(text: bytes) -> list[bytes]:
    return _word.findall(text.lower())


class Words:
    """Word numbers of several texts in a row, each ended by 0, and the suffix array of the positions in runs of at
    least n numbers above 0.

    A suffix ends with the first 0, as any match does. Suffixes are sorted by their first n numbers; those that tie are
    sorted on by the rank of what follows, over twice as many numbers each time (prefix doubling), until none tie
    before their ends. keys: the first n numbers of each, packed into integers that compare as the numbers in turn.
    """

    def __init__(self, ids: np.ndarray, n: int, bits: int):
        self.ids, self.n, self.bits = ids, n, bits
        zeros = np.flatnonzero(ids == 0)
        at = np.arange(len(ids))
        end = zeros[np.searchsorted(zeros, at)] if len(zeros) else at  # ids end with 0
        begin = np.r_[0, zeros + 1][np.searchsorted(zeros, at)] if len(zeros) else at
        starts = np.flatnonzero((end - begin >= n) & (ids > 0))
        self._end = end
        keys = self._keys(starts, 0)
        order = np.lexsort(keys.T[::-1]) if len(starts) else np.zeros(0, np.int64)
        array, self.keys = starts[order], keys[order]
        change = (self.keys[1:] != self.keys[:-1]).any(axis=1)
        self.first = np.flatnonzero(np.r_[True, change]) if len(array) else np.zeros(0, np.int64)  # of each run of equal keys
        index = np.arange(len(array))
        rank = np.full(len(ids), -1)
        rank[array] = np.maximum.accumulate(np.where(np.r_[True, change][: len(array)], index, 0)) if len(array) else 0
        active, shift = index, n
        while len(active):
            group = rank[array[active]]
            same = group[1:] == group[:-1]
            tied = np.r_[False, same] | np.r_[same, False]
            active, group = active[tied], group[tied]
            going = np.isin(group, group[end[array[active]] > array[active] + shift])
            active, group = active[going], group[going]
            then = array[active] + shift
            key = np.where(then < end[array[active]], rank[np.minimum(then, len(ids) - 1)], -1)
            by = np.lexsort((key, group))
            array[active], key = array[active[by]], key[by]
            if len(active):
                parts = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
                rank[array[active]] = active[np.maximum.accumulate(np.where(parts, np.arange(len(active)), 0))]
            shift *= 2
        self.array = array

    def _keys(self, at: np.ndarray, shift: int) -> np.ndarray:
        per = 62 // self.bits
        out = np.zeros((len(at), -(-self.n // per)), np.int64)
        end = self._end[at]
        last = len(self.ids) - 1
        for k in range(self.n):
            where = at + shift + k
            value = np.where(where < end, self.ids[np.minimum(where, last)], 0)
            out[:, k // per] = (out[:, k // per] << self.bits) | value
        return out

    def before(self, at: np.ndarray) -> np.ndarray:
        """The number before each position; 0 at the start of a text and after an unknown word."""
        return np.where(at > 0, self.ids[at - 1], 0)


def _rank(array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many rows of the sorted array are less than each key, by binary search."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(array), np.int64)
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        row = array[np.minimum(mid, len(array) - 1)]
        less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for c in range(array.shape[1]):
            less |= same & (row[:, c] < keys[:, c])
            same &= row[:, c] == keys[:, c]
        up = go & less
        lo, hi = np.where(up, mid + 1, lo), np.where(go & ~up, mid, hi)
    return lo


class TestIndex:
    """Vocabulary and sorted suffixes of a block of test texts; texts with the same words are searched once."""

    __test__ = False

    def __init__(self, rows: list[tuple[int, bytes]], n: int = MIN_WORDS):
        self.n = n
        alike: dict[tuple, list[int]] = {}
        for i, t in rows:
            w = words(t)
            if len(w) >= n:
                alike.setdefault(tuple(w), []).append(i)
        self.items = list(alike.values())
        self.vocabulary: dict[bytes, int] = {}
        for w in alike:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.bits = max(1, len(self.vocabulary).bit_length())
        parts = [np.array([*(self.vocabulary[x] for x in w), 0], np.int64) for w in alike]
        self.starts = np.cumsum([0, *map(len, parts)])[:-1]
        self.words = Words(np.concatenate(parts) if parts else np.zeros(1, np.int64), n, self.bits)

    def numbers(self, docs: list[tuple[int | None, list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the documents in a row, each ended by 0, and where each begins."""
        get = self.vocabulary.get
        parts = [np.array([*(get(x, 0) for x in w), 0], np.int64) for _, w in docs]
        return np.concatenate(parts) if parts else np.zeros(1, np.int64), np.cumsum([0, *map(len, parts)])[:-1]

    def matches(self, docs: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
        """Rows of SCHEMA for the documents of one stretch."""
        ids, begins = self.numbers(docs)
        corpus, tests = Words(ids, self.n, self.bits), self.words
        if not len(corpus.array) or not len(tests.array):
            return []
        # ranges of the two arrays with the same first n words
        at = _rank(corpus.keys[corpus.first], tests.keys[tests.first])
        heads = corpus.keys[corpus.first]
        mine = tests.keys[tests.first]
        whole = (mine[:, -1] & ((1 << self.bits) - 1)) > 0  # else a suffix of fewer than n words
        hit = np.flatnonzero(whole & (at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == mine).all(axis=1))
        c_end, t_end = np.r_[corpus.first[1:], len(corpus.array)], np.r_[tests.first[1:], len(tests.array)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if held:
                p, q = (np.concatenate(v) for v in zip(*held))
                self._longest(corpus, p, q, begins, best)
                held.clear()
                size = 0

        for t in hit.tolist():
            p = corpus.array[corpus.first[at[t]] : c_end[at[t]]]
            q = tests.array[tests.first[t] : t_end[t]]
            # a pair that the word before carries on is part of a longer match, which another range has
            before_p, before_q = corpus.before(p), tests.before(q)
            for v in np.unique(before_p).tolist():
                pv = p[before_p == v]
                qv = q if v == 0 else q[before_q != v]
                if not len(qv):
                    continue
                step = max(1, AT_ONCE // len(qv))
                for lo in range(0, len(pv), step):
                    some = pv[lo : lo + step]
                    held.append((np.repeat(some, len(qv)), np.tile(qv, len(some))))
                    size += len(some) * len(qv)
                    if size >= AT_ONCE:
                        settle()
        settle()
        return [(docs[d][0], i, n, -a, -b) for (d, w), (n, a, b) in best.items() for i in self.items[w]]

    def _longest(self, corpus: Words, p: np.ndarray, q: np.ndarray, begins: np.ndarray, best: dict) -> None:
        """Lengths of the matches that begin at p and q; the best of each document and test text goes to `best`."""
        length = np.full(len(p), self.n)
        go = np.arange(len(p))
        while len(go):
            x, y = corpus.ids[p[go] + length[go]], self.words.ids[q[go] + length[go]]
            go = go[(x == y) & (x > 0)]
            length[go] += 1
        doc, text = np.searchsorted(begins, p, side="right") - 1, np.searchsorted(self.starts, q, side="right") - 1
        order = np.lexsort((q, p, -length, text, doc))
        doc, text, length, p, q = doc[order], text[order], length[order], p[order], q[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
        for d, w, n, a, b in zip(doc[new].tolist(), text[new].tolist(), length[new].tolist(), (p - begins[doc])[new].tolist(), (q - self.starts[text])[new].tolist()):
            one = (n, -a, -b)
            if (d, w) not in best or one > best[d, w]:
                best[d, w] = one


def leaks(documents: DataFrame, tests: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    """(doc_id, eval_id, n_words, doc_word, eval_word): each document with each test item of which it has at least n
    words in a row; length and word positions (from 0) of the longest such match, the first of equals.

    documents: (doc_id, text); tests: (eval_id, text), whose repeated texts all count. Null and empty texts match
    nothing; tests shorter than n words cannot leak. A word is ASCII, so accents part words. An eval_id with several
    texts is a task with each of them. Tests of more than MAX_TEST_BYTES raise ValueError.
    """
    spark = documents.sparkSession
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_TEST_BYTES:
        raise ValueError(f"{size} bytes of test texts; executors hold at most {MAX_TEST_BYTES}")
    many = -(-size // TEST_BYTES) or 1
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.encode("text", "UTF-8").alias("text"))
    shared = []
    for k in range(many):
        block = tests.where(f"text IS NOT NULL AND eval_id IS NOT NULL AND pmod(xxhash64(eval_id), {many}) = {k}")
        rows = [(r[0], bytes(r[1])) for r in block.select("eval_id", F.encode("text", "UTF-8")).distinct().collect()]
        shared.append(spark.sparkContext.broadcast(TestIndex(sorted(rows), n)))

    def search(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("eval_id", pa.int64()), *((c, pa.int32()) for c in ("n_words", "doc_word", "eval_word"))])
        docs, held = [], 0

        def flush():
            got = [r for index in shared for r in index.value.matches(docs)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*got), schema)] if got else [pa.array([], f.type) for f in schema], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                docs.append((i, words(raw)))
                held += len(raw)
                if held >= STRETCH:
                    yield flush()
                    docs, held = [], 0
        if docs:
            yield flush()

    found = texts.mapInArrow(search, SCHEMA)
    # a task or document with several rows is reported once, with its longest match
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("eval_word")).alias("e"))).alias("m")
    return found.groupBy("doc_id", "eval_id").agg(best).selectExpr("doc_id", "eval_id", "m.n_words", "-m.d AS doc_word", "-m.e AS eval_word")


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents without those that leak; a null doc_id is kept."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
