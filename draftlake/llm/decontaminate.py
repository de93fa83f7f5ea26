"""Benchmark passages in documents, found in a latent space and checked by common subsequences.

1. Texts are hashed once: a table holds, of each document, its number of words and the place and number of
   every word that the benchmark uses too.  All later passes read that table.
2. Passages are runs of PASSAGE words.  Terms are the benchmark's words, in TERMS hash cells;
   document frequencies of the cells come from all passages of all documents.
3. A randomised singular value decomposition of the passages' TF-IDF rows, with the benchmark's own
   rows at equal weight: one pass gives A'AX for a random X, whose orthonormal basis a second
   pass turns into singular vectors.  Each task sends its own sum, of fixed size.
4. Windows are projected by running sums over their terms and compared, in blocks of ITEMS, with the
   items of about their length (widths_of); those with a cosine of NEAR or more are candidates.
   Windows of PASSAGE words lie STRIDE apart, others in proportion.
5. Around candidates the longest common subsequence with the item must hold COVERED of the
   item's words within a span of at most SPAN times the item, and ANSWER of its last sentence's words.
   Regions in which no span holds so many of the item's words at all are left out before (reachable),
   which loses nothing.

The benchmark is the query set: it comes to the driver BENCH_ITEMS items at a time, and each such block is
searched by itself.  Null and empty texts have no passages.  Items without words match nothing, nor do items of one word, for
which any text with that word would be a match; repeated items are reported one by one, as are repeated documents.  Very long texts are searched whole; a run of texts
holds RUN places or one text.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import remove, save
from .sums import SUM_SCHEMA, sum_rows, summed

PASSAGE, STRIDE = 24, 8
TERMS, RANK, SPARE = 1 << 13, 96, 32
STEP, LEAST = 1.5, 4  # ratio of window lengths, and the least
CELLS = 1 << 22  # of the table that tells the benchmark's words
NEAR, COVERED, SPAN, ANSWER = 0.5, 0.7, 1.5, 0.5
COMMON = 0.05  # share of passages above which a word is no term, where its items have RARE others
RARE = 6
ITEMS = 4096
BENCH_ITEMS = 50_000
RUN = 8192  # places of the texts that are looked at together
SHORT = 24  # rows of a run that are added up row by row
PAIRS = 1 << 20  # words of candidate regions that are looked at together
_LAST = re.compile(r"[.!?。！？\n]+\s*")

U = np.uint64


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(41)).astype(np.int64) % CELLS


class Items:
    """The benchmark's items as word hashes, with the table that tells their words."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.words, self.answers = ids, [], []
        np.seterr(over="ignore")
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            self.words.append(W.words(data, W.MARKS)[2])
            ends = [m.end() for m in _LAST.finditer(text or "") if text[m.end() :].strip()]
            tail = (text or "")[ends[-1] :] if ends else text or ""
            self.answers.append(W.words(tail.encode("utf-8", "surrogatepass"), W.MARKS)[2])
        self.known = np.unique(np.concatenate([*self.words, np.zeros(0, U)]))
        self.term = (W.mix(self.known) % U(TERMS)).astype(np.int32)
        self.longest = np.array([len(w) for w in self.words], np.int64)
        self.masks: dict[int, tuple[dict[int, int], ...]] = {}

    @cached_property
    def table(self) -> np.ndarray:
        """For each cell the number of its word among known, -1 for none, -2 for several."""
        cell, first, count = np.unique(cells_of(self.known), return_index=True, return_counts=True)
        out = np.full(CELLS, -1, np.int32)
        out[cell] = np.where(count == 1, first, -2)
        return out

    @cached_property
    def held(self) -> np.ndarray:
        """Marks of all (word, item): a pair without mark is not one of an item's words."""
        word, item = np.concatenate([np.zeros(0, np.int64), *map(self.numbers, self.words)]), np.repeat(np.arange(len(self.words)), self.longest)
        out = np.zeros(1 << max(16, (32 * len(word)).bit_length()), bool)
        out[self.marked(word, item, len(out))] = True
        return out

    @staticmethod
    def marked(word: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
        x = (word.astype(U) << U(32)) + item.astype(U)
        return ((x * U(0x9E3779B97F4A7C15)) >> U(65 - size.bit_length())).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word among known; all must be known."""
        return np.searchsorted(self.known, h)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the words that are known."""
        number = self.table[cells_of(h)]
        place = np.flatnonzero(number != -1)
        number, h = number[place], h[place]
        several = np.flatnonzero(number == -2)
        number[several] = np.minimum(np.searchsorted(self.known, h[several]), len(self.known) - 1)
        same = self.known[number] == h if len(number) else np.zeros(0, bool)
        return place[same], number[same]

    def masks_of(self, i: int) -> tuple[dict[int, int], ...]:
        """Of item i: the places of each word as bits, and the same from the end; then both for its answer."""
        if i not in self.masks:
            both = (self.numbers(x).tolist() for x in (self.words[i], self.answers[i]))
            self.masks[i] = tuple(m for x in both for m in (masks(x), masks(x[::-1])))
        return self.masks[i]

    def choose(self, count: np.ndarray, passages: int) -> np.ndarray:
        """Weights (inverse document frequency) of the cells; common ones get 0 unless an item has little else."""
        idf = np.log((passages + 1) / (count + 1)) + 1e-3
        on = count <= COMMON * passages
        for w in self.words:
            t = self.term[self.numbers(w)]
            if on[t].sum() < RARE:
                on[t] = True
        return np.where(on, idf, 0.0)

    def rows(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF rows of the items."""
        out = np.zeros((len(self.words), TERMS))
        for r, w in enumerate(self.words):
            np.add.at(out[r], self.term[self.numbers(w)], 1.0)
        return out * idf


def encoded(docs: DataFrame, items) -> DataFrame:
    """doc_id, n_words, and of the words that the benchmark uses their places and numbers, 32 bits each; for texts with words."""
    names = ["doc_id", "n_words", "place", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            rows = []
            for at, h, bound in W.text_words(batch.column("text").to_pylist(), W.MARKS):
                place, number = items.value.found(h)
                cut = np.searchsorted(place, bound)
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if n := int(bound[k + 1] - bound[k]):
                        rows.append((at + k, n, (place[a:b] - bound[k]).astype(np.int32).tobytes(), number[a:b].tobytes()))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary())))], names=names)

    return docs.mapInArrow(run, "doc_id long, n_words long, place binary, number binary")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of encoded texts: index of the first, bounds of the texts in words, place and number of the known words."""
    size, places, numbers = (batch.column(c).to_pylist() for c in ("n_words", "place", "number"))
    at = 0
    while at < len(size):
        n, to = 0, at
        while to < len(size) and (to == at or n + len(places[to]) <= 4 * RUN):
            n += len(places[to])
            to += 1
        bound = np.concatenate([[0], np.cumsum(size[at:to])])
        place, number = (np.frombuffer(b"".join(x[at:to]), np.int32) for x in (places, numbers))
        yield at, bound, place + np.repeat(bound[:-1], [len(x) // 4 for x in places[at:to]]), number
        at = to


def _terms(batch: pa.RecordBatch, term: np.ndarray, weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: their bounds, and place and cell of the words that are terms."""
    for _, bound, place, number in _runs(batch):
        cell = term[number]
        if weight is not None:
            on = weight[cell] > 0
            place, cell = place[on], cell[on]
        yield bound, place, cell


def _passages(bound: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """The passage of each place, and how many passages the texts have."""
    n = -(-np.diff(bound) // PASSAGE)
    text = np.searchsorted(bound, place, side="right") - 1
    return (np.cumsum(n) - n)[text] + (place - bound[text]) // PASSAGE, int(n.sum())


def frequencies(docs: DataFrame, items) -> tuple[np.ndarray, int]:
    """Passages with each cell, and all passages, of encoded docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for bound, place, term in _terms(batch, items.value.term):
                passage, n = _passages(bound, place)
                total[:TERMS] += np.bincount(np.unique(passage * TERMS + term) % TERMS, minlength=TERMS)
                total[TERMS] += n
        yield from sum_rows(total)

    total = summed(docs.mapInArrow(run, SUM_SCHEMA), (TERMS + 1,), np.int64)
    return total[:TERMS], int(total[TERMS])


def summed_runs(parts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows of parts that begin at first; short runs row by row all at once, long ones one by one."""
    count = np.diff(np.append(first, len(parts)))
    out = parts[first].copy()
    for k in np.flatnonzero(count > SHORT).tolist():
        out[k] = parts[first[k] : first[k] + count[k]].sum(axis=0)
    for j in range(1, SHORT):
        k = np.flatnonzero((count > j) & (count <= SHORT))
        if not len(k):
            break
        out[k] += parts[first[k] + j]
    return out


def _products(batch: pa.RecordBatch, items: Items, idf: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the entries (passage, cell, value) of A, and A times x."""
    for bound, place, term in _terms(batch, items.term, idf):
        if len(place):
            passage, _ = _passages(bound, place)
            key, tf = np.unique(passage * TERMS + term, return_counts=True)
            row, cell = np.divmod(key, TERMS)
            value = (tf * idf[cell]).astype(np.float32)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            yield np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row)))), cell, value, summed_runs(x[cell] * value[:, None], first)


def singular_vectors(docs: DataFrame, items, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The RANK first right singular vectors (cells by columns) and singular values, of encoded docs."""
    own = items.value.rows(idf)
    x = np.random.default_rng(11).standard_normal((TERMS, RANK + SPARE)).astype(np.float32)
    spark = docs.sparkSession

    def gram_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, x.shape[1]), np.float32)
        weight = sent.value
        for batch in batches:
            for row, cell, value, y in _products(batch, items.value, weight, x):
                order = np.argsort(cell, kind="stable")
                c = cell[order]
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                total[c[first]] += summed_runs(y[row[order]] * value[order][:, None], first)
        yield from sum_rows(total)

    def small_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = basis.value, 0.0
        for batch in batches:
            for *_, y in _products(batch, items.value, sent.value, q):
                total = total + (y.T @ y).astype(np.float64)
        yield from sum_rows(total + np.zeros((q.shape[1],) * 2))

    sent = spark.sparkContext.broadcast(idf)
    z = summed(docs.mapInArrow(gram_times, SUM_SCHEMA), x.shape, np.float32).astype(np.float64)
    z_own = own.T @ (own @ x)
    scale = np.linalg.norm(z) / max(np.linalg.norm(z_own), 1e-9) if np.any(z) else 1.0
    q, _ = np.linalg.qr(z + scale * z_own)
    basis = spark.sparkContext.broadcast(q.astype(np.float32))
    b = summed(docs.mapInArrow(small_gram, SUM_SCHEMA), (q.shape[1],) * 2, np.float64)
    y = own @ q
    value, vector = np.linalg.eigh(b + scale * (y.T @ y))
    top = np.argsort(-value)[:RANK]
    return (q @ vector[:, top]).astype(np.float32), np.sqrt(np.maximum(value[top], 0))


def masks(words: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    bits: dict[int, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def _longest(bits: dict[int, int], size: int, y: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence of a text, by its masks and size, with y, and the first place where y has it."""
    v = full = (1 << size) - 1
    best, end = 0, -1
    for j, w in enumerate(y):
        if m := bits.get(w):
            v = ((v + (v & m)) | (v & ~m)) & full
            n = size - v.bit_count()
            if n > best:
                best, end = n, j
    return best, end


def _common(forth: dict[int, int], back: dict[int, int], size: int, y: list[int]) -> tuple[int, int, int]:
    n, end = _longest(forth, size, y)
    return (n, end - _longest(back, size, y[end::-1])[1], end) if n else (0, 0, 0)


def common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of item a with b, first and last place in b that it can span."""
    x = a.tolist()
    return _common(masks(x), masks(x[::-1]), len(x), b.tolist())


def widths_of(length: int) -> tuple[int, int]:
    """Lengths of the windows for an item: the nearest to its own, for close copies, and the next, for stretched ones."""
    k = round(math.log(max(1, length) / PASSAGE, STEP))
    return max(LEAST, round(PASSAGE * STEP**k)), max(LEAST, round(PASSAGE * STEP ** (k + 1)))


def _need(n):
    """Words that an item of n words must have in common with a text, at least."""
    return np.ceil(COVERED * n - 1e-9).astype(np.int64)


def reachable(items: Items, item: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which regions (item, from low to before high) have a span with as many of the item's words as a match needs."""
    first, last = np.searchsorted(place, low), np.searchsorted(place, high)
    size, out, at = last - first, np.zeros(len(item), bool), 0
    total = np.cumsum(size)
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = size[at:to]
        of = np.repeat(np.arange(at, to), n)
        k = np.arange(len(of)) + np.repeat(first[at:to] - (np.cumsum(n) - n), n)
        on = items.held[items.marked(number[k], item[of], len(items.held))]
        of, p = of[on], place[k[on]]
        need = _need(items.longest[item[of]])
        end = np.minimum(np.arange(len(of)) + need - 1, len(of) - 1)
        near = (np.arange(len(of)) + need <= len(of)) & (of[end] == of) & (p[end] - p < (SPAN * items.longest[item[of]]).astype(np.int64))
        out[of[near]] = True
        at = to
    return out


def best_place(items: Items, i: int, place: list[int], word: list[int]) -> tuple[float, int, int] | None:
    """Coverage, first place and span of item i among words (numbers) at rising places, or None."""
    size, n_answer = len(items.words[i]), len(items.answers[i])
    forth, back, a_forth, a_back = items.masks_of(i)
    need, span = int(_need(size)), int(SPAN * size)
    on = [k for k, w in enumerate(word) if w in forth]
    if not size or len(on) < need:
        return None
    place, word = [place[k] for k in on], [word[k] for k in on]

    def answered(first: int, last: int) -> bool:
        return not n_answer or _common(a_forth, a_back, n_answer, word[first : last + 1])[0] >= ANSWER * n_answer

    n, first, last = _common(forth, back, size, word)
    if n < need:
        return None
    if place[last] - place[first] < span and answered(first, last):
        return n / size, place[first], place[last] - place[first] + 1
    # The longest one is stretched or lacks the answer: take the best of all runs as long as the span.
    best, stop = (0, 0, 0), np.searchsorted(place, np.array(place) + span).tolist()
    for k, end in enumerate(stop):
        if end - k >= need and end - k > best[0]:
            n, first, last = _common(forth, back, size, word[k:end])
            if n >= need and n > best[0] and answered(k + first, k + last):
                best = n, place[k + first], place[k + last]
                if n == size:
                    break
    n, first, last = best
    return (n / size, first, last - first + 1) if n else None


def _match(items: Items, i: int, h: np.ndarray, low: int, high: int) -> tuple[float, int, int] | None:
    """Coverage, first word and span of item i in words low to high of a text, or None."""
    place, number = items.found(h[low:high])
    return best_place(items, i, (place + low).tolist(), number.tolist())


def matches(docs: DataFrame, items, idf: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """doc_id, item_id, coverage, cosine, first_word, n_words: the best place of each item in each of the encoded docs."""
    spark = docs.sparkSession
    rows = items.value.rows(idf) @ vectors
    length = np.linalg.norm(rows, axis=1)
    rows = (rows / np.maximum(length, 1e-12)[:, None]).astype(np.float32)
    sent = spark.sparkContext.broadcast((idf, (vectors * idf[:, None]).astype(np.float32), rows))
    names = ["doc_id", "item_id", "coverage", "cosine", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        weight, project, item_rows = sent.value
        bench = items.value
        alike: dict[int, list[int]] = {}
        for k, n in enumerate(bench.longest.tolist()):
            for width in set(widths_of(n)) if n else ():
                alike.setdefault(width, []).append(k)
        compared = [(width, np.array(k), np.ascontiguousarray(item_rows[k].T)) for width, k in sorted(alike.items())]
        for batch in batches:
            out = []
            for at, bound, place, number in _runs(batch):
                text, i, start, end, cos = _near(bound, place, bench.term[number], weight, project, compared)
                if not len(text):
                    continue
                # Candidates of one text and item that lie within reach of each other are one region.
                order = np.lexsort((start, i, text))
                text, i, start, end, cos = (x[order] for x in (text, i, start, end, cos))
                far = (start[1:] - start[:-1]) > bench.longest[i[1:]]
                fresh = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (i[1:] != i[:-1]) | far]))
                end, cos = np.maximum.reduceat(end, fresh), np.maximum.reduceat(cos, fresh)
                text, i, start = text[fresh], i[fresh], start[fresh]
                reach = (SPAN * bench.longest[i]).astype(np.int64)
                low, high = np.maximum(bound[text], start - reach), np.minimum(bound[text + 1], end + reach)
                for k in np.flatnonzero(reachable(bench, i, low, high, place, number)).tolist():
                    a, b = np.searchsorted(place, (low[k], high[k]))
                    found = best_place(bench, int(i[k]), place[a:b].tolist(), number[a:b].tolist())
                    if found:
                        out.append((at + int(text[k]), int(i[k]), found[0], float(cos[k]), found[1] - int(bound[text[k]]), found[2]))
            best: dict[tuple[int, int], tuple] = {}
            for r in out:
                if (key := r[:2]) not in best or (r[2], -r[4]) > (best[key][2], -best[key][4]):
                    best[key] = r
            rows_ = list(best.values())
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows_], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([bench.ids[r[1]] for r in rows_], pa.int64()), *(pa.array([r[c] for r in rows_], t) for c, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.int64()), (5, pa.int64())))], names=names)

    return docs.mapInArrow(run, "doc_id long, item_id long, coverage double, cosine double, first_word long, n_words long")


def _near(bound: np.ndarray, place: np.ndarray, term: np.ndarray, weight: np.ndarray, project: np.ndarray, compared: list[tuple]) -> tuple[np.ndarray, ...]:
    """Text, item, start, end and cosine of the windows that are near an item."""
    on = weight[term] > 0
    place, term = place[on], term[on]
    sums = np.zeros((len(place) + 1, project.shape[1]), np.float32 if len(place) < 1 << 14 else np.float64)
    np.cumsum(project[term], axis=0, out=sums[1:])
    hits = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.float32),)]
    for width, which, near in compared if len(place) else ():
        stride = max(1, width * STRIDE // PASSAGE)
        n = np.maximum(0, -(-(np.diff(bound) - width) // stride)) + (np.diff(bound) > 0)
        text = np.repeat(np.arange(len(n)), n)
        start = bound[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
        end = np.minimum(start + width, bound[text + 1])
        lo, hi = np.searchsorted(place, start), np.searchsorted(place, end)
        some = np.flatnonzero(hi - lo >= 2)
        text, start, end, lo, hi = (x[some] for x in (text, start, end, lo, hi))
        for k in range(0, len(text), 1024):
            part = slice(k, k + 1024)
            v = (sums[hi[part]] - sums[lo[part]]).astype(np.float32, copy=False)
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)[:, None]
            for block in range(0, len(which), ITEMS):
                cos = v @ near[:, block : block + ITEMS]
                flat = np.flatnonzero(cos.ravel() >= NEAR)
                w, i = np.divmod(flat, cos.shape[1])
                hits.append((text[w + k], which[i + block], start[w + k], end[w + k], cos.ravel()[flat]))
    return tuple(np.concatenate([x[c] for x in hits]) for c in range(5))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold items (item_id, text), with the place of the best match of each pair."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, coverage double, cosine double, first_word long, n_words long")
    for rows in batched(bench.orderBy("item_id", "text").toLocalIterator(), BENCH_ITEMS):
        items = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
        places = save(encoded(docs, items), "places")
        count, passages = frequencies(places, items)
        idf = items.value.choose(count, passages)
        vectors, _ = singular_vectors(places, items, idf)
        found = found.union(save(matches(places, items, idf, vectors), "leaks"))
        remove(spark, places.inputFiles()[0].rsplit("/", 1)[0])
    return found
