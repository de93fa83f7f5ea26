"""Language of each word, and of each document, by a linear-chain conditional random field.

Words are runs of letters; chains are runs of CHAIN words of a text, so that long texts cost
no more a word than short ones.  A word's score for a language is the sum of the weights of its
features: affixes up to three letters, pairs and triples of letters, and membership in the lexicon
of frequent words of each language.  Weights of features and of transitions between languages are
learned together from PER_LANGUAGE snippets of each language, half of them joined with another
one's, so that changes within a text are seen.  Forward-backward gives each word's
posterior; a document's language is the one with the largest mean posterior, which is its score, and
runs of words with one likeliest language are its spans.

A text without a letter, or null, is ``und`` with score 0 and has no spans, as is all when nothing is labelled.
Where only one language is labelled, every text with letters has that one.  Each row is judged by
its text alone, whatever its length; repeated rows get equal answers.  ``languages`` ignores other columns;
``predict`` keeps them, and a column named like one of its own gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

PER_LANGUAGE = 600  # expected snippets of each language in the training sample
SNIPPET = 400  # characters of a snippet, from a place in the text that its hash names
LEXICON = 1500  # frequent words of each language
FEATURES = 1 << 15
CHAIN, EPOCHS, RATE = 64, 4, 0.3

#: Runs of ASCII letters and of all bytes above ASCII.
LETTERS = np.ones(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
W._FIND[id(LETTERS)] = re.compile(rb"[^A-Za-z\x80-\xff]")
_LETTERS = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


class Field:
    """Weights of a linear chain over the labels."""

    def __init__(self, labels: list[str], lexicon: dict[str, list[str]]):
        self.labels, k = labels, len(labels)
        self.lexicon: dict[str, list[int]] = {}
        for j, label in enumerate(labels):
            for word in lexicon[label]:
                self.lexicon.setdefault(word, []).append(j)
        self.weights = np.zeros((FEATURES + k, k), np.float32)
        self.moves = np.zeros((k, k), np.float32)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of all words, one word after the other, and where each word's start; words have letters only."""
        np.seterr(over="ignore")
        joined = "\n".join(words).lower()
        a = np.concatenate([[10], np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), [10]]).astype(np.uint64)
        edge = np.flatnonzero(a == 10)
        first, last = edge[:-1] + 1, edge[1:] - 1
        size = last - first + 1
        found, owner, at = [], [], np.arange(len(words))
        letters = np.flatnonzero(a != 10)
        word_of = np.repeat(at, size)
        for n, salt in ((2, 1), (3, 2)):
            on = letters[np.arange(len(letters)) + n <= np.repeat(np.cumsum(size), size)]
            h = np.full(len(on), salt, np.uint64)
            for k in range(n):
                h = W.mix(h * np.uint64(31) + a[on + k])
            found.append(h)
            owner.append(word_of[np.arange(len(letters)) + n <= np.repeat(np.cumsum(size), size)])
        for start, step, salt in ((first, 1, 3), (last, -1, 4)):
            h = np.full(len(words), salt, np.uint64)
            for k in range(3):
                on = np.flatnonzero(size > k)
                h[on] = W.mix(h[on] * np.uint64(31) + a[start[on] + step * k])
                found.append(h[on])
                owner.append(on)
        numbers = [(x >> np.uint64(20)).astype(np.int64) % FEATURES for x in found]
        pairs = [(i, FEATURES + j) for i, w in enumerate(joined.split("\n")) if w in self.lexicon for j in self.lexicon[w]]
        owner.append(np.array([i for i, _ in pairs], np.int64))
        numbers.append(np.array([f for _, f in pairs], np.int64))
        owner, numbers = np.concatenate(owner), np.concatenate(numbers)
        order = np.argsort(owner, kind="stable")
        return numbers[order], np.searchsorted(owner[order], at)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        number, start = self.features(words)
        width = np.diff(np.append(start, len(number)))
        sums = np.empty((len(words), len(self.labels)), np.float32)
        for j in range(len(self.labels)):
            sums[:, j] = np.add.reduceat(self.weights[:, j][number], start)
        return sums / np.sqrt(width)[:, None].astype(np.float32)

    def posteriors(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chains (chain, word, label) of the given sizes: word posteriors, and summed posteriors of moves."""
        n, t, k = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        e[np.arange(t)[None, :] >= sizes[:, None]] = 1.0
        move = np.exp(self.moves - self.moves.max())
        alpha, beta, z = np.empty_like(e), np.ones_like(e), np.empty((n, t, 1), e.dtype)
        a = e[:, 0]
        for i in range(t):
            if i:
                a = (alpha[:, i - 1] @ move) * e[:, i]
            z[:, i] = a.sum(axis=1, keepdims=True)
            alpha[:, i] = a / z[:, i]
        for i in range(t - 2, -1, -1):
            b = ((beta[:, i + 1] * e[:, i + 1]) @ move.T) / z[:, i + 1]
            last = (i + 1 >= sizes)[:, None]  # words behind the end say nothing
            beta[:, i] = np.where(last, 1.0, b)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        pair = np.zeros((k, k))
        for i in range(t - 1):
            on = i + 1 < sizes
            m = alpha[on, i, :, None] * move * (beta[on, i + 1] * e[on, i + 1])[:, None, :]
            pair += (m / m.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return post, pair

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word posteriors only."""
        e = np.ascontiguousarray(np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2))
        t = len(e)
        move = np.exp(self.moves - self.moves.max()).astype(e.dtype)
        ones = np.ones(e.shape[2], e.dtype)
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            a = np.matmul(alpha[i - 1], move, out=alpha[i])
            a *= e[i]
            a /= (a @ ones)[:, None]
        b = np.ones_like(e[0])
        for i in range(t - 2, -1, -1):
            b = (b * e[i + 1]) @ move.T
            b /= (b @ ones)[:, None]
            b[i + 1 >= sizes] = 1.0
            alpha[i] *= b
        return (alpha / alpha.sum(axis=2, keepdims=True)).transpose(1, 0, 2)


def fit(snippets: list[tuple[str, str]]) -> Field | None:
    """Learn a field from (text, language) pairs; None without any word."""
    texts = [(_LETTERS.findall(t), label) for t, label in snippets]
    texts = sorted(((w[:CHAIN], label) for w, label in texts if w), key=lambda x: (x[1], x[0]))
    labels = sorted({label for _, label in texts})
    if not labels:
        return None
    counts = {label: Counter() for label in labels}
    for w, label in texts:
        counts[label].update(x.lower() for x in w)
    field = Field(labels, {x: [w for w, n in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:LEXICON] if n > 1] for x, c in counts.items()})
    rng = np.random.default_rng(7)
    number = {x: j for j, x in enumerate(labels)}
    chains = []
    order, other = rng.permutation(len(texts)), rng.permutation(len(texts))
    for turn, (a, b) in enumerate(zip(order, other, strict=True)):
        (w, x), (v, y) = texts[a], texts[b]
        if turn % 2:
            w, v = w[: CHAIN // 2], v[: CHAIN // 2]
            chains.append((w + v, [number[x]] * len(w) + [number[y]] * len(v)))
        else:
            chains.append((w, [number[x]] * len(w)))
    types = sorted({x for w, _ in chains for x in w})
    place = {x: i for i, x in enumerate(types)}
    flat, starts = field.features(types)
    feats = np.split(flat, starts[1:])
    width = np.diff(np.append(starts, len(flat)))
    share = (1 / np.sqrt(width))[:, None]
    k, seen_w, seen_m = len(labels), np.full(field.weights.shape, 1e-6, np.float32), np.full((len(labels),) * 2, 1e-6)
    for _ in range(EPOCHS):
        for at in range(0, len(chains), 128):
            part = chains[at : at + 128]
            sizes = np.array([len(w) for w, _ in part])
            ids, gold = np.zeros((2, len(part), sizes.max()), np.int64)
            for r, (w, y) in enumerate(part):
                ids[r, : len(w)], gold[r, : len(w)] = [place[x] for x in w], y
            table = np.add.reduceat(field.weights[flat], starts, axis=0) * share
            post, pair = field.posteriors(table[ids].astype(np.float64), sizes)
            on = np.arange(ids.shape[1])[None, :] < sizes[:, None]
            grad = np.zeros((len(types), k))
            np.add.at(grad, ids[on], np.eye(k)[gold[on]] - post[on])
            used = np.flatnonzero(np.abs(grad).sum(axis=1))
            moved = np.zeros((k, k))
            both = on[:, 1:]
            np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            step = np.zeros(field.weights.shape)
            if len(used):
                np.add.at(step, np.concatenate([feats[i] for i in used]), np.repeat((grad * share)[used], width[used], axis=0))
            step = step / len(part) - 1e-5 * field.weights
            seen_w += step**2
            field.weights += (RATE * step / np.sqrt(seen_w)).astype(np.float32)
            step_m = (moved - pair) / len(part)
            seen_m += step_m**2
            field.moves += (RATE * step_m / np.sqrt(seen_m)).astype(np.float32)
    return field


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Snippets of labelled rows that are not held out: about PER_LANGUAGE of each language, chosen and cut by a hash of the text."""
    open_ = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row for each language
    if not sizes:
        return []
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(n))])[F.col("lang")]
    key = F.xxhash64("text")
    drawn = open_.withColumn("n", share).filter(F.col("n").isNotNull() & (F.pmod(key, F.col("n")) < PER_LANGUAGE))
    start = F.pmod(F.shiftrightunsigned(key, 20), F.greatest(F.lit(1), F.length("text") - SNIPPET)).cast("int") + 1
    cut = drawn.select(F.substring(F.col("text"), start, F.lit(SNIPPET)).alias("text"), "lang").dropDuplicates()
    return [(r["text"], r["lang"]) for r in cut.limit(2 * PER_LANGUAGE * len(sizes)).collect()]


class Judge:
    """Documents judged by their words' posteriors."""

    def __init__(self, field: Field):
        self.field = field

    def _scores(self, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Scores of all words, found once for each different one."""
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        return self.field.scores([data[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])[which]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[np.ndarray]]:
        """Of each text the language, its score, and the spans as rows (first word, words, number of the label)."""
        names, scores, spans = [], [], []
        k = len(self.field.labels)
        for at, to, data, starts in W.in_pieces(texts):
            start, end, h = W.words(data, LETTERS)
            bound = np.searchsorted(start, starts)
            total, runs, cut = np.zeros((to - at, k)), np.zeros((0, 3), np.int64), np.zeros(to - at + 1, np.int64)
            if len(h):
                s = self._scores(data, start, end, h)
                n = np.diff(bound)
                doc = np.repeat(np.arange(to - at), n)
                within = np.arange(len(h)) - np.repeat(bound[:-1], n)
                fresh = np.flatnonzero(within % CHAIN == 0)
                sizes = np.diff(np.append(fresh, len(h)))
                post = np.empty((len(h), k), np.float32)
                # Chains of about one length go together, so that short ones are not padded to CHAIN.
                order = np.argsort(sizes, kind="stable")
                for part in np.split(order, np.searchsorted(sizes[order], (5, 9, 17, 33, CHAIN))):
                    if len(part):
                        place = fresh[part][:, None] + np.arange(sizes[part].max())[None, :]
                        on = np.arange(place.shape[1])[None, :] < sizes[part][:, None]
                        post[place[on]] = self.field.marginals(s[np.minimum(place, len(h) - 1)], sizes[part])[on]
                for j in range(k):
                    total[:, j] = np.bincount(doc, post[:, j], minlength=to - at)
                label = post.argmax(axis=1)
                first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                runs = np.stack([within[first], np.diff(np.append(first, len(h))), label[first]], axis=1)
                cut = np.searchsorted(first, bound)
            for text, row, n, a, b in zip(texts[at:to], total, np.diff(bound), cut[:-1], cut[1:], strict=True):
                if not n or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    spans.append(runs[:0])
                else:
                    names.append(self.field.labels[int(row.argmax())])
                    scores.append(min(1.0, float(row.max() / n)))
                    spans.append(runs[a:b])
        return names, scores, spans


_SPAN = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType())]))


def _span_column(spans: list[np.ndarray], labels: list[str]) -> pa.Array:
    rows = np.concatenate([np.zeros((0, 3), np.int64), *spans]).astype(np.int32)
    named = pa.array(labels, pa.string()).take(pa.array(rows[:, 2]))
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), named], names=["first_word", "n_words", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), parts)


def predict(docs: DataFrame, field: Field | None, text_col: str = "text", spans: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with spans also the runs of words of one language (first_word, n_words, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # FEATURES rows of a weight for each language
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", _SPAN)] if spans else [])]
    docs = docs.select(*(c for c in docs.columns if c not in {e.name for e in extra}))
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        judge = Judge(shared.value) if shared.value is not None else None
        for batch in (b.slice(first, 512) for b in batches for first in range(0, b.num_rows, 512)):
            part = batch.column(at).to_pylist()
            names, scores, found = judge.judge(part) if judge else (["und"] * len(part), [0.0] * len(part), [np.zeros((0, 3), np.int64)] * len(part))
            added = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), *([_span_column(found, judge.field.labels if judge else [])] if spans else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, *(e.name for e in extra)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    field = fit(training_sample(docs))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), field, spans=True).drop("text")
