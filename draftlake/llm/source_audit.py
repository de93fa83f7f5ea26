"""How far the word use of sources of one language diverges, by single-pass in-memory indexing.

1. Each task reads its documents once and builds block postings in memory: for each language, term and source the
   occurrences, and for each language and term the documents.  When ``RUN_ENTRIES`` are held, or the input ends, the block
   is spilled: cut by hash shard, each shard's terms sorted, as a run of chunks of at most ``CHUNK`` terms.
2. Runs are dealt by shard and read in the order of their chunks' first terms.  A heap merges them: it holds one chunk of each run at a time, adds up equal terms,
   and yields the terms that enough documents of the language have, with their frequencies by source.
3. A group's share of a term is ``p = 1 + floor(PARTS * (count + 5) / (N + 5 V))``, N its occurrences of kept terms, V their
   number.  Two groups differ by ``V * |p0 - p0'|``, p0 the share of a term that a group lacks, but for terms that one of
   them has.  These corrections are streamed: terms that only one has come from counts of equal shares, terms that both have from the postings of each term
   in turn, added up by pair before they are shuffled.

All arithmetic is in whole numbers.  Null texts, languages and sources count as ''; repeated rows count each; texts of any length are read in
pieces, so that a piece, a text's distinct terms and a block are what a task holds.  Groups without terms have
shares like others; a language without kept terms has value 0 for each pair.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, save

PARTS, PRIOR = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
RUN_ENTRIES = 1 << 18  # postings and terms that a block holds
CHUNK = 2048  # terms of a run that are merged at a time
SQUARE = 1024  # sources of a language whose pairs a task holds as a square of numbers
PAIRS = 1 << 20  # corrections of more sources that a task holds before it adds up those of one pair
SALT = 32  # parts of a language that meet its groups apart
PIECE = 1 << 20  # bytes of a text looked at together
#: A term is a run of characters other than ASCII ones that are not letters; A-Z count as a-z.  All other bytes become blanks.
_PLAIN = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_APART = re.compile(rb"[^A-Za-z\x80-\xff]")

_RUN = "shard int, lang string, first binary, terms binary, docs binary, n binary, source binary, count binary, sources array<string>"
_KEPT = "lang string, term string, sources array<string>, counts array<long>"


def text_terms(text: str | None) -> Iterator[list[bytes]]:
    """A text's terms, as UTF-8, in lists of a piece each."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        cut = _APART.search(data, at + PIECE)
        to = cut.end() if cut else len(data)
        yield data[at:to].translate(_PLAIN).split()
        at = to


class Block:
    """Postings held in memory: occurrences by language and source, documents by language."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.entries = 0

    def add(self, lang: str, source: str, text: str | None) -> None:
        counts, docs, seen = self.counts[lang][source], self.docs[lang], set()
        before = len(counts) + len(docs)
        for terms in text_terms(text):
            counts.update(terms)
            seen.update(terms)
        docs.update(seen)
        self.entries += len(counts) + len(docs) - before

    def runs(self, shards: int) -> Iterator[dict]:
        """The block's chunks, each shard's terms in order."""
        for lang, counts in self.counts.items():
            terms, sources = sorted(self.docs[lang]), sorted(counts)
            if not terms:
                continue
            rank = dict(zip(terms, range(len(terms)), strict=True))
            of = np.fromiter(chain.from_iterable(map(rank.__getitem__, counts[s]) for s in sources), np.int64)
            count = np.fromiter(chain.from_iterable(counts[s].values() for s in sources), np.int64)
            source = np.repeat(np.arange(len(sources)), [len(counts[s]) for s in sources])
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards
            dealt = np.argsort(shard, kind="stable")  # terms by shard, in order within
            place = np.empty(len(terms), np.int64)
            place[dealt] = np.arange(len(terms))
            order = np.argsort(place[of], kind="stable")
            count, source = count[order], source[order]
            n = np.bincount(of, minlength=len(terms))[dealt]
            docs = np.fromiter(map(self.docs[lang].__getitem__, terms), np.int64, len(terms))[dealt]
            ends, shard = np.concatenate([[0], np.cumsum(n)]), shard[dealt]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for first, end in zip(cuts, [*cuts[1:], len(terms)], strict=True):
                for a in range(first, end, CHUNK):
                    b = min(a + CHUNK, end)
                    part = [terms[k] for k in dealt[a:b]]
                    there, at = np.unique(source[ends[a] : ends[b]], return_inverse=True)
                    yield {
                        "shard": int(shard[a]), "lang": lang, "first": part[0], "terms": b"\n".join(part), "docs": docs[a:b].tobytes(), "n": n[a:b].astype(np.int32).tobytes(),
                        "source": at.astype(np.int32).tobytes(), "count": count[ends[a] : ends[b]].tobytes(), "sources": [sources[k] for k in there],
                    }


def _indexed(shards: int, most: int):
    """Chunks of runs, and a row (shard null, lang, sources) of the groups that a task has seen."""
    names = [c.split()[0] for c in _RUN.split(", ")]

    def rows(found: list[dict]) -> pa.RecordBatch:
        types = [pa.int32(), pa.string(), *[pa.binary()] * 6, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], t) for c, t in zip(names, types, strict=True)], names=names)

    def spilled(block: Block) -> Iterator[pa.RecordBatch]:
        part = []
        for r in block.runs(shards):
            part.append(r)
            if len(part) == 512:
                yield rows(part)
                part = []
        if part:
            yield rows(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = Block(), defaultdict(set)
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                seen[lang].add(source)
                block.add(lang, source, text)
                if block.entries >= most:
                    yield from spilled(block)
                    block = Block()
        yield from spilled(block)
        if seen:
            yield rows([{"lang": lang, "sources": sorted(sources)} for lang, sources in seen.items()])

    return run


def _opened(row: dict) -> Iterator[tuple[bytes, int, tuple]]:
    """The terms of a chunk in order, with their documents and where their postings are."""
    sources, place, count = row["sources"], np.frombuffer(row["source"], np.int32), np.frombuffer(row["count"], np.int64)
    ends = np.cumsum(np.frombuffer(row["n"], np.int32)).tolist()
    at = 0
    for term, docs, end in zip(row["terms"].split(b"\n"), np.frombuffer(row["docs"], np.int64).tolist(), ends, strict=True):
        yield term, docs, (sources, place, count, at, end)
        at = end


def _by_source(found: list[tuple]) -> dict[str, int]:
    of: dict[str, int] = {}
    for sources, place, count, at, end in found:
        for k, n in zip(place[at:end].tolist(), count[at:end].tolist(), strict=True):
            of[sources[k]] = of.get(sources[k], 0) + n
    return of


def merged(chunks: Iterator[dict], least: int) -> Iterator[tuple[str, bytes, dict[str, int]]]:
    """(lang, term, occurrences by source) of the terms of least documents or more, from chunks in order of shard, language and first term."""
    heap, tie = [], 0
    ahead = next(chunks, None)
    while ahead is not None or heap:
        # A chunk enters when no term before its first is left.
        while ahead is not None and (not heap or (ahead["shard"], ahead["lang"], ahead["first"]) <= heap[0][:3]):
            terms = _opened(ahead)
            term, docs, postings = next(terms)
            heapq.heappush(heap, (ahead["shard"], ahead["lang"], term, tie, docs, postings, terms))
            tie, ahead = tie + 1, next(chunks, None)
        shard, lang, term = heap[0][:3]
        total, found = 0, []
        while heap and heap[0][2] == term and heap[0][1] == lang and heap[0][0] == shard:
            *_, order, docs, postings, terms = heap[0]
            total += docs
            found.append(postings)
            after = next(terms, None)
            if after is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (shard, lang, after[0], order, after[1], after[2], terms))
        if total >= least:
            yield lang, term, _by_source(found)


def _frequencies(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list) -> pa.RecordBatch:
            columns = zip(*((lang, term.decode("utf-8", "surrogatepass"), list(of), list(of.values())) for lang, term, of in found), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["lang", "term", "sources", "counts"])

        part = []
        for found in merged((row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()), least):
            part.append(found)
            if len(part) == 2048:
                yield rows(part)
                part = []
        if part:
            yield rows(part)

    return run


def indexed(docs: DataFrame, least_docs: int = LEAST_DOCS, run_entries: int = RUN_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, sources, counts) and groups (lang, source) of documents (text, lang, source)."""
    shards = max(16, 2 * partitions(docs.sparkSession))
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    runs = save(docs.mapInArrow(_indexed(shards, run_entries), _RUN), "runs", "lz4")
    groups = runs.filter("shard IS NULL").select("lang", F.explode("sources").alias("source")).distinct()
    dealt = runs.filter("shard IS NOT NULL").repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    return save(dealt.mapInArrow(_frequencies(least_docs), _KEPT), "terms"), save(groups, "groups")


def share(count: Column, n: Column, v: Column) -> Column:
    whole = [x.cast("decimal(38,0)") for x in (count + PRIOR, n + PRIOR * v)]
    return F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * whole[0].cast("decimal(27,0)"), whole[1]) + 1


class PairSums:
    """Sums by pairs of one language's sources: a square of numbers while they are few, else keys and values that are added up when they are many."""

    def __init__(self, lang: str):
        self.lang, self.number, self.square, self.held, self.n = lang, {}, np.zeros((0, 0), np.int64), [], 0

    def add(self, sources: list[str], p: np.ndarray, p0: np.ndarray) -> None:
        """What a term that all these sources have adds for each pair of them."""
        at = np.array([self.number.setdefault(s, len(self.number)) for s in sources], np.int64)
        if len(self.number) > len(self.square) and len(self.number) <= SQUARE:
            size = min(SQUARE, 2 * len(self.number))
            self.square = np.pad(self.square, (0, size - len(self.square)))
        for k in range(0, len(at), SQUARE):
            row = slice(k, k + SQUARE)
            value = np.abs(p[row, None] - p) - np.abs(p[row, None] - p0) - np.abs(p0[row, None] - p) + np.abs(p0[row, None] - p0)
            if len(self.number) <= SQUARE:
                self.square[np.ix_(at[row], at)] += value
            else:
                self.held.append((((at[row, None] << 32) | at).ravel(), value.ravel()))
                self.n += value.size
                if self.n >= PAIRS:
                    self.held = [self._summed()]
                    self.n = len(self.held[0][0])

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([v for _, v in self.held]))
        return keys, total

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All sums so far; the next ones start anew."""
        g, h = np.nonzero(self.square)
        parts = [(g, h, self.square[g, h])] if len(g) else []
        if self.held:
            keys, total = self._summed()
            parts.append((keys >> 32, keys & 0xFFFFFFFF, total))
        names = pa.array(list(self.number), pa.string())
        for g, h, total in parts:
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(h)), pa.array(total)], names=["lang", "source", "other", "value"])
        self.number, self.square, self.held, self.n = {}, np.zeros((0, 0), np.int64), [], 0


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, other, value): what terms that both sources have add, summed for each pair."""
    sums: dict[str, PairSums] = {}
    for batch in batches:
        posted = batch.column("posted")
        flat, ends = posted.flatten(), posted.value_lengths().to_numpy().cumsum()
        source, (p, p0) = flat.field("source").to_pylist(), (flat.field(c).to_numpy() for c in ("p", "p0"))
        at = 0
        for lang, end in zip(batch.column("lang").to_pylist(), ends.tolist(), strict=True):
            of = sums.setdefault(lang, PairSums(lang))
            of.add(source[at:end], p[at:end], p0[at:end])
            at = end
            if of.n >= PAIRS // 2:
                yield from of.rows()
    for of in sums.values():
        yield from of.rows()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance from the other sources of its language, and its most overused terms."""
    terms, groups = indexed(docs, least_docs, run_entries)
    counted = terms.select("lang", F.posexplode("sources").alias("k", "source"), "counts").groupBy("lang", "source").agg(F.sum(F.col("counts")[F.col("k")]).alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))
    groups = groups.join(counted, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", n.alias("n"), v.alias("v"), "total")
    groups = save(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0)), "groups")

    posted = terms.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    posted = posted.select("lang", "term", "all", F.col("x.sources").alias("source"), F.col("x.counts").alias("count")).join(groups, ["lang", "source"])
    posted = save(posted.select("lang", "term", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("all"), F.col("total"), F.col("v")).alias("q"), "p0"), "posted")

    over = posted.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    # Each group meets the others of its language; parts of a language's groups meet them apart.
    salt = F.pmod(F.xxhash64("source"), F.lit(SALT)).cast("int")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = groups.withColumn("salt", salt).join(others, ["lang", "salt"]).filter("source <> other")
    base = pairs.select("lang", "source", "other", (F.col("v") * F.abs(F.col("p0") - F.col("other_p0"))).alias("value"))
    # Shares of one size count together; what p gives beyond p0 against a source without the term.
    equal = posted.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    lone = equal.withColumn("salt", salt).join(others, ["lang", "salt"]).filter("source <> other")
    lone = lone.groupBy("lang", "source", "other").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("other_p0")) - F.abs(F.col("p0") - F.col("other_p0")))).alias("value"))
    both = posted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posted")).filter(F.size("posted") > 1)
    both = both.select("lang", "posted").mapInArrow(_corrections, "lang string, source string, other string, value long").filter("source <> other")
    swapped = lone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    value = base.union(lone).union(swapped).union(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    apart = value.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    apart = apart.withColumn("rank", F.row_number().over(best))
    return apart.union(over)
