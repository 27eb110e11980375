"""Benchmark decontamination by one FM-index per training shard.

A shard is a stretch of a task's rows with up to SHARD_BYTES of data. Its documents become a sequence over the words that occur in
benchmark phrases; every other word separates, as no phrase can run across it, and a stretch between separators that is
shorter than the shortest phrase is left out, as it can hold none. Over that sequence the shard builds a suffix array, its
Burrows-Wheeler transform as a wavelet tree, and a sample of suffix positions. All phrases are searched backwards together, their
occurrences are located by walking to the nearest sampled position, and the covered words merge into removal spans. A shard of more
than INDEX_WORDS words is indexed in pieces that overlap by a phrase less a word, so a text of any length takes bounded memory.

Nulls and texts without words have no hits and zero words. Repeated rows are each answered. Benchmark rows without words
pose no phrase; one with a null item_id poses its phrases, whose words are hit, but has no id to tell; an item_id that comes with several
texts poses the phrases of all. An empty benchmark leaves every document clean, an empty table of documents gives no rows. Other columns
of either table are ignored, or kept by unseen_documents().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import append, forget, materialise, unused

#: A phrase of the benchmark: so many words, or a whole shorter item.
WINDOW = 13
#: Phrases that one pass may broadcast (56 bytes each, and as many words at most); a larger benchmark goes in several passes.
PHRASES = 500_000
#: Bytes of a shard's rows, and words in one index.
SHARD_BYTES, INDEX_WORDS = 16 << 20, 2_000_000
#: Every so-many-th text position keeps its place in the suffix sample.
SAMPLE = 16

FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
#: Hits of a benchmark of several passes that are broadcast: spans and items together.
BROADCAST_HITS = 200_000
# The words of words() as a pattern for the JVM.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and whatever lies beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks of symbols in a sequence; level k holds bit k of every symbol, nodes in the order of their prefixes."""

    def __init__(self, seq: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        counts = np.bincount(seq, minlength=1 << self.depth)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.words, self.ones = [], []
        level = seq
        for k in range(self.depth):
            bits = (level >> (self.depth - 1 - k)) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            if k + 1 < self.depth:
                level = level[np.argsort(level >> (self.depth - 1 - k), kind="stable")]

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ones[k][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        i = i.astype(np.int64)
        for k in range(self.depth):
            shift = self.depth - k
            start = self.before[(symbol >> shift) << shift]
            one = self._ones(k, start + i) - self._ones(k, start)
            i = np.where((symbol >> (shift - 1)) & 1, one, i - one)
        return i

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        i, symbol = i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.depth):
            shift = self.depth - k
            start = self.before[symbol << shift]
            at = start + i
            bit = ((self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            one = self._ones(k, at) - self._ones(k, start)
            i = np.where(bit, one, i - one)
            symbol = symbol * 2 + bit
        return symbol


class FMIndex:
    """Over symbols 1..size-1 in segments that end with a 0. The zeros count as different, the first as the smallest."""

    def __init__(self, text: np.ndarray, size: int):
        order = self._suffixes(text)
        previous = text[order - 1]
        self.tree = WaveletTree(previous, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        # A segment's start is always sampled: no walk crosses a zero.
        kept = (order % SAMPLE == 0) | (previous == 0)
        self.kept = np.flatnonzero(kept)
        self.marked, self.places = kept, order[kept]
        self.n = len(text)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """By doubling. Zeros are unique from the start, so the depth is that of the longest segment."""
        n = len(text)
        zeros = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(zeros)
        rank[zeros] = np.arange(len(zeros))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (n + len(zeros) + int(text.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases (rows, aligned right): the interval [low, high) of suffixes of each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, -back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        place, live, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            done = self.marked[at]
            place[live[done]] = self.places[np.searchsorted(self.kept, at[done])] + steps
            live, at = live[~done], at[~done]
            if len(live):
                symbol = self.tree.access(at)
                at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return place


class Phrases:
    """The benchmark's distinct phrases over their own vocabulary, and the items each stands in; arrays, as every task holds them."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window, numbers = window, {}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids):
                ids = np.concatenate([np.zeros(max(0, window - len(ids)), np.int32), ids])
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owners.append(np.full(len(rows[-1]), -1 if item is None else numbers.setdefault(item, len(numbers)), np.int32))
        self.names = list(numbers)
        self.rows, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.rows != 0).sum(1)
        # Items by phrase: those of phrase k stand at at[k]:at[k + 1].
        pairs = np.unique(np.stack([phrase.ravel(), np.concatenate(owners)], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.items, self.at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.shortest = int(self.lengths.min()) if len(self.rows) else 0


def _hits(pieces: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> np.ndarray:
    """Document, first word and phrase of every occurrence, by one index over pieces (document, its first word, symbols)."""
    whole = np.concatenate([x for _, _, piece in pieces for x in (piece, np.zeros(1, np.int32))])
    inside = np.concatenate([[0], (whole != 0).view(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    long = ends - starts >= max(1, phrases.shortest)
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    sizes = ends - starts + 1  # with the zero that ends it
    at = np.cumsum(sizes) - sizes
    text = whole[np.repeat(starts - at, sizes) + np.arange(sizes.sum())]
    text[at + sizes - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.find(phrases.rows, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    place = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(which)))
    segment = np.searchsorted(at, place, side="right") - 1
    place = place - at[segment] + starts[segment]
    lengths = np.array([len(piece) + 1 for _, _, piece in pieces])
    first = np.cumsum(lengths) - lengths
    piece = np.searchsorted(first, place, side="right") - 1
    doc, offset = (np.array([p[c] for p in pieces], np.int64) for c in (0, 1))
    return np.stack([doc[piece], place - first[piece] + offset[piece], which], 1)


def scan(texts: list[str | None], phrases: Phrases) -> dict:
    """Word count, merged spans and sorted items of each text."""
    get, n_words, pieces, found, room = phrases.vocabulary.get, [], [], [], INDEX_WORDS
    for k, text in enumerate(texts):
        split = words(text)
        n_words.append(len(split))
        symbols = np.fromiter((get(w, 0) for w in split), np.int32, len(split))
        for at in range(0, len(symbols) if len(phrases.rows) else 0, INDEX_WORDS):
            pieces.append((k, at, symbols[at : at + INDEX_WORDS + phrases.window - 1]))
            room -= len(pieces[-1][2])
            if room <= 0:
                found.append(_hits(pieces, phrases))
                pieces, room = [], INDEX_WORDS
    if pieces:
        found.append(_hits(pieces, phrases))
    hits = np.concatenate([np.zeros((0, 3), np.int64), *found])
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    for doc, begin, size in zip(hits[:, 0].tolist(), hits[:, 1].tolist(), phrases.lengths[hits[:, 2]].tolist(), strict=True):
        _cover(spans[doc], begin, begin + size)
    once = np.unique(hits[:, ::2], axis=0)
    count = phrases.at[once[:, 1] + 1] - phrases.at[once[:, 1]]
    item = phrases.items[np.repeat(phrases.at[once[:, 1]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    for doc, number in np.unique(np.stack([np.repeat(once[:, 0], count), item], 1), axis=0).tolist():
        items[doc].append(phrases.names[number])
    return {"n_words": n_words, "spans": spans, "items": [sorted(x) for x in items]}


def _cover(spans: list[dict], start: int, end: int) -> None:
    """Add a span that doesn't start before the last one."""
    if spans and start <= spans[-1]["end"]:
        spans[-1]["end"] = max(spans[-1]["end"], end)
    else:
        spans.append({"start": start, "end": end})


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about `most` at most, built one at a time; a single, empty block where there are none."""
    posed = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase")).filter("phrase is not null")
    size = posed.agg(F.sum(F.greatest(F.regexp_count("phrase", F.lit(_WORD)) - (window - 1), F.lit(1)))).first()[0] or 0
    blocks = -(-size // most) or 1
    for k in range(blocks):
        rows = posed.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == k).distinct().collect()
        yield Phrases(sorted(((r.item, r.phrase) for r in rows), key=lambda x: (x[0] is None, x)), window)


def _pass(documents: DataFrame, name: str, phrases: Phrases) -> tuple[DataFrame, Broadcast]:
    """documents with a column of FOUND by one block's phrases. No row moves."""
    held = documents.sparkSession.sparkContext.broadcast(phrases)

    def start():
        known = held.value
        return lambda cols: scan(cols["text"], known)

    return append(documents, name, ["text"], FOUND, start, SHARD_BYTES), held


def marked(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrases: int = PHRASES) -> tuple[DataFrame, str]:
    """documents with one more column, a struct of n_words, spans (words [start, end) inside any benchmark phrase, merged) and
    items (ids, as sorted strings), and that column's name.

    The benchmark's phrases are counted: up to `phrases` go to every task at once, and no row moves. A larger benchmark goes in blocks, one
    pass each, whose hits are written before the next is read; they come back to the documents by doc_id and the text's digest, so rows that repeat an
    id keep to themselves.
    """
    name, known = unused(documents, "_found"), _blocks(benchmark, window, phrases)
    first, second = next(known), next(known, None)
    if second is None:
        return _pass(documents, name, first)[0], name
    digest, hits = unused(documents, "_digest"), []
    keyed = documents.withColumn(digest, F.md5(F.encode("text", "UTF-8")))
    for block in (x for some in ([first, second], known) for x in some):
        found, held = _pass(keyed.select("doc_id", "text", digest), name, block)
        found = found.filter(F.size(f"{name}.spans") > 0).select(F.col("doc_id").alias("_hit"), F.col(digest).alias("_of"), f"{name}.spans", f"{name}.items")
        hits.append(materialise(found.distinct(), "decontaminate-hits"))
        held.destroy()
    every = hits[0]
    for one in hits[1:]:
        every = every.union(one)
    every = every.groupBy("_hit", "_of").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))

    def merged(cols: dict) -> dict:
        out = [[] for _ in cols["all"]]
        for spans, found in zip(out, cols["all"], strict=True):
            for span in found:
                _cover(spans, span["start"], span["end"])
        return {"spans": out}

    every = append(every, "_merged", ["all"], "spans array<struct<start:bigint,end:bigint>>", lambda: merged)
    every = materialise(every.select("_hit", "_of", F.col("_merged.spans").alias("_spans"), "_items"), "decontaminate-merged")
    forget(*hits)
    size = every.agg(F.sum(F.size("_spans") + F.size("_items"))).first()[0] or 0
    at = [unused(keyed, c) for c in every.columns]
    every = every.toDF(*at)
    joined = keyed.join(F.broadcast(every) if size <= BROADCAST_HITS else every, F.col("doc_id").eqNullSafe(F.col(at[0])) & (F.col(digest) == F.col(at[1])), "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    spans, items = (F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in ((at[2], "array<struct<start:bigint,end:bigint>>"), (at[3], "array<string>")))
    return joined.withColumn(name, F.struct(n_words.alias("n_words"), spans.alias("spans"), items.alias("items"))).select(*documents.columns, name), name


def _hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x.end - x.start)


def benchmark_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrases: int = PHRASES) -> DataFrame:
    """doc_id, n_words, spans, items of every document, as in marked()."""
    found, name = marked(documents.select("doc_id", "text"), benchmark, window, phrases)
    return found.select("doc_id", f"{name}.n_words", f"{name}.spans", f"{name}.items")


def unseen_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrases: int = PHRASES) -> DataFrame:
    """The rows of documents that aren't contaminated, with all their columns."""
    found, name = marked(documents, benchmark, window, phrases)
    hit = _hit(f"{name}.spans")
    return found.filter(~((hit > 0) & (hit * 20 >= F.col(f"{name}.n_words")))).select(documents.columns)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict per document: words, words hit, items, and whether a twentieth of the words is hit."""
    hit = _hit("spans")
    return benchmark_spans(documents, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
