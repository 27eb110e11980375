"""Language-model scores: smoothed n-grams as a weighted automaton with failure arcs, walked once along every text.

Tokens are lower-cased (A-Z) words and one end per text. The model is learned from all rows outside the held-out fold: with c the counts in these, N their
tokens, V the distinct ones and h' a context h without its first token,

    p(w) = (c(w) + 1) / (N + V + 1)        p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR)

so all words and one unknown word sum to 1 after every context. A known context is a state; a known n-gram is an arc with weight log10 p(w | h) to the
longest known context that ends there; the failure arc of h leads to h' and weighs log10(PRIOR / (c(h) + PRIOR)). At a token
the walk takes failure arcs until the state has an arc for it.

The automaton of a whole corpus fits nowhere, so each block of texts gets the part that its texts can reach, which is never
larger than the block. Texts are cut into blocks once, with words as numbers. Every block sends its distinct n-grams, hashed to 64 bits, with
its own counts to buckets of bounded size; a bucket adds up what all blocks sent and answers every block in the order that
it sent. Nothing is pruned and nothing but three totals comes to the driver. An n-gram reaches a bucket once a block, however often it occurs, so no bucket
is hot. Two of n n-grams share a hash with a chance of n^2 / 2^65.

Nulls and texts without words hold the end alone. A null doc_id is never held out. Repeated rows are texts of their own, each answered and each learned
from. A text longer than a block is read in pieces that carry their context, so memory is bounded by BLOCK (a single longer word
aside). An empty table gives no rows, and with no row to learn from every token has probability 1. No ties arise. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidewright.llm.quality import held_out
from tidewright.llm.shared import forget, materialise

HELD_OUT = (7, 2)
#: Tokens of the longest n-gram, and the weight of the shorter context's distribution in counts.
ORDER, PRIOR = 2, 2000.0
#: Characters of text in a block, and n-grams in a bucket, about.
BLOCK, BUCKET = 4 << 20, 1 << 20
#: Tasks that buckets or blocks are dealt to, at most; beyond that a task takes several, one after the other.
PARTS = 20_000

# Numbers of the two tokens that are no words, and their hashes.
START, END = 0, 1
_MARKS = [xxh3_64_intdigest(b" start"), xxh3_64_intdigest(b" end")]
_GAP = re.compile(r"[\x20\x09-\x0D]")

BLOCKS = "block bigint, row array<bigint>, doc_id array<bigint>, held array<boolean>, size array<int>, skip array<int>, tokens binary, words binary, n_tokens bigint, train_tokens bigint"
SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers as bytes of the least width, which the first byte tells: all lowest bytes first, then the next. Spark's compression shortens planes that hardly vary."""
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return bytes([kind.itemsize]) + np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(kind)


def _packed_keys(sorted_keys: np.ndarray) -> bytes:
    return _packed(np.diff(sorted_keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _pieces(text: str, block: int, context: int) -> Iterator[tuple[list[str], str]]:
    """A text in pieces of about `block` characters that end at a gap, each with the words before it, at most `context`."""
    at, before = 0, []
    while len(text) - at > block:
        gap = _GAP.search(text, at + block)
        if not gap:
            break
        piece = text[at : gap.start()]
        yield before, piece
        if context:
            last = [w.decode("utf-8", "surrogatepass") for w in piece.encode("utf-8", "surrogatepass").rsplit(None, context)[-context:]]
            before = (before + last)[-context:]
        at = gap.end()
    yield before, text[at:]


def cut_blocks(documents: DataFrame, fold: tuple[int, int] = HELD_OUT, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """A row per block: its texts (row number, doc_id, held out, tokens, tokens of context), all tokens as numbers, and the hash of each number's word."""
    context = order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, count, size, held = TaskContext.get().partitionId() << 32, 0, 0, 0, []
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, out, text = (batch.column(c)[k].as_py() for c in range(3))
                pieces = list(_pieces(text or "", block, context))
                for j, (before, piece) in enumerate(pieces):
                    held.append((task + row, doc_id, out, before, piece, j == 0, j == len(pieces) - 1))
                    size += len(piece)
                    if size >= block:
                        yield _block(task + count, held, context)
                        count, size, held = count + 1, 0, []
                row += 1
        if held:
            yield _block(task + count, held, context)

    return documents.select("doc_id", held_out("doc_id", fold), "text").mapInArrow(run, BLOCKS)


def _block(number: int, held: list[tuple], context: int) -> pa.RecordBatch:
    texts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([" ".join([*x[3], x[4]]) for x in held], pa.large_string())))
    flat = texts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    n_words = np.diff(np.concatenate([[0], np.cumsum(real)])[texts.offsets.to_numpy()])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    # A text opens with the start where its words do not already fill the context, and the last piece closes with the end.
    opens = np.array([x[5] or len(x[3]) < context for x in held])
    closes = np.array([x[6] for x in held])
    size = opens + n_words + closes
    first = np.cumsum(size) - size
    tokens = np.zeros(size.sum(), np.uint32)
    own = np.arange(n_words.sum()) + np.repeat(first + opens - (np.cumsum(n_words) - n_words), n_words)
    tokens[own] = coded.indices.to_numpy().astype(np.uint32) + 2
    tokens[(first + size - 1)[closes]] = END
    words = np.array(_MARKS + [xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    # What stands before a piece is context; the start itself counts once a text, as context and not as a token.
    skip = np.array([0 if x[5] else len(x[3]) + int(o) for x, o in zip(held, opens, strict=True)])
    free = np.array([not x[2] for x in held])
    n_tokens = size - np.maximum(skip, opens)
    columns = [[number], [[x[0] for x in held]], [[x[1] for x in held]], [[x[2] for x in held]], [size.tolist()], [skip.tolist()], [_packed(tokens)], [words.tobytes()], [int(n_tokens.sum())], [int(n_tokens[free].sum())]]
    schema = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])


@dataclass
class Level:
    """The distinct n-grams of one length in a block: each one's first tokens and last tokens as numbers of the level below, its last token, its hash, its count."""

    before: np.ndarray
    after: np.ndarray
    last: np.ndarray
    key: np.ndarray
    own: np.ndarray

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams in the order of their hashes, which buckets share in ranges: their places, the buckets that occur and where each begins."""
        place = np.argsort(self.key, kind="stable")
        found, start = np.unique((self.key[place] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
        return place, found, start


def levels(block: dict, order: int) -> list[Level]:
    tokens = _unpacked(block["tokens"])
    words = np.frombuffer(block["words"], np.uint64)
    size, skip = np.array(block["size"], np.int64), np.array(block["skip"], np.int64)
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
    learned = np.repeat(~np.array(block["held"], bool), size) & (at >= np.repeat(skip, size))
    zero = np.zeros(len(words), np.int64)
    out = [Level(zero, zero, np.arange(len(words)), words, np.bincount(tokens[learned], minlength=len(words)))]
    ids = tokens
    for n in range(2, order + 1):
        place = np.flatnonzero(at >= n - 1)
        before, last = ids[place - 1], tokens[place]
        _, first, number = np.unique(before * len(words) + last, return_index=True, return_inverse=True)
        low = out[-1]
        key = (low.key[before[first]] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + words[last[first]]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(Level(before[first], ids[place[first]], last[first], key ^ (key >> np.uint64(32)), np.bincount(number[learned[place]], minlength=len(first))))
        ids = np.zeros(len(tokens), np.int64)
        ids[place] = number
    return out


def counted(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """block, bucket, counts: for what each block holds in a bucket, the counts over all blocks; and in rows without a block, how many words a bucket knows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                for n, level in enumerate(levels(block, order)):
                    place, found, start = level.order(buckets)
                    if not len(place):
                        continue
                    cut = [np.split(a[place], start[1:]) for a in (level.key, level.own)]
                    yield pa.RecordBatch.from_pydict({
                        "block": [block["block"]] * len(found), "bucket": n * buckets + found.astype(np.int64),
                        "keys": [_packed_keys(a) for a in cut[0]], "counts": [_packed(a) for a in cut[1]],
                    })

    def add(sent: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(k) for k in sent["keys"].to_pylist()]
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, number, np.concatenate([_unpacked(c) for c in sent["counts"].to_pylist()]))
        cut = np.split(total[number], np.cumsum([len(k) for k in keys])[:-1])
        bucket = sent["bucket"][0].as_py()
        known = int(((total > 0) & (distinct != _MARKS[START])).sum()) if bucket < buckets else 0
        return pa.table({
            "block": pa.concat_arrays([*sent["block"].chunks, pa.nulls(1, pa.int64())]),
            "bucket": pa.array([bucket] * (len(keys) + 1), pa.int64()),
            "counts": pa.array([*[_packed(c) for c in cut], _packed(np.array([known]))], pa.binary()),
            "known": pa.array([0] * len(keys) + [known], pa.int64()),
        })

    sent = blocks.select("block", "held", "size", "skip", "tokens", "words").mapInArrow(send, "block bigint, bucket bigint, keys binary, counts binary")
    return sent.repartition(min(order * buckets, PARTS), "bucket").groupBy("bucket").applyInArrow(add, "block bigint, bucket bigint, counts binary, known bigint")


class Automaton:
    """The states and arcs that a block's texts can reach. State 0 has no context."""

    def __init__(self, found: list[Level], counts: list[np.ndarray], n_tokens: int, n_words: int, prior: float):
        order, self.width = len(found), len(found[0].key)
        self.base = (counts[0] + 1.0) / (n_tokens + n_words + 1.0)
        # The state of n-gram g of level n is begin[n] + g; those of the longest are no states.
        begin = np.cumsum([1] + [len(f.key) for f in found[: order - 1]])
        fail, back = np.zeros(begin[-1], np.int64), np.zeros(begin[-1])
        arcs, weights, targets, p = [], [], [], self.base
        for n, (level, count) in enumerate(zip(found, counts, strict=True)):
            if n:
                p = (count + prior * p[level.after]) / (counts[n - 1][level.before] + prior)
            known = np.flatnonzero(count > 0) if n else np.arange(self.width)
            source = begin[n - 1] + level.before[known] if n else 0
            if n < order - 1:
                target = np.where(count[known] > 0, begin[n] + known, 0)
                fail[begin[n] : begin[n + 1]] = begin[n - 1] + level.after if n else 0
                back[begin[n] : begin[n + 1]] = np.log10(prior / (count + prior))
            else:
                target = begin[n - 1] + level.after[known] if n else np.zeros(self.width, np.int64)
            arcs.append(source * self.width + level.last[known])
            weights.append(np.log10(p[known]))
            targets.append(target)
        self.fail, self.back = array("q", fail.tobytes()), array("d", back.tobytes())
        self.arcs = {a: k for k, a in enumerate(np.concatenate(arcs).tolist())}
        self.weights, self.targets = array("d", np.concatenate(weights).tobytes()), array("q", np.concatenate(targets).tobytes())

    def walk(self, context: list[int], tokens: list[int]) -> float:
        """The sum of weights along the tokens from the state that the context leads to."""
        arcs, weights, targets, fail, back, width = self.arcs, self.weights, self.targets, self.fail, self.back, self.width
        state, total = 0, 0.0
        for token in context:
            while (arc := arcs.get(state * width + token)) is None:
                state = fail[state]
            state = targets[arc]
        for token in tokens:
            while (arc := arcs.get(state * width + token)) is None:
                total += back[state]
                state = fail[state]
            total += weights[arc]
            state = targets[arc]
        return total


def scored(blocks: DataFrame, counts: DataFrame, order: int, buckets: int, n_tokens: int, n_words: int, prior: float, parts: int) -> DataFrame:
    """SCORED per piece of a text: every block meets the answers that it got."""

    def score(blocks_of: pa.Table, answers: pa.Table) -> pa.Table:
        block = blocks_of.to_pylist()[0]
        got = dict(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        found, totals = levels(block, order), []
        for n, level in enumerate(found):
            place, held, _ = level.order(buckets)
            total = np.zeros(len(place), np.int64)
            total[place] = np.concatenate([np.zeros(0, np.int64), *[_unpacked(got[n * buckets + b]) for b in held.tolist()]])
            totals.append(total)
        machine = Automaton(found, totals, n_tokens, n_words, prior)
        tokens = _unpacked(block["tokens"])
        base, known = np.log10(machine.base), totals[0] > 0
        end, rows = np.cumsum(block["size"]), []
        for k, (stop, size, skip) in enumerate(zip(end.tolist(), block["size"], block["skip"], strict=True)):
            mine = tokens[stop - size : stop]
            before, own = np.split(mine, [max(skip, int(size > 0 and mine[0] == START))])
            rows.append((block["row"][k], block["doc_id"][k], block["held"][k], len(own), int(known[own].sum()), float(base[own].sum()), machine.walk(before.tolist(), own.tolist())))
        names = [c.split()[0] for c in SCORED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        del found, totals, machine
        pa.default_memory_pool().release_unused()
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    sides = [side.repartition(parts, "block").groupBy("block") for side in (blocks, counts.filter("block is not null").drop("known"))]
    return sides[0].cogroup(sides[1]).applyInArrow(score, SCORED)


def lm_scores(documents: DataFrame, fold: tuple[int, int] = HELD_OUT, order: int = ORDER, prior: float = PRIOR, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    blocks = materialise(cut_blocks(documents, fold, order, block), "lm-blocks")
    all_of = blocks.agg(F.sum("n_tokens").alias("all"), F.sum("train_tokens").alias("train"), F.count("*").alias("blocks")).first()
    buckets = -(-max(all_of["all"] or 0, 1) // bucket)
    counts = materialise(counted(blocks, order, buckets), "lm-counts")
    n_tokens, n_words = all_of["train"] or 0, counts.agg(F.sum("known")).first()[0] or 0
    pieces = scored(blocks.drop("n_tokens", "train_tokens"), counts, order, buckets, n_tokens, n_words, prior, min(max(all_of["blocks"], 1), PARTS))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    done = materialise(pieces.groupBy("row", "doc_id", "held_out").agg(*sums), "lm-scores")
    forget(blocks, counts)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
