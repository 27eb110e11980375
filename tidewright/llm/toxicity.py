"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text becomes lower-case words; every word enters as the sum of a hashed word vector and the scaled sum of hashed
vectors of its characters' n-grams. The network reads windows that overlap, and every window of the whole text is
scored; the text's score is that of its worst window, calibrated on the training sample. It is trained on a bounded
sample of labelled rows by the gradient of the logistic loss, over all windows of these: first all carry the label of their text, then of a
toxic text only the worst windows do. A text longer than PIECE is read in pieces that overlap by a window, so memory is bounded.

The inputs of the gates depend on the word alone, so they are made once per distinct word; a step of the recurrence is then one
small matrix product over thousands of windows at once.

Nulls and texts without words score 0. Repeated rows are each answered. Without toxic labels every score is 0, without others 1. An empty
table gives no rows. A score at the threshold is toxic. Ties in the sample's order are broken by the id and the text's hash. Other columns never enter.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.quality import held_out, labelled_sample
from tidewright.llm.shared import append, map_rows, unused

#: Labelled rows to learn from, at most, and bytes of their texts; the rows with the smallest hashes are taken.
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 16 << 20
#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 40, 32
THRESHOLD = 0.5
HELD_OUT = (5, 0)
#: Hash buckets for words and for character n-grams, size of a vector, units in each direction.
WORDS, GRAMS, SIZE, UNITS = 4096, 16384, 8, 8
GRAM_SIZES = (3, 5)
EPOCHS = 7
#: Weight of the counts in the first vectors, spread of their other numbers, and the vectors' share of the learning rate.
PRIOR, SPREAD, EMBED_RATE = 0.5, 0.3, 0.2
#: Letters of text that a task encodes at once.
PIECE = 1 << 20

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Words:
    """The words of some texts: text of each word, its row in the table of distinct words, and that table's hash buckets."""

    owner: np.ndarray
    ids: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    grams: np.ndarray
    key: np.ndarray | None = None

    @classmethod
    def joined(cls, texts: list[str | None], room: int = 1 << 20) -> Words:
        """As of(), piece by piece: what is held at once is the result and the arrays of one piece."""
        parts, at, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= room or k + 1 == len(texts):
                part = cls.of(texts[at : k + 1])
                part.owner = part.owner + at
                parts.append(part)
                at, size = k + 1, 0
        if not parts:
            return cls.of([])
        key, first, same = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
        base = np.cumsum([0] + [len(p.key) for p in parts])
        ids = np.concatenate([same[b + p.ids] for b, p in zip(base, parts, strict=False)])
        table = cls(np.concatenate([p.owner for p in parts]), ids, *(np.concatenate([getattr(p, f) for p in parts]) for f in ("word", "gram", "grams"))).some(first)
        table.key = key
        return table

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        """All in array operations: the texts stand in one buffer of bytes, folded to lower case, blanks between words.

        A word's 64-bit hash is a difference of running sums, so equal words meet by sorting numbers. N-grams are
        of bytes and take in the blank on either side, which marks the word's ends.
        """
        parts = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
        data = np.frombuffer(b"      " + b" ".join(parts) + b"      ", np.uint8)
        letter = (data != 32).view(np.int8)
        edge = np.diff(letter)
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        place = np.cumsum([6] + [len(x) + 1 for x in parts])[:-1] if parts else np.zeros(1, np.int64)
        owner = np.searchsorted(place, start, side="right") - 1
        width = end - start
        # Horner within the word: b0 * m^0 + b1 * m^1 + ..., by sums over runs of letters.
        power = _powers(int(width.max(initial=1)))
        inside = np.flatnonzero(letter)
        offset = inside - np.repeat(start, width)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[inside].astype(np.uint64) + np.uint64(1)) * power[offset], dtype=np.uint64)])
        stop = np.cumsum(width)
        key = total[stop] - total[stop - width]
        _, first, ids = np.unique(key, return_index=True, return_inverse=True)
        word = (key[first] * _ODD[0]) >> np.uint64(64 - WORDS.bit_length() + 1)
        wide, begin = width[first], start[first]
        grams = []
        for n, odd in zip(GRAM_SIZES, _ODD[1:], strict=True):
            count = np.maximum(wide + 3 - n, 0)
            owns = np.repeat(np.arange(len(wide)), count)
            at = begin[owns] - 1 + np.arange(len(owns)) - np.repeat(np.cumsum(count) - count, count)
            value = np.zeros(len(at), np.uint64)
            for k in range(n):
                value = value * np.uint64(257) + data[at + k]
            grams.append((owns, (value * odd) >> np.uint64(64 - GRAMS.bit_length() + 1)))
        owns = np.concatenate([o for o, _ in grams])
        order = np.argsort(owns, kind="stable")
        return cls(owner, ids.ravel(), word.astype(np.int64), np.concatenate([g for _, g in grams])[order].astype(np.int64), np.bincount(owns, minlength=len(wide)), key[first])

    def some(self, rows: np.ndarray) -> Words:
        """The table of these distinct words only."""
        starts, count = np.cumsum(self.grams) - self.grams, self.grams[rows]
        at = np.repeat(starts[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return Words(self.owner, self.ids, self.word[rows], self.gram[at], count)

    def windows(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows x WINDOW of word rows plus one, 0 where a short text is padded, and the text of each window.

        Overlapping windows cover every word; the last one ends with the text.
        """
        count = np.bincount(self.owner, minlength=texts)
        first, each = np.cumsum(count) - count, np.where(count > 0, 1 + -(-np.maximum(count - WINDOW, 0) // STRIDE), 0)
        owner = np.repeat(np.arange(texts), each)
        starts = np.minimum((np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE, np.maximum(count[owner] - WINDOW, 0))
        at = starts[:, None] + np.arange(WINDOW)
        real = at < count[owner][:, None]
        ids = np.zeros(at.shape, np.int32)
        ids[real] = self.ids[(at + first[owner][:, None])[real]] + 1
        return ids, owner


#: Odd multipliers that spread hashes over buckets: of words, and of each size of n-gram.
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def _powers(n: int) -> np.ndarray:
    """m^0 .. m^n for the hash of words, modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x5851F42D4C957F2D, np.uint64)]), dtype=np.uint64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def summed(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values that belong to each row."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.zeros((rows, values.shape[1]), np.float32)
    out[row[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Network:
    """Parameters by name; d stands for a direction, 0 forwards and 1 backwards."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {"word": draw(WORDS, SIZE, by=0.1), "gram": draw(GRAMS, SIZE, by=0.3)}
        for d in "01":
            self.p |= {f"w{d}": draw(SIZE, 3 * UNITS, by=SIZE**-0.5), f"u{d}": draw(UNITS, 3 * UNITS, by=UNITS**-0.5), f"b{d}": np.zeros(3 * UNITS, np.float32)}
            self.p[f"b{d}"][:UNITS] = -0.5
        self.p |= {"att": draw(2 * UNITS, UNITS, by=0.3), "att_b": np.zeros(UNITS, np.float32), "att_v": draw(UNITS, by=0.5), "out": draw(2 * UNITS, by=0.5), "out_b": np.array([-1.0], np.float32)}
        self.scale, self.shift = 1.0, 0.0

    # A word's vector, and what it brings to the gates of either direction.

    def vectors(self, w: Words) -> np.ndarray:
        if not len(w.word):
            return np.zeros((0, SIZE), np.float32)
        sums = np.add.reduceat(self.p["gram"][w.gram], np.cumsum(w.grams) - w.grams, axis=0)
        return self.p["word"][w.word] + sums / np.sqrt(w.grams)[:, None].astype(np.float32)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "01"]

    @staticmethod
    def padded(gate: np.ndarray) -> np.ndarray:
        """Row 0 becomes the padding: its update gate is shut, so the state goes through unchanged."""
        pad = np.zeros((1, gate.shape[1]), np.float32)
        pad[0, :UNITS] = 40
        return np.concatenate([pad, gate])

    def run(self, ids: np.ndarray, gates: list[np.ndarray], keep: bool = False):
        """Logits of windows. ids: windows x words, 0 where padded; gates: padded gate inputs by word."""
        n, size = ids.shape
        states, held = np.empty((size, n, 2 * UNITS), np.float32), []
        for d in (0, 1):
            u = self.p[f"u{d}"]
            uzr, un, h = u[:, : 2 * UNITS], u[:, 2 * UNITS :], np.zeros((n, UNITS), np.float32)
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                x = gates[d][ids[:, t]]
                zr = sigmoid(x[:, : 2 * UNITS] + h @ uzr)
                z, r = zr[:, :UNITS], zr[:, UNITS:]
                hn = h @ un
                c = np.tanh(x[:, 2 * UNITS :] + r * hn)
                if keep:
                    held.append((d, t, h, z, r, hn, c))
                h = c + z * (h - c)
                states[t, :, d * UNITS : (d + 1) * UNITS] = h
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        e[ids.T == 0] = -1e9
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tnu->nu", alpha, states)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (states, a, alpha, pooled, held)) if keep else logit

    def gradient(self, ids: np.ndarray, gates: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        """Of the weighted logistic loss: by parameter, and by the gate input of each word."""
        logit, (states, a, alpha, pooled, held) = self.run(ids, gates, keep=True)
        p, g = self.p, {}
        dl = ((sigmoid(logit) - y) * weight).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["out"]
        ds = alpha[:, :, None] * dpool
        dalpha = np.einsum("nu,tnu->tn", dpool, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["att_v"] = np.einsum("tn,tnu->u", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tnu,tnv->uv", states, da), da.sum((0, 1))
        ds = ds + da @ p["att"].T
        by_place = [np.empty((ids.shape[1], ids.shape[0], 3 * UNITS), np.float32) for _ in gates]
        for d in "01":
            g[f"u{d}"] = np.zeros_like(p[f"u{d}"])
        dh, at = None, None
        for d, t, h, z, r, hn, c in reversed(held):
            if d != at:
                dh, at = np.zeros_like(h), d
            u = p[f"u{d}"]
            dh = dh + ds[t, :, d * UNITS : (d + 1) * UNITS]
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * hn * r * (1 - r)
            dzr, dn = np.concatenate([dz, dr], 1), dc * r
            g[f"u{d}"][:, : 2 * UNITS] += h.T @ dzr
            g[f"u{d}"][:, 2 * UNITS :] += h.T @ dn
            by_place[d][t, :, : 2 * UNITS], by_place[d][t, :, 2 * UNITS :] = dzr, dc
            dh = dh * z + dzr @ u[:, : 2 * UNITS].T + dn @ u[:, 2 * UNITS :].T
        return g, [summed(ids.T.ravel(), x.reshape(-1, 3 * UNITS), len(gate)) for x, gate in zip(by_place, gates, strict=True)]


def fit(texts: list[str | None], y: np.ndarray, share: float | None = None, epochs: int = EPOCHS, batch: int = 1024, steps_least: int = 400, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on whole texts with their labels (0 or 1); every fifth text is kept aside for the calibration.

    share: the part of all labels that is toxic, where the sample has another.
    """
    net, rng = Network(), np.random.default_rng(seed)
    if not len(texts) or y.max() == 0 or y.min() == 1:
        net.scale, net.shift = 0.0, 8.0 if len(texts) and y.max() else -50.0
        return net
    aside = np.arange(len(texts)) % 5 == 4
    learn, truth = [t for t, a in zip(texts, aside, strict=True) if not a], y[~aside]
    table = Words.joined(learn)
    cut, owner = table.windows(len(learn))
    count = np.bincount(owner, minlength=len(learn))
    batch = max(32, min(batch, len(cut) * epochs // steps_least))  # a small sample still gives enough steps
    if PRIOR:
        _start_from_counts(net, table, truth)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for epoch in range(epochs):
        # A text's windows share its weight in the first rounds; later each counts for itself.
        use, weight = np.arange(len(cut)), 1 / np.sqrt(count[owner])
        if epoch >= 3:
            gates = [net.padded(x) for x in net.gates(net.vectors(table))]
            z = np.concatenate([net.run(cut[k : k + 8192], gates) for k in range(0, len(cut), 8192)])
            best = np.full(len(learn), -1e9)
            np.maximum.at(best, owner, z)
            # Of clean texts the windows that look toxic, and a third of the others.
            hard = z > np.minimum(-2, best[owner] - 1)
            use = np.flatnonzero(np.where(truth[owner] == 0, hard | (rng.random(len(z)) < 0.34), (z >= best[owner] - 0.5) | (z > 2)))
            weight = np.where(truth[owner] == 1, 1.0, np.where(hard, 1.0, 0.5))
        use = rng.permutation(use)
        for k in range(0, len(use), batch):
            rows = use[k : k + batch]
            mine, ids = np.unique(np.concatenate([[0], cut[rows].ravel()]), return_inverse=True)
            ids = ids[1:].reshape(len(rows), WINDOW)
            some = table.some(mine[1:] - 1)
            x = net.vectors(some)
            gates = [net.padded(v) for v in net.gates(x)]
            w = weight[rows].astype(np.float32)
            g, by_word = net.gradient(ids, gates, truth[owner[rows]].astype(np.float32), w / w.sum())
            dx = np.zeros_like(x)
            for d in "01":
                dg = by_word[int(d)][1:]
                g[f"w{d}"], g[f"b{d}"] = x.T @ dg, dg.sum(0)
                dx += dg @ net.p[f"w{d}"].T
            g["word"] = summed(some.word, dx, WORDS)
            g["gram"] = summed(some.gram, np.repeat(dx / np.sqrt(some.grams)[:, None].astype(np.float32), some.grams, axis=0), GRAMS)
            steps += 1
            pace = rate * (0.25 if epoch >= epochs - 2 else 1)
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[name] -= pace * (EMBED_RATE if name in ("word", "gram") else 1) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
    best = worst_windows(net, [t for t, a in zip(texts, aside, strict=True) if a])
    _calibrate(net, np.maximum(best, -20.0), y[aside].astype(float), share)
    return net


def _start_from_counts(net: Network, table: Words, truth: np.ndarray) -> None:
    """The first number of every word and n-gram vector starts as the smoothed log-odds of texts that hold it.

    What few texts hold starts near 0, so that a small sample is not learned by heart.
    """
    toxic, starts = truth == 1, np.cumsum(table.grams) - table.grams
    held = np.unique(table.owner * len(table.word) + table.ids)
    counts = {name: np.zeros((2, size), np.int64) for name, size in (("word", WORDS), ("gram", GRAMS))}
    for part in np.array_split(np.arange(len(truth)), max(1, len(truth) // 100)):  # texts are counted apart, so any split gives the same
        if not len(part):
            continue
        low, high = np.searchsorted(held, [part[0] * len(table.word), (part[-1] + 1) * len(table.word)])
        text, word = held[low:high] // len(table.word), held[low:high] % len(table.word)
        count = table.grams[word]
        at = np.repeat(starts[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        for name, texts, bucket, size in (("word", text, table.word[word], WORDS), ("gram", np.repeat(text, count), table.gram[at], GRAMS)):
            pairs = np.unique(texts * size + bucket)
            for side in (0, 1):
                counts[name][side] += np.bincount((pairs % size)[toxic[pairs // size] == side], minlength=size)
    for name, (no, yes) in counts.items():
        odds = np.log((yes + 2) / (toxic.sum() + 4)) - np.log((no + 2) / ((~toxic).sum() + 4))
        net.p[name][:, 0] = PRIOR * np.where(yes + no > 0, odds, 0)
        net.p[name][:, 1:] *= SPREAD


def _calibrate(net: Network, z: np.ndarray, y: np.ndarray, share: float | None) -> None:
    """Two parameters by damped Newton steps: the worst window's logit to the text's, at the share that toxic texts have."""
    a, b = 1.0, 0.0
    w = np.ones(len(y))
    if share and 0 < y.mean() < 1:
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = w * p * (1 - p) + 1e-6
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        da, db = np.linalg.solve(h, [(w * (y - p) * z).sum() - (a - 1), (w * (y - p)).sum() - 0.1 * b])
        pace = min(1.0, 1.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + pace * da, b + pace * db
    net.scale, net.shift = float(max(a, 0.05)), float(b)


def pieces_of(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about `size` letters that overlap by a window of words, if that many fit in half a piece."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at + size // 2, at + size), text.rfind("\n", at + size // 2, at + size))
        end = end if end > 0 else at + size
        yield text[at:end]
        before = text[max(at + 1, end - size // 2) : end]
        places = [m.start() for m in re.finditer(r"\S+", before)]
        at = end - len(before) + places[-WINDOW] if len(places) >= WINDOW else end
    yield text[at:]


def worst_windows(net: Network, texts: list[str | None]) -> np.ndarray:
    """The highest logit over all windows of each text; -inf without words. Some PIECE of text is held as numbers at a time."""
    out, held, owners, size = np.full(len(texts), -np.inf), [], [], 0

    def read() -> None:
        table = Words.of(held)
        gates = [net.padded(x) for x in net.gates(net.vectors(table))]
        ids, piece = table.windows(len(held))
        owner = np.array(owners)[piece]
        for w in range(0, len(ids), 4096):
            np.maximum.at(out, owner[w : w + 4096], net.run(ids[w : w + 4096], gates))

    for k, text in enumerate(texts):
        for piece in pieces_of(text or "", PIECE):
            held.append(piece)
            owners.append(k)
            size += len(piece)
            if size >= PIECE:
                read()
                held, owners, size = [], [], 0
    if held:
        read()
    return out


def scores(net: Network, texts: list[str | None]) -> np.ndarray:
    z = worst_windows(net, texts)
    p = 1 / (1 + np.exp(-np.clip(net.scale * np.nan_to_num(z, neginf=0.0) + net.shift, -40, 40)))
    return np.where(np.isneginf(z), 0.0, p)


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic", size: int = SAMPLE_BYTES) -> Network:
    """The network is fitted where the bounded sample is one task's rows, so neither its texts nor the arrays of training are held by the driver, which gets the parameters."""
    sample = labelled_sample(documents, labels, label, HELD_OUT, rows, size)
    share = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id", HELD_OUT)).agg(F.avg(label)).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, t or "") for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = fit([t for _, _, t in got], np.array([y for _, y, _ in got], np.int64), share)
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    # Spark may leave the task out where it sees that the sample is empty.
    nets = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(nets[0].net) if nets else fit([], np.zeros(0, np.int64), share)


def toxicity_scores(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. The network is broadcast; its size is fixed."""
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))

    def start():
        net = held.value
        return lambda cols: {"doc_id": cols["doc_id"], "score": scores(net, cols["text"])}

    scored = map_rows(documents, ["doc_id", "text"], "doc_id bigint, score double", start)
    return scored.select("doc_id", held_out("doc_id", HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that don't score as toxic, with all their columns. No row moves."""
    held, name = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows)), unused(documents, "_toxic")

    def start():
        net = held.value
        return lambda cols: {"score": scores(net, cols["text"])}

    return append(documents, name, ["text"], "score double", start).filter(F.col(f"{name}.score") < threshold).select(documents.columns)
