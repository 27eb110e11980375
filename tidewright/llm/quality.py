"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text come from one pass over its bytes and words. On a bounded sample of labelled rows
(weighted so that each label counts with its share of all labelled rows) small boosted trees are grown, every path of every tree becomes a conjunctive rule, a lasso logistic regression
keeps the few rules that matter, and these are compiled into one Spark column expression over the statistics.

Nulls, empty texts and texts without words have all statistics 0 and so a score like any other. Repeated rows are each answered, and a
document labelled more than once counts with each label. Without labels of both kinds the score is near 1 or 0, as the labels are, or
0.5 without any. An empty table gives no rows. A score at the threshold is good. Ties in the sample's order are broken by the id and the text's
hash. Memory follows the longest text, at some ten times its size. Other columns never enter.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import append, map_rows, materialise, unused

#: Labelled rows to learn from, at most; the rows with the smallest hashes are taken.
SAMPLE_ROWS = 6_000
#: Characters that one row may bring where a sample is bounded by bytes.
LONG_ROW = 1 << 20
#: A document is good from this score on.
THRESHOLD = 0.7
HELD_OUT = (4, 2)

STATS = (
    "log_bytes log_words word_bytes upper digits marks bangs symbols pipes spaces lines beyond_ascii distinct_words repeats top_word "
    "distinct_lines line_words line_end vowels sentence_words letters_entropy capital_words lone_bytes long_words"
).split()
STAT_SCHEMA = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS)

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b".,;:?", "bangs": b"!",
    "symbols": b"#$%&*+<=>@^_~\\/{}[]`", "pipes": b"|", "spaces": b" \t\r\x0b\x0c", "lines": b"\n", "vowels": b"aeiouAEIOU",
}
_MASK = np.array([[b in chars for b in range(256)] for chars in _CLASS.values()], np.float64).T


def held_out(doc_id: str | Column = "doc_id", fold: tuple[int, int] = HELD_OUT) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves this remainder. A null id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def _one(text: str | None) -> tuple[bytes, list[float]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return b"", [0.0] * 9
    seen: dict[bytes, int] = {}
    again, last = 0, None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        again += w == last
        last = w
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    sentences = max(1, data.count(b". ") + data.count(b".\n") + data.count(b"!") + data.count(b"?"))
    capital = sum(w[:1].isupper() for w in words)
    alone = sum(len(w) == 1 for w in words)
    long = sum(len(w) > 24 for w in words)
    return data, [len(seen) / n, again / n, max(seen.values()) / n, len(set(lines)) / len(lines), n / len(lines), ends / len(lines), min(n / sentences, 1000.0), capital / n, alone / n, long / n, n]


def statistics_of(texts: list[str | None]) -> np.ndarray:
    """One row of STATS per text."""
    out = np.zeros((len(texts), len(STATS)))
    for k, text in enumerate(texts):
        data, more = _one(text)
        if not data:
            continue
        distinct, again, top, lines, per_line, ends, sentence, capital, alone, long, n = more
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size = len(data)
        share = dict(zip(_CLASS, counts @ _MASK / size, strict=True))
        p = counts[counts > 0] / size
        out[k] = [
            np.log1p(size), np.log1p(n), size / n, share["upper"], share["digits"], share["marks"], share["bangs"], share["symbols"], share["pipes"], share["spaces"],
            share["lines"], counts[128:].sum() / size, distinct, again, top, lines, min(per_line, 1000.0), ends, share["vowels"], sentence, -(p * np.log(p)).sum(), capital, alone, long,
        ]
    return out


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text; a narrow pass."""

    def each(cols: dict) -> dict:
        got = statistics_of(cols["text"])
        return {"doc_id": cols["doc_id"]} | {s: got[:, k] for k, s in enumerate(STATS)}

    return map_rows(documents, ["doc_id", "text"], STAT_SCHEMA, lambda: each)


def labelled_rows(labels: DataFrame, label: str, fold: tuple[int, int]) -> DataFrame:
    """labelled, label of every row that may be learned from."""
    return labels.select(F.col("doc_id").alias("labelled"), F.col(label).alias("label")).filter(F.col("labelled").isNotNull() & F.col("label").isin(0, 1) & ~held_out("labelled", fold))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], rows: int, size: int | None = None) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled rows outside the held-out fold, half of each label where there are enough.

    The ids are taken by smallest hash, so the same labels give the same sample; with that bound they are broadcast. Documents that
    repeat an id count against the same bound, equal ones once. size: bytes of all texts together, half for each label. Both labels stop at the same rank, the first at which
    a next row doesn't fit, so no length is preferred; a text of more than LONG_ROW or an eighth of size gives so many characters from a place that its hash draws, so one row fits always.
    """
    told = labelled_rows(labels, label, fold)
    place = lambda c: (F.xxhash64(c), c)
    half = lambda k: told.filter(F.col("label") == k).orderBy(*place("labelled")).limit(rows // 2)
    met = documents.select("doc_id", "text").join(F.broadcast(half(0).union(half(1))), F.col("doc_id") == F.col("labelled"))
    met = met.select("doc_id", "label", F.xxhash64("text").alias("of"), "text")
    if size is not None:
        most = min(LONG_ROW, size // 8)
        beyond = F.length("text") - most
        met = met.withColumn("text", F.when(beyond > 0, F.substring("text", F.pmod("of", F.greatest(beyond, F.lit(1))).cast("int") + 1, F.lit(most))).otherwise(F.col("text")))
    met = materialise(met.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "labelled")
    ranked = {k: met.filter(F.col("label") == k).select("doc_id", "of", "bytes").distinct().orderBy(*place("doc_id"), "of").limit(rows // 2).collect() for k in (0, 1)}
    picks, taken = [], [0, 0]
    for pair in itertools.zip_longest(ranked[0], ranked[1]):
        taken = [n + (r.bytes if r else 0) for n, r in zip(taken, pair, strict=True)]
        if size is not None and max(taken) > size // 2:
            break
        picks += [(r.doc_id, r.of, k) for k, r in enumerate(pair) if r]
    picks = documents.sparkSession.createDataFrame(picks, "doc_id bigint, of bigint, label int")
    same = [F.col(f"m.{c}") == F.col(f"p.{c}") for c in ("doc_id", "of", "label")]
    return met.alias("m").join(F.broadcast(picks.alias("p")), same, "left_semi").dropDuplicates(["doc_id", "of", "label"]).select("doc_id", "text", "label")


# --- learning ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """All of (statistic index, threshold, above) hold: value > threshold if above, else value <= threshold."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, inside: str = "") -> Column:
        col = F.lit(True)
        for k, t, above in self.terms:
            stat = F.col(inside + STATS[k])
            col = col & (stat > t if above else stat <= t)
        return col


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, inside: str = "") -> Column:
        """The whole model as one expression inside code generation. inside: the struct that holds the statistics, with its dot."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(inside), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, columns: np.ndarray, terms: tuple = ()) -> tuple[list[Rule], np.ndarray]:
    """A regression tree's paths (inner ones too) and its fitted values."""
    rules = [Rule(terms)] if terms else []
    value = grad.sum() / (hess.sum() + 1.0)
    best = (1e-3, None)
    if depth and len(x) >= 20:
        total = grad.sum() ** 2 / (hess.sum() + 1)
        for k in columns:
            edges = cuts[k]
            if not len(edges):
                continue
            bins = np.searchsorted(edges, x[:, k], side="left")  # value <= edges[b] goes to bins 0..b
            g = np.cumsum(np.bincount(bins, grad, len(edges) + 1))
            h = np.cumsum(np.bincount(bins, hess, len(edges) + 1))
            n = np.cumsum(np.bincount(bins, minlength=len(edges) + 1))
            gl, hl, nl = g[:-1], h[:-1], n[:-1]
            gain = gl**2 / (hl + 1) + (g[-1] - gl) ** 2 / (h[-1] - hl + 1) - total
            gain[(nl < 5) | (n[-1] - nl < 5)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (int(k), float(edges[at])))
    if best[1] is None:
        return rules, np.full(len(x), value)
    k, t = best[1]
    above, fitted = x[:, k] > t, np.empty(len(x))
    for side in (False, True):
        part = above == side
        found, fitted[part] = _tree(x[part], grad[part], hess[part], cuts, depth - 1, columns, (*terms, (k, t, side)))
        rules += found
    return rules, fitted


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, rounds: int = 600, stands_for: np.ndarray | None = None) -> RuleModel:
    """Boosted trees, their paths as rules, then proximal gradient steps on the lasso logistic loss.

    stands_for: how many labelled rows each row of the sample stands for; without it all count alike.
    """
    if not len(y):
        return RuleModel((), (), 0.0)
    if y.min() == y.max():
        return RuleModel((), (), 8.0 if y[0] else -8.0)
    rng = np.random.default_rng(0)
    cuts = [np.unique(np.quantile(col, np.linspace(0.005, 0.995, 128)))[:-1] for col in x.T]
    weight = np.ones(len(y)) if stands_for is None else stands_for / stands_for.mean()
    share = (weight * y).mean()
    z, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        found, step = _tree(x, weight * (y - p), weight * p * (1 - p), cuts, depth, rng.permutation(x.shape[1])[: 2 * x.shape[1] // 3])
        rules |= dict.fromkeys(found)
        z += 0.3 * step
    rules = list(rules)
    a = np.column_stack([r.holds(x) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    mean = weight @ a / len(y)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0)) + 1e-3
    a = (a - mean) / spread
    w, b, v, vb = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0
    rate = 4 / (np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2 / len(y) + 1)
    for k in range(rounds):
        r = weight * (1 / (1 + np.exp(-(a @ v + vb))) - y) / len(y)
        new, newb = v - rate * (a.T @ r), vb - rate * r.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        pace = k / (k + 3)
        v, vb, w, b = new + pace * (new - w), newb + pace * (newb - b), new, newb
    keep = np.flatnonzero(np.abs(w) > 1e-9)
    weights = w[keep] / spread[keep]
    return RuleModel(tuple(rules[k] for k in keep), tuple(map(float, weights)), float(b - (mean[keep] * weights).sum()))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> RuleModel:
    sample = labelled_sample(documents, labels, label, HELD_OUT, rows).repartition(12)
    got = sorted(_collect(sample))
    # The sample cuts each label on its own, so a row stands for its label's rows over those taken.
    each = {k: n / min(n, rows // 2) for k, n in labelled_rows(labels, label, HELD_OUT).groupBy("label").count().collect()}
    return fit_rules(np.array([g[2:] for g in got]).reshape(len(got), len(STATS)), np.array([g[1] for g in got], float), stands_for=np.array([each[g[1]] for g in got]))


def _collect(sample: DataFrame) -> list[tuple]:
    """Statistics and label of the bounded sample."""

    def each(cols: dict) -> dict:
        stats = statistics_of(cols["text"])
        return {"doc_id": cols["doc_id"], "label": cols["label"]} | {s: stats[:, k] for k, s in enumerate(STATS)}

    schema = STAT_SCHEMA.replace("doc_id bigint,", "doc_id bigint, label int,")
    return [tuple(r) for r in map_rows(sample, ["doc_id", "text", "label"], schema, lambda: each).collect()]


def quality_scores(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(documents, labels, rows)
    return text_statistics(documents).select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score as good, with all their columns. No row moves."""
    model, name = train(documents, labels, rows), unused(documents, "_stats")

    def each(cols: dict) -> dict:
        got = statistics_of(cols["text"])
        return {s: got[:, k] for k, s in enumerate(STATS)}

    seen = append(documents, name, ["text"], STAT_SCHEMA.replace("doc_id bigint, ", ""), lambda: each)
    return seen.filter(model.column(f"{name}.") >= threshold).select(documents.columns)
