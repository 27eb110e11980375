"""Token counts of a byte-level BPE vocabulary, with a shortcut for words that are one token.

On the driver, every vocabulary string is put to the proof: it is in the shortcut only if the pre-tokeniser leaves it
whole and the file's merges turn its bytes into exactly that one token. In the tasks a pre-token of the shortcut counts one
at once; the rest is merged, by the file's list of merges, and its length remembered within the task. Strings of special tokens inside a text are
one token each, as the library does by default.

The rest goes to a compiled merger that joins whatever neighbours give the string of the lowest rank. That is the same as the file's list, pair by pair, if
every merge gives a string of its own and every string that takes part is reached when its bytes are merged alone: merges within a stretch of text go
in the same order wherever it stands, so a string that forms there forms from the same pair. The driver proves both by the list; with a
file where the first fails, tasks merge by the list itself. A file that asks for anything else, as another normaliser, pre-tokeniser or way to merge, is refused.

Nulls and empty texts count no tokens. Texts of any length are counted whole, also where they are one word, in time that grows a little more
than in proportion; memory follows the longest text, at some twenty times its size. Repeated rows are each answered, an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import map_rows

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
#: A document with more tokens than this is over the limit.
LIMIT = 512
#: Lengths that a task remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of a pre-token from which on its merges are held in a heap.
LONG_PIECE = 200
#: What stands for a pair that isn't merged: later than every rank.
NEVER = (1 << 60, -1)

# The pattern of the pre-tokeniser that the vocabulary file names.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _whole(strings: Iterable[bytes]) -> Iterator[str]:
    """Those that are text and that the pre-tokeniser leaves whole."""
    pattern = regex.compile(PRE_TOKEN)
    for piece in strings:
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        if (m := pattern.match(text)) and m.end() == len(text):
            yield text


def _check(told: dict) -> None:
    """Refuse a file that asks for more than is done here."""
    model, before = told["model"], told.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in {
            "the model isn't BPE": model.get("type", "BPE") != "BPE",
            "a normaliser": told.get("normalizer") is not None,
            "a pre-tokeniser that isn't the byte-level one with its pattern": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
            "dropout, fall-back, prefix or suffix": any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")),
            "added tokens that aren't plain strings": any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
            "single bytes without a token": not _byte_letters().keys() <= model["vocab"].keys(),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"this vocabulary can't be counted: {', '.join(wrong)}")


class Vocabulary:
    """Merges over numbered symbols, added strings, and the shortcut."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        _check(told)
        letters, vocabulary = _byte_letters(), told["model"]["vocab"]
        self.special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.byte = [0] * 256
        for letter, byte in letters.items():
            self.byte[byte] = vocabulary[letter]
        #: A pair of symbols to its rank among the merges and to the symbol that it gives.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        strings = {bytes(letters[c] for c in t): k for t, k in vocabulary.items() if t not in self.special and set(t) <= letters.keys()}
        alone = {piece: k for piece, k in strings.items() if self.merged(piece) == 1}
        #: Vocabulary strings that encode alone as one token: whole after the pre-tokeniser, one after the merges.
        self.shortcut = dict.fromkeys(_whole(alone), 1)
        rank = {new: 256 + place for place, new in self.merges.values()}
        own = len(rank) == len(self.merges)
        #: Ranks for the compiled merger, if it may be used: single bytes, then reached strings in the order of their merges.
        self.ranks = {piece: rank.get(k, piece[0]) for piece, k in alone.items()} if own else None

    def merger(self) -> Callable[[str], int]:
        """A function from a pre-token to its number of tokens after all merges."""
        if self.ranks is None:
            return lambda text: self.merged(text.encode("utf-8", "surrogatepass"))
        import tiktoken

        piece = tiktoken.Encoding("counted", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        return lambda text: len(piece(text.encode("utf-8", "surrogatepass")))

    def merged(self, piece: bytes) -> int:
        """The number of tokens of one pre-token by the list: of all neighbours the pair of the lowest rank is merged first, then the one further left."""
        symbols, get = [self.byte[b] for b in piece], self.merges.get
        if len(symbols) > LONG_PIECE:
            return self._merged_long(symbols)
        offers = [get(pair, NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
        while offers and (best := min(offers)) is not NEVER:
            at = offers.index(best)
            symbols[at : at + 2] = [best[1]]
            del offers[at]
            if at:
                offers[at - 1] = get((symbols[at - 1], best[1]), NEVER)
            if at < len(offers):
                offers[at] = get((best[1], symbols[at + 1]), NEVER)
        return len(symbols)

    def _merged_long(self, symbols: list[int | None]) -> int:
        """The same by a heap of pairs over linked symbols, for long pre-tokens."""
        n, get = len(symbols), self.merges.get
        after, back = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (found := get((symbols[k], symbols[after[k]]))):
                heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]], found[1]))

        for k in range(n - 1):
            offer(k)
        count = n
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            other = after[k]
            if symbols[k] != left or other < 0 or symbols[other] != right:
                continue
            symbols[k], symbols[other], after[k] = new, None, after[other]
            if after[k] >= 0:
                back[after[k]] = k
            count -= 1
            offer(back[k])
            offer(k)
        return count


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def counter(known: Vocabulary):
    """A function from a text to its number of tokens."""
    find, merged, seen = regex.compile(PRE_TOKEN).findall, known.merger(), dict(known.shortcut)
    apart = regex.compile("|".join(map(regex.escape, known.special))) if known.special else None

    def plain(text: str) -> int:
        nonlocal seen
        pieces = find(text)
        got = list(map(seen.get, pieces))
        if None in got:
            if len(seen) > REMEMBERED:
                seen = dict(known.shortcut)
            for k, n in enumerate(got):
                if n is None:
                    piece = pieces[k]
                    got[k] = seen[piece] = seen.get(piece) or merged(piece)
        return sum(got)

    def count(text: str | None) -> int:
        if not text:
            return 0
        if apart is None or not apart.search(text):
            return plain(text)
        return len(apart.findall(text)) + sum(plain(part) for part in apart.split(text) if part)

    return count


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. No shuffle; what is broadcast has the vocabulary's size."""
    held = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def start():
        count = counter(held.value)
        return lambda cols: {"doc_id": cols["doc_id"], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols["text"]], "n_tokens": [count(t) for t in cols["text"]]}

    return map_rows(documents, ["doc_id", "text"], SCHEMA, start).withColumn("over_limit", F.col("n_tokens") > limit)
