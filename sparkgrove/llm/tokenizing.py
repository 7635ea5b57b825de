"""Byte-level BPE over whole columns of text, with pre-tokenisation by scans instead of regular expressions.

A batch of texts becomes one array of code points. A table gives each code point its class (letter,
number, white space, apostrophe, other); with the classes of the neighbours that makes one of a few symbols.
Every symbol is a function from the state before it to the state after it, such functions compose
associatively, and so the states at all positions come from a blocked scan over arrays. A word starts where the
scan says so. The words' bytes go through a cache of finished merges.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; the files are read where they lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)  # classes; SPACE is white space other than the blank
# States: what the word that holds the last code point is, and so what may follow in it.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, CLITIC_1, CLITIC_2 = range(8)
# Symbols: classes with what follows them. *_LAST: the white space before something else; QUOTE_n: an
# apostrophe before a clitic of n letters.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_SPACE_LAST, S_BLANK_LAST, S_QUOTE_1, S_QUOTE_2, S_START = range(9)
#: The clitics that form words of their own.
CLITICS = ("s", "t", "m", "d", "re", "ve", "ll")
BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word starts) by state and symbol."""
    step, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for state in range(8):
        run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
        for symbol, own in run.items():
            step[symbol, state], begins[symbol, state] = own, state not in (own, AFTER_BLANK)
        for symbol, letters in ((S_QUOTE_1, CLITIC_1), (S_QUOTE_2, CLITIC_2)):
            joins = state in (IN_OTHERS, AFTER_BLANK)
            step[symbol, state], begins[symbol, state] = IN_OTHERS if joins else letters, not joins
        step[S_SPACE, state], begins[S_SPACE, state] = IN_SPACE, state != IN_SPACE
        step[S_SPACE_LAST, state], begins[S_SPACE_LAST, state] = FRESH, True
        step[S_BLANK_LAST, state], begins[S_BLANK_LAST, state] = AFTER_BLANK, True
        if state in (CLITIC_1, CLITIC_2):
            step[S_LETTER, state], begins[S_LETTER, state] = (FRESH if state == CLITIC_1 else CLITIC_1), False
    return step, begins


STEP, BEGINS = _automaton()


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode categories; white space as regular expressions have it."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(sys.maxunicode + 1):
        if (kind := kinds.get(unicodedata.category(chr(point))[0])) is not None:
            table[point] = kind
    for point in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[point] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks the first one of each text."""
    kinds = class_table()[points]
    n = len(points)
    ends = np.append(first[1:], True)
    white = (kinds == SPACE) | (kinds == BLANK)
    more_white = np.append(white[1:], False)
    out = np.array([S_LETTER, S_NUMBER, S_SPACE, S_SPACE, S_OTHER, S_OTHER], np.uint8)[kinds]
    last = white & ~more_white & ~ends
    out[last & (kinds == SPACE)] = S_SPACE_LAST
    out[last & (kinds == BLANK)] = S_BLANK_LAST
    at = np.flatnonzero((kinds == QUOTE) & ~ends)
    if len(at):
        one = points[at + 1]
        after = at + 2
        inside = (after < n) & ~ends[at + 1]
        two = np.where(inside, points[np.minimum(after, n - 1)], 0)
        for clitic in CLITICS:
            hit = one == ord(clitic[0])
            if len(clitic) == 2:
                hit &= two == ord(clitic[1])
            out[at[hit]] = S_QUOTE_1 if len(clitic) == 1 else S_QUOTE_2
    return out


def states_before(syms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's state before each position, by a blocked scan of transition functions.

    The first position of a text forgets what came before, so its function is constant.
    """
    n = len(syms)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = syms
    fresh = np.zeros(blocks * BLOCK, bool)
    fresh[:n] = first
    padded, fresh = padded.reshape(blocks, BLOCK), fresh.reshape(blocks, BLOCK)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # the function of each block
    for j in range(BLOCK):
        whole[fresh[:, j]] = FRESH
        whole = STEP[padded[:, j][:, None], whole]
    width = 1  # functions of all blocks up to this one, by doubling
    while width < blocks:
        whole[width:] = np.take_along_axis(whole[width:], whole[:-width], axis=1)
        width *= 2
    state = np.append(np.uint8(FRESH), whole[:-1, FRESH]) if blocks else np.zeros(0, np.uint8)
    before = np.empty((blocks, BLOCK), np.uint8)
    for j in range(BLOCK):
        state = np.where(fresh[:, j], FRESH, state).astype(np.uint8)
        before[:, j] = state
        state = STEP[padded[:, j], state]
    return before.reshape(-1)[:n]


def word_starts(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of the texts together, the byte offsets where words start (and the end), and the words of each text."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # surrogates cannot stand in Spark's strings; "surrogatepass" keeps this total all the same
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(points), bool)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    first[offsets[:-1][lengths > 0]] = True
    syms = symbols(points, first)
    begins = BEGINS[syms, states_before(syms, first)] | first
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.append(at[np.flatnonzero(begins)], at[-1])
    counts = np.concatenate(([0], np.cumsum(begins)))[offsets]
    return joined.encode("utf-8", "surrogatepass"), starts, np.diff(counts)


class BytePairs:
    """Ids of byte-level BPE words, from a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the adjacent pair of lowest rank is merged until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return (whole,)
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    pair = parts[left] + parts[right]
                    if (r := ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, left, len(pair)))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        data, starts, counts = word_starts(texts)
        known, bounds, k = self.words, starts.tolist(), 0
        for count in counts.tolist():
            ids: list[int] = []
            for i in range(k, k + count):
                word = data[bounds[i] : bounds[i + 1]]
                found = known.get(word)
                if found is None:
                    found = self.merge(word)
                    if len(word) <= 64:
                        if len(known) > 500_000:
                            known.clear()
                        known[word] = found
                ids += found
            yield ids
            k += count

    def decode(self, ids: Sequence[int]) -> str:
        words = self.decoder()
        return b"".join(words[i] for i in ids).decode("utf-8", "replace")

    @lru_cache(1)
    def decoder(self) -> dict[int, bytes]:
        return {rank: word for word, rank in self.ranks.items()}


@lru_cache(2)
def vocabulary(path: str) -> BytePairs:
    """Loaded once per Python worker."""
    return BytePairs(path)


def _slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` code points, so that memory doesn't follow the batch."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_column(docs: DataFrame, key: str, text: str, count_only: bool = False, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ``count_only``.

    Null and empty texts have an empty list and no tokens. The text is taken as it is, special tokens are ordinary text. Rows
    that repeat are encoded as often as they come; rows with a null key stay. Other columns are dropped, so
    their names cannot clash. Very long texts are encoded whole. There is no shuffle.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                found = pairs.encode([x or "" for x in texts[a:b]])
                made = pa.array((len(x) for x in found), pa.int32()) if count_only else pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], names=["key", "made"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, made {'int' if count_only else 'array<int>'}")
    return out.toDF(key, "n_tokens" if count_only else "ids")


def decode_column(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; a null list gives null, ids outside the vocabulary raise an error."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    kind = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else pairs.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind.simpleString()}, text string").toDF(key, "text")
