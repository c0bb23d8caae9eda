"""Token counts by byte-pair merging (operator 1).

A pre-token's bytes form a doubly linked list.  A heap holds the adjacent pairs
that the vocabulary can merge, keyed by merge rank and then by place; the lowest
is popped, stale entries are skipped, and the merged symbol's two new neighbour
pairs are pushed.  A pre-token of n bytes costs O(n log n) whatever its length.
The count is the number of initial symbols minus the number of merges; no token
identifiers are made.

Pre-tokens repeat, so each Python worker keeps bounded tables of counts.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.pretok import SPECIAL, Memo, chunks, splitter

#: Entries of each of a worker's two tables before it is emptied; about 150 bytes each.
MEMO_ENTRIES = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairMerger:
    """Merge table of a byte-level BPE vocabulary file (the ``.json`` format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        symbol = dict(byte_symbols())
        #: By pair of symbols, 20 bits each: the rank, then 20 bits of the merged symbol.
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbol[left], symbol[right]
            merged = symbol.setdefault(left + right, len(symbol))
            self.pairs.setdefault(a << 20 | b, rank << 20 | merged)

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = merged_n = len(word)
        get = self.pairs.get
        symbols = list(word)
        # an entry is rank << 32 | place: lowest rank first, leftmost among equals
        heap = [v >> 20 << 32 | i for i, (a, b) in enumerate(zip(word, word[1:])) if (v := get(a << 20 | b)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            e = pop(heap)
            i = e & 0xFFFFFFFF
            a = symbols[i]
            if a < 0:
                continue
            j = after[i]
            b = symbols[j]
            if b < 0:
                continue
            v = get(a << 20 | b)
            if v is None or v >> 20 != e >> 32:
                continue
            a = symbols[i] = v & 0xFFFFF
            symbols[j] = -1
            merged_n -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                v = get(a << 20 | symbols[j])
                if v is not None:
                    push(heap, v >> 20 << 32 | i)
            j = before[i]
            if j >= 0:
                v = get(symbols[j] << 20 | a)
                if v is not None:
                    push(heap, v >> 20 << 32 | j)
        return merged_n


@functools.cache
def _memos(path: str, entries: int) -> tuple[Memo, Memo]:
    """Counts by pre-token, and by chunk without the space before it."""
    count, find = PairMerger(path).count, splitter().findall
    words = Memo(lambda w: count(w.encode()), entries)
    return words, Memo(lambda c: sum(map(words.__getitem__, find(" " + c))), entries)


def count_tokens(text: str | None, path: str | None = None, entries: int = MEMO_ENTRIES) -> int:
    """Tokens of one text; null and empty texts have none."""
    if not text:
        return 0
    if SPECIAL in text:
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(count_tokens(p, path, entries) for p in parts)
    words, by_chunk = _memos(path or default_path(), entries)
    cut = chunks(text)
    if cut is None:
        return sum(map(words.__getitem__, splitter().findall(text)))
    first = sum(map(words.__getitem__, splitter().findall(cut[0])))
    return first + sum(map(by_chunk.__getitem__, cut[1:]))


def token_counts(docs: DataFrame, text: str = "text", *, keep: list[str] | None = None, path: str | None = None, limit: int = 512, entries: int = MEMO_ENTRIES) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to the ``keep`` columns.

    One row for each input row, repeated rows included.  Null text counts as
    empty: 0 bytes, 0 tokens.  Columns of ``docs`` outside ``keep`` (default:
    ``doc_id``) are dropped, so they can't clash; a ``keep`` column named as one
    of the three results is an error.  Nothing is shuffled.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    clash = {"n_bytes", "n_tokens", "over_limit"} & set(keep)
    if clash:
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].cast("string").alias("__text"))

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [count_tokens(t, path, entries) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["__row", "n_bytes", "n_tokens", "over_limit"])

    schema = slim.select("__row").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return slim.mapInArrow(run, schema).select("__row.*", "n_bytes", "n_tokens", "over_limit")
