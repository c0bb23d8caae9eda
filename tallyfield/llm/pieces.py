"""SentencePiece encoding and decoding (operator 3).

Pieces stand in a double-array trie over their UTF-8 bytes: a state's child by
byte ``c`` is ``base[state] + c`` if ``check`` there names the state.  Viterbi
takes the segmentation with the greatest sum of log scores.  A character that no
piece covers falls back to the pieces of its bytes.  White space is a marker in
front of words; decoding joins pieces and bytes and turns markers into spaces,
and gives back the text exactly.

Where no piece has a marker after another character, the best segmentation of a
text is that of its words one by one, and words repeat: each worker keeps a
bounded table of them.  A model with other pieces has its texts segmented whole.

A unigram model's scores are taken as they are.  Of the public vocabularies none
has any: the one with byte fallback ranks its pieces.  Its ranks become log scores by Zipf's law, with the
score of a piece of rank r that of 1 / (r + 10).
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyfield.llm.arrowio import slices
from tallyfield.llm.pretok import Memo

MARK = "▁"
MEMO_ENTRIES = 500_000
#: What falling back costs beyond the least score of a piece.
PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """Static trie of byte strings with a value each."""

    def __init__(self, values: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in values.items():
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = value
        size = 2 * len(tree) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, todo = 1, [(0, 0)]
        while todo:
            node, state = todo.pop()
            self.value[state] = ends.get(node, -1)
            children = sorted(tree[node])
            if not children:
                self.base[state] = size  # leads nowhere
                continue
            while self.check[free] >= 0:
                free += 1
            at, taken = free, 0
            while True:
                b = at - children[0]
                while b + 256 >= len(self.check):
                    self._grow()
                if b > 0 and all(self.check[b + c] < 0 for c in children):
                    break
                taken += self.check[at] >= 0
                at += 1
            if taken > 0.9 * (at - free + 1):
                free = at  # nearly full up to here: later searches begin beyond
            self.base[state] = b
            for c in children:
                self.check[b + c] = state
            todo += [(tree[node][c], b + c) for c in children]
        end = len(self.check)
        self.base = [end if b == size else b for b in self.base]
        self.check += [-1] * 256

    def _grow(self) -> None:
        n = len(self.check)
        self.base += [0] * n
        self.check += [-1] * n
        self.value += [-1] * n

    def prefixes(self, data: bytes, start: int) -> list[tuple[int, int]]:
        """(end, value) of each key that ``data`` has at ``start``, shortest first."""
        base, check, value, state, out = self.base, self.check, self.value, 0, []
        for i in range(start, len(data)):
            to = base[state] + data[i]
            if check[to] != state:
                break
            state = to
            if value[state] >= 0:
                out.append((i + 1, value[state]))
        return out


class Unigram:
    """Pieces by id, their log scores, and the pieces of single bytes."""

    def __init__(self, pieces: dict[int, tuple[str, float]], byte_ids: list[int]):
        self.pieces = pieces
        self.score = {i: s for i, (_, s) in pieces.items()}
        self.scores = [self.score.get(i, -math.inf) for i in range(max(self.score, default=-1) + 1)]
        self.byte_ids = byte_ids
        self.least = min(self.score.values(), default=0.0) - PENALTY
        self.trie = DoubleArray({p.encode(): i for i, (p, _) in pieces.items()})
        #: Whether words can be segmented one by one.
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in pieces.values())
        self.bytes_of = {i: p.replace(MARK, " ").encode() for i, (p, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.known = np.zeros(max(self.bytes_of, default=0) + 1, bool)
        self.known[list(self.score)] = True

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = [0] * 256
        pieces = {}
        # ranks are whole numbers that fall by one; log scores aren't
        scores = [model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranked = all(s == int(s) for s in scores)
        for i in ids:
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = model.id_to_piece(i), -math.log(10 - model.get_score(i)) if ranked else model.get_score(i)
        return cls(pieces, byte_ids)

    def segment(self, word: str) -> list[int]:
        """Ids of the best segmentation of one word, its markers in place."""
        data = word.encode()
        n, score, least = len(data), self.scores, self.least
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, begin, piece_of = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            after = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, alone = best[i], False
            # down the trie, as ``prefixes`` does, without a list
            state, j = 0, i
            while j < n:
                to = base[state] + data[j]
                if check[to] != state:
                    break
                state = to
                j += 1
                piece = value[state]
                if piece >= 0:
                    s = here + score[piece]
                    if s > best[j]:
                        best[j], begin[j], piece_of[j] = s, i, piece
                    if j == after:
                        alone = True
            if not alone:
                s = here + least
                if s > best[after]:
                    best[after], begin[after], piece_of[after] = s, i, -1
            i = after
        out = []
        while n:
            i, piece = begin[n], piece_of[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(data[i:n])]
            n = i
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def _words(model: Unigram) -> re.Pattern:
    """Markers, then other characters; every text is such words one after another.

    A control character that no longer piece has is a word of its own, as every
    segmentation cuts before and behind it.
    """
    longer = {c for p, _ in model.pieces.values() if len(p) > 1 for c in p}
    alone = re.escape("".join(c for c in "\n\t\r\x0b\x0c" if c not in longer))
    return re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))


class Codec:
    """Encoding of whole texts; a marker that the text itself has goes by its bytes."""

    def __init__(self, model: Unigram, entries: int = MEMO_ENTRIES):
        self.model = model
        self.memo = Memo(lambda w: array("I", model.segment(w)).tobytes(), entries)
        self.words = _words(model)
        self.mark = array("I", [model.byte_ids[b] for b in MARK.encode()]).tobytes()

    def encode(self, text: str | None) -> array:
        """Ids; none for null and empty texts."""
        out = array("I")
        if not text:
            return out
        parts = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                parts.append(self.mark)
            marked = part.replace(" ", MARK)
            whole = marked if k else MARK + marked
            if not self.model.by_word:
                parts.append(array("I", self.model.segment(whole)).tobytes())
                continue
            parts += map(self.memo.__getitem__, self.words.findall(whole))
        out.frombytes(b"".join(parts))
        return out


@functools.cache
def codec(path: str) -> Codec:
    return Codec(Unigram.load(path))


def encoded(docs: DataFrame, text: str = "text", *, keep: list[str], path: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``ids`` (array) and ``decoded`` (the text from them again).

    A row for each row of ``docs``.  Null and empty texts have no ids and decode
    to the empty text.
    """
    return _run(docs, text, keep, path, {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "decoded": ("string", pa.string())}, lambda c, t, ids: (ids.tolist(), c.model.decode(ids)))


def digests(docs: DataFrame, text: str = "text", *, keep: list[str], path: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``n_bytes, n_pieces, n_byte_pieces, ids_crc32, round_trip``, as above without the ids."""

    def row(c: Codec, t: str | None, ids: array) -> tuple:
        by_bytes = int((~c.model.known[np.frombuffer(ids, np.uint32)]).sum())
        return len((t or "").encode()), len(ids), by_bytes, zlib.crc32(ids.tobytes()), c.model.decode(ids) == (t or "")

    long = ("long", pa.int64())
    return _run(docs, text, keep, path, {"n_bytes": long, "n_pieces": long, "n_byte_pieces": long, "ids_crc32": long, "round_trip": ("boolean", pa.bool_())}, row)


def _run(docs: DataFrame, text: str, keep: list[str], path: str | None, results: dict, row) -> DataFrame:
    if clash := set(results) & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].cast("string").alias("__text"))

    def run(batches):
        c = codec(path or default_path())
        for b in slices(batches):
            rows = [row(c, t, c.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(results.values()))], names=["__row", *results])

    schema = slim.select("__row").schema
    for name, (kind, _) in results.items():
        schema = schema.add(name, kind)
    return slim.mapInArrow(run, schema).select("__row.*", *results)
