"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut at added tokens and then into pieces by the byte-level pattern.  Within a piece every
adjacent pair of tokens has a leaf that holds its merge rank and position; inner nodes hold the least
of their children, so the root yields the leftmost lowest-rank merge.  A merge changes three leaves
and the nodes above them.  It ends when no pair is left that can be merged.

Pieces up to 64 bytes are encoded many at once: one tree per row of a numpy table.  Longer ones get a
tree of their own.  Encoded pieces are remembered up to a bound, then forgotten together.

Defined results
---------------
* null or empty text: no tokens, empty text;
* very long texts and pieces without any space are encoded whole;
* repeated rows get equal results; null ids are kept;
* an empty table gives an empty table; further columns are ignored, whatever their names;
* ids outside the vocabulary are skipped when decoding; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

# Fixed values of the byte-level format: its pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ROW_BYTES = 64
REMEMBERED = 120_000
_NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it is a visible Latin-1
    character, else the next code point from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class SegmentTree:
    """Least (rank, position) over the adjacent pairs of one piece."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [int(_NEVER)] * self.size + keys + [int(_NEVER)] * (self.size - len(keys))
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def least(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        k = at + self.size
        self.node[k] = key
        while k > 1:
            k >>= 1
            least = min(self.node[2 * k], self.node[2 * k + 1])
            if self.node[k] == least:
                return
            self.node[k] = least


class Codec:
    """Encoder and decoder of one tokenizer description (the JSON text of a byte-level BPE)."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normaliser or prefix space is needed")
        odd = [k for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word") if any(t.get(k) for t in spec.get("added_tokens", []))]
        if odd:
            raise ValueError(f"this description asks for what is not done here: {', '.join(odd)}")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.wide = max(max(vocab.values()), *self.added.values(), 0) + 2
        keys = np.array([vocab[a] * self.wide + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys.tolist())))}
        parts = [b""] * (self.wide - 1)
        for token, k in vocab.items():
            parts[k] = bytes(to_byte[c] for c in token)
        for token, k in self.added.items():
            parts[k] = token.encode()
        self.token_size = np.array([len(p) for p in parts], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    # --- pieces

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _rank_keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NEVER; negative tokens pair with nothing."""
        key = left * self.wide + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NEVER)

    def _encode_rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids one after another and their number for each piece; pieces have at most ``width`` bytes."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        token = np.full((n, width + 1), -1, np.int64)
        row = np.repeat(np.arange(n), size)
        col = X.gather_ranges(np.zeros(n, np.int64), size)
        token[row, col] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(width + 1) + 1, width) * np.ones((n, 1), np.int64)
        before = np.arange(width + 1) - 1 + np.zeros((n, 1), np.int64)
        shift = np.int64(width)
        tree = np.full((n, 2 * width), _NEVER * shift, np.int64)
        rank = self._rank_keys(token[:, :-1], token[:, 1:])
        tree[:, width:] = np.where(rank < _NEVER, rank * shift + np.arange(width), _NEVER * shift)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

        def put(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
            k = at + width
            tree[rows, k] = keys
            while width > 1 and k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < _NEVER * shift) if width > 1 else np.zeros(0, np.int64)
        while len(rows):
            root = tree[rows, 1]
            at, gone = root % shift, None
            gone = after[rows, at]
            token[rows, at] = self.made[root // shift]
            token[rows, gone] = -1
            right = after[rows, gone]
            after[rows, at] = right
            before[rows, right] = at
            put(rows, gone, np.full(len(rows), _NEVER * shift))
            rank = self._rank_keys(token[rows, at], token[rows, right])
            put(rows, at, np.where(rank < _NEVER, rank * shift + at, _NEVER * shift))
            left = before[rows, at]
            has = np.flatnonzero(left >= 0)
            if len(has):
                r, p = rows[has], left[has]
                rank = self._rank_keys(token[r, p], token[r, at[has]])
                put(r, p, np.where(rank < _NEVER, rank * shift + p, _NEVER * shift))
            rows = rows[tree[rows, 1] < _NEVER * shift]
        alive = token >= 0
        return token[alive].astype(np.int32), alive.sum(1)

    def _encode_long(self, piece: bytes) -> list[int]:
        token = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(p: int) -> int:
            q = after[p]
            rank = self.rank_of.get(token[p] * self.wide + token[q]) if q < n else None
            return int(_NEVER) * n if rank is None else rank * n + p

        none = int(_NEVER) * n
        tree = SegmentTree([key(p) for p in range(n)])
        tree.node = [none if x == int(_NEVER) else x for x in tree.node]
        while (root := tree.least()) < none:
            p = root % n
            gone = after[p]
            token[p], token[gone] = int(self.made[root // n]), -1
            after[p] = after[gone]
            if after[p] < n:
                before[after[p]] = p
            tree.put(gone, none)
            tree.put(p, key(p))
            if before[p] >= 0:
                tree.put(before[p], key(before[p]))
        return [t for t in token if t >= 0]

    def _learn(self, pieces: Iterable[str]) -> None:
        groups: dict[int, list[str]] = {}
        for p in pieces:
            b = len(p.encode())
            groups.setdefault(0 if b > ROW_BYTES else 1 << (b - 1).bit_length(), []).append(p)
        for width, group in groups.items():
            step = max(1, 400_000 // max(1, width))
            for k in range(0, len(group), step if width else 1):
                part = group[k : k + (step if width else 1)]
                if width:
                    flat, size = self._encode_rows([p.encode() for p in part], width)
                else:
                    flat = np.array(self._encode_long(part[0].encode()), np.int32)
                    size = np.array([len(flat)])
                self._add(part, flat, size)

    def _add(self, pieces: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        base = len(self.number)
        self.number.update((p, base + k) for k, p in enumerate(pieces))
        self.pending.append((flat, size))

    def _settle(self) -> None:
        if self.pending:
            flats, sizes = zip(*self.pending, strict=True)
            size = np.concatenate([self.size, *sizes])
            self.flat = np.concatenate([self.flat, *flats])
            self.size, self.start = size, np.cumsum(size) - size

    # --- texts

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and the number of tokens of each."""
        if len(self.number) > REMEMBERED:
            self.forget()
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        find, pieces, counts = self.pattern.findall, [], []
        special: list[str] = []
        for text in texts:
            before = len(pieces)
            if self.split is not None and (parts := self.split.split(text)) and len(parts) > 1:
                for k, part in enumerate(parts):
                    if k % 2:
                        pieces.append("\0added " + part)  # no piece of the pattern mixes these classes
                        special.append(part)
                    else:
                        pieces += find(part)
            else:
                pieces += find(text)
            counts.append(len(pieces) - before)
        for part in set(special):
            if "\0added " + part not in self.number:
                self._add(["\0added " + part], np.array([self.added[part]], np.int32), np.array([1]))
        self._learn({p for p in pieces if p not in self.number} if len(self.number) else set(pieces))
        self._settle()
        which = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        size = self.size[which]
        flat = self.flat[X.gather_ranges(self.start[which], size)]
        bounds = np.append(0, np.cumsum(counts))
        total = np.append(0, np.cumsum(size))
        return flat, total[bounds[1:]] - total[bounds[:-1]]

    def decode_many(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        """UTF-8 texts of token lists that lie one after another."""
        known = (flat >= 0) & (flat < len(self.token_size))
        ids = np.where(known, flat, 0)
        lengths = np.where(known, self.token_size[ids], 0)
        data = self.token_bytes[X.gather_ranges(self.token_start[ids], lengths)].tobytes()
        total = np.append(0, np.cumsum(lengths))
        bounds = total[np.append(0, np.cumsum(size))].tolist()
        out = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        try:
            data.decode()
            return out
        except UnicodeDecodeError:
            return [x.decode("utf-8", "replace").encode() for x in out]


_codecs: dict[int, Codec] = {}


def _codec(description: str) -> Codec:
    key = hash(description)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(description)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids) and decoded (the text that the ids decode to) of every row.

    ``tokenizer_path`` names a tokenizer description that the driver can read; executors get its text.
    """
    X.small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(description.value)
        for batch in batches:
            for lo, hi, data, offsets in X.chunks(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                flat, size = codec.encode_many(texts)
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(flat, pa.int32()))
                decoded = pa.array(codec.decode_many(flat, size), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, decoded], names=["doc_id", "ids", "decoded"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(X.tidy(run), "doc_id long, ids array<int>, decoded string")
