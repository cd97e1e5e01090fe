"""Byte-level BPE of many texts, a word at a time.

The vocabulary cuts a text before every space that follows another character
than white space, so the stretches between such spaces are encoded on their
own. Equal stretches of a batch are encoded once, and remembered. That holds
for texts of characters below U+0250 without no-break spaces; all others go
through the tokenizer as a whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from funnelspark.llm.textarrays import Spans, hashes, is_space, utf8

#: Stretches remembered by a worker; the memory is emptied when full.
REMEMBERED = 150_000
SPECIAL = b"<|endoftext|>"


class ByteBpe:
    _held: dict[tuple, ByteBpe] = {}

    def __init__(self, tokenizer: str, ranks: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.path, self._whole = tokenizer, None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[bytes, int] = {}
        self._reset()

    @property
    def whole(self):
        """The tokenizer itself, loaded with the first text that needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    @classmethod
    def of(cls, tokenizer: str, ranks: str) -> ByteBpe:
        key = tokenizer, ranks
        if key not in cls._held:
            cls._held[key] = cls(*key)
        return cls._held[key]

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.start = np.zeros(1 << 18, dtype=np.int64)

    def _learn(self, new: list[bytes]) -> None:
        encode = self.part.encode_ordinary
        encoded = [encode(b.decode()) for b in new]
        lengths = np.fromiter(map(len, encoded), np.int64, len(new))
        flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        n = len(self.known)
        base = int(self.start[n])
        while base + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[base : base + len(flat)] = flat
        self.start[n + 1 : n + len(new) + 1] = base + np.cumsum(lengths)
        self.known.update(zip(new, range(n, n + len(new))))

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> Spans:
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = (data[1:] == 32) & ~is_space(data[:-1])
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        row = np.searchsorted(offsets, start, side="right") - 1
        return Spans(start, np.append(start[1:], len(data)), row, len(offsets) - 1)

    def encode(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text followed by ``end``; null counts as empty."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        odd = data >= 0xCA
        odd[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(odd)])
        whole = np.diff(sums[offsets]) > 0
        blob = data.tobytes()
        if SPECIAL in blob:
            whole |= np.array([SPECIAL in blob[a:b] for a, b in zip(offsets[:-1], offsets[1:])])

        spans = self._stretches(data, offsets)
        plain = ~whole[spans.row]
        spans = Spans(spans.start[plain], spans.end[plain], spans.row[plain], rows)
        _, first, which = np.unique(hashes(data, spans), return_index=True, return_inverse=True)
        parts = [blob[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
        if len(self.known) > REMEMBERED:
            self._reset()
        new = [p for p in parts if p not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))[which] if parts else np.zeros(0, np.int64)
        start, length = self.start[at], self.start[at + 1] - self.start[at]
        done = np.cumsum(length)
        flat = self.ids[np.arange(done[-1] if len(done) else 0) + np.repeat(start - done + length, length)]
        size = np.bincount(spans.row, weights=length, minlength=rows).astype(np.int64)
        upto = np.cumsum(size)
        flat = np.insert(flat, upto, np.uint32(end))
        upto = upto + np.arange(1, rows + 1)
        out = [flat[b - n - 1 : b] for b, n in zip(upto.tolist(), size.tolist())]
        for i in np.flatnonzero(whole):
            ids = self.whole.encode(blob[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids
            out[i] = np.array([*ids, end], dtype=np.uint32)
        return out
