"""Token statistics of whole texts with a public sentencepiece vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: First code points of the scripts told apart, in order.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Other"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x1E00, "Latin"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODES = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def script(text: str) -> str | None:
    """The script with most letters in the text; None without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    points = points[(points >= 0xAA) | ((points >= 65) & (points < 91)) | ((points >= 97) & (points < 123))]
    if not len(points):
        return None
    which = np.bincount(_CODES[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_NAMES))
    return _NAMES[int(which.argmax())]


class Vocabulary:
    """A sentencepiece model, loaded once per worker."""

    _held: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def fertility(self, column: pa.Array) -> list[pa.Array]:
        """script, n_tokens, characters per token, byte share and relative entropy of each text; null for texts without tokens."""
        out: list[tuple] = []
        for text in column.to_pylist():
            ids = np.array(self.model.encode(text), dtype=np.int32) if text else ()
            n = len(ids)
            if not n:
                out.append((None, 0, None, None, None))
                continue
            times = np.bincount(ids)
            times = times[times > 0]
            entropy = float(np.log2(n) - (times * np.log2(times)).sum() / n)
            most = np.log2(n) if n > 1 else 1.0
            out.append((script(text), n, len(text) / n, float(self.is_byte[ids].mean()), entropy / most))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
