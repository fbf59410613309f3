"""Tokens of Arrow string columns as Arrow arrays, cut on raw bytes with numpy.

A token is a maximal run of bytes of a class.  UTF-8 never uses the bytes of ASCII characters inside longer ones, so classes of
ASCII characters, with all others inside or outside, can be cut on bytes.  Null texts have no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm import text as tx

_ASCII = np.arange(256)
#: Letters and digits of ASCII, and every other character.
ALNUM = (_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x41) & (_ASCII <= 0x5A)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))
#: All but space and U+0009..U+000D.
SOLID = ~((_ASCII == 0x20) | ((_ASCII >= 0x09) & (_ASCII <= 0x0D)))
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)


def tokens(column: pa.Array, inner: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, and the token number at which each text begins, and the end; ``lower`` turns A-Z into a-z."""
    data, offsets = tx._utf8(column)
    solid = inner[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] = solid[edges]  # a text's first byte opens a token even after a token
    starts = np.flatnonzero(opens)
    kept = data[solid]
    at = np.append(np.cumsum(solid, dtype=np.int64)[starts] - 1, len(kept))
    kept = LOWER[kept] if lower else kept
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each token."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
