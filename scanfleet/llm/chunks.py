"""Token ids of texts by way of their distinct chunks.

A tokenizer whose first step splits at white space gives a chunk the same ids wherever it stands. So each distinct
chunk is encoded once and texts are sums of what their chunks gave. The store of a Python worker is bounded: past ``limit``
entries it starts anew, which costs time and changes no id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa


#: Texts whose chunks are held at a time.
STEP = 64


class ChunkStore:
    """Ids, as bytes of 32-bit integers, of the chunks seen so far."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, texts: list[str | None], chunks: Callable[[str], list[str]]) -> list[bytes]:
        """The ids of each text. Chunks of a few texts at a time are held."""
        out: list[bytes] = []
        for i in range(0, len(texts), STEP):
            if len(self.known) > self.limit:
                self.known = {}
            lists = [chunks(t) if t else [] for t in texts[i : i + STEP]]
            missing = list(set().union(*lists).difference(self.known))
            if missing:
                self.known.update(zip(missing, self.encode(missing)))
            out += [b"".join(map(self.known.__getitem__, x)) for x in lists]
        return out


def id_lists(ids: list[bytes]) -> pa.Array:
    """array<int> from bytes of 32-bit integers."""
    offsets = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
