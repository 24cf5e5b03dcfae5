"""Compression with zstandard raw-content dictionaries, used by the language and quality classifiers."""

from __future__ import annotations

import zstandard


#: Bytes of a slice that a long text gives to a dictionary.
SLICE = 256


class Codec:
    """Compressed sizes of texts under one raw-content dictionary.

    Texts of more than `piece` bytes are compressed in pieces, each against the fresh dictionary, and the sizes added:
    a long text would else match itself more and more, and the dictionary less.
    """

    def __init__(self, content: bytes, level: int, piece: int):
        self._piece = piece
        d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def size(self, data: bytes) -> int:
        if len(data) <= self._piece:
            return len(self._compress(data))
        return sum(len(self._compress(data[i : i + self._piece])) for i in range(0, len(data), self._piece))


def content(texts: list[bytes], limit: int) -> bytes:
    """A dictionary of at most `limit` bytes: each text gives an equal share, in slices from all over it where it is longer."""
    out, left = [], limit
    for i, t in enumerate(sorted(texts, key=len)):
        share = left // (len(texts) - i)
        slices = min(-(-share // SLICE), 8) if len(t) > share else 1
        step, each = len(t) // slices, share // slices
        out.append(b"".join(t[k * step : k * step + each] for k in range(slices)) if len(t) > share else t)
        left -= len(out[-1])
    return b"\n".join(out)[-limit:]
