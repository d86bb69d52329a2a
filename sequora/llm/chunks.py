"""Texts as chunks: what the pre-tokenizer pattern splits never crosses the edges of a chunk.

A chunk is a run without white space with the one space before it, or a run of white space.
Chunks repeat a lot, so a worker encodes each new one once and looks the others up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Code points with the Unicode property White_Space (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_ODD = [c for c in map(chr, [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) if c != "\n"]


def chunk_keys(text: str) -> list[str]:
    """The chunks of ``text`` as keys; ``key_text`` gives the chunk of a key.

    A text whose words are parted by one space or line feed each is split at them, which is
    several times as fast as the pattern; any other text goes through the pattern.
    """
    if not text:
        return []
    odd = _ODD[:4] if text.isascii() else _ODD
    if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in odd) or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
        return ["\r" + x for x in CHUNK.findall(text)]
    return ("\r" + text).replace("\n", " \n").split(" ")


def key_text(key: str) -> str:
    """``\\r`` marks a chunk as it is, ``\\n`` a word after a line feed; else a space comes before it."""
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key


class ChunkCache(dict):
    """Values by chunk key. Long chunks are not kept, and a full cache starts anew: memory is bounded."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 120_000, longest: int = 40) -> None:
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def values_of(self, texts: list[str]) -> list[list]:
        """The values of each text's chunks, in order; ``compute(chunks)`` is asked for new ones once."""
        keys = [chunk_keys(t) for t in texts]
        found = [list(map(self.get, x)) for x in keys]
        new = list({k for ks, vs in zip(keys, found) if None in vs for k, v in zip(ks, vs) if v is None})
        if new:
            fresh = dict(zip(new, self.compute([key_text(k) for k in new])))
            for i, (ks, vs) in enumerate(zip(keys, found)):
                if None in vs:
                    found[i] = [fresh[k] if v is None else v for k, v in zip(ks, vs)]
            if len(self) + len(new) > self.most:
                self.clear()
            self.update((k, v) for k, v in fresh.items() if len(k) <= self.longest)
        return found
