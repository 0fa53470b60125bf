"""Pre-tokens of a byte-level BPE vocabulary, found for many texts at once.

The split rule of byte_bpe_50k.json is: contractions, letters, numbers and other characters (each run with at most one
space before it), and white space, of which the last character before a word stays apart. Each rule only looks at the
classes of neighbouring characters, so that the starts of all pre-tokens come from a few array operations.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import regex
from tokenizers import pre_tokenizers

from . import common

OTHER, LETTER, NUMBER, SPACE = range(4)
SPECIAL = "<|endoftext|>"


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    codes = np.arange(sys.maxunicode + 1, dtype="<u4")
    codes[0xD800:0xE000] = ord("?")
    every = codes.tobytes().decode("utf-32-le")  # as characters one by one, it would be a million objects
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    # the regex module may know a later Unicode than the library; what Python's own tables don't have, the library decides
    new = [c for c in map(chr, np.flatnonzero((out == LETTER) | (out == NUMBER))) if unicodedata.category(c) == "Cn"]
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for kind, lead in ((LETTER, "a"), (NUMBER, "1")):
        begins = {a: b - a for _, (a, b) in split("".join(f"{lead}{c}{lead}\n" for c in new))}
        for i, c in enumerate(new):
            if out[ord(c)] == kind and begins.get(4 * i) != 3:
                out[ord(c)] = OTHER
    return out


class Pretokens:
    """Pre-tokens of a run of texts: `start` and `end` (bytes in `data`), `hash`, and `first` (of each text, and the end)."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.data = joined.encode()
        n = len(code)
        base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=base[1:])
        begins = np.zeros(n + 1, bool)
        begins[base] = True
        kind = classes()[code]
        before = np.empty(n, np.uint8)  # the class of the character before; 9 at the start of a text
        before[1:] = kind[:-1]
        before[begins[:n]] = 9
        space = kind == SPACE
        blank = code == 0x20
        start = kind != before
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~begins[:n]
        start &= space | ~after_blank  # a run joins the one space before it
        # the last white space before a word begins a pre-token: with the word if it is a blank, else alone
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
        start |= last
        for i in np.flatnonzero(code == 0x27):  # contractions, where a pre-token begins with the apostrophe
            if start[i] and not after_blank[i]:
                stop = base[np.searchsorted(base, i, "right")]
                for size in (2, 3):
                    if i + size <= stop and joined[i + 1 : i + size] in _SHORT[size]:
                        start[i + 1] = False
                        if i + size < stop and kind[i + size] == LETTER:
                            start[i + size] = True
                        break
        start |= begins[:n]
        width = 1 + (code > 0x7F).astype(np.uint8) + (code > 0x7FF) + (code > 0xFFFF)
        place = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=place[1:])
        at = np.flatnonzero(start)
        self.start = place[at]
        self.end = np.append(self.start[1:], place[n])[: len(at)]
        self.first = np.searchsorted(at, base)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.hash = common.byte_spans(self.bytes, self.start, self.end)


_SHORT = {2: {"s", "t", "m", "d"}, 3: {"re", "ve", "ll"}}
