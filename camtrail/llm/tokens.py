"""Token ids of whole texts with a public byte-level BPE vocabulary, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
# Cached pieces of a worker, about. It changes the speed only.
CACHED = 600_000
# Bytes of text that are split at once.
SLICE = 4 << 20

# Any character that some definition counts as white space.
SPACE = "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}"
# Texts in which a cut before a space, or a restored one, might not be a boundary of the vocabulary's own splitting.
ODD = rf"^[{SPACE}]| [.,\n ]| $|[{SPACE}] [{SPACE}]|<\|"
LETTER = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}"
_WHITE = re.compile("[\x09-\x0d\x1c-\x20\x85\xa0 ᠎ -‏    ⁠　﻿]")


def vocabulary(name: str = BYTE_BPE) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slabs(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) of slices of at most ``limit`` bytes, or of one text, as large_string; a null becomes an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, pa.concat_arrays([texts.slice(at, end - at)])
        at = end


class Encoder:
    """Ids of texts, equal to encoding each whole text at once.

    A byte-level BPE never merges across the boundaries of its splitting pattern, and a text can safely be cut before a space between other characters, between a
    letter and ``.`` or ``,`` and before a newline after those. Cutting there, Arrow finds the distinct pieces of many texts and only pieces that the
    worker has not met are encoded. Texts where such a cut is not surely a boundary (runs of white space, texts of special tokens) are encoded whole.
    """

    odd = ODD

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cached
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Cache ids of pieces. Pieces without white space go in lines of one text, so a line's ids lie between newline ids."""
        lead = np.array([self.newline], np.uint32).tobytes()
        names, cores, heads, direct = [], [], [], []
        for u in pieces:
            head, core = (lead, u[1:]) if u[:1] == "\n" else (b"", u if u[:1] in (".", ",") else " " + u)
            if not core:
                self.cache[u] = head
            elif _WHITE.search(core, 1 if core[0] == " " else 0):
                direct.append(u)
            else:
                names.append(u), heads.append(head), cores.append(core)
        for at in range(0, len(cores), 4096):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(cores[at : at + 4096])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            start, raw = 0, ids.tobytes()
            for u, head, end in zip(names[at : at + 4096], heads[at : at + 4096], ends.tolist(), strict=True):
                self.cache[u] = head + raw[4 * start : 4 * end]
                start = end + 1
        for u, ids in zip(direct, self.whole([u if u[0] in "\n.," else " " + u for u in direct]), strict=True):
            self.cache[u] = ids.tobytes()

    def _look_up(self, known: list[str]) -> list[bytes]:
        """Ids of distinct pieces. Of two generations the older is dropped when the younger is full, so frequent pieces stay."""
        young = self.cache
        absent = [u for u in known if u not in young]
        missing = []
        for u in absent:
            ids = self.older.get(u)
            if ids is None:
                missing.append(u)
            else:
                young[u] = ids
        self._learn(missing)
        raw = [young[u] for u in known]
        if 2 * len(young) > self.cached:
            self.older, self.cache = young, {}
        return raw

    def _pieces(self, texts: pa.Array) -> list[np.ndarray]:
        cut = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
        cut = pc.replace_substring_regex(cut, rf"([{LETTER}.,])\n", "\\1 \n")
        cut = pc.replace_substring_regex(cut, rf"([{LETTER}])([.,])", "\\1 \\2")
        split = pc.split_pattern(cut, " ")
        coded = split.flatten().dictionary_encode()
        raw = self._look_up(coded.dictionary.to_pylist())
        sizes = np.array([len(b) for b in raw], np.int64) // 4
        table, first = np.frombuffer(b"".join(raw), np.uint32), np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        flat = table[np.repeat(first[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.append(0, ends)[split.offsets.to_numpy()]
        return [flat[a + 1 : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids (uint32) per text; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        out, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
            part = pa.concat_arrays([texts.slice(at, end - at)])
            odd = pc.match_substring_regex(part, self.odd).to_numpy(zero_copy_only=False)
            got: list = [None] * len(part)
            for rows, ids in (
                (np.flatnonzero(odd), self.whole(part.filter(pa.array(odd)).to_pylist())),
                (np.flatnonzero(~odd), self._pieces(part.filter(pa.array(~odd))) if not odd.all() else []),
            ):
                for r, i in zip(rows.tolist(), ids, strict=True):
                    got[r] = i
            out += got
            at = end
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = BYTE_BPE, cached: int = CACHED) -> Encoder:
    """The worker's encoder of a vocabulary, with its cache of about ``cached`` pieces."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary(name))
    _ENCODERS[name].cached = cached
    return _ENCODERS[name]
