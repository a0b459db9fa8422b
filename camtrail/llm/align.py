"""Alignment of two tokenizers: a byte-level BPE (A) and a piece vocabulary with byte fallback (B) over the same text.

Byte offsets at which tokens of both end are shared cuts. They are found by dividing: a common end near the middle of an interval is located by bisecting the ends
of B, both halves are treated alike, and an interval without a cut is a group. All intervals of a level are divided together. Documents are tokenized once; what is
shuffled are counts per pair of ids. A pair can be linked only if the bytes of one id end in those of the other, so the vocabularies bound the table of pairs.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from camtrail.llm import tokens
from camtrail.scale import cut_lineage

BYTE_BPE = tokens.BYTE_BPE
PIECES = "piece_bpe_32k.model"
# Bytes of text that are tokenized at once, and that are aligned at once; one longer text goes alone.
SLAB, PART = 2 << 20, 1 << 19
# Cached words of a worker and vocabulary, about. It changes the speed only.
CACHED = 300_000
# Probes beside the middle of an interval before all its ends are bisected at once.
PROBES = 8
SPACE = "▁"


class SpacedEncoder(tokens.Encoder):
    """Encodes texts that begin with one added space; strings of special tokens are plain text."""

    odd = tokens.ODD.replace(f"^[{tokens.SPACE}]", f"^ ?$|^[{tokens.SPACE}][{tokens.SPACE}]|^[^ ]", 1)

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__(path, cached)
        self.tokenizer.encode_special_tokens = True

    def spellings(self) -> list[bytes]:
        """Bytes of each id, by the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [bytes(alphabet[c] for c in self.tokenizer.id_to_token(i)) for i in range(size)]


def _table(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and how many each id has."""
    return np.frombuffer(b"".join(names), np.uint8), np.array([len(s) for s in names], np.int64)


# Stands for the ids of a word that the vocabulary spells differently; no vocabulary has this id.
MISSPELT = b"\xff\xff\xff\xff"


class PieceEncoder:
    """Ids of whole texts by a piece vocabulary that adds a leading space, each distinct word encoded once per worker.

    No piece has a space after another character or holds a newline, so no merge crosses the place before a space or either side of a newline; that is
    checked when the vocabulary is loaded. Texts in which words do not stand alone (runs of spaces, a space beside a newline, the space sign itself) are encoded whole.
    """

    odd = f"^$|^[ \n]| $| [ \n]|{SPACE}"

    def __init__(self, path: str, cached: int = CACHED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cached = cached
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table, self.sizes = _table(self.spellings())
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in names)
        self.bare = self.model.encode("\n")[:-1]

    def spellings(self) -> list[bytes]:
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def _says(self, ids: np.ndarray, text: str) -> bool:
        want, at = text.encode(), 0
        for k in range(0, len(ids), 1 << 16):
            part = spell(ids[k : k + (1 << 16)], self.table, self.sizes).tobytes()
            if want[at : at + len(part)] != part:
                return False
            at += len(part)
        return at == len(want)

    def _look_up(self, words: list[str]) -> list[bytes]:
        young, missing = self.cache, []
        for w in words:
            if w not in young:
                ids = self.older.get(w)
                if ids is None:
                    missing.append(w)
                else:
                    young[w] = ids
        # A word that begins with a newline has no space before it: the ids of the added one go.
        bare = len(self.bare)
        coded = [array("I", ids[bare:] if w[:1] == "\n" else ids).tobytes() for w, ids in zip(missing, self.model.encode(missing, num_threads=1) if missing else [], strict=True)]
        said = spell(np.frombuffer(b"".join(coded), np.uint32), self.table, self.sizes).tobytes()
        if said != "".join([w if w[:1] == "\n" else " " + w for w in missing]).encode():
            for k, (w, ids) in enumerate(zip(missing, coded, strict=True)):
                if spell(np.frombuffer(ids, np.uint32), self.table, self.sizes).tobytes() != (w if w[:1] == "\n" else " " + w).encode():
                    coded[k] = MISSPELT
        young.update(zip(missing, coded, strict=True))
        raw = [young[w] for w in words]
        if 2 * len(young) > self.cached:
            self.older, self.cache = young, {}
        return raw

    def _words(self, texts: pa.Array) -> list[np.ndarray | None]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        raw = self._look_up(coded.dictionary.to_pylist())
        sizes = np.array([len(b) for b in raw], np.int64) // 4
        flat = spell(coded.indices.to_numpy(), np.frombuffer(b"".join(raw), np.uint32), sizes)
        ends = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        bounds = ends[split.offsets.to_numpy()].tolist()
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if MISSPELT in raw:
            bad = flat == np.frombuffer(MISSPELT, np.uint32)[0]
            out = [None if bad[a:b].any() else x for x, a, b in zip(out, bounds[:-1], bounds[1:], strict=True)]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray | None]:
        """One array of ids (uint32) per text, or None if their bytes are not a space and the text."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        got: list = [None] * len(texts)
        plain = self._words(texts.filter(pa.array(~odd))) if not odd.all() else []
        alone = texts.filter(pa.array(odd)).to_pylist()
        alone = [ids if self._says(ids, " " + t) else None for ids, t in zip(self._whole(alone), alone, strict=True)]
        for rows, ids in ((np.flatnonzero(odd), alone), (np.flatnonzero(~odd), plain)):
            for r, i in zip(rows.tolist(), ids, strict=True):
                got[r] = i
        return got


def spell(ids: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Entries of ``table`` for a sequence of ids; entry k has ``sizes[k]`` items."""
    n = sizes[ids]
    ends = np.cumsum(n)
    first = np.cumsum(sizes) - sizes
    return table[np.repeat(first[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def divide(a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: a mark per token of A and one per token of B.

    ``a_ends`` and ``b_ends`` are ascending byte offsets of token ends, ``a_docs`` and ``b_docs`` the bounds of documents, whose ends are cuts.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    has = np.diff(a_docs) > 0
    a_cut[a_docs[1:][has] - 1] = True
    b_cut[b_docs[1:][has] - 1] = True
    low, high, b_low, b_high = a_docs[:-1][has], a_docs[1:][has], b_docs[:-1][has], b_docs[1:][has]
    while True:
        open_ = (high - low > 1) & (b_high - b_low > 1)
        low, high, b_low, b_high = low[open_], high[open_], b_low[open_], b_high[open_]
        if not len(low):
            return a_cut, b_cut
        middle = (low + high - 2) // 2
        at, place = np.full(len(low), -1), np.zeros(len(low), np.int64)
        left = np.arange(len(low))
        for k in range(PROBES):
            probe = middle[left] + ((k + 1) // 2 if k % 2 else -(k // 2))
            inside = (probe >= low[left]) & (probe < high[left] - 1)
            end = a_ends[np.where(inside, probe, middle[left])]
            where = np.searchsorted(b_ends, end)
            hit = inside & (b_ends[where] == end)
            at[left[hit]], place[left[hit]] = probe[hit], where[hit]
            left = left[~hit]
            if not len(left):
                break
        for i in left[(high - low)[left] > PROBES].tolist():
            ends = a_ends[low[i] : high[i] - 1]
            where = np.searchsorted(b_ends, ends)
            hits = np.flatnonzero(b_ends[where] == ends)
            if len(hits):
                best = hits[np.argmin(np.abs(hits + low[i] - middle[i]))]
                at[i], place[i] = low[i] + best, where[best]
        found = at >= 0
        low, high, b_low, b_high, at, place = (x[found] for x in (low, high, b_low, b_high, at, place))
        a_cut[at], b_cut[place] = True, True
        low, high = np.concatenate([low, at + 1]), np.concatenate([at + 1, high])
        b_low, b_high = np.concatenate([b_low, place + 1]), np.concatenate([place + 1, b_high])


SLOT_BITS = 21


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Aligned:
    """Alignment of some texts: bounds of each text's tokens and groups, ids, and where groups end."""

    a: np.ndarray
    b: np.ndarray
    a_docs: np.ndarray
    b_docs: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    groups: np.ndarray
    ends: np.ndarray


class Pair:
    """Two vocabularies, and the pairs of their ids that a link can hold."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.left, self.right = SpacedEncoder(tokens.vocabulary(byte_bpe)), PieceEncoder(tokens.vocabulary(pieces))
        a, b = self.left.spellings(), self.right.spellings()
        self.a_sizes, self.b_sizes = _table(a)[1], _table(b)[1]
        self.width = len(b)
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for names, table in ((a, of_a), (b, of_b)):
            for i, s in enumerate(names):
                table.setdefault(s, []).append(i)
        keys = {i * self.width + j for i, s in enumerate(a) for k in range(len(s)) for j in of_b.get(s[k:], ())}
        keys |= {i * self.width + j for j, s in enumerate(b) for k in range(len(s)) for i in of_a.get(s[k:], ())}
        self.keys = np.array(sorted(keys), np.int64)
        self.slots = np.zeros(1 << SLOT_BITS, np.uint32)
        self.slots[_slot(self.keys)] = np.arange(len(self.keys), dtype=np.uint32)
        size = max(len(a), len(b))
        self.digits = np.array([str(i).encode() for i in range(size)], f"S{len(str(size - 1))}").view(np.uint8).reshape(size, -1)

    def align(self, texts: pa.Array) -> Iterator[tuple[int, int, Aligned]]:
        """(start, end, alignment) of parts of ``texts`` (large_string without nulls). A text that is empty or that B spells differently has no tokens.

        A has no normalization and its alphabet has all bytes, so A spells every text; its length is checked all the same.
        """
        size = pc.binary_length(texts).to_numpy()
        a = self.left.encode(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        b = self.right.encode(texts)
        none = np.zeros(0, np.uint32)
        for k, n in enumerate(size.tolist()):
            if not n or b[k] is None or int(self.a_sizes[a[k]].sum()) != n + 1:
                a[k] = b[k] = none
        ends, at = np.cumsum(size), 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            yield at, end, self._part(a[at:end], b[at:end])
            at = end

    def _part(self, a: list[np.ndarray], b: list[np.ndarray]) -> Aligned:
        a_docs, b_docs = (np.cumsum([0, *map(len, x)]) for x in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        a_ends = np.cumsum(self.a_sizes[a])
        a_cut, b_cut = divide(a_ends, np.cumsum(self.b_sizes[b]), a_docs, b_docs)
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        return Aligned(a, b, a_docs, b_docs, a_last, b_last, np.searchsorted(a_last, a_docs), a_ends[a_last])

    def links(self, x: Aligned) -> np.ndarray:
        """Place in ``keys`` of the pair of ids that end each group: by its slot, or bisected where another pair has the slot."""
        wanted = x.a[x.a_last].astype(np.int64) * self.width + x.b[x.b_last]
        out = self.slots[_slot(wanted)]
        other = np.flatnonzero(self.keys[out] != wanted)
        out[other] = np.searchsorted(self.keys, wanted[other])
        return out

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        starts_b = np.append(0, x.b_last + 1)
        group_a = np.repeat(np.arange(len(x.a_last)), np.diff(np.append(-1, x.a_last)))
        group_b = np.repeat(np.arange(len(x.b_last)), np.diff(np.append(-1, x.b_last)))
        cells = np.zeros((len(x.a) + len(x.b), self.digits.shape[1] + 1), np.uint8)
        at_a, at_b = np.arange(len(x.a)) + starts_b[group_a], np.arange(len(x.b)) + x.a_last[group_b] + 1
        cells[at_a, :-1], cells[at_b, :-1], cells[:, -1] = self.digits[x.a], self.digits[x.b], ord(",")
        cells[at_a[x.a_last], -1], cells[at_b[x.b_last], -1] = ord("|"), ord(";")
        out = []
        for p, q in zip((x.a_docs + x.b_docs)[:-1].tolist(), (x.a_docs + x.b_docs)[1:].tolist(), strict=True):
            if p == q:
                out.append("")
                continue
            part = cells[p:q].ravel()
            out.append(hashlib.sha256(part[part != 0][:-1].tobytes()).hexdigest())
        return out


@functools.cache
def pair(byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> Pair:
    """The worker's vocabularies."""
    return Pair(byte_bpe, pieces)


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, ends: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) per row: ``links`` has, packed, the pair of ids at the end of every group; with ``ends`` also the byte ends
    of the groups in the space and text, as ``group_ends``.

    Null and empty texts and those that a vocabulary spells differently have no tokens. Rows are worked on one by one, so repeated rows give equal answers and other columns
    play no part. Memory follows the longest text.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_bpe, pieces)
        for batch in batches:
            for at, end, x in ((k + p, k + q, x) for k, texts in tokens.slabs(batch.column("text"), SLAB) for p, q, x in both.align(texts)):
                links = both.links(x)
                bounds = list(zip(x.groups[:-1].tolist(), x.groups[1:].tolist(), strict=True))
                columns = [
                    batch.column("doc_id").slice(at, end - at),
                    *[pa.array(np.diff(n)) for n in (x.a_docs, x.b_docs, x.groups)],
                    pa.array(both.digests(x), pa.string()),
                    pa.array([pa.compress(links[p:q].tobytes(), "zstd", asbytes=True) for p, q in bounds], pa.binary()),
                ]
                if ends:
                    begin = np.append(0, x.ends)[x.groups]
                    columns.append(pa.array([(x.ends[p:q] - s) for (p, q), s in zip(bounds, begin[:-1].tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["group_ends"] * ends]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        read,
        f"doc_id {key_type}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", group_ends array<long>" * ends,
    )


def _unpack(cells: list, sizes: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(pa.decompress(c, 4 * n, "zstd", asbytes=True) for c, n in zip(cells, sizes, strict=True)), np.uint32)


def pair_counts(aligned: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """(pair, a, b, n): how many links hold a pair of ids, over all documents. A task adds its links up first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pair(byte_bpe, pieces).keys
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            total += np.bincount(_unpack(batch.column("links").to_pylist(), batch.column("n_groups").to_pylist()), minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(x) for x in np.divmod(keys[seen], width)], pa.array(total[seen])], ["pair", "a", "b", "n"])

    width = pair(byte_bpe, pieces).width
    counts = aligned.select("links", "n_groups").mapInArrow(add, "pair long, a long, b long, n long")
    return counts.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))


def best_links(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A group has one link: of the tokens that end in it, only its last ones end together. The counts per pair come to the driver and go to all tasks; they have at most one row for
    each pair of ids of which one ends in the other, some hundred thousand, whatever the corpus.
    """
    aligned = cut_lineage(align_documents(docs, key, text, byte_bpe, pieces))
    known = pair(byte_bpe, pieces)
    counts = np.zeros(len(known.keys), np.int64)
    for row in pair_counts(aligned, byte_bpe, pieces).select("pair", "n").toLocalIterator():
        counts[row["pair"]] = row["n"]
    highest = np.zeros(known.width, np.int64)
    np.maximum.at(highest, known.keys % known.width, counts)
    table = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[known.keys % known.width]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = table.value
        for batch in batches:
            sizes = batch.column("n_groups").to_numpy()
            links = _unpack(batch.column("links").to_pylist(), sizes.tolist())
            ends = np.append(0, np.cumsum(sizes))
            sums = [np.append(0, np.cumsum(x[links]))[ends] for x in (best.astype(np.int64), counts)]
            columns = [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")], *[pa.array(np.diff(s)) for s in sums], batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    key_type = aligned.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return aligned.mapInArrow(look_up, f"doc_id {key_type}, {longs}, groups_sha256 string")
