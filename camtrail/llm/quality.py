"""Quality of whole texts: counting rules, and a linear-chain conditional random field over lines whose Viterbi path tells content from boilerplate.

The field is fitted on a bounded sample of documents with a quality label. Every text is then read once, in Arrow batches of bounded size; nothing is shuffled but the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from camtrail.llm.tokens import slabs

# Documents of each label that the field is fitted on, and the most lines one of them may have.
PER_LABEL = 300
MOST_LINES = 200
STEPS = 300
RIDGE = 1e-3
# A document stays if at least this share of its word characters is in lines of content.
LEAST_CONTENT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
# Bytes of text that are worked on at once; one longer text goes alone.
SLAB = 1 << 20

SYMBOLS = b"#*$%&|<>"
BLANK, TAIL, LOWER, UPPER, DIGIT, SYMBOL, STOP, OTHER, LEAD = range(9)
FEATURES = ("one", "symbols", "lone_symbols", "capitals", "digits", "marks", "word_length", "words", "repeated", "copied")


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = BLANK
    kinds[0x80:0xC0], kinds[0xC0:] = TAIL, LEAD
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    kinds[list(b".,")], kinds[list(SYMBOLS)] = STOP, SYMBOL
    return kinds


KINDS = _classes()


def _repeated(words: np.ndarray, known: int) -> np.ndarray:
    """For the word ids of one text: true where a word is in a window of three that occurs twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < 4:
        return out
    if known < 1 << 21:
        windows = (words[:-2] * known + words[1:-1]) * known + words[2:]
    else:
        _, pairs = np.unique(words[:-1] * known + words[1:], return_inverse=True)
        windows = pairs[:-1] * known + words[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    out[:-2] |= again
    out[1:-1] |= again
    out[2:] |= again
    return out


@dataclass
class Slab:
    """What is counted in some texts: one entry per text, and per line with the first line of each text in ``first``."""

    first: np.ndarray
    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    copied: np.ndarray
    repeated: np.ndarray
    features: np.ndarray

    def per_text(self, of_lines: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_lines, self.first[:-1]) if len(self.first) > 1 else of_lines[:0]


def count(texts: pa.Array) -> Slab:
    """Counts and features of ``texts`` (large_string, no nulls), exact for any white space and length."""
    raw = [t.as_buffer().to_pybytes() if t.as_buffer() else b"" for t in texts]
    buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    kinds = KINDS[buffer]
    starts = np.append(0, np.flatnonzero(buffer == 10)[:-1] + 1) if len(buffer) else np.zeros(0, np.int64)
    first = np.cumsum([0, *[t.count(b"\n") + 1 for t in raw]])
    number = [np.add.reduceat(kinds == k, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for k in range(9)]
    blank = kinds == BLANK
    lone = kinds == SYMBOL
    lone[1:] &= blank[:-1]
    lone[:-1] &= blank[1:]
    alone = np.add.reduceat(lone, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    word = ~blank
    word[1:] &= blank[:-1]
    line_of = np.searchsorted(starts, np.flatnonzero(word), "right") - 1
    words = np.bincount(line_of, minlength=len(starts))

    split = pc.ascii_split_whitespace(texts).flatten()
    coded = split.filter(pc.not_equal(pc.binary_length(split), 0)).dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    ends = np.searchsorted(line_of, first)
    again = np.zeros(len(ids), bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        again[a:b] = _repeated(ids[a:b], known)
    repeated = np.bincount(line_of, again, len(starts)).astype(np.int64)

    copied = np.zeros(len(starts), bool)
    for t, a in zip(raw, first.tolist(), strict=False):
        lines = t.split(b"\n")
        if len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for k, line in enumerate(lines):
                copied[a + k] = line in seen
                seen.add(line)
    copied &= words > 0

    chars = sum(number[k] for k in range(9) if k not in (BLANK, TAIL))
    size, n = np.maximum(chars, 1), np.maximum(words, 1)
    features = np.stack(
        [
            np.ones(len(starts)),
            np.minimum(number[SYMBOL] / n, 3),
            5 * alone / n,
            number[UPPER] / np.maximum(number[UPPER] + number[LOWER], 1),
            number[DIGIT] / size,
            np.minimum(number[OTHER] / n, 3),
            np.minimum(chars / n, 20) / 10,
            np.log1p(words) / 5,
            repeated / n,
            copied,
        ],
        axis=1,
    )
    return Slab(first, words, chars, number[SYMBOL], copied.astype(np.int64), repeated, features)


@dataclass
class Field:
    """Scores of state 1 (boilerplate) against state 0 (content) per feature and at the start, and of each change of state."""

    weights: np.ndarray
    start: float
    moves: np.ndarray

    def path(self, features: np.ndarray) -> list[int]:
        """Most likely states of the lines of one text (Viterbi); a tie goes to content."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        own = (features @ self.weights).tolist()
        if not own:
            return []
        zero, one, back = 0.0, self.start + own[0], []
        for score in own[1:]:
            stay0, from1 = zero + m00, one + m10
            from0, stay1 = zero + m01, one + m11
            back.append((from1 > stay0, stay1 >= from0))
            zero, one = max(stay0, from1), max(from0, stay1) + score
        state = int(one > zero)
        states = [state]
        for came in reversed(back):
            state = int(came[state])
            states.append(state)
        return states[::-1]


def _marginals(own: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each state at each line, and expected changes of state, by the forward and backward recursions over padded texts."""
    n, t = own.shape[:2]
    ahead, behind = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    ahead[0] = own[:, 0]
    for k in range(1, t):
        ahead[k] = own[:, k] + np.logaddexp(ahead[k - 1][:, :1] + moves[0], ahead[k - 1][:, 1:] + moves[1])
    for k in range(t - 2, -1, -1):
        later = own[:, k + 1] + behind[k + 1]
        step = np.logaddexp(moves[:, 0] + later[:, :1], moves[:, 1] + later[:, 1:])
        behind[k] = np.where((k + 1 < sizes)[:, None], step, 0)
    total = np.logaddexp(*(ahead[0] + behind[0]).T)
    inside = np.arange(t)[:, None] < sizes
    each = np.exp(ahead + behind - total[:, None]) * inside[:, :, None]
    pairs = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            score = ahead[:-1, :, i] + moves[i, j] + np.swapaxes(own, 0, 1)[1:, :, j] + behind[1:, :, j] - total
            pairs[i, j] = np.exp(np.where(inside[1:], score, -np.inf)).sum()
    return each.transpose(1, 0, 2), pairs


def train(texts: list[np.ndarray], states: list[np.ndarray], chain: bool = True, steps: int = STEPS) -> Field:
    """Field of greatest penalized likelihood for given states of lines, by gradient steps with momentum; without ``chain`` lines stand alone."""
    sizes = np.array([len(x) for x in texts])
    t, n, width = int(sizes.max()), len(texts), texts[0].shape[1]
    x, y = np.zeros((n, t, width)), np.zeros((n, t), np.int64)
    for k, (a, b) in enumerate(zip(texts, states, strict=True)):
        x[k, : len(a)], y[k, : len(b)] = a, b
    inside = np.arange(t) < sizes[:, None]
    seen = np.einsum("ntf,nt->f", x, (y * inside).astype(float))
    pair_in = inside[:, 1:]
    seen_pairs = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair_in).sum() for j in range(2)] for i in range(2)], float)
    theta, mean, square, lines = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5), sizes.sum()
    for step in range(1, steps + 1):
        moves = theta[width + 1 :].reshape(2, 2) * chain
        own = np.zeros((n, t, 2))
        own[:, :, 1] = x @ theta[:width]
        own[:, 0, 1] += theta[width] * chain
        each, pairs = _marginals(own, moves, sizes)
        slope = np.concatenate([
            seen - np.einsum("ntf,nt->f", x, each[:, :, 1]),
            [(y[:, 0] - each[:, 0, 1]).sum() * chain],
            ((seen_pairs - pairs) * chain).ravel(),
        ]) / lines - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:width], float(theta[width]) * chain, theta[width + 1 :].reshape(2, 2) * chain)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, quality, features) of at most ``per_label`` labelled documents of each quality, those with the smallest hashes.

    The ids are cut by a hash bound from the counts before they are sorted, and only they are joined with the texts.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    place = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for q, n in sorted(counts.items()):
        ids = known.filter((F.col("quality") == q) & (place <= min(1.0, 3.0 * per_label / n))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = ids if chosen is None else chosen.union(ids)
    if chosen is None:
        return known.select("doc_id", "quality", F.lit(None).cast("array<double>").alias("features")).limit(0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slabs(batch.column("text"), SLAB):
                slab = count(texts)
                rows = []
                for k in range(len(texts)):
                    a, b = slab.first[k], slab.first[k + 1]
                    own = slab.features[a:b][slab.words[a:b] > 0]
                    rows.append(own.ravel().tolist() if len(own) <= MOST_LINES else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), batch.column("quality").slice(at, len(texts)), pa.array(rows, pa.list_(pa.float64()))],
                    ["doc_id", "quality", "features"],
                )

    # At most 2 * per_label ids, so the side is small by its making.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    read_rows = texts.mapInArrow(read, "doc_id long, quality int, features array<double>").filter("size(features) > 0")
    return read_rows.orderBy(F.xxhash64("doc_id", "features"), "doc_id").limit(2 * per_label)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """The field that labelled documents (quality 0 or 1) give, or None if one of the labels is missing.

    Lines of documents of quality 1 are content. Of the others, a line is boilerplate unless a first model of single lines takes it for content.
    """
    rows = sample(docs, labels, per_label).collect()
    texts = [np.array(r["features"]).reshape(-1, len(FEATURES)) for r in rows]
    states = [np.full(len(x), 1 - r["quality"]) for x, r in zip(texts, rows, strict=True)]
    if len({int(s[0]) for s in states}) < 2:
        return None
    alone = train(texts, states, chain=False)
    states = [s & (x @ alone.weights > 0) for x, s in zip(texts, states, strict=True)]
    return train(texts, states)


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, line_states string, content_share double, kept boolean"
)


def judge(docs: DataFrame, field: Field | None, text: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """One row per row of ``docs``: the caller's row as the struct ``row``, and beside it the columns of RESULT.

    ``line_states`` has a letter per line: c content, b boilerplate, - without a word (such lines are no part of the sequence). ``content_share`` is the share of word characters in
    lines of content, null without words. Kept are rows that do not fail the counting rules and have ``least_content`` of content;
    without a field every line is content. A null text counts as an empty one, and fails. Repeated rows get equal answers, columns of any name travel inside ``row``, an
    empty table gives an empty one. Memory follows the longest text, some 30 bytes per byte of it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for at, texts in slabs(pc.struct_field(rows, [names.index(text)]), SLAB):
                slab = count(texts)
                chars, words, repeated = slab.per_text(slab.chars), slab.per_text(slab.words), slab.per_text(slab.repeated)
                failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
                states, shares = [], []
                for k, (a, b) in enumerate(zip(slab.first[:-1].tolist(), slab.first[1:].tolist(), strict=True)):
                    has = slab.words[a:b] > 0
                    path = np.zeros(int(has.sum()), bool) if field is None else np.array(field.path(slab.features[a:b][has]), bool)
                    letters = np.full(b - a, ord("-"), np.uint8)
                    letters[has] = np.where(path, ord("b"), ord("c"))
                    states.append(letters.tobytes().decode())
                    shares.append(float(slab.chars[a:b][has][~path].sum() / chars[k]) if chars[k] else None)
                good = np.array([s is not None and s >= least_content for s in shares], bool)
                columns = [words, chars, slab.per_text(slab.symbols), slab.per_text(slab.copied), repeated, failed, np.diff(slab.first)]
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(at, len(texts)), *[pa.array(c) for c in columns], pa.array(states, pa.string()), pa.array(shares, pa.float64()), pa.array(~failed & good)],
                    ["row", *[c.split()[0] for c in RESULT.split(", ")]],
                )

    names = docs.columns
    row = F.struct(*[docs[f"`{c}`"] for c in names]).alias("row")
    rows = docs.select(row)
    return rows.mapInArrow(read, StructType([*rows.schema.fields, *StructType.fromDDL(RESULT).fields]))
