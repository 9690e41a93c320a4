"""Operator 5: quality rules by line sequence labelling.

The lines of a text are a linear chain whose states are boilerplate (0) and
content (1).  A line's statistics give its state potentials, neighbouring lines
the transition potentials; Viterbi decoding marks every line and the share of
words in content lines decides whether the text is kept.

The field is learned by its exact conditional likelihood (forward-backward)
from at most `PER_CLASS` labelled texts of either class, of a longer text from
`FIT_LINES` lines in a row (which ones, a hash of its id decides).  Only texts
are labelled, not lines: a line takes its text's label, but lines that stand in
`SHARED_TEXTS` unlike texts of the sample are boilerplate in good texts too
(where they hold less than half of the words, so near copies do not condemn each
other), and every fourth text is joined to another so that changes of state
occur.  Rows whose id hashes to the held-out remainder take no part.

Scoring is one pass without a shuffle; the model has a few hundred numbers.
Defined cases: a null or empty text has no words, fails the base rules and is
not kept; without labelled rows of both classes the verdict of the base rules
stands; null ids stay null and are never learned from; repeated rows get a row
each; a text of any number of lines is scored whole, in memory of some times its
size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinforge.llm.frames import class_sizes, labelled_sample, map_texts, two_columns
from kinforge.llm.quality import statistics
from kinforge.llm.ragged import SEP, chunks, counts, covered, gather, hash_slices, mix, padded, per_row, window_hash, words

MODULUS, HELD_OUT = 5, 0
PER_CLASS = 2048
#: Lines of one labelled text that the field is learned from.
FIT_LINES = 512
#: Unlike texts of the sample from which on a line that they share is boilerplate.
SHARED_TEXTS = 4
#: Steps of learning, each over a batch of texts, and texts in a batch; alike for every size of sample.
FIT_STEPS, FIT_BATCH = 320, 128
#: Steps of any statistic.
STEPS = 48
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))

RULED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("content_share", T.DoubleType()),
        T.StructField("line_states", T.ArrayType(T.ByteType())),
    ]
)


@dataclass
class Field:
    """State potentials by statistic and step, transitions, and first-line potentials."""

    state: np.ndarray  # (statistics, STEPS, 2)
    move: np.ndarray  # (2, 2)
    first: np.ndarray  # (2,)

    def potentials(self, steps: np.ndarray) -> np.ndarray:
        return self.state[np.arange(steps.shape[1]), steps].sum(axis=1)

    def viterbi(self, steps: np.ndarray, begin: np.ndarray, size: np.ndarray, span: int = 1024) -> np.ndarray:
        """Best states of all lines; text i has lines begin[i] .. begin[i] + size[i].

        Texts are cut into segments of `span` lines, which go forward side by side
        for either state before them; then the segments of a text are chained."""
        own = self.potentials(steps)
        n_segments = -(-size // span)
        first_segment = np.cumsum(n_segments) - n_segments
        text = np.repeat(np.arange(len(size)), n_segments)
        number = np.arange(len(text)) - first_segment[text]
        start = begin[text] + number * span
        length = np.minimum(span, begin[text] + size[text] - start)
        order = np.argsort(-length, kind="stable")
        start, length, at_first = start[order], length[order], (number == 0)[order]
        back = np.zeros((len(own), 2, 2), np.int8)  # line, state before the segment, state
        entry = np.where(at_first[:, None, None], self.first, self.move)
        best = own[start][:, None, :] + entry
        final = np.zeros((len(start), 2, 2))
        live, longest = len(start), int(length.max(initial=0))
        for t in range(1, longest + 1):
            still = int(np.searchsorted(-length, -t, side="left"))  # segments with more than t lines
            final[order[still:live]] = best[still:live]
            live = still
            if not live:
                break
            ways = best[:live, :, :, None] + self.move  # (segment, before, from, to)
            here = start[:live] + t
            back[here] = ways.argmax(axis=2)
            best = ways.max(axis=2) + own[here][:, None, :]
        # chain the segments of each text
        came = np.zeros((len(order), 2), np.int8)
        many = np.argsort(-n_segments, kind="stable")
        score = final[first_segment[many], 0]
        for k in range(1, int(n_segments.max(initial=0))):
            on = int(np.searchsorted(-n_segments[many], -k, side="left"))
            ways = score[:on, :, None] + final[first_segment[many[:on]] + k]
            came[first_segment[many[:on]] + k] = ways.argmax(axis=1)
            score[:on] = ways.max(axis=1)
        leaves, enters = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
        state = score.argmax(axis=1).astype(np.int8)
        for k in range(int(n_segments.max(initial=0)) - 1, -1, -1):
            on = int(np.searchsorted(-n_segments[many], -k, side="left"))
            segment = first_segment[many[:on]] + k
            leaves[segment] = state[:on]
            enters[segment] = came[segment, state[:on]] if k else 0
            state[:on] = enters[segment]
        out = np.zeros(len(own), np.int8)
        state, before = leaves[order], enters[order]
        for t in range(longest - 1, -1, -1):
            on = int(np.searchsorted(-length, -t, side="left"))
            here = start[:on] + t
            out[here] = state[:on]
            state[:on] = back[here, before[:on], state[:on]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], n_steps: int = FIT_STEPS, batch: int = FIT_BATCH, rate: float = 0.05, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam; a sequence is (steps by line, state of each line)."""
    width = sequences[0][0].shape[1]
    field = Field(np.zeros((width, STEPS, 2)), np.zeros((2, 2)), np.zeros(2))
    parts = (field.state, field.move, field.first)
    mean = [np.zeros_like(p) for p in parts]
    square = [np.zeros_like(p) for p in parts]
    by_size = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
    groups = [by_size[a : a + batch] for a in range(0, len(by_size), batch)]
    rng, tick = np.random.default_rng(5), 0
    column = np.arange(width)
    while tick < n_steps:
        for g in rng.permutation(len(groups))[: n_steps - tick]:
            picked = [sequences[i] for i in groups[g]]
            size = np.array([len(y) for _, y in picked])
            n, longest = len(picked), int(size.max())
            flat = np.concatenate([s for s, _ in picked])
            y = np.concatenate([y for _, y in picked])
            text = np.repeat(np.arange(n), size)
            line = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            own = np.zeros((n, longest, 2))
            own[text, line] = field.potentials(flat)
            inside = np.zeros((n, longest), bool)
            inside[text, line] = True
            ahead = np.zeros((n, longest, 2))
            ahead[:, 0] = own[:, 0] + field.first
            for t in range(1, longest):
                step = _lse(ahead[:, t - 1, :, None] + field.move, 1) + own[:, t]
                ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
            total = _lse(ahead[:, -1], 1)
            behind = np.zeros((n, longest, 2))
            moves = np.zeros((2, 2))
            for t in range(longest - 2, -1, -1):
                on = inside[:, t + 1]
                step = field.move + (own[:, t + 1] + behind[:, t + 1])[:, None, :]
                behind[:, t] = np.where(on[:, None], _lse(step, 2), 0.0)
                moves += np.exp(ahead[on, t, :, None] + step[on] - total[on, None, None]).sum(axis=0)
            belief = np.exp(ahead + behind - total[:, None, None])[text, line]
            belief[np.arange(len(y)), y] -= 1  # expected minus observed
            grads = [np.zeros_like(p) for p in parts]
            for state in (0, 1):
                np.add.at(grads[0][:, :, state], (column[None, :], flat), belief[:, state, None])
            follows = line[1:] > 0
            np.add.at(moves, (y[:-1][follows], y[1:][follows]), -1.0)
            grads[1] = moves
            grads[2] = belief[line == 0].sum(axis=0)
            tick += 1
            for p, grad, m, s in zip(parts, grads, mean, square, strict=True):
                grad = grad / n + ridge * p
                m += 0.1 * (grad - m)
                s += 0.01 * (grad**2 - s)
                p -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.99**tick)) + 1e-8)
    return field


class Lines:
    """Lines of a run of texts, and the counts of the base rules."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = self.n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        row_of = np.searchsorted(offsets, breaks, side="right") - 1
        starts = np.concatenate([offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(n), row_of])
        order = np.lexsort((starts, owner))  # a line behind a last line break is an empty line of its own text
        self.start, self.text = starts[order], owner[order]
        last = np.append(self.text[1:] != self.text[:-1], True) if len(self.text) else np.zeros(0, bool)
        following = np.append(self.start[1:], 0)
        self.end = np.where(last, offsets[self.text + 1], following)
        edges = np.append(self.start, len(data))
        word_start, word_end, line = words(data, edges)
        # an empty line has the same start as the next: words lie in the last line of that start
        self.row = self.text[line] if len(line) else line
        h, _ = hash_slices(padded(data), word_start, word_end)
        self.line_words = counts(line, len(self.start))
        self.n_words = counts(self.row, n)
        self.line_begin = np.searchsorted(self.text, np.arange(n))
        self.n_lines = counts(self.text, n)
        visible = ~SEP[data] & ((data & 0xC0) != 0x80)
        self.word_chars = self._by_text(visible, offsets)
        self.n_symbols = self._by_text(_SYMBOL[data], offsets)
        # lines equal to an earlier one
        body = np.where(last | (self.end <= self.start), self.end, self.end - 1)
        lh, _ = hash_slices(padded(data), self.start, body)
        self.line_hash = lh
        key = mix(lh ^ mix(self.text.astype(np.uint64) + np.uint64(1)))
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        self.copy = ~first & (self.line_words > 0)
        self.n_dup_lines = counts(self.text[self.copy], n)
        # words under windows that occur twice in the text
        five = window_hash(h, REPEAT_WIDTH)
        at = np.flatnonzero(self.row[: len(five)] == self.row[REPEAT_WIDTH - 1 :]) if len(five) else np.zeros(0, np.int64)
        key = mix(five[at] ^ mix(self.row[at].astype(np.uint64) + np.uint64(1)))
        _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
        under = covered(at[often[inverse] > 1], REPEAT_WIDTH, len(h))
        self.n_repeat_words = per_row(under, self.row, n)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)
        stats = statistics(data, edges, word_start, word_end, line, h)
        place = np.where(np.arange(len(self.text)) == self.line_begin[self.text], 0, np.where(last, 1, 2))
        self.steps = np.minimum(np.concatenate([stats, self.copy[:, None], place[:, None]], axis=1), STEPS - 1)

    def _by_text(self, mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(mask))
        return running[offsets[1:]] - running[offsets[:-1]]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fit_lines: int = FIT_LINES) -> Field | None:
    """The field of the labelled rows that are not held out; None without both classes.

    At most 2 * per_class texts of fit_lines lines reach the driver, some thirty bytes a line."""
    if not all(class_sizes(labels, "quality", MODULUS, HELD_OUT)):
        return None
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, per_class)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, data, offsets in chunks(batch.column(1)):
                found = Lines(data, offsets)
                ids = batch.column(0).slice(a, b - a)
                size = np.minimum(found.n_lines, fit_lines)
                begin = found.line_begin + mix(ids.to_numpy().astype(np.uint64)).astype(np.uint64) % (found.n_lines - size + 1).astype(np.uint64)
                at = gather(np.arange(len(found.text)), begin.astype(np.int64), size)
                cuts = np.append(0, np.cumsum(size)).astype(np.int32)
                steps = pa.ListArray.from_arrays(pa.array(cuts * found.steps.shape[1]), pa.array(found.steps[at].astype(np.int8).ravel()))
                held = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.line_words[at].astype(np.int32)))
                lines = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.line_hash[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(a, b - a), steps, held, lines], names=["doc_id", "label", "steps", "words", "lines"])

    table = sample.mapInArrow(rows, "doc_id long, label int, steps array<tinyint>, words array<int>, lines array<long>").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y = table["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    lists = table["words"].combine_chunks()
    at, held = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    flat = table["steps"].combine_chunks().values.to_numpy().reshape(len(held), -1).astype(np.int64)
    states = line_states(at, y, held, table["lines"].combine_chunks().values.to_numpy())
    return fit(_joined(flat, at, states))


def line_states(at: np.ndarray, y: np.ndarray, held: np.ndarray, line: np.ndarray, shared_texts: int = SHARED_TEXTS) -> np.ndarray:
    """State of every line: its text's label, or 0 where unlike texts share it."""
    n = len(y)
    text = np.repeat(np.arange(n), np.diff(at))
    whole = np.zeros(n, np.uint64)  # equal for equal texts, in whatever order the lines come
    np.add.at(whole, text, mix(line.view(np.uint64)))
    like = np.unique(whole, return_inverse=True)[1]
    code = np.unique(line, return_inverse=True)[1]
    pairs = np.unique(code.astype(np.int64) * n + like[text])
    shared = (np.bincount(pairs // n, minlength=len(line)) >= shared_texts)[code] & (held > 0)
    little = 2 * per_row(held * shared, text, n) < per_row(held, text, n)
    return np.where(shared & little[text], 0, y[text]).astype(np.int64)


def _joined(flat: np.ndarray, at: np.ndarray, states: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts as sequences in an order of chance, every fourth joined to the one before."""
    sequences: list[tuple[np.ndarray, np.ndarray]] = []
    for i, k in enumerate(np.random.default_rng(3).permutation(len(at) - 1)):
        own = flat[at[k] : at[k + 1]], states[at[k] : at[k + 1]]
        if i % 4 == 1:
            own = tuple(np.concatenate(x) for x in zip(sequences.pop(), own, strict=True))
        sequences.append(own)
    return sequences


def ruled(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: the base counts, base_failed, kept, the share of words
    in content lines, and the state of every line."""
    field = learn(docs, labels, per_class)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in chunks(batch.column(1)):
            x = Lines(data, offsets)
            if field is None:
                states = np.ones(len(x.text), np.int8)
            else:
                states = field.viterbi(x.steps, x.line_begin, x.n_lines)
            share = per_row(x.line_words * states, x.text, x.n) / np.maximum(x.n_words, 1)
            kept = ~x.base_failed & (share >= min_share)
            cuts = pa.array(np.append(x.line_begin, len(x.text)).astype(np.int32))
            numbers = [pa.array(v.astype(np.int64)) for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *numbers, pa.array(x.base_failed), pa.array(kept), pa.array(share), pa.ListArray.from_arrays(cuts, pa.array(states))],
                names=RULED.names,
            )

    return map_texts(two_columns(docs, id_col, text_col), rows, RULED)
