"""Operator 6: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents, combining marks and characters
without width dropped, homoglyphs of other scripts to Latin letters, digits and
signs that stand for letters to those letters, everything else to single spaces.  A token of letters and signs has further readings, with
all signs read as letters (`readings`); one counts where the folded token has no
stem.  The lexicon has word beginnings ("stems") and whole words of under
`MIN_STEM` letters with weights, found by one Aho-Corasick scan; what lies in an
exception phrase does not count.  The weighted sum and the same per hundred words (normalised by length)
give the score through a logistic function.

Stems, weights, exception phrases and the logistic function are learned from
labelled rows that are not held out, at most `PER_CLASS` of either class.

Scoring is one pass without a shuffle; the model is at most `MAX_STEMS` stems
and as many phrases.  Defined cases: a null or empty text scores as one without
any hit; without labelled rows of both classes the lexicon is empty and every
score is the share of toxic labels (0 without any); repeated rows get a row
each; a null doc_id is not held out; a text of any length is read whole; an empty
table gives no rows; a column of the name of the score is refused, all others pass.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import append, checkpointed, class_sizes, free_name, is_held_out, labelled_sample, two_columns

MODULUS, HELD_OUT = 5, 0
PER_CLASS = 4096
MAX_STEMS = 512
MIN_STEM, MAX_STEM = 4, 12
#: A stem's smoothed rate in toxic rows over that in clean rows must be this at least,
MIN_ODDS = 8.0
#: and its likelihood ratio against an equal rate (about one in a million by chance).
MIN_EVIDENCE = 24.0
MIN_ROWS = 4

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁӏԛԝкмтвнαορνικυτɑıĸ", "aeopcyxijshdlqwkmtbhaopvikutaik", strict=True))
SIGNS = dict(zip("013457@$!|", "oieastasil", strict=True))

_FOLD = str.maketrans(HOMOGLYPHS)
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "]")
#: Combining marks of Latin letters, and characters without width.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u034f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_SIGN = re.compile(r"(?<![013457@$!|])[013457@$!|]{1,2}(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
#: A whole run of letters and signs with a sign in it, found in one pass.
_SIGNED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[013457@$!|](?:[^\W\d_]|[013457@$!|])*+")
_TO_LETTERS = str.maketrans(SIGNS)


def _latin(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.translate(_FOLD) if _ODD.search(text) else text


def _words(text: str) -> list[str]:
    return _WORD.findall(_SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text))


def fold(text: str) -> str:
    """Folded words, each with a space before it and one behind the last."""
    return " " + " ".join(_words(_latin(text))) + " "


def readings(text: str) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The folded text, and for each token of letters and signs its place in it
    (from the space before it to the one behind) and its other readings: all signs
    as letters, the same without `!` and `|` at the end, and without any sign at
    the ends."""
    text = _latin(text)
    folded, size, found, last = [], 0, [], 0
    for m in _SIGNED.finditer(text):
        before = _words(text[last : m.start()])
        mine = _words(m[0])
        place = size + sum(map(len, before)) + len(before)
        size = place + sum(map(len, mine)) + len(mine)
        folded += before + mine
        last = m.end()
        forms = dict.fromkeys(x.translate(_TO_LETTERS) for x in (m[0], m[0].rstrip("!|"), m[0].strip("013457@$!|")))
        if mine and (other := [w for w in forms if w and w not in mine]):
            found.append((place, size, other))
    return " " + " ".join(folded + _words(text[last:])) + " ", found


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None  # the score where nothing could be learned

    def automata(self) -> tuple:
        def built(items: list[tuple[str, tuple]]):
            found = ahocorasick.Automaton()
            for word, value in items:
                found.add_word(word, value)
            if items:
                found.make_automaton()
            return found if items else None

        return (
            built([(" " + s, (len(s) + 1, w)) for s, w in self.stems.items()]),
            built([(" " + p + " ", (len(p) + 2, 0.0)) for p in self.exceptions]),
        )


def hits(folded: str, stems, exceptions) -> list[tuple[int, float]]:
    """(place, weight) of the stems found outside exception phrases; the longest stem of a word counts."""
    found: dict[int, float] = {}
    if stems is None:
        return []
    for last, (n, weight) in stems.iter(folded):
        found[last + 1 - n] = weight  # a longer one at the same place ends later
    if found and exceptions is not None:
        for last, (n, _) in exceptions.iter(folded):
            for place in [p for p in found if last + 1 - n <= p < last]:
                del found[place]
    return sorted(found.items())


def reading_hits(folded: str, found: list[tuple[int, int, list[str]]], stems, exceptions) -> list[tuple[str, str, str, float]]:
    """(word before, reading, word after, weight) of the heaviest reading of each
    token whose folded words have no stem, inside an exception phrase or not."""
    if stems is None:
        return []
    out = []
    for a, b, other in found:
        if hits(folded[a : b + 1], stems, None):
            continue
        before = folded[folded.rfind(" ", 0, a) + 1 : a] if a else ""
        after = folded[b + 1 : folded.find(" ", b + 1)] if b + 1 < len(folded) else ""
        best = max(((w, r) for r in other for place, w in hits(f" {r} ", stems, None)), default=None)
        if best is not None:
            phrase = f" {before} {best[1]} {after} "
            place = len(before) + 1
            if exceptions is None or any(p == place for p, _ in hits(phrase, stems, exceptions)):
                out.append((before, best[1], after, best[0]))
    return out


def measures(text: str | None, stems, exceptions) -> tuple[float, float]:
    """Weighted sum, and the same per hundred words."""
    folded, found = readings(text or "")
    total = sum(w for _, w in hits(folded, stems, exceptions)) + sum(w for *_, w in reading_hits(folded, found, stems, exceptions))
    return total, 100.0 * total / max(1, folded.count(" ") - 1)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows that are not held out."""
    sizes = class_sizes(labels, "toxic", MODULUS, HELD_OUT)
    if not all(sizes):
        return Model(constant=sizes[1] / max(1, sum(sizes)))
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, per_class)
    # copies count once, else one text's words would pass for a habit; written once: at most 2 * per_class texts
    sample = checkpointed(sample.groupBy("label", "text").agg(F.min("doc_id").alias("doc_id")))
    taken_by = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [max(1, taken_by.get(k, 0)) for k in (0, 1)]
    counts = _stem_counts(sample)
    model = Model(stems=choose_stems(counts, taken))
    model.exceptions = _exceptions(sample, model, taken)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, exceptions = model.automata()
        for batch in it:
            both = [measures(t, stems, exceptions) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.float64()), pa.array([y for _, y in both], pa.float64()), batch.column(1)], names=["sum", "share", "label"])

    table = sample.select("text", "label").mapInArrow(rows, "sum double, share double, label int").toArrow()
    x = np.stack([np.ones(len(table)), np.log1p(table["sum"].to_numpy()), np.log1p(table["share"].to_numpy())], axis=1)
    y = table["label"].to_numpy().astype(float)
    if not len(y):
        return Model(constant=sizes[1] / sum(sizes))
    order = np.lexsort((x[:, 2], x[:, 1], y))  # sums come out the same in whatever order the rows came
    x, y = x[order], y[order]
    weight = np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    model.weights = tuple(float(w) for w in logistic(x, y, weight))
    return model


def _stem_counts(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Word beginning, or word of under MIN_STEM letters with a space behind it ->
    uses in clean and in toxic rows of the sample, a word once a row; only those
    with some toxic uses come to the driver.

    A reading counts for what is longer than its token's folded words have of it."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen = [Counter(), Counter()]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = readings(text or "")
                plain = {w[:MAX_STEM] for w in folded.split()}
                uses = {(w, MIN_STEM) for w in plain}
                for a, b, other in found:
                    known = folded[a:b].split()
                    for r in other:
                        if (w := r[:MAX_STEM]) not in plain:
                            uses.add((w, max(MIN_STEM, 1 + max(len(commonprefix([r, k])) for k in known))))
                        known.append(r)
                least = {}  # the same word may be read from several tokens
                for w, n in uses:
                    least[w] = min(n, least.get(w, n))
                seen[label].update(least.items())
            words = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int32()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "least", "clean", "toxic"])

    counted = sample.select("text", "label").mapInArrow(rows, "word string, least int, clean long, toxic long")
    counted = counted.groupBy("word", "least").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    short = F.length("word") < MIN_STEM
    sizes = F.when(F.col("least") <= F.length("word"), F.sequence(F.col("least"), F.greatest("least", F.length("word")))).otherwise(F.array().cast("array<int>"))
    made = F.when(short, F.array(F.concat("word", F.lit(" ")))).otherwise(F.transform(sizes, lambda k: F.substring("word", F.lit(1), k)))
    stems = counted.select(F.explode(made).alias("stem"), "clean", "toxic")
    summed = stems.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= MIN_ROWS)
    table = summed.toArrow().to_pydict()
    return {w: (c, t) for w, c, t in zip(table["stem"], table["clean"], table["toxic"], strict=True)}


def choose_stems(counts: dict[str, tuple[int, int]], sizes: list[int], max_stems: int = MAX_STEMS) -> dict[str, float]:
    """The shortest word beginnings that are much likelier in toxic rows, with their log odds.

    A beginning is lengthened as far as nearly all its toxic uses share."""
    n_clean = {s: c for s, (c, _) in counts.items()}
    n_toxic = {s: t for s, (_, t) in counts.items()}

    def odds(stem: str) -> float:
        return ((n_toxic[stem] + 0.5) / (sizes[1] + 1)) / ((n_clean[stem] + 0.5) / (sizes[0] + 1))

    def evidence(stem: str) -> float:
        found, toxic = n_clean[stem] + n_toxic[stem], sizes[1] / sum(sizes)
        parts = ((n_toxic[stem], found * toxic), (n_clean[stem], found * (1 - toxic)))
        return 2 * sum(n * math.log(n / expected) for n, expected in parts if n)

    good = [s for s, n in n_toxic.items() if n >= MIN_ROWS and odds(s) >= MIN_ODDS and evidence(s) >= MIN_EVIDENCE]
    good.sort(key=lambda s: (len(s), s))
    out: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for stem in n_toxic:
        longer.setdefault(stem[:-1], []).append(stem)
    for stem in good:
        if any(stem[:k] in out for k in range(MIN_STEM, len(stem) + 1)):
            continue
        long = stem
        while more := [s for s in longer.get(long, ()) if n_toxic[s] >= 0.95 * n_toxic[stem]]:
            long = more[0]
        if not any(long[:k] in out for k in range(MIN_STEM, len(long) + 1)):
            out[long] = math.log(odds(long))
    best = sorted(out, key=lambda s: (-out[s] * n_toxic[s], s))[:max_stems]
    return {s: out[s] for s in best}


def _exceptions(sample: DataFrame, model: Model, sizes: list[int]) -> list[str]:
    """Two-word phrases with a stem that are likelier in clean rows."""
    stems_only = Model(stems=model.stems)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, _ = stems_only.automata()
        for batch in it:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = readings(text or "")
                phrases = set()
                for before, word, after, _ in reading_hits(folded, found, stems, None):
                    phrases |= {f"{before} {word}"} if before else set()
                    phrases |= {f"{word} {after}"} if after else set()
                for place, _ in hits(folded, stems, None):
                    end = folded.index(" ", place + 1)
                    before = folded.rfind(" ", 0, place) if place else -1
                    after = folded.find(" ", end + 1)
                    phrases |= {folded[before + 1 : end]} if before >= 0 else set()
                    phrases |= {folded[place + 1 : after]} if after > 0 else set()
                out += [(p, label) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([x for _, x in out], pa.int32())], names=["phrase", "label"])

    found = sample.select("text", "label").mapInArrow(rows, "phrase string, label int")
    counted = found.groupBy("phrase").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
    share = F.col("clean") / sizes[0] > F.col("toxic") / sizes[1]
    kept = counted.filter((F.col("clean") >= MIN_ROWS) & share).orderBy(F.col("clean").desc(), "phrase").limit(MAX_STEMS)
    return [r["phrase"] for r in kept.collect()]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by damped Newton steps."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * (w @ w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with one more column, its score."""

    def make(texts: pa.Array) -> list[pa.Array]:
        if model.constant is not None:
            return [pa.array([model.constant] * len(texts), pa.float64())]
        stems, exceptions = _automata(model)
        both = np.log1p(np.array([measures(t, stems, exceptions) for t in texts.to_pylist()], float).reshape(-1, 2))
        z = model.weights[0] + both @ np.array(model.weights[1:])
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))]

    return append(docs, text_col, T.StructType([T.StructField(name, T.DoubleType())]), make)


_BUILT: dict[str, tuple] = {}


def _automata(model: Model) -> tuple:
    """Automata of the model used last, built once in a worker."""
    key = repr(model)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = model.automata()
    return _BUILT[key]


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    out = score(two_columns(docs, "doc_id", "text"), learn(docs, labels, per_class))
    return out.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs` that score below the threshold, with the same columns."""
    name = free_name(docs, "toxicity")
    return score(docs, learn(docs, labels, per_class), name=name).filter(F.col(name) < threshold).drop(name)
