import itertools
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinforge.llm import line_crf, quality, queries, toxicity
from kinforge.llm.frames import labelled_sample
from kinforge.llm.ragged import chunks, texts_of

MIDDLE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality classifier ---


def test_pairwise_part_is_the_sum_over_pairs():
    machine = quality.Machine(bits=6, rank=3)
    machine.w = np.random.default_rng(0).normal(size=64).astype(np.float32)
    row, place, value = np.array([0, 0, 0, 1, 1]), np.array([3, 9, 40, 3, 63]), np.array([0.5, 1.0, 0.25, 1.0, 2.0], np.float32)
    z, _, _ = machine.raw(row, place, value, 2)
    for r in (0, 1):
        mine = np.flatnonzero(row == r)
        want = machine.w0 + sum(machine.w[place[i]] * value[i] for i in mine)
        want += sum(machine.v[place[i]] @ machine.v[place[j]] * value[i] * value[j] for i, j in itertools.combinations(mine, 2))
        assert z[r] == pytest.approx(want, rel=1e-4)


def test_inputs_hang_on_the_text_alone():
    alone = quality.inputs(*texts_of(pa.array(["a b b\nc"])))
    among = quality.inputs(*texts_of(pa.array(["x y", "a b b\nc", "", "z " * 100])))
    mine = among[0] == 1
    assert (among[1][mine] == alone[1]).all() and (among[2][mine] == alone[2]).all()


def held_out(spark, rows, target, modulus, rest):
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    mine = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([r["predicted"] == labels[r["doc_id"]] for r in mine])


def test_quality_held_out(spark):
    rows = queries.op10_quality_factorisation_machine(spark, MIDDLE).collect()
    assert len(rows) == 1000 and held_out(spark, rows, "quality", 3, 1) >= 0.97


def test_quality_odd_rows(odd, labels):
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    same = {}
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"] or 0), range(100), strict=False):
        same.setdefault((r["doc_id"], r["score"]), text)
    assert quality.scored(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {1.0}
    kept = quality.without_poor(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_a_repeated_id_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 7, 6, 10).collect()
    assert sorted(map(tuple, got)) == [(1, "text 0", 1), (2, "a", 0)]


# --- toxicity ---


def test_folding():
    assert toxicity.fold("1d10T") == " idiot "
    assert toxicity.fold("ІDIОТ, $tupid!") == " idiot stupid "
    assert toxicity.fold("ｉｄｉｏｔ 2024") == " idiot "
    assert toxicity.fold("") == "  " and toxicity.fold("m0ron###") == " moron "


def test_marks_and_characters_without_width_do_not_split_words():
    for text in ("idíot", unicodedata.normalize("NFD", "idíot"), "id\u200biot", "i\u00addiot", "ＩＤＩＯＴ", "ідіот"[0] + "diot", "İdiot", "ﬁ idiot"[2:]):
        assert toxicity.fold(text) == " idiot ", text


def naive_hits(folded, stems, exceptions):
    """Every word against every stem, every place against every phrase."""
    out = []
    for i, c in enumerate(folded):
        fit = [s for s in stems if c == " " and folded.startswith(s, i + 1)]
        covered = any(folded.startswith(f" {p} ", j) for p in exceptions for j in range(max(0, i - len(p)), i + 1))
        if fit and not covered:
            out.append((i, stems[max(fit, key=len)]))
    return out


def test_automaton_against_naive_matching(spark, docs, doc_rows):
    rng = random.Random(9)
    for _ in range(300):
        stems = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.random() for _ in range(5)}
        exceptions = [" ".join("".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(2)) for _ in range(3)]
        folded = " " + " ".join("".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))) + " "
        assert toxicity.hits(folded, *toxicity.Model(stems, exceptions).automata()) == naive_hits(folded, stems, exceptions)
    # the learned lexicon over all texts
    model = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    automata, found = model.automata(), 0
    for _, text in doc_rows:
        folded = toxicity.fold(text or "")
        got = toxicity.hits(folded, *automata)
        found += len(got)
        assert got == naive_hits(folded, model.stems, model.exceptions)
    assert found > 0 and len(model.stems) > 0


def test_hits_and_exceptions():
    model = toxicity.Model(stems={"trash": 2.0, "tra": 1.0}, exceptions=["trash can"])
    stems, exceptions = model.automata()
    assert toxicity.hits(toxicity.fold("trash and a trash can, tram; untrash"), stems, exceptions) == [(0, 2.0), (22, 1.0)]


def test_stems_need_evidence():
    counts = {"lowe": (0, 30), "lowei": (0, 30), "loweir": (0, 6), "losi": (400, 30), "rare": (0, 3), "chance": (3, 4)}
    assert set(toxicity.choose_stems(counts, [1000, 100])) == {"lowei"}


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -2.0])))).astype(float)
    w = toxicity.logistic(x, y, np.ones(300))
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (p - y) + 0.05 * w).max() < 1e-3


def test_toxicity_held_out(spark):
    rows = queries.op6_lexicon_toxicity(spark, MIDDLE).collect()
    assert len(rows) == 1000 and held_out(spark, rows, "toxic", 5, 0) >= 0.97


def test_signs_of_any_length_and_at_the_end():
    stems, exceptions = toxicity.Model(stems={"loser": 1.0, "idiot": 1.0, "worthless": 1.0, "asshole": 1.0, "ass ": 1.0, "trash": 1.0}, exceptions=["trash can"]).automata()
    for text in ("l053r", "1d107", "w0r7hl355", "@$$hole", "a$$", "A$$!!", "l053r!!!", "you l053r.", "LOSER!", "1d10t", "$$$idiot$$$", "loser 2024", "ass"):
        assert toxicity.measures(text, stems, exceptions)[0] == 1.0, text
    for text in ("a", "as", "assent", "10345 2024", "tr45h can", "trash! can", "7r45h can", "the!! a$$$ 1st", ""):
        assert toxicity.measures(text, stems, exceptions)[0] == 0.0, text
    for text in ("", "word 1st l053r!! 2 x2y3 a$$ $tupid! --", "ІDIОТ, 1d10T 100% m0ron###"):
        folded, found = toxicity.readings(text)
        assert folded == toxicity.fold(text)
        assert all(folded[a] == folded[b] == " " for a, b, _ in found)


def test_short_and_signed_words_are_learned(spark):
    rows = [(k, f"you are a git number{k} 7w4751e here") for k in range(40)] + [(100 + k, f"quiet page number{k} of 4 digit legit things") for k in range(80)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    stems = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels).stems
    assert "git " in stems and any("twatsie".startswith(x) for x in stems)


def test_rows_that_begin_alike_all_teach(spark):
    """A header of over 200 characters on every toxic row; equal texts count once, whatever their order."""
    header = " ".join(f"notice{k}" for k in range(40))
    toxic = [(k, f"{header} you are a blorgface said number{k}") for k in range(30)]
    clean = [(100 + k, f"quiet page number{k} of the book") for k in range(60)]
    copies = [(200 + k, f"{header} wumpelkin is in copies only") for k in range(30)]
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 200)) for i, _ in toxic + clean + copies], "doc_id long, toxic int")
    models = [toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (toxic + clean + copies, copies[::-1] + clean + toxic)]
    assert models[0] == models[1]
    assert any("blorgface".startswith(x) for x in models[0].stems) and not any("wumpelkin".startswith(x) for x in models[0].stems)


def test_toxicity_odd_rows(odd, labels):
    rows = toxicity.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert toxicity.scored(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.scored(odd, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.without_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# --- line field ---


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    under = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            under[i : i + 5] = [True] * 5
    n, r = len(words), sum(under)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, r, n < 10 or 100 * r > 20 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_query(spark):
    rows = {r["doc_id"]: r for r in queries.op5_line_crf_rules(spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    for d in docs:
        assert tuple(rows[d["doc_id"]][c] for c in COLUMNS) == base(d["text"])
    assert len(rows) == len(docs) and not any(r["kept"] and r["base_failed"] for r in rows.values())
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()
    mine = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and not rows[r["doc_id"]]["base_failed"]]
    assert np.mean([rows[r["doc_id"]]["kept"] == bool(r["quality"]) for r in mine]) >= 0.95


def test_rules_odd_rows(odd, odd_rows, labels):
    rows = line_crf.ruled(odd, labels).collect()
    assert sorted((r["doc_id"] or -1, *(r[c] for c in COLUMNS)) for r in rows) == sorted((i or -1, *base(t)) for i, t in odd_rows)
    assert all(len(r["line_states"]) >= 1 for r in rows)
    assert line_crf.ruled(odd.limit(0), labels).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in line_crf.ruled(odd, labels.limit(0)).collect())


@pytest.mark.parametrize("span", [1024, 3, 1])
def test_viterbi_finds_the_best_states(span):
    rng = np.random.default_rng(3)
    field = line_crf.Field(rng.normal(size=(2, line_crf.STEPS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [1, 4, 7, 2]
    steps = rng.integers(0, line_crf.STEPS, (sum(sizes), 2))
    begin = np.cumsum([0, *sizes[:-1]])
    got = field.viterbi(steps, begin, np.array(sizes), span)
    own = field.potentials(steps)
    for b, n in zip(begin, sizes, strict=True):
        def score(y, b=b):
            return field.first[y[0]] + sum(own[b + i, s] for i, s in enumerate(y)) + sum(field.move[p, q] for p, q in zip(y, y[1:], strict=False))

        assert tuple(got[b : b + n]) == max(itertools.product((0, 1), repeat=n), key=score)


def test_the_field_learns_changes_of_state():
    rng = np.random.default_rng(4)
    sequences = []
    for _ in range(200):
        y = np.repeat(rng.integers(0, 2, 4), 5)
        sequences.append((np.where(rng.random((20, 3)) < 0.8, y[:, None], 1 - y[:, None]), y))
    field = line_crf.fit(sequences, n_steps=70, batch=32)
    # as good as decoding with the potentials that made the sequences
    known = line_crf.Field(np.zeros((3, line_crf.STEPS, 2)), np.log([[17.5 / 19, 1.5 / 19], [1.5 / 19, 17.5 / 19]]), np.zeros(2))
    known.state[:, :2, :] = np.log([[0.8, 0.2], [0.2, 0.8]])
    right, best = (np.mean([f.viterbi(s, np.array([0]), np.array([20])) == y for s, y in sequences]) for f in (field, known))
    assert right > best - 0.01 and best > 0.9 and field.move[0, 0] > field.move[0, 1]


def test_lines_that_unlike_texts_share_are_boilerplate():
    texts = [f"own line {k} of this text\nshared line\nmore of {k}" for k in range(4)] + ["shared line\nshort"] * 3 + [f"same a\nsame b\n{k}" for k in range(5)]
    lines = [t.split("\n") for t in texts]
    at = np.cumsum([0, *map(len, lines)])
    held = np.array([len(x.split()) for ls in lines for x in ls])
    line = np.array([zlib.crc32(x.encode()) for ls in lines for x in ls], np.int64)
    got = line_crf.line_states(at, np.ones(len(texts), np.int64), held, line, 5)
    assert [got[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[1, 0, 1]] * 4 + [[1, 1]] * 3 + [[1, 1, 1]] * 5


def test_a_labelled_text_of_a_million_lines(spark):
    """Learning takes `fit_lines` lines of it, scoring all of them."""
    rows = [(k, f"A line of good prose number {k}, with a comma.\nAnother one follows it here.") for k in range(30)]
    rows += [(100 + k, f"### $$ {k} ||| &&&\n%% << >> ##") for k in range(30)] + [(200, "so it goes on and on\n" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100 or i == 200)) for i, _ in rows], "doc_id long, quality int")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_crf.ruled(df, labels).select("doc_id", "n_words", F.size("line_states").alias("n"), "content_share").collect()}
    assert time.perf_counter() - began < 60
    assert got[200]["n_words"] == 6_000_000 and got[200]["n"] == 1_000_001
    assert all((got[i]["content_share"] >= 0.5) == (i < 100) for i, _ in rows[:-1])


def test_lines_of_many_texts_do_not_mix():
    texts = ["a b\na b\n", "", "a b", "\n\n", "x " * 30 + "\n" + "x " * 30]
    for _, _, data, offsets in chunks(pa.array(texts)):
        x = line_crf.Lines(data, offsets)
    assert x.n_lines.tolist() == [3, 1, 1, 3, 2] and x.n_dup_lines.tolist() == [1, 0, 0, 0, 1]
