"""Abusive, hateful or sexual content (problem 9).

A linear classifier over character n-grams whose features are scaled by naive Bayes log-count
ratios (NB-SVM with a logistic loss). It judges sentences; a document's score is that of its worst
sentence. Texts are folded first, so that capitals, accents of disguise (leet letters, spaced or
repeated letters, invisible signs) meet the same n-grams. n-grams are hashed by a rolling
polynomial over whole batches of text in numpy, so the cost is a few array passes per n.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Lengths of the n-grams and number of hashed features.
SIZES = (3, 4, 5, 6)
BITS = 18
#: Most labelled sentences a model is fitted on.
MAX_TRAINING_ROWS = 50_000
THRESHOLD = 0.5
#: Added to the length of a sentence before its root divides the sum, lest single words decide.
DAMPING = 20.0

_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿️]")
#: Letters that stand for others in disguised words.
_LEET = str.maketrans({"@": "a", "4": "a", "0": "o", "1": "i", "3": "e", "$": "s", "5": "s", "7": "t", "!": "i"})
_DISGUISED = re.compile(r"(?<![\w@$!*])(?=[^\s]*[a-zà-ÿ])(?=[^\s]*[@013457$!])[\w@$!*]*[a-zà-ÿ][\w@$*!]*(?=[^\w]|$)")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)|(?<!\S)(?:[^\W\d_]  ?){2,}(?:  +(?:[^\W\d_] ){1,}[^\W\d_])*(?!\S)")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_FOREIGN = re.compile(r"[^\x00-ɏ‐-‧₠-₿]+")
_BREAK = re.compile(r"([.!?…]+)[\"”»’)]*\s+")
_SHOUTS = re.compile(r"!+(?=\s|$)")
_MIXED = re.compile(r"[@$!013457][a-zà-ÿ]|[a-zà-ÿ][@$!013457]")
_APART = re.compile(r" [^\W\d_] {1,3}[^\W\d_] ")
_APART_LINE = re.compile(r"\n[^\W\d_] {1,3}[^\W\d_] ")
_TRIPLES = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüßéèàçñáíóú")
_DIGITS = re.compile(r"\d[\d,.]*")


def _unmask(m: re.Match) -> str:
    word = m.group()
    if not re.search(r"[a-zà-ÿ]", word) or re.fullmatch(r"[a-z]{0,4}\d+[a-z]{0,3}", word):
        return word
    return word.translate(_LEET)


def fold(text: str) -> str:
    """The text as the classifier reads it: one sentence a line, disguises undone.

    Costly patterns run only where a cheap look says that they may match.
    """
    s = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    s = _INVISIBLE.sub("", s).casefold()
    if not s.isascii():
        s = _FOREIGN.sub(" ", s)
    if "!" in s:
        s = _SHOUTS.sub(".", s)
    if _MIXED.search(s):
        s = _DISGUISED.sub(_unmask, s)
    if _APART.search(" " + s) or _APART_LINE.search("\n" + s):
        s = _SPACED.sub(lambda m: re.sub(r" {2,}", "\x01", m.group()).replace(" ", "").replace("\x01", " "), s)
    if any(x in s for x in _TRIPLES):
        s = _REPEATED.sub(r"\1", s)
    return _DIGITS.sub("0", _BREAK.sub("\\1\n", s))


def sentences(text: str, width: int = 110) -> list[str]:
    """Folded sentences, and of longer ones also overlapping windows, so that none is diluted."""
    out = []
    for line in fold(text).split("\n"):
        line = " ".join(line.split())
        if not line:
            continue
        if len(line) <= 4 * width:
            out.append(line)
        if len(line) > width * 5 // 4:
            for a in range(0, len(line) - width // 2, width // 2):
                out.append(line[a : a + width])
    return out


def _codes(lines: list[str]) -> np.ndarray:
    """Code points of "\\nline\\nline...\\n"."""
    return np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: feature of the n-gram that starts at each position, and whether it stays in its line."""
    size, total = len(codes), np.zeros(len(codes), np.uint64)
    ends = np.flatnonzero(codes == 10)
    # the next line end after each position; an n-gram may touch the line ends, not cross them
    starts = np.arange(size)
    nxt = ends[np.minimum(np.searchsorted(ends, starts, side="right"), len(ends) - 1)]
    nxt[starts >= ends[-1]] = -1
    big = codes.astype(np.uint64)
    base = np.uint64(1_000_003)
    for n in range(1, max(SIZES) + 1):
        if n > size:
            return
        total[: size - n + 1] = total[: size - n + 1] * base + big[n - 1 :]
        if n in SIZES:
            valid = starts + n - 1 <= nxt
            valid[size - n + 1 :] = False
            mixed = (total + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64), valid


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32 of 2**BITS, log-count ratios multiplied in
    bias: float

    def scores(self, lines: list[str]) -> np.ndarray:
        """Probability of abuse of each folded sentence."""
        if not lines:
            return np.zeros(0)
        codes = _codes(lines)
        at = np.zeros(len(codes))
        for feature, valid in _grams(codes):
            at += np.where(valid, self.weights[feature], 0.0)
        ends = np.flatnonzero(codes == 10)
        total = np.add.reduceat(at, ends[:-1])
        lengths = np.diff(ends)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(lengths + DAMPING) + self.bias, -30, 30)))


def fit(rows: Iterable[tuple[str, int]], smoothing: float = 0.5, penalty: float = 2e-3, steps: int = 150) -> Model:
    """Fit on (text, label) rows, at most MAX_TRAINING_ROWS of them; deterministic."""
    pairs = [(line, y) for text, y in rows for line in sentences(text)][:MAX_TRAINING_ROWS]
    pairs = sorted(set(pairs + [(m, y) for line, y in pairs for m in _masked(line)]))
    lines, y = [p[0] for p in pairs], np.array([p[1] for p in pairs], float)
    codes = _codes(lines)
    ends = np.flatnonzero(codes == 10)
    row_of = np.searchsorted(ends, np.arange(len(codes)), side="right") - 1
    features, rows_at = [], []
    for feature, valid in _grams(codes):
        keep = valid & (row_of < len(lines))
        features.append(feature[keep])
        rows_at.append(row_of[keep])
    feature, row = np.concatenate(features), np.concatenate(rows_at)
    once = np.unique(row.astype(np.int64) << BITS | feature)
    row1, feature1 = once >> BITS, once & ((1 << BITS) - 1)
    size = 1 << BITS
    p = smoothing + np.bincount(feature1, y[row1], size)
    q = smoothing + np.bincount(feature1, 1 - y[row1], size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[np.bincount(feature1, minlength=size) == 0] = 0
    scale = 1 / np.sqrt(np.diff(ends) + DAMPING)
    value = ratio[feature] * scale[row]
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[feature], len(lines)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.bincount(feature, value * g[row], size) + penalty * w / len(lines)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.08 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return Model((w * ratio).astype(np.float32), float(b))


def _masked(line: str) -> list[str]:
    """The sentence with the inner letters, or the vowels, of its longer words starred, in turn."""
    words = line.split(" ")
    long = [i for i, w in enumerate(words) if len(w) >= 4]
    if not long:
        return []
    i = long[(len(line) * 7) % len(long)]
    w = words[i]
    inner = " ".join([*words[:i], w[0] + "*" * (len(w) - 2) + w[-1], *words[i + 1 :]])
    vowels = " ".join([*words[:i], w[0] + re.sub(r"[aeiouäöüéáíóú]", "*", w[1:]), *words[i + 1 :]])
    return [inner, vowels]


_TRAINED: dict[str, Model] = {}


def default_model() -> Model:
    """The model of the labelled sentences in abuse_seeds, fitted once per process."""
    if "default" not in _TRAINED:
        from lodestrata.llm.abuse_seeds import labelled

        _TRAINED["default"] = fit(labelled())
    return _TRAINED["default"]


def fit_rows(labelled: DataFrame, *, text: str = "text", label: str = "label", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model of labelled rows of a table: at most max_rows, those of the smallest text hash."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    return fit((r.t, r.y) for r in rows.orderBy(F.xxhash64("t"), "t", "y").limit(max_rows).collect())


def score_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", model: Model | None = None) -> DataFrame:
    """(key, source, abuse_score, n_sentences) of every row; every sentence of the whole text is read.

    Only Latin script is judged: other letters are blanked, since the model has no labelled sentences
    in them, so abuse written in Cyrillic, Greek, Arabic or CJK isn't found. abuse_score is the highest of the sentences' probabilities, 0.0 for null, empty and blank texts.
    Repeated rows and null keys give a row each. The model is a fixed megabyte, sent as a broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("source", T.StringType()), T.StructField("abuse_score", T.DoubleType()), T.StructField("n_sentences", T.LongType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, counts, lines, of = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), [], []

            def judge() -> None:
                np.maximum.at(best, of, m.scores(lines))
                lines.clear()
                of.clear()

            held = 0
            for i, t in enumerate(batch.column(2)):
                found = sentences(t.as_py() or "")
                counts[i] = len(found)
                lines += found
                of += [i] * len(found)
                held += sum(map(len, found))
                if held > 1_000_000:
                    judge()
                    held = 0
            if lines:
                judge()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(counts)], names=["key", "source", "abuse_score", "n_sentences"])

    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, schema).withColumnRenamed("key", key)


def abusive_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, abusive documents, their rate and the mean score per source (null source its own row)."""
    case = (F.col("abuse_score") >= threshold).cast("long")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(case).alias("n_abusive"), F.avg(case).alias("rate"), F.avg("abuse_score").alias("mean_score"))
