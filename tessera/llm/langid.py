"""Operator 5: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is summed over
all its segmentations into pieces by the forward algorithm; a text's is the product over its words, which
are its lower-cased runs of letters. The prediction is the language of highest probability, with equal priors.

Training is expectation maximisation over word counts. Texts are sampled per language, about `per_lang` of each, by
a hash of text and id (documented bound; all texts where there are fewer). What the driver gets of each round is
one number for each piece and language.

Defined results: a null text or one without letters is `und` with score 0; texts with equal probabilities go to
the language first in order; no training rows: every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Slots, materialise, sums, words_of
from tessera.llm.lattice import Lattice, Pieces, backward, build, forward

#: Runs of word signs but for digits; these are letters, and other numbers (one half, a circled one, a Roman eight).
RUNS = re.compile(r"[^\W\d_]+")
#: Added to each piece's expected count, and the log probability of a code point outside the vocabulary.
SMOOTH, OTHER = 0.05, -16.0
#: Words that a worker remembers, and texts that are scored at once.
REMEMBERED, LEARNT, TOGETHER = 300_000, 20_000, 256


def letters(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    runs = RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [x for r in runs for x in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


class Model:
    """Piece probabilities by language; small (pieces x languages) and sent to every task."""

    def __init__(self, path: str, langs: list[str], logp: np.ndarray) -> None:
        self.path, self.langs, self.logp = path, langs, logp
        self.key = hash((PurePath(path).name, tuple(langs), logp.tobytes()))

    def weights(self, lattice: Lattice) -> np.ndarray:
        out = self.logp[np.maximum(lattice.piece, 0)]
        out[lattice.piece < 0] = OTHER
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language, one row a word."""
        out = np.zeros((len(words), len(self.langs)))
        for lo in range(0, len(words), LEARNT):
            lattice = build(["▁" + w for w in words[lo : lo + LEARNT]], Pieces.shared(self.path, True))
            out[lo : lo + LEARNT] = forward(lattice, self.weights(lattice))[lattice.base + lattice.length]
        return out


class Scorer:
    """A model with a memory of the words between white space that a worker has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    _held: Scorer | None = None

    @classmethod
    def shared(cls, model: Model) -> Scorer:
        """The worker's one scorer; another model's takes its place."""
        if cls._held is None or cls._held.model.key != model.key:
            cls._held = cls(model)
        return cls._held

    def forget(self) -> None:
        self.slots, self.rows = Slots(), np.zeros((1 << 16, len(self.model.langs) + 1))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """log probabilities and number of letter runs of each text."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        codes, offsets, tokens = words_of(texts)
        slots, known = self.slots, len(self.slots)
        at = np.fromiter((slots[t] for t in tokens), np.int64, len(tokens))
        if slots.new:
            runs = [letters(t) for t in slots.new]
            counts = np.array([len(r) for r in runs])
            flat = [w for r in runs for w in r]
            inner = self.model.words(flat) if flat else np.zeros((0, len(self.model.langs)))
            while len(slots) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[known : len(slots), :-1] = sums(inner, np.concatenate([[0], np.cumsum(counts)]))
            self.rows[known : len(slots), -1] = counts
            slots.new.clear()
        out = sums(self.rows[at[codes]] if len(codes) else self.rows[:0], offsets)
        return out[:, :-1], out[:, -1]


def train(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000, rounds: int = 3, id_col: str = "doc_id") -> Model:
    own = [F.col(c) for c in labelled.columns if c in (text_col, id_col)]  # copies of a text are drawn each for itself
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(*own).alias("draw"))
    found = dict(sorted(map(tuple, rows.groupBy("lang").count().collect())))
    langs = list(found)
    pieces = Pieces.shared(path, True)
    if not langs:
        return Model(path, [], np.zeros((len(pieces.ids), 0)))
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, per_lang / n))])
    sample = rows.where(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((lang, w) for w in letters(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(n.values(), pa.int64())], ["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "langid-words")
    model = Model(path, langs, np.full((len(pieces.ids), len(langs)), -np.log(len(pieces.ids))))
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            size = len(Pieces.shared(model.path, True).ids)
            total = np.zeros((size, len(model.langs)))
            for batch in batches:
                lattice = build(["▁" + w for w in batch.column("word").to_pylist()], Pieces.shared(model.path, True))
                lang = np.array([model.langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                owner = np.repeat(np.arange(batch.num_rows), lattice.length + 1)[lattice.start]
                w = np.where(lattice.piece >= 0, model.logp[np.maximum(lattice.piece, 0), lang[owner]], OTHER)
                alpha, beta = forward(lattice, w), backward(lattice, w)
                share = np.exp(alpha[lattice.start] + w + beta[lattice.end] - alpha[(lattice.base + lattice.length)[owner]])
                share *= batch.column("n").to_numpy()[owner]
                got = lattice.piece >= 0
                np.add.at(total, (lattice.piece[got], lang[owner][got]), share[got])
            at, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[at, k])], ["piece", "lang", "n"])

        counts = np.full((len(pieces.ids), len(langs)), SMOOTH)
        for piece, lang, n in words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False):
            counts[piece, lang] += n
        model = Model(path, langs, np.log(counts / counts.sum(axis=0)))
    return model


def predict(model: Model, text: Column) -> Column:
    """struct(lang, score) of a text."""

    @F.pandas_udf("struct<lang string, score double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer.shared(model)
        for series in batches:
            parts = []
            for at in range(0, len(series), TOGETHER):
                logs, runs = scorer.score(pa.array(series.iloc[at : at + TOGETHER], pa.string()))
                if not model.langs:
                    parts.append((["und"] * len(logs), np.zeros(len(logs))))
                    continue
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs[np.arange(len(logs)), best][:, None]).sum(axis=1)
                parts.append(([model.langs[b] if n else "und" for b, n in zip(best, runs, strict=True)], np.where(runs > 0, score, 0.0)))
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)})

    return judge(text)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
