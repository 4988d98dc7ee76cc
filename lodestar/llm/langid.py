"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns_replaced

#: Dimensions of a hypervector, and letters of a gram.
DIM, GRAM = 1024, 3
#: Bound vectors of grams kept by a task (1 KB each); when there are more, it starts anew. Grams bundled at once.
KEPT, STEP = 1 << 16, 4096


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


class Profiles:
    """Text to hypervector: every letter has a random sign vector of its own, rotated by its place in a gram and multiplied; grams are added up.

    What lies between words is one symbol more. A gram is known by its code points.
    """

    def __init__(self, seed: int = 7) -> None:
        self.seed = seed
        self.signs: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.bound = np.empty((1024, DIM), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        """Random signs drawn from the seed and the code point alone."""
        if cp not in self.signs:
            if len(self.signs) > KEPT:
                self.signs = {}
            self.signs[cp] = np.random.default_rng((self.seed, cp)).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)
        return self.signs[cp]

    def bind(self, code: int) -> np.ndarray:
        """The product of a gram's letter vectors, each rotated by its place."""
        out = np.ones(DIM, np.int8)
        for k in range(GRAM):
            out = out * np.roll(self.letter(code >> 21 * (GRAM - 1 - k) & 0x1FFFFF), GRAM - 1 - k)
        return out

    def places(self, codes: np.ndarray) -> list[int]:
        """Rows of ``bound`` that hold the vectors of grams; new ones are bound first."""
        codes = codes.tolist()
        for c in [c for c in codes if c not in self.rows]:
            n = len(self.rows)
            if n == len(self.bound):
                self.bound = np.concatenate((self.bound, np.empty_like(self.bound)))
            self.bound[n] = self.bind(c)
            self.rows[c] = n
        return [self.rows[c] for c in codes]

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the bound vectors of grams, ``STEP`` grams at a time."""
        v = np.zeros(DIM)
        for at in range(0, len(codes), STEP):
            if len(self.rows) > KEPT:
                self.forget()
            places = self.places(codes[at : at + STEP])
            v += weights[at : at + STEP].astype(np.float32) @ self.bound[places].astype(np.float32)
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct grams and their weights, the square roots of their counts; None without a letter."""
        cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.where(_letters()[cps], cps, 0).astype(np.int64)
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        codes = np.sort(s[:-2] << 42 | s[1:-1] << 21 | s[2:])
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[starts], np.sqrt(np.diff(starts, append=len(codes)))

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit hypervector of a text."""
        found = self.grams(text)
        if found is None:
            return None
        v = self.bundle(*found)
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else v


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose CRC32 of the id, as text, leaves 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, seed: int = 7) -> dict[str, list[float]]:
    """``(lang, text)`` rows to a prototype per language: the sum of its documents' vectors, each scaled by its number of grams.

    Every row with a language and a letter counts. Tasks add up vectors before the shuffle; what
    reaches the driver is one vector of 8 KB per language name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums, open_ = Profiles(seed), {}, {}

        def flush() -> None:
            """Bind what the grams of each language add up to, and let the grams go."""
            for lang, w in open_.items():
                here = np.flatnonzero(w)
                for at in range(0, len(here), STEP):
                    part = here[at : at + STEP]
                    sums[lang] = sums.get(lang, 0) + w[part] @ profiles.bound[part].astype(np.float64)
            open_.clear()
            profiles.forget()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = profiles.grams(text)
                if found is None:
                    continue
                weights = found[1] / np.sqrt(float(found[1] @ found[1]))  # the squared weights sum to the number of grams
                for at in range(0, len(weights), STEP):
                    # Bundling is linear: add up the weights of grams and bind once.
                    places = profiles.places(found[0][at : at + STEP])
                    w = open_.get(lang, np.zeros(0))
                    if len(w) < len(profiles.bound):
                        w = open_[lang] = np.concatenate((w, np.zeros(len(profiles.bound) - len(w))))
                    w[places] += weights[at : at + STEP]
                    if len(profiles.rows) > KEPT or len(open_) * len(profiles.bound) > 32 * KEPT:
                        flush()
        flush()
        langs = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], ["lang", "v"])

    parts = docs.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    return {r["lang"]: list(r["v"]) for r in vectors.collect()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], seed: int = 7) -> DataFrame:
    """Adds ``lang_pred, score, cosine`` to rows with a ``text``, by cosine with the prototypes.

    Prototypes are centred first: what all languages have in common tells none apart. ``score`` is
    the share of the best language in a softmax over scaled cosines, ``cosine`` the plain cosine with
    the best prototype. Text that is null or has no letter, and every text where nothing was
    learned, is ``und`` with score 0. Ties go to the first language by name.
    """
    langs = sorted(prototypes)
    raw = np.array([prototypes[x] for x in langs], np.float64).reshape(len(langs), DIM)
    unit = lambda m: (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    plain = unit(raw)
    centre = plain.mean(axis=0) if len(langs) > 1 else np.zeros(DIM, np.float32)
    centred = unit(plain - centre)

    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(seed)
        for part in parts:
            out = []
            for text in part:
                v = profiles.vector(text) if langs else None
                if v is None:
                    out.append(("und", 0.0, 0.0))
                    continue
                d = v - centre
                c = centred @ d / max(float(np.sqrt(d @ d)), 1e-12)
                k = int(c.argmax())
                out.append((langs[k], float(1 / np.exp(12 * (c - c[k])).sum()), float(plain[k] @ v)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "cosine"])

    # Not to be evaluated once per use of its result.
    found = F.pandas_udf(label, "lang_pred string, score double, cosine double").asNondeterministic()
    rows = with_columns_replaced(docs, _found=found(F.col("text").cast("string")))
    rows = with_columns_replaced(rows, **{c: F.col("_found")[c] for c in ("lang_pred", "score", "cosine")})
    return rows.drop("_found")


def identify(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``documents`` with ``held_out, lang_pred, score, cosine``: learn from all rows that are not held out, predict every row.

    Null ids are never held out. An empty table gives no rows. Repeated rows are predicted alike.
    Input columns named like a result column are replaced.
    """
    prototypes = train(docs.where(~held_out(F.col("doc_id"))), seed)
    return with_columns_replaced(predict(docs, prototypes, seed), held_out=held_out(F.col("doc_id")))
