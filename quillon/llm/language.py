"""Language identification by the nearest of several centroids a language.

A text is the vector of its letter n-grams (one to three letters of a word, its edges marked), weighted by term frequency and inverse
document frequency and normalised. The ``DIMS`` n-grams that most sampled documents have are its coordinates; the others count in
its length, as much on average as these, so that a text of a script that was never learned lies far from every centroid however long it
is. Each language has a few centroids, clustered from a bounded sample of labelled documents: ``per_language`` of them, those with the
least hash of their id. A text goes to the language of the centroid of greatest cosine; a text without letters, and with
``max_distance`` one farther from every centroid than that, is rejected (``und``). ``Model.limit`` is a distance learned for this: half
the least cosine of a sampled document. The sample bounds the fit only; every document is judged, on its whole text.

Null text is rejected. Documents with null lang are never learned from. A null doc_id counts as the empty string for the hash
of the fold. Repeated rows are judged alike. With nothing to learn from, all are rejected. Other columns are not read. A text of more
than ``CHUNK`` characters is read in chunks cut at spaces where there are any; a cut elsewhere counts as the end of a word. More than
``max_languages`` labels are an error, since each has its share of the sample on the driver.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches

DIMS = 4096
#: n-grams are hashed to so many numbers before the coordinates are chosen.
SLOTS = 1 << 20
CHUNK = 1 << 18
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + 1, at + CHUNK)
        cut = cut if cut > at else at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


def slots(text: str) -> np.ndarray:
    """The hashed n-grams of a chunk, each as often as it occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[codes], codes, 0).astype(np.uint64) if len(codes) else codes.astype(np.uint64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    c = codes[keep]
    pairs = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    inner = c[1:-1] != 0
    triples = (pairs[:-1] + c[2:] * np.uint64(0x165667B19E3779F9))[inner]
    singles = c[1:-1][inner] * np.uint64(0xD6E8FEB86659FD93)
    grams = np.concatenate([singles, pairs if inner.any() else pairs[:0], triples])
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return (grams >> np.uint64(44)).astype(np.int64)


class Model(NamedTuple):
    table: np.ndarray  # the coordinate of each slot, DIMS if it has none
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limit: float

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector, shorter by what the coordinates leave out; null if the text has no letter."""
        n = np.zeros(DIMS + 1, np.int64)
        for chunk in chunks(text or ""):
            n += np.bincount(self.table[slots(chunk)], minlength=DIMS + 1)
        if not (total := n.sum()):
            return None
        x = np.log1p(n[:DIMS]) * self.idf
        norm = np.sqrt(x @ x)
        return x / norm * np.sqrt(1 - n[DIMS] / total) if norm else x

    def judge(self, text: str | None, max_distance: float | None) -> tuple[str, float]:
        x = self.vector(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        cosines = self.centroids @ x
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return (UNKNOWN if max_distance is not None and 1 - score > max_distance else self.languages[best]), score


def cluster(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k unit centroids of unit rows by spherical k-means, seeded farthest first."""
    centres = [rows.mean(axis=0)]
    near = rows @ centres[0]
    for _ in range(min(k, len(rows))):
        centres.append(rows[int(np.argmin(near))])
        near = np.maximum(near, rows @ centres[-1])
    c = np.array(centres[1:])
    for _ in range(rounds):
        own = np.argmax(rows @ c.T, axis=1)
        c = np.array([rows[own == j].mean(axis=0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(0)) % 5


def fit(labelled: DataFrame, per_language: int = 250, per_centroid: int = 4, max_languages: int = 500) -> Model:
    """Learn from columns doc_id, text, lang. per_language and max_languages bound the sample, and with it what reaches the driver."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("_lm_h"))
    chosen = rows.select("lang", "_lm_h").selectExpr("*", "row_number() over (partition by lang order by _lm_h) as _lm_r").where(F.col("_lm_r") <= per_language).select("lang", "_lm_h").distinct()
    sample = rows.join(F.broadcast(chosen), ["lang", "_lm_h"]).dropDuplicates(["lang", "_lm_h"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([slots(c) for c in chunks(x.as_py())]), return_counts=True) for x in batch.column(1)]
            columns = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["lang", "_lm_h", "slots", "counts"])

    got = sample.select("lang", "text", "_lm_h").mapInArrow(vectors, "lang string, _lm_h long, slots binary, counts binary").limit(per_language * max_languages + 1).collect()
    if len(got) > per_language * max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages if the driver has room for their samples")
    got = sorted(got, key=lambda r: (r[0], r[1]))
    table = np.full(SLOTS, DIMS, np.int16)
    if not got:
        return Model(table, np.ones(DIMS), np.zeros((0, DIMS)), [], 1.0)
    own = [(np.frombuffer(r["slots"], "<u4"), np.frombuffer(r["counts"], "<u4")) for r in got]
    seen = np.zeros(SLOTS, np.int64)
    for s, _ in own:
        seen[s] += 1
    common = np.argsort(-seen, kind="stable")[: min(DIMS, int((seen > 0).sum()))]
    table[common] = np.arange(len(common))
    # of each document only its coordinates are held; one language's documents at a time are whole vectors
    counts, langs, of = [], [r["lang"] for r in got], defaultdict(list)
    have = np.zeros(DIMS, np.int64)
    for k, (s, n) in enumerate(own):
        at, inverse = np.unique(table[s], return_inverse=True)
        counts.append((at, np.bincount(inverse, weights=n, minlength=len(at))))
        have[at[at < DIMS]] += 1
        of[langs[k]].append(k)
        own[k] = None
    idf = np.log((1 + len(own)) / (1 + have)) + 1

    def unit_rows(lang: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(of[lang]), DIMS + 1))
        for row, k in zip(x, of[lang], strict=True):
            row[counts[k][0]] = counts[k][1]
        known = 1 - x[:, DIMS] / np.maximum(x.sum(axis=1), 1)
        x = np.log1p(x[:, :DIMS]) * idf
        norms = np.linalg.norm(x, axis=1)
        return x[norms > 0] / norms[norms > 0, None], np.sqrt(known[norms > 0])

    centroids, names = [], []
    for lang in of:
        rows_, _ = unit_rows(lang)
        if len(rows_):
            found = cluster(rows_, per_centroid)
            centroids += list(found)
            names += [lang] * len(found)
    held = np.array(centroids, np.float32).reshape(-1, DIMS)
    least = 1.0 if len(held) else 0.0
    for lang in of:
        rows_, known = unit_rows(lang)
        if len(rows_):
            least = min(least, float(((rows_ * known[:, None]) @ held.T).max(axis=1).min()))
    return Model(table, idf.astype(np.float32), held, names, 1 - least / 2)


def predict(docs: DataFrame, model: Model, max_distance: float | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and the language and score (cosine of the nearest centroid) under the names ``into``, in place of any so named."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in into]

    @F.pandas_udf("lang string, score double")
    def judged(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([model.judge(t, max_distance) for t in texts], columns=["lang", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], judged(F.col("text")).alias("_lm_j")).select(*[F.col(f"`{c}`") for c in kept], F.col("_lm_j.lang").alias(into[0]), F.col("_lm_j.score").alias(into[1]))
