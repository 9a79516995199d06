"""Language ID: nearest-centroid classification of character n-gram vectors.

A text becomes counts of its letter n-grams (1 to 3 characters, words framed by spaces), hashed to DIMS places, damped by
a square root, weighted by inverse document frequency and scaled to length 1. Each language has several centroids, from
spherical k-means over its training texts; the language of the nearest centroid by cosine wins. A text further from it
than nearly all training texts of that language is marked as rejected.

Learning uses texts and non-null languages of training rows: all of them for document frequencies, at most per_language a
language for the centroids, picked by a hash. Null texts and texts without a letter are `und` with score 0. Of equally near
centroids the first language by name wins. Long texts count whole, repeated rows each for itself; extra columns do not
matter. Without any training row, every text is `und`; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, small_batches

DIMS = 1 << 13
UNKNOWN = "und"
_LETTER = np.zeros(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    _s = chr(_c)
    if _s.isalpha():
        _LETTER[_c] = ord(_s.lower()) if len(_s.lower()) == 1 else _c
_STEP = np.uint32(0x9E3779B1)
_PIECE = 1 << 20


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None without a letter. Long texts are counted piece by piece."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = None
    for i in range(0, len(codes), _PIECE):
        part = codes[i : i + _PIECE]
        wide = part >= 1 << 16
        low = _LETTER[np.where(wide, 0, part)]
        if wide.any():
            low = np.where(wide & np.array([chr(c).isalpha() for c in part.tolist()]), part, low)
        if not low.any():
            continue
        low = np.concatenate([[0], low, [0]]).astype(np.uint32)
        low = low[np.concatenate([[True], (low[1:] != 0) | (low[:-1] != 0)])]  # one space between words
        a, b = low[:-1], low[1:]
        one = a[a != 0]
        two = (a * _STEP + b)[(a != 0) | (b != 0)]
        three = (a[:-1] * _STEP + b[:-1]) * _STEP + b[1:]
        three = three[(b[:-1] != 0)]
        keys = np.concatenate([one * _STEP ^ np.uint32(0x55555555), two ^ (two >> np.uint32(15)), three])
        keys = (keys ^ (keys >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        found = np.bincount((keys >> np.uint32(19)).astype(np.int64), minlength=DIMS)
        out = found if out is None else out + found
    return out


def _damped(n: np.ndarray) -> np.ndarray:
    return np.sqrt(n.astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMS)
    langs: list[str]  # of each centroid
    limit: list[float]  # cosine below which a text is rejected, of each centroid

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not self.langs:
            return langs, scores, rejected
        for first in range(0, len(texts), 256):
            part = [(i, c) for i, t in enumerate(texts[first : first + 256], first) if t and (c := counts(t)) is not None]
            if not part:
                continue
            near = _unit(_damped(np.stack([c for _, c in part])) * self.idf) @ self.centroids.T
            for (i, _), row in zip(part, near, strict=True):
                best = int(row.argmax())
                langs[i], scores[i], rejected[i] = self.langs[best], float(min(1.0, max(0.0, row[best]))), bool(row[best] < self.limit[best])
        return langs, scores, rejected


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each new seed is the vector furthest from the seeds so far."""
    seeds = [_unit(x.mean(axis=0))]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int((x @ np.stack(seeds).T).max(axis=1).argmin())])
    centres = np.stack(seeds)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, clusters: int = 4, reject: float = 0.005) -> Model:
    """Learn from docs: training rows only, and every language in them.

    Document frequencies are counted over all rows; centroids come from at most per_language rows a language, each language
    in one task. The driver gets the centroids.
    """
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.where(known).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("h"))

    def frequencies(batches):
        found: dict[str, np.ndarray] = {}  # of each language: documents, and those with an n-gram of each place
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (c := counts(t)) is not None:
                    own = found.setdefault(lang, np.zeros(DIMS + 1, np.int64))
                    own[0] += 1
                    own[1:] += c > 0
        for lang, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at - 1), pa.array(own[at])], names=["lang", "place", "n"])

    small_batches(docs.sparkSession)
    per = materialize(rows.select("t", "lang").mapInArrow(frequencies, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")), "frequencies")
    sizes = per.where("place = -1").select("lang", F.col("n").alias("size"))
    number, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not number:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], [])
    # the share of documents is that of the mean language, however large
    share = np.zeros(DIMS)
    for r in per.where("place >= 0").join(sizes, "lang").groupBy("place").agg((F.sum(F.col("n") / F.col("size")) / number).alias("share")).collect():  # at most DIMS rows
        share[r.place] = r.share
    idf = np.log((total + 1) / (share * total + 1)).astype(np.float32) + 0.1
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def centre(table: pa.Table) -> pa.Table:
        found = [c for t in table.column("t").to_pylist() if (c := counts(t)) is not None]
        if not found:
            return pa.table({"lang": pa.array([], pa.string()), "centre": pa.array([], pa.binary()), "low": pa.array([], pa.float64())})
        x = _unit(_damped(np.stack(found)) * shared.value)
        centres = _kmeans(x, clusters)
        near = x @ centres.T
        own = near.argmax(axis=1)
        limits = [float(np.quantile(near[own == j, j], reject)) if (own == j).any() else 0.0 for j in range(len(centres))]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(centres)), "centre": pa.array([c.astype("<f4").tobytes() for c in centres], pa.binary()), "low": pa.array(limits)})

    found = _sample(rows, per_language).groupBy("lang").applyInArrow(centre, "lang string, centre binary, low double").collect()
    found = sorted(found, key=lambda r: (r.lang, r.centre))
    centroids = np.stack([np.frombuffer(r.centre, "<f4") for r in found]) if found else np.zeros((0, DIMS), np.float32)
    return Model(idf, centroids, [r.lang for r in found], [r.low for r in found])


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """Of each language, the per_language rows that are least by hash.

    Rows far above that number by their hash are left out before they are sorted; a language whose rows are all so is taken
    whole, as only repeated rows can be.
    """
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    near = rows.join(F.broadcast(sizes), "lang").withColumn("near", share * F.col("size") < 4 * per_language)  # one row a language, as in the model
    held = near.groupBy("lang").agg(F.bool_or("near").alias("held"))
    some = near.join(F.broadcast(held), "lang").where("near or not held")
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "t"))
    first = some.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))).withColumn("no", number("lang", "salt")).where(F.col("no") <= per_language)
    return first.withColumn("no", number("lang")).where(F.col("no") <= per_language).select("lang", "t")


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid) and rejected; columns of those names are replaced."""
    names = ["lang_pred", "score", "rejected"]
    held, own = fresh("text", [*docs.columns, *names]), F.col(text_col).cast("string")
    rows = docs.withColumn(held, own).drop(*names)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *names])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, schema)
