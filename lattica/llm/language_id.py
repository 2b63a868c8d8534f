"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its hashed character n-grams (1 to 3 signs of the case-folded letters,
with a blank for whatever stands between words), scaled to length 1. Each language has a few centroids, found by spherical
k-means over the vectors of its training texts. The closest centroid by cosine gives the language. Short texts lie farther
from all centroids than long ones do, so how far is too far is learnt for each language and class of length, from pieces of the
training texts: a text is rejected where its cosine is below MARGIN times the least that a piece had. A text without letters always is.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices_as_they_are, stage, text_slices
from .words import mix

UNKNOWN = "und"
#: Hashed n-gram dimensions.
DIMENSIONS = 1 << 13
#: Training texts of a language at most, those of least hash; whole texts are used.
TRAINING_TEXTS = 400
CENTROIDS = 4
#: Classes of length are powers of two of signs, from the first to the last; shorter texts are never rejected.
FIRST_CLASS, LAST_CLASS = 3, 14
#: Of the least cosine of a training piece: what a text of its class must reach. A class of fewer pieces takes over the limit of the class before.
MARGIN, LEAST_PIECES = 0.8, 30
#: No limit is above this cosine: long texts of a few words are near enough to the language of those.
HIGHEST_LIMIT = 0.3


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x dimensions, float32, of length 1
    idf: np.ndarray
    limits: np.ndarray  # centroids x classes of length: the least cosine that isn't rejected


_ASCII = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else 32 for b in range(128)) + bytes([32] * 128)


def signs(text: str) -> np.ndarray:
    """The case-folded letters as code points, blanks between words and one at either end; empty without letters."""
    if text.isascii():
        kept = b" ".join(text.encode().translate(_ASCII).split())
        codes = np.frombuffer(kept, np.uint8).astype(np.uint32)
    else:
        low = text.lower()
        codes = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")
        distinct = np.unique(codes)
        other = [c for c in distinct.tolist() if not chr(c).isalpha()]
        blank = np.isin(codes, np.array(other, np.uint32)) if other else np.zeros(len(codes), bool)
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # the first sign of a run stands for it
        codes = np.where(blank, 32, codes)[keep]
        if len(codes) and codes[0] == 32:
            codes = codes[1:]
        if len(codes) and codes[-1] == 32:
            codes = codes[:-1]
    return np.concatenate([[32], codes, [32]]).astype(np.uint64) if len(codes) else np.zeros(0, np.uint64)


def ngram_counts(text: str, dimensions: int) -> np.ndarray:
    """How often each hashed n-gram of 1 to 3 signs occurs; all zero without letters."""
    return gram_counts(signs(text), dimensions)


def gram_counts(s: np.ndarray, dimensions: int) -> np.ndarray:
    if not len(s):
        return np.zeros(dimensions, np.float32)
    pair = s[:-1] << np.uint64(21) | s[1:]
    triple = pair[:-1] << np.uint64(21) | s[2:]
    out = np.zeros(dimensions, np.int64)
    for n, grams in enumerate((s[1:-1], pair, triple)):
        out += np.bincount((mix(grams + np.uint64(n << 62)) & np.uint64(dimensions - 1)).astype(np.int64), minlength=dimensions)
    return out.astype(np.float32)


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 (rows), with damped counts; a row of zeros stays."""
    x = np.log1p(counts) * idf
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def cluster(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Spherical k-means: at most k centroids of length 1."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):  # the farthest from those chosen
        far = (x @ x[chosen].T).max(1)
        if far.min() > 1 - 1e-6:
            break
        chosen.append(int(far.argmin()))
    centers = x[chosen]
    for _ in range(rounds):
        label = (x @ centers.T).argmax(1)
        sums = np.stack([x[label == c].sum(0) if (label == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


def length_class(n: int) -> int:
    """0 below FIRST_CLASS, which has no limit; then one for each power of two."""
    return max(0, min(n.bit_length() - 1, LAST_CLASS) - FIRST_CLASS + 1)


def pieces(s: np.ndarray) -> list[np.ndarray]:
    """Of a training text's signs: all of them, and for each class of length the first stretch and the one in the middle."""
    out = [s] * (len(s) > 0)
    for k in range(FIRST_CLASS, LAST_CLASS + 1):
        n = len(s) >> k
        out += [s[a << k : (a + 1) << k] for a in sorted({0, n // 2})] if n > 1 else []
    return out


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = TRAINING_TEXTS, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from rows with a text and a language: at most `most` texts of each language, those whose id hashes least.

    The texts become count vectors and each language's centroids on the executors; the driver gets the centroids, how
    many texts have each dimension, and the limits. Texts without letters teach nothing. No usable row gives a model that rejects everything.
    """
    lang, key = F.col(lang_col).cast("string"), F.col(id_col).cast("string")
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(lang.alias("lang"), key.alias("id"), F.xxhash64(key, F.lit(11)).alias("h"))
    # of a common language only hashes below a bound go on, some four times as many as are wanted, so ranks are few in any task
    found = labelled.groupBy("lang").count().collect()  # a row for each language
    top = (1 << 63) - 1
    bound = {r.lang: min(top, 2 * top * (4 * most + 100) // r["count"] - top) for r in found}
    nothing = Model([], np.zeros((0, dimensions), np.float32), np.ones(dimensions, np.float32), np.zeros((0, LAST_CLASS - FIRST_CLASS + 2)))
    if not bound:
        return nothing
    bounds = F.create_map(*[x for k, v in bound.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    order = Window.partitionBy("lang").orderBy("h", "id")
    sample = labelled.filter(F.col("h") <= bounds[F.col("lang")]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", "id")
    texts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang.alias("lang"), key.alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample.distinct()), ["lang", "id"], "left_semi")  # languages * most rows
    chosen = chosen.groupBy("lang", "id").agg(F.min("text").alias("text"))  # an id that rows repeat counts once

    def count(batches):
        for batch in text_slices(batches):
            blobs = [ngram_counts(t, dimensions).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("id"), batch.column("text"), pa.array(blobs, pa.binary())], ["lang", "id", "text", "counts"])

    counted = stage(chosen.select("lang", "id", "text").mapInArrow(count, "lang string, id string, text string, counts binary"), "language-counts")

    def occurring(batches):
        texts, seen = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                counts = np.frombuffer(blob, "<f4") > 0
                texts += bool(counts.any())
                seen += counts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimensions)), pa.array(np.append(texts, seen))], ["dimension", "n"])

    seen_in = {r.dimension: r.n for r in counted.select("counts").mapInArrow(occurring, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()}  # a row for each dimension
    n_texts = seen_in.pop(-1, 0)
    if not n_texts:
        return nothing
    idf = (np.log((1 + n_texts) / (1 + np.array([seen_in[k] for k in range(dimensions)]))) + 1).astype(np.float32)

    def centers(rows: pa.Table) -> pa.Table:  # `most` texts of a language
        rows = rows.sort_by([("id", "ascending"), ("counts", "ascending")])
        counts = np.stack([np.frombuffer(b, "<f4") for b in rows.column("counts").to_pylist()])
        counts = counts[counts.any(1)]
        blobs = [c.tobytes() for c in cluster(weights(counts, idf), centroids)] if len(counts) else []
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(blobs), pa.string()), "center": pa.array(blobs, pa.binary())})

    learnt = sorted((r.lang, bytes(r.center)) for r in counted.select("lang", "id", "counts").groupBy("lang").applyInArrow(centers, "lang string, center binary").collect())  # a few for each language
    languages, matrix = [lang for lang, _ in learnt], np.stack([np.frombuffer(c, "<f4") for _, c in learnt])

    def nearest(batches):
        for batch in text_slices(batches):
            names, classes, least = [], [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = pieces(signs(text))
                if parts:
                    cosines = weights(np.stack([gram_counts(p, dimensions) for p in parts]), idf) @ matrix[[x == name for x in languages]].T
                    names += [name] * len(parts)
                    classes += [length_class(len(p)) for p in parts]
                    least += cosines.max(1).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(classes, pa.int32()), pa.array(least, pa.float64())], ["lang", "class", "least"])

    found = counted.select("lang", "text").mapInArrow(nearest, "lang string, class int, least double").groupBy("lang", "class").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    least = {(r.lang, r["class"]): r.least for r in found.collect() if r.n >= LEAST_PIECES}  # a row for each language and class
    limits = np.zeros((len(languages), LAST_CLASS - FIRST_CLASS + 2))
    for i, name in enumerate(languages):
        for k in range(1, limits.shape[1]):
            limits[i, k] = min(HIGHEST_LIMIT, MARGIN * least[name, k]) if (name, k) in least else limits[i, k - 1]
    return Model(languages, matrix, idf, limits)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, rejecting: bool = True) -> DataFrame:
    """The columns of `keep`, then lang_pred and score (cosine with the closest centroid, 0 to 1; ties to the smaller name).

    lang_pred is "und" and score 0 for a null text and one without letters. Where `rejecting`, lang_pred is "und" as well if the score is
    below the model's limit for that language and length, so a text far from all languages is rejected; otherwise every text with
    letters has a learnt language. Every row is judged alone and whole. Columns of `keep` that are called lang_pred or score stay
    as they are, before the new ones.
    """
    keep = keep or []
    held = docs.sparkSession.sparkContext.broadcast(model)  # centroids * dimensions numbers
    dimensions = model.centroids.shape[1]
    at = keep.index(text_col) if text_col in keep else len(keep)
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(text_col).alias(f"k{at}")] * (at == len(keep)))

    def judge(batches):
        m = held.value
        names = [f"k{i}" for i in range(len(keep))]
        for batch in slices_as_they_are(batches, f"k{at}", rows=256):
            signs_ = [signs(t or "") for t in batch.column(f"k{at}").to_pylist()]
            cosines = weights(np.stack([gram_counts(s, dimensions) for s in signs_]), m.idf) @ m.centroids.T
            if not len(m.languages):
                cosines = np.zeros((len(signs_), 1), np.float32)
            best = cosines.argmax(1)
            letters = np.array([len(s) > 0 for s in signs_], bool)
            score = np.where(letters, np.clip(cosines.max(1), 0, 1).astype(np.float64), 0.0)
            known = letters & bool(len(m.languages))
            if rejecting and len(m.languages):
                known &= score >= m.limits[best, [length_class(len(s)) for s in signs_]]
            langs = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string", "score double"])
    return source.mapInArrow(judge, schema).toDF(*keep, "lang_pred", "score")
