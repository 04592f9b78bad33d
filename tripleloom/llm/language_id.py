"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (lengths 2 and 3 over
lower-cased letters, words set off by spaces), normalised to length 1. Each
language has several centroids, found by spherical k-means on a bounded sample
of its training texts (about ``SAMPLE`` distinct texts a language of up to
``SAMPLE_CHARS`` characters, chosen by the text's hash). Frequencies of n-grams
count all training texts, and every text is judged whole. The
language of the centroid with the largest cosine is predicted; a text farther
from it than nearly all of the language's training sample is marked rejected.

Nulls: a null text, or one without a letter, gets ``und`` and score 0. A null
doc_id counts as training; a null lang is never learned. Repeated rows are
separate documents. An empty table gives no rows; without any training text
all predictions are ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

DIMS = 1 << 13
#: Distinct training texts of a language that centroids are fitted on, about, and the length of the longest ones drawn.
SAMPLE = 400
SAMPLE_CHARS = 1 << 16
CENTROIDS = 3
#: Share of the sample that lies within the rejection distance.
ACCEPT = 0.995
#: Documents whose counts are held at a time: so many, and so many bytes unless one has more.
GROUP = 64
GROUP_BYTES = 1 << 22
#: Places of a text whose n-grams are counted at a time.
STEP = 1 << 20
UNKNOWN = "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed n-grams, one row for each text; whether it has a letter).

    Bytes of non-ASCII characters count as letters here; whether a text has a
    letter at all is asked of its characters.
    """
    forms = [b" ".join((t or b"").translate(_LETTERS).split()) for t in texts]
    has = np.array([any(c.isalpha() for c in _first_letters(f)) for f in forms], dtype=bool)
    data = np.frombuffer(b"".join(b" " + f + b" " for f in forms), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(f) + 2 for f in forms], dtype=np.int64)
    docs = np.repeat(np.arange(len(forms), dtype=np.int32), sizes)
    counts = np.zeros(len(forms) * DIMS, dtype=np.float32)
    for at in range(0, len(data), STEP):
        # Two places more than are counted, so that n-grams across the cut are whole.
        piece, doc = data[at : at + STEP + 2], docs[at : at + STEP + 2]
        code = piece
        for k in (1, 2):
            code = (code[:-1] << np.uint32(8)) | piece[k:]
            inside = (doc[: len(code)] == doc[k:])[:STEP]
            spread = (code[:STEP] * np.uint32(2654435761)) ^ np.uint32(k * 0x1E3779B9)
            cell = (spread >> np.uint32(19)).astype(np.int64) + doc[: len(spread)].astype(np.int64) * DIMS
            counts += np.bincount(cell[inside], minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(forms), DIMS), has


def _first_letters(form: bytes) -> str:
    """Enough of a text to find a letter: an ASCII letter if it has one, else all of it."""
    bare = form.translate(None, bytes(range(128, 256)) + b" ")
    return bare[:1].decode() or form.decode(errors="ignore")


def _groups(texts: pa.Array) -> Iterator[list[bytes | None]]:
    values = texts.cast(pa.large_binary())
    held: list[bytes | None] = []
    size = 0
    for value in values:
        text = value.as_py()
        if held and (len(held) == GROUP or size + len(text or b"") > GROUP_BYTES):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or b"")
    if held:
        yield held


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for texts in _groups(batch.column(0)):
            counts, _ = gram_counts(texts)
            total += (counts > 0).sum(axis=0)
            docs += len(texts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *some.tolist()], pa.int32()), pa.array([docs, *total[some].tolist()], pa.int64())], names=["dim", "n"]
    )


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (rows of zeros stay)."""
    rows = np.sqrt(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def spherical_centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of length 1; starts are spread out by farthest point."""
    picked = [0]
    near = rows @ rows[0]
    while len(picked) < min(k, len(rows)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[picked[-1]])
    centroids = rows[picked]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit_languages(train: DataFrame, sample: int = SAMPLE, seed: int = 11) -> dict:
    """Fit on ``train`` (text, lang, doc_id); lang and text are not null."""
    frequency = train.select(F.col("text").cast("string").alias("text")).mapInArrow(_document_frequency, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS)
    docs = 0
    for r in frequency:
        if r["dim"] < 0:
            docs = r["n"]
        else:
            seen[r["dim"]] = r["n"]
    idf = np.log((docs + 1) / (seen + 1)) + 1.0
    short = F.length("text") <= SAMPLE_CHARS
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("text"))).alias("n")).collect()}
    langs, centroids, limits, owner = sorted(sizes), [], [], []
    if langs:
        share = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(sample / max(v, 1)))]), F.col("lang"))
        drawn = train.filter(short & (unit_hash(F.col("text"), F.lit(seed)) < share)).select("lang", F.col("text").cast("string").alias("text"))
        picked = sorted(drawn.distinct().collect())
        for j, lang in enumerate(langs):
            texts = [r["text"].encode() for r in picked if r["lang"] == lang]
            if not texts:
                texts = [train.filter(F.col("lang") == lang).agg(F.min_by(F.col("text").cast("string"), F.struct(F.length("text"), "text"))).first()[0].encode()]
            rows = np.concatenate([weigh(gram_counts(texts[k : k + GROUP])[0], idf) for k in range(0, len(texts), GROUP)])
            found = spherical_centroids(rows, CENTROIDS)
            limits.append(float(np.quantile((rows @ found.T).max(axis=1), 1 - ACCEPT)))
            centroids.append(found)
            owner += [j] * len(found)
    return {
        "langs": langs, "idf": idf.astype(np.float32), "limits": np.array(limits), "owner": np.array(owner, dtype=np.int64),
        "centroids": np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIMS), np.float32),
    }


def _predict(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model["langs"], UNKNOWN], dtype=object)
        for batch in batches:
            pred, score, rejected = [], [], []
            for texts in _groups(batch.column(2)):
                counts, has = gram_counts(texts)
                if not len(model["owner"]):
                    has[:] = False
                    best, own = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                    far = ~has
                else:
                    cosine = weigh(counts, model["idf"]) @ model["centroids"].T
                    at = cosine.argmax(axis=1)
                    best, own = cosine[np.arange(len(at)), at], model["owner"][at]
                    far = ~has | (best < model["limits"][own])
                pred += langs[np.where(has, own, len(langs) - 1)].tolist()
                score.append(np.where(has, np.clip(best, 0, 1), 0.0).astype(np.float64))
                rejected.append(far)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), rejected for every document."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"), "lang")
    model = fit_languages(rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.drop("lang").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
