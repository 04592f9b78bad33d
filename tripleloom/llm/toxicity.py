"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A text is cut into words (runs of letters, ASCII letters in lower case) and
into overlapping windows of them. A word enters the network by word inputs (how
much the word itself speaks for toxic training texts) and character inputs (the
same for its hashed character n-grams, so unseen words of a known make are
recognised). Two gated recurrent layers read a window in both directions,
attention pools their states, and the window with the highest logit gives the
text's score after calibration. All windows are scored.

The network is fitted on a bounded sample of labelled rows: at most ``SAMPLE``
toxic and twice as many other texts, in the order of a hash and as long as they
hold ``SAMPLE_BYTES`` in all (twice that for the others), both kinds bounded on
their own before anything reaches the driver. Tables for the word and character
inputs are made crosswise while training, so that no text sees its own label.

Nulls: a null or empty text, or one without letters, is one empty window and
has a score like any other. A null doc_id counts as training; rows without a
label, or with a null one, teach nothing. Repeated rows are scored alike, and
teach once; rows of one doc_id with different texts teach on their own, and one
with both labels teaches both. Ties: a score of exactly 0.5 counts as toxic. A
very long text is read in full, window by window. An empty table gives no rows;
with fewer than 8 labelled texts, or labels of one kind only, every score is
the share of toxic labels (0 without any). Other columns are ignored, whatever
their names and types; the stage returns them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, numbered, texts_of, unit_hash

SAMPLE = 1_200
SAMPLE_BYTES = 12_000_000
WINDOW = 48
STRIDE = 36
HIDDEN = 8
INPUTS = 6
#: Cells of the hashed character n-grams, lengths 3 to 5 with word ends marked.
CELLS = 1 << 16
LENGTHS = (3, 4, 5)
#: A word or n-gram in fewer training texts says nothing.
LEAST = 3
#: Steps that the network is trained for at least.
STEPS = 240
#: Words of a text chunk, windows in a batch, and words whose inputs a worker remembers.
CHUNK = 1_000_000
BATCH = 2_048
#: Words whose character n-grams are hashed at a time.
PART = 10_000
MEMORY = 120_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def word_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all words' n-grams, word of each)."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    cells, of = [], []
    for n in LENGTHS:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : len(data) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        spread = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(n)
        cells.append((spread >> np.uint64(48)).astype(np.int64))
        of.append(owner[: len(code)][inside])
    if not cells:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(cells), np.concatenate(of)


class Inputs:
    """How much words and character n-grams speak for a toxic text, from labelled texts."""

    def __init__(self, texts: list[list[bytes]], toxic: np.ndarray):
        share = (toxic.sum() + 1) / (len(toxic) + 2)
        self.base = float(np.log(share / (1 - share)))
        seen: dict[bytes, list[int]] = {}
        cells, mark = np.zeros((CELLS, 2)), np.zeros(CELLS, dtype=bool)
        vocabulary = list({w for t in texts for w in t})
        places = {w: i for i, w in enumerate(vocabulary)}
        sizes, parts = [np.zeros(1, np.int64)], [np.empty(0, np.uint16)]
        for k in range(0, len(vocabulary), PART):
            some = vocabulary[k : k + PART]
            found, of = word_cells(some)
            parts.append(found[np.argsort(of, kind="stable")].astype(np.uint16))  # CELLS fit
            sizes.append(np.bincount(of, minlength=len(some)))
        cell, edge = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
        for words, label in zip(texts, toxic.astype(int)):
            unique = set(words)
            for w in unique:
                seen.setdefault(w, [0, 0])[label] += 1
            if unique:
                mark[:] = False
                mark[np.concatenate([cell[edge[places[w]] : edge[places[w] + 1]] for w in unique])] = True
                cells[:, label] += mark
        total = np.array([(toxic == 0).sum(), (toxic == 1).sum()], dtype=float)
        often = [w for w, c in seen.items() if sum(c) >= LEAST]
        odds = self._odds(np.array([seen[w] for w in often], dtype=float).reshape(-1, 2), total)
        self.words = dict(zip(often, odds.tolist()))
        self.cells = np.where(cells.sum(axis=1) >= LEAST, self._odds(cells, total), 0.0).astype(np.float32)

    @staticmethod
    def _odds(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Half the log odds, drawn to 0 where few texts speak: by chance some words are in a few toxic ones only."""
        rate, seen = (counts + 0.5) / (total + 1.0), counts.sum(axis=1)
        odds = np.log(rate[:, 1] / rate[:, 0])
        sure = np.sign(odds) * np.maximum(0, np.abs(odds) - 1.5 / np.sqrt(seen + 0.5))
        return np.clip(sure * seen / (seen + 5.0), -4, 6) / 2

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Network inputs of some words."""
        out = np.zeros((len(words), INPUTS), dtype=np.float32)
        for k in range(0, len(words), PART):
            self._fill(out[k : k + PART], words[k : k + PART])
        return out

    def _fill(self, out: np.ndarray, words: list[bytes]) -> None:
        out[:, 0] = [self.words.get(w, 0.0) for w in words]
        out[:, 1] = [w in self.words for w in words]
        cell, of = word_cells(words)
        value = self.cells[cell]
        n = np.bincount(of, minlength=len(words))
        out[:, 2] = np.bincount(of, weights=value, minlength=len(words)) / np.maximum(n, 1)
        np.maximum.at(out[:, 3], of, value)
        out[:, 4] = np.bincount(of, weights=value > 1.0, minlength=len(words)) / np.maximum(n, 1)
        out[:, 5] = np.minimum(np.array([len(w) for w in words]) / 10, 2)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; a text has one at least."""
    count = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = place * STRIDE
    return text, begin, np.minimum(sizes[text] - begin, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1, out=x)
    return np.multiply(x, 0.5, out=x)


class Network:
    """Parameters and passes. States are kept as (HIDDEN, windows)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 0.5, (3 * h, INPUTS)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, 0.3, (3 * h, h)).astype(np.float32)
            self.p[f"c{side}"] = np.zeros((3 * h, 1), dtype=np.float32)
        self.p["att"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["bias"] = np.zeros(1, dtype=np.float32)

    def project(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' part of all gates, once for each distinct word."""
        return tuple(np.ascontiguousarray(rows @ self.p[f"w{s}"].T + self.p[f"c{s}"].T) for s in "fb")

    def forward(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ids (steps, windows) into ``gates``; mask is 1 on words."""
        h, steps, n = HIDDEN, *ids.shape
        states = np.zeros((steps, 2 * h, n), dtype=np.float32)
        kept = []
        for s, (side, at) in enumerate(zip("fb", gates)):
            u = self.p[f"u{side}"]
            now = np.zeros((h, n), dtype=np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                x = at[ids[t]].T
                g = u @ now
                zr = _sigmoid(x[: 2 * h] + g[: 2 * h])
                z, r = zr[:h], zr[h:]
                c = np.tanh(x[2 * h :] + r * g[2 * h :])
                new = c + z * (now - c)
                new *= mask[t]
                if keep:
                    kept.append((side, t, now, z, r, c, g[2 * h :]))
                states[t, s * h : (s + 1) * h] = new
                now = new
        score = np.einsum("d,tdn->tn", self.p["att"], states)
        score = np.where(mask > 0, score, -30.0)
        alpha = np.exp(score - score.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tdn->dn", alpha, states)
        logit = self.p["out"] @ pooled + self.p["bias"][0]
        return (logit, states, alpha, pooled, kept) if keep else logit

    def gradients(self, rows: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by backpropagation through time."""
        h = HIDDEN
        logit, states, alpha, pooled, kept = self.forward(self.project(rows), ids, mask, keep=True)
        d_logit = (1 / (1 + np.exp(-logit)) - label) / len(label)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"][0] = pooled @ d_logit, d_logit.sum()
        d_pooled = self.p["out"][:, None] * d_logit
        along = np.einsum("dn,tdn->tn", d_pooled, states)
        d_score = alpha * (along - (alpha * along).sum(axis=0)) * (mask > 0)
        grad["att"] = np.einsum("tn,tdn->d", d_score, states)
        d_states = alpha[:, None, :] * d_pooled + d_score[:, None, :] * self.p["att"][None, :, None]
        carry = {s: np.zeros_like(pooled[:h]) for s in "fb"}
        for side, t, before, z, r, c, g in reversed(kept):
            half = slice(0, h) if side == "f" else slice(h, 2 * h)
            d = (d_states[t, half] + carry[side]) * mask[t]
            d_c = d * (1 - z) * (1 - c * c)
            d_gates = np.concatenate([d * (before - c) * z * (1 - z), d_c * g * r * (1 - r), d_c])
            d_hidden = d_gates.copy()
            d_hidden[2 * h :] *= r
            grad[f"u{side}"] += d_hidden @ before.T
            grad[f"w{side}"] += d_gates @ rows[ids[t]]
            grad[f"c{side}"] += d_gates.sum(axis=1, keepdims=True)
            carry[side] = d * z + self.p[f"u{side}"].T @ d_hidden
        return grad

    def train(self, rows: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int = 6, size: int = 256, rate: float = 0.02) -> None:
        """Adam over shuffled batches; ids and mask are (windows, steps).

        Few windows make smaller batches and more epochs, as the network needs
        some ``STEPS`` steps whatever the size of its sample.
        """
        rng = np.random.default_rng(1)
        size = min(size, max(16, len(label) // 8))
        epochs = max(epochs, -(-STEPS * size // max(1, len(label))))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for k in range(0, len(order), size):
                some = order[k : k + size]
                used, at = np.unique(ids[some], return_inverse=True)
                grad = self.gradients(rows[used], at.reshape(ids[some].shape).T, mask[some].T, label[some])
                step += 1
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    self.p[name] -= (rate / (1 + 1.5 * epoch / epochs) * change).astype(np.float32)


def _window_matrix(texts: list[list[bytes]], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, ids, mask) of all windows of some texts; the id past the last word pads."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.fromiter(chain((place[w] for t in texts for w in t), [len(place)]), dtype=np.int32)
    text, begin, length = windows_of(sizes)
    start = (np.cumsum(sizes) - sizes)[text] + begin
    step = np.arange(WINDOW)
    mask = step < length[:, None]
    at = np.where(mask, start[:, None] + step, len(flat) - 1)
    return text, flat[at], mask.astype(np.float32)


class Model:
    """Inputs, network and calibration."""

    def __init__(self, texts: list[list[bytes]], toxic: np.ndarray):
        self.constant = None
        if len(toxic) < 8 or toxic.min() == toxic.max():
            self.constant = float(toxic.mean()) if len(toxic) else 0.0
            return
        half = np.arange(len(texts)) % 2
        place = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        pad = np.zeros((1, INPUTS), dtype=np.float32)
        sets, tops = [], []
        for side in (0, 1):
            other = Inputs([t for t, s in zip(texts, half) if s != side], toxic[half != side])
            mine = [t for t, s in zip(texts, half) if s == side]
            label = toxic[half == side]
            rows = np.concatenate([other.rows(list(place)), pad])
            text, ids, mask = _window_matrix(mine, place)
            loud = rows[:, [0, 3]].max(axis=1)[ids].max(axis=1) if len(ids) else np.zeros(0)
            # A toxic text is taught by its loudest window; others by their loudest and one more.
            order = np.lexsort((-loud, text))
            lead = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            rest = np.setdiff1d(np.flatnonzero(label[text] == 0), lead)
            more = np.random.default_rng(side).permutation(rest)[: len(lead)]
            use = np.concatenate([lead, more])
            sets.append((rows, ids[use], mask[use], label[text[use]].astype(np.float32)))
            tops.append((rows, text, ids, mask, label))
        shift = len(sets[0][0])
        rows = np.concatenate([sets[0][0], sets[1][0]])
        ids = np.concatenate([sets[0][1], sets[1][1] + shift])
        self.network = Network()
        self.network.train(rows, ids, np.concatenate([s[2] for s in sets]), np.concatenate([s[3] for s in sets]))
        logits, labels = [], []
        for rows, text, ids, mask, label in tops:
            gates = self.network.project(rows)  # once for all windows
            found = np.concatenate([self.network.forward(gates, ids[k : k + BATCH].T, mask[k : k + BATCH].T) for k in range(0, len(ids), BATCH)])
            top = np.full(len(label), -np.inf)
            np.maximum.at(top, text, found)
            logits.append(top)
            labels.append(label)
        self.scale, self.shift = _calibrate(np.concatenate(logits), np.concatenate(labels))
        self.inputs = Inputs(texts, toxic)

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -60, 60)))


def _calibrate(logit: np.ndarray, label: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Logistic regression of labels on the texts' highest window logits."""
    mid, wide = logit.mean(), logit.std() + 1e-6
    x = (logit - mid) / wide
    a, b = 1.0, 0.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(a * x + b))) - label
        a -= 1.0 * ((miss * x).mean() + 1e-3 * a)
        b -= 1.0 * miss.mean()
    return a / wide, b - a * mid / wide


class Scorer:
    """Scores texts in a worker and remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        """Word 0 pads. Room for gates doubles as words come."""
        self.place: dict[bytes, int] = {b"": 0}
        if self.model.constant is None:
            self.gates = list(self.model.network.project(np.zeros((1, INPUTS), dtype=np.float32)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        model = self.model
        if model.constant is not None:
            return np.full(len(texts), model.constant)
        said = [words_of(t) for t in texts]
        if len(self.place) > MEMORY:
            self.forget()
        place = self.place
        known = len(place)
        flat = np.fromiter((place.setdefault(w, len(place)) for t in said for w in t), dtype=np.int32)
        if len(place) > known:
            new = list(place)[known:]
            for k, added in enumerate(model.network.project(model.inputs.rows(new))):
                if len(self.gates[k]) < len(place):
                    self.gates[k] = np.resize(self.gates[k], (2 * len(place), 3 * HIDDEN))
                self.gates[k][known : len(place)] = added
        flat = np.append(flat, np.int32(0))
        sizes = np.array([len(t) for t in said], dtype=np.int64)
        text, begin, length = windows_of(sizes)
        start = (np.cumsum(sizes) - sizes)[text] + begin
        step = np.arange(WINDOW)[:, None]
        top = np.full(len(texts), -np.inf)
        for k in range(0, len(text), BATCH):
            some = slice(k, k + BATCH)
            mask = step < length[some]
            ids = flat[np.where(mask, start[some] + step, len(flat) - 1)]
            np.maximum.at(top, text[some], model.network.forward(self.gates, ids, mask.astype(np.float32)))
        return model.probability(top)


_SCORERS: dict[str, Scorer] = {}


def _run(shared, name: str) -> Callable:
    """Worker function: the text, the last column, becomes its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for batch in batches:
            found, part, size = [np.empty(0)], [], 0
            for text in batch.columns[-1].cast(pa.large_binary()):
                part.append(text.as_py())
                size += len(part[-1] or b"")
                if size > CHUNK:
                    found.append(scorer.scores(part))
                    part, size = [], 0
            if part:
                found.append(scorer.scores(part))
            values = pa.array(np.concatenate(found), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], "score"])

    return run


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 13) -> Model:
    """Fit on labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = known.filter(~is_held_out(F.col("doc_id"))).dropDuplicates(["doc_id", "toxic"])
    most = {1: sample, 0: 2 * sample}
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = unit_hash(F.col("doc_id"), F.lit(seed))
    # The hash thins out both kinds to a little more than asked, then the smallest hashes are taken.
    picked = [known.filter((F.col("toxic") == kind) & (u < 1.2 * n / max(1, sizes.get(kind, 0)))).orderBy(u, "doc_id").limit(n) for kind, n in most.items()]
    picked = materialize(picked[0].unionByName(picked[1]), "toxic-labels")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~is_held_out(F.col("doc_id")))
    # The labels are 3 * sample rows at most, so they go to the texts and no text is shuffled.
    taught = texts.join(F.broadcast(picked), "doc_id").withColumns({"h": unit_hash(F.col("doc_id"), F.col("text"), F.lit(seed)), "size": F.coalesce(F.octet_length("text"), F.lit(0))})
    taught = materialize(taught, "toxic-sample")
    # Where doc_ids repeat there may be any number of texts: their hashes alone are ordered and bounded, in rows and in bytes.
    kinds = []
    for kind, n in most.items():
        kept = taught.filter(F.col("toxic") == kind).select("toxic", "h", "size").distinct().orderBy("h", "size").limit(n)
        until = F.sum("size").over(Window.orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0))
        kinds.append(kept.withColumn("until", until).filter(F.col("until") <= sample_bytes * (2 - kind)).select("toxic", "h", "size"))
    chosen = materialize(kinds[0].unionByName(kinds[1]), "toxic-chosen")
    rows = taught.join(F.broadcast(chosen), ["toxic", "h", "size"]).groupBy("h", "toxic", "size").agg(F.first("text").alias("text"))
    rows = rows.orderBy("h", "toxic", "size").select("text", "toxic").toArrow()
    seen: dict[bytes, bytes] = {}  # equal words are one object
    texts = [[seen.setdefault(w, w) for w in words_of((t.as_py() or "").encode())] for t in rows["text"]]
    return Model(texts, rows["toxic"].to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_run(shared, uuid.uuid4().hex), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score_toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    rows = numbered(docs, "toxic-rows")
    shared = spark.sparkContext.broadcast(fit_toxicity(texts_of(rows, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    texts = rows.select("row_id", F.col("doc.text").cast("string").alias("text"))
    scored = texts.mapInArrow(_run(shared, uuid.uuid4().hex), "row_id long, score double")
    bad = materialize(scored.filter("score >= 0.5").select("row_id"), "toxic")
    shared.unpersist()
    return rows.join(bad, "row_id", "left_anti").select("doc.*")
