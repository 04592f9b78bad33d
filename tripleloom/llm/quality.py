"""Quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains. Expectation
maximisation over the vote patterns of all documents estimates how often each
rule votes bad on good and on bad documents, and how common good documents
are; a document's posterior probability of being good replaces the demand that
every rule pass. A rule is never taken to be worse than chance and good
documents are at least half, so a document without a bad vote is always kept.

Nulls: a null or empty text has no words, so its base check fails. Repeated
rows count as often as they occur. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Text bytes handled at a time in a worker.
CHUNK = 2_000_000
ROUNDS = 60

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_NO_LETTER = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122) and c not in WHITE)
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_letter_words"]


def repeated_words(texts_words: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each text the words inside windows that it holds twice or more."""
    sizes = np.array([len(w) for w in texts_words], dtype=np.int64)
    flat = [w for words in texts_words for w in words]
    n = len(flat)
    out = np.zeros(len(sizes), dtype=np.int64)
    if n < window:
        return out.tolist()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = np.fromiter(map(hash, flat), dtype=np.int64, count=n).view(np.uint64)
    rolled = doc[: n - window + 1].astype(np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + key[k : n - window + 1 + k]
        rolled ^= rolled >> np.uint64(31)
    whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    rolled = rolled[whole]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    begin = np.zeros(n, dtype=bool)
    if same.any():
        member = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        # Equal hashes are confirmed by the words themselves.
        seen: dict[tuple, int] = {}
        for i in np.sort(whole[order[member]]).tolist():
            at = (int(doc[i]), *flat[i : i + window])
            if at in seen:
                begin[seen[at]] = begin[i] = True
            else:
                seen[at] = i
    hit = np.zeros(n, dtype=bool)
    at = np.flatnonzero(begin)
    for k in range(window):
        hit[at + k] = True
    np.add.at(out, doc[hit], 1)
    return out.tolist()


def _text_stats(text: str | None) -> tuple[list[bytes], list[int]]:
    """(words, counts in the order of _STATS without n_repeat_words)."""
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(data.count(c) for c in WHITE)
    symbols = sum(data.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    upper, lower = (len(data) - len(data.translate(None, x)) for x in (_UPPER, _LOWER))
    return words, [len(words), chars, symbols, dup, lines, upper, lower, data.count(b"!"), len(data.translate(None, _NO_LETTER).split())]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list[int]] = []
        part: list[list[bytes]] = []
        begin, size = 0, 0

        def close() -> None:
            for row, repeats in zip(rows[begin:], repeated_words(part)):
                row.insert(4, repeats)

        for text in batch.column(1):
            words, counts = _text_stats(text.as_py())
            part.append(words)
            rows.append(counts)
            size += counts[1]
            if size > CHUNK:
                close()
                begin, part, size = len(rows), [], 0
        close()
        values = np.array(rows, dtype=np.int64).reshape(-1, len(_STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(values[:, k]) for k in range(len(_STATS))]], names=["doc_id", *_STATS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of _STATS for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in _STATS))


def rule_votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def below(value: Column, good: float, bad: float) -> Column:
        return vote(value, value <= good, value > bad)

    length = F.col("word_chars") / n
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)).cast("double")
    return {
        "long_enough": vote(n, n >= 30, F.col("n_words") < 10),
        "word_length": vote(length, length.between(3.0, 9.0), ~length.between(2.0, 14.0)),
        "few_symbols": below(F.col("n_symbols") / n, 0.05, 0.3),
        "few_symbol_chars": below(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"), 0.01, 0.08),
        "few_dup_lines": below(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), 0.1, 0.4),
        "few_repeats": below(F.col("n_repeat_words") / n, 0.05, 0.2),
        "lower_case": below(F.col("n_upper") / letters, 0.3, 0.6),
        "few_bangs": below(F.col("n_bangs") / n, 0.1, 0.5),
        "letter_words": vote(n, F.col("n_letter_words") >= 0.9 * n, F.col("n_letter_words") < 0.7 * n),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, rules' rate of bad votes on good, and on bad documents).

    ``votes`` has a row for each distinct pattern and ``counts`` how many
    documents show it. Abstentions carry no weight.
    """
    bad, cast = votes < 0, votes != 0
    good = np.where(bad.any(axis=1), 0.2, 0.98)
    share = 0.9
    for _ in range(rounds):
        rates = []
        for weight, prior in ((counts * good, 0.02), (counts * (1 - good), 0.3)):
            seen = (weight[:, None] * cast).sum(axis=0)
            rates.append(((weight[:, None] * bad).sum(axis=0) + 10 * prior) / (seen + 10))
        on_good, on_bad = np.minimum(*rates), rates[1]
        share = max(0.5, (counts * good).sum() / max(counts.sum(), 1))
        good = posterior(votes, share, on_good, on_bad)
    return share, on_good, on_bad


def posterior(votes: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """Probability of being good for each vote pattern."""
    odds = np.full(len(votes), np.log(share) - np.log(max(1 - share, 1e-9)))
    odds += np.where(votes < 0, np.log(on_good / on_bad), 0).sum(axis=1)
    odds += np.where(votes > 0, np.log((1 - on_good) / (1 - on_bad)), 0).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, quality (posterior), kept for every document."""
    rules = rule_votes()
    pattern = sum(((v + 1) * 3**i for i, v in enumerate(rules.values())), F.lit(0))
    stats = materialize(text_statistics(docs).withColumn("pattern", pattern.cast("int")), "quality")
    # At most 3 ** 9 patterns, whatever the number of documents.
    found = stats.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in found], dtype=np.int64)
    votes = (codes[:, None] // 3 ** np.arange(len(rules))) % 3 - 1
    counts = np.array([r["n"] for r in found], dtype=np.float64)
    good = posterior(votes, *fit_votes(votes, counts)) if len(found) else np.empty(0)
    table = [x for c, g in zip(codes.tolist(), good.tolist()) for x in (F.lit(c), F.lit(g))]
    quality = F.element_at(F.create_map(*table), F.col("pattern").cast("long")) if table else F.lit(None).cast("double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("quality", quality)
    return judged.withColumn("kept", ~failed & (F.col("quality") >= 0.5))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    judged = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
