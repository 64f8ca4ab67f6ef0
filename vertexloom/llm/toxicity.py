"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, ids_of, list_array, lower_ascii, pieces, prefix_hash, row_of, span_hash, words
from .linear import N_DENSE, averaged_descent, crc_fold, dense_features, feature_table, labelled, matrix, moments, scored, sigmoid, summed

#: Rows of labels read for mining voters, and the voters kept of each kind.
LABELLED_ROWS = 20_000
VOTERS = 160
LEAST_SUPPORT = 4
HITS = (1, 2, 3, 5)
# The seed lexicon.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "vermin", "filth", "hate", "kill"]
# The byte lengths of word beginnings that can become voters; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 10)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SALT = {k: np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1) for k in LENGTHS}


def word_patterns(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word's patterns: the word itself and its beginnings, lower case in A-Z."""
    low = lower_ascii(buf)
    starts, ends, first = words(low, off, _LETTER[low])
    if not len(starts):
        return
    rows, prefix = row_of(first), prefix_hash(low.astype(np.uint64) + np.uint64(1))
    for k in LENGTHS:
        if k == 0:
            yield rows, span_hash(prefix, starts, ends) ^ _SALT[0]
        else:
            long = ends - starts >= k
            yield rows[long], span_hash(prefix, starts[long], starts[long] + k) ^ _SALT[k]


def pattern_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(next(iter(word_patterns(raw, np.array([0, len(raw)]))))[1][0])


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pattern of a batch and each least number of hits: the labelled rows with so many, and those among them labelled 1."""
    for batch in batches:
        for part, buf, off in pieces(batch, "text", 1 << 20):
            y, found = ids_of(part, "y"), []
            for rows, h in word_patterns(buf, off):
                if not len(h):
                    continue
                order = np.lexsort((rows, h))
                h, rows = h[order], rows[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])))
                hits = np.diff(np.append(new, len(h)))
                found += [(h[new][hits >= t], rows[new][hits >= t], np.full((hits >= t).sum(), t)) for t in HITS]
            if not found:
                continue
            h, rows, least = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((least, h))
            h, rows, least = h[order], rows[order], least[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (least[1:] != least[:-1])))
            n = np.diff(np.append(new, len(h)))
            pos = np.add.reduceat(y[rows].astype(np.int64), new)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(least[new], pa.int32()), pa.array(n, pa.int64()), pa.array(pos)], names=["h", "least", "n", "pos"])


class Voters(NamedTuple):
    """Pattern voters: a voter fires on a text with at least `least` hits of its pattern; `hit1` and `hit0` are its first guesses of P(fires | label)."""

    pattern: np.ndarray
    least: np.ndarray
    hit1: np.ndarray
    hit0: np.ndarray
    prior: float


def mine_voters(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, voters: int = VOTERS) -> Voters:
    """The seed lexicon, then the word patterns that go with label 1 most clearly."""
    known = labelled(labels, "toxic", bound)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(crc_fold("doc_id") != 0)
    rows = text.join(F.broadcast(known), "doc_id").select("y", "text")  # at most `bound` ids
    base = known.agg(F.avg("y"), F.sum("y"), F.count("*")).first()
    rate, n_pos, n_all = float(base[0] or 0), float(base[1] or 0), float(base[2] or 0)
    chosen = {(pattern_of(w), 1): (0.05, 0.0005) for w in LEXICON}
    if 0 < rate < 1:
        counts = rows.mapInArrow(_mined, "h long, least int, n long, pos long").groupBy("h", "least").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        # a pattern is kept where even a pessimistic rate is well above the base rate
        sure = (F.col("pos") - F.sqrt(F.col("pos").cast("double"))) / (F.col("n") + 2)
        best = counts.where(F.col("pos") >= LEAST_SUPPORT).withColumn("sure", sure).where(F.col("sure") > max(0.35, 2 * rate))
        top = best.orderBy((F.col("pos") * F.log(F.col("sure") / rate)).desc(), "h", "least").limit(8 * voters).collect()
        seen = set()
        for r in top:
            key = (int(np.int64(r.h).view(np.uint64)), r.least)
            if (r.n, r.pos) in seen and key not in chosen or len(seen) == voters:  # beginnings of one word count the same rows
                continue
            seen.add((r.n, r.pos))
            chosen[key] = ((r.pos + 0.5) / (n_pos + 1), (r.n - r.pos + 0.05) / (n_all - n_pos + 1))
    keys, hits = list(chosen), np.array(list(chosen.values()))
    return Voters(np.array([k for k, _ in keys], np.uint64), np.array([t for _, t in keys]), hits[:, 0], hits[:, 1], rate if 0 < rate < 1 else 0.1)


def vote_kernel(voters: Voters):
    """(bytes, offsets) to [votes | shape features]; a vote is 0, or 1 where the voter fires."""
    ranked, which = np.unique(voters.pattern, return_inverse=True)
    m = len(ranked)
    maybe = np.zeros(1 << 16, bool)
    maybe[(ranked & np.uint64(0xFFFF)).astype(np.int64)] = True

    def kernel(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        votes = np.zeros((n, m), np.float32)
        for rows, h in word_patterns(buf, off):
            near = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(ranked, h[near]), m - 1)
            hit = ranked[at] == h[near]
            np.add.at(votes, (rows[near[hit]], at[hit]), 1)
        return np.hstack([(votes[:, which] >= voters.least).astype(np.float32), dense_features(buf, off)])

    return kernel


class LabelModel:
    """A latent label votes are noisy signs of: P(vote | label) for each voter, fitted by EM over all rows.

    Voters that fire together, among texts of label 1, more than by chance are correlated;
    their votes are discounted by the sum of their correlations, so a family of
    overlapping patterns counts about once.
    """

    def __init__(self, hit1: np.ndarray, hit0: np.ndarray, prior: float):
        self.prior, self.hit1, self.hit0, self.weight = prior, hit1, hit0, np.ones(len(hit1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.hit1 / self.hit0)
        out = np.log((1 - self.hit1) / (1 - self.hit0))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * on) + (1 - votes) @ (self.weight * out))

    def fit(self, table: DataFrame, rounds: int = 2) -> LabelModel:
        m = len(self.weight)
        for turn in range(rounds):
            at = self

            def kernel(batches, at=at, cross=turn == 0):
                acc = np.zeros(2 + 2 * m + m * m)
                for b in batches:
                    v = (matrix(b)[:, :m] > 0).astype(np.float64)
                    p = at.posterior(v)
                    acc[: 2 + 2 * m] += np.concatenate([[len(v), p.sum()], p @ v, v.sum(0)])
                    if cross:
                        acc[2 + 2 * m :] += (v.T @ (v * p[:, None])).ravel()
                return acc

            s = summed(table, kernel, 2 + 2 * m + m * m)
            n, pos, hits1, hits = max(s[0], 1), s[1], s[2 : 2 + m], s[2 + m : 2 + 2 * m]
            hit1 = np.clip((hits1 + 0.5) / (pos + 5), 1e-4, 0.95)
            nxt = LabelModel(hit1, np.clip((hits - hits1 + 0.05) / (n - pos + 5), 1e-6, 0.5), float(np.clip(pos / n, 0.005, 0.5)))
            nxt.weight = self.weight
            if turn == 0:
                both, rate = s[2 + 2 * m :].reshape(m, m) / max(pos, 1), hits1 / max(pos, 1)
                spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
                alike = (both - rate[:, None] * rate[None]) / (spread[:, None] * spread[None])
                np.fill_diagonal(alike, 0)
                nxt.weight = 1 / (1 + np.where(alike > 0.7, np.minimum(alike, 1), 0).sum(1))
            self = nxt
        return self


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, rounds: int = 5) -> DataFrame:
    """doc_id, held_out, score of every document.

    Voters are a seed lexicon and word patterns mined from at most `bound`
    training rows: at most VOTERS of them, those that go with label 1 most clearly
    (a family of patterns that count the same rows is one). A generative label model learns each voter's accuracy and the
    voters' correlations from the votes of all documents; a linear classifier over
    votes and shape features is fitted to its posteriors.

    Null and empty texts get a score from their (zero) features, repeated rows are
    scored each, an empty table gives no rows. Without labels the lexicon alone
    votes. Other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    voters = mine_voters(docs, labels, bound)
    m = len(voters.pattern)
    table = stage.write(feature_table(docs, vote_kernel(voters)), "features")
    d = m + N_DENSE
    mean, dev, n = moments(table, d)
    mean[:m], dev[:m] = 0, 1
    model = LabelModel(voters.hit1, voters.hit0, voters.prior).fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b) if b.num_rows else np.zeros((0, d), np.float32)
            p = model.posterior((x[:, :m] > 0).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(x.ravel(), np.arange(len(x) + 1) * d, pa.float32()), pa.array(p)], names=["doc_id", "fold", "x", "p"])

    fitted = table.mapInArrow(run, "doc_id long, fold int, x array<float>, p double")
    w = np.zeros(d + 1)
    w[-1] = -2.0

    def gradient(v, x, y, _):
        return (x * (sigmoid(x @ v) - y)[:, None]).mean(0) + 1e-5 * v

    w = averaged_descent(fitted, w, gradient, rounds, 0.2, mean, dev, "p")
    return scored(table, w, mean, dev)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
