"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, crc_fold, ids_of, lower_ascii, pieces, row_of, words

BUCKETS = 1 << 14
CHUNK = 1 << 10
PENALTY = 8.0
#: A script is a candidate's where at least this share of the language's letters is in it.
LEAST_SHARE = 0.01
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
# Scripts by the lead byte of UTF-8 (Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, Indic and South-East Asian, Han and Kana, Hangul, the rest).
SCRIPTS = 9
_SCRIPT = np.full(256, 8, np.uint8)
_SCRIPT[:128] = 0
_SCRIPT[0xC2:0xCD] = 0
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD4:0xD8] = 3
_SCRIPT[0xD8:0xDC] = 4
_SCRIPT[0xE0:0xE2] = 5
_SCRIPT[0xE3:0xEA] = 6
_SCRIPT[0xEA:0xEE] = 7
WIDTH = BUCKETS + CHUNK  # the scripts' counts stand after the buckets


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word spans and, for every byte, the bucket of the three bytes around it; separators count as spaces."""
    low = lower_ascii(buf)
    letter = _LETTER[low]
    starts, ends, first = words(low, off, letter)
    clean = np.where(letter, low, 32).astype(np.uint32)
    before, after = np.empty_like(clean), np.empty_like(clean)
    before[1:], after[:-1] = clean[:-1], clean[1:]
    inner = off[:-1][off[:-1] < len(clean)]
    before[inner] = 32
    after[(off[1:] - 1)[off[1:] > 0]] = 32
    key = before * np.uint32(0x9E3779B1) ^ clean * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return starts, ends, first, (key >> np.uint32(18)).astype(np.int64), letter


class Model(NamedTuple):
    langs: list[str]
    score: np.ndarray  # log probability by bucket and language
    scripts: np.ndarray  # which languages are candidates in a script


def train(docs: DataFrame, stage: Stage) -> Model:
    """Counts byte trigrams and scripts of each language over all training documents.

    Every partition adds up its own counts; they meet by (language, chunk of
    buckets), so no task sees more than one row a partition.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                starts, ends, first, key, letter = _grams(buf, off)
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    mine = np.repeat(np.array([x == lang for x in langs]), np.diff(off)) & letter
                    acc = held.setdefault(lang, np.zeros(WIDTH))
                    acc[:BUCKETS] += np.bincount(key[mine], minlength=BUCKETS)
                    lead = buf[mine]
                    acc[BUCKETS : BUCKETS + SCRIPTS] += np.bincount(_SCRIPT[lead[(lead < 128) | (lead >= 192)]], minlength=SCRIPTS)
        for lang, acc in held.items():
            for c in range(WIDTH // CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c], pa.int32()), pa.array([acc[c * CHUNK : (c + 1) * CHUNK].tobytes()], pa.binary())], names=["lang", "chunk", "counts"])

    def add(key, table):
        total = np.zeros(CHUNK)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.float64)
        return pa.table({"lang": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, chunk int, counts binary"
    rows = docs.where(F.col("lang").isNotNull() & (crc_fold("doc_id") != 0)).select("lang", "text").mapInArrow(count, kind)
    sums = rows.groupBy("lang", "chunk").applyInArrow(add, kind).collect()
    langs = sorted({r.lang for r in sums})
    counts = np.zeros((WIDTH, len(langs)))
    for r in sums:
        counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK, langs.index(r.lang)] = np.frombuffer(r.counts, np.float64)
    grams, scripts = counts[:BUCKETS], counts[BUCKETS : BUCKETS + SCRIPTS]
    score = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, score, scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every word: summed scores less the penalty for each switch, per row, all rows side by side."""
    n_rows, n_lang = len(first) - 1, scores.shape[1]
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, size = first[:-1][order], length[order]
    label = np.zeros(len(scores), np.uint8 if n_lang <= 256 else np.int32)
    stays, best = np.zeros((len(scores), n_lang), bool), np.zeros(len(scores), label.dtype)
    state = np.zeros((n_rows, n_lang), np.float64)
    steps = int(size[0]) if n_rows else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # rows with more than t words
    for t in range(steps):
        a = active[t]
        at, now = begin[:a] + t, state[:a]
        if t:
            k = now.argmax(1)
            jump = now[np.arange(a), k] - penalty
            stay = now >= jump[:, None]
            stays[at], best[at] = stay, k
            now = np.where(stay, now, jump[:, None])
        state[:a] = now + scores[at]
    current = state.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        label[at] = current[:a]
        if t:
            current[:a] = np.where(stays[at, current[:a]], current[:a], best[at])
    return label


def word_scores(buf: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Spans of the words, first word of each row, and each word's score by language."""
    starts, ends, first, key, _ = _grams(buf, off)
    n_lang = len(model.langs)
    scores = np.empty((len(starts), n_lang), np.float32)
    total = np.zeros(len(buf) + 1)
    for i in range(n_lang):
        np.cumsum(model.score[:, i][key], out=total[1:])
        scores[:, i] = total[ends] - total[starts]
    if len(starts):
        lead = _SCRIPT[buf[starts]]
        out = ~model.scripts[lead]
        out[out.all(1)] = False  # no language is written so: all stay candidates
        scores[out] -= 50.0
    return starts, ends, first, scores


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, spans: array of (start, end, lang) in words.

    Words are runs of ASCII letters and non-ASCII characters. A word's candidates
    are the languages written in its script; the path of labels through a text
    pays `penalty` for every switch. lang_pred has the most bytes of words, score
    is its share of them; ties go to the first language by name. A text that is
    null or has no letter is ``und`` with score 0. Repeated rows are labelled each.
    """
    n_lang = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part, _, _ in pieces(whole, "text", 1 << 24)):
            got = [(part, *word_scores(buf, off, model)) for part, buf, off in pieces(batch, "text")] if n_lang else []
            n = batch.num_rows
            pred, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if got:
                sizes = np.concatenate([e - s for _, s, e, _, _ in got])
                shift = np.cumsum([0] + [len(s) for _, s, _, _, _ in got])
                first = np.concatenate([*(f[:-1] + k for (_, _, _, f, _), k in zip(got, shift[:-1], strict=True)), shift[-1:]])
                label = viterbi(np.concatenate([x for *_, x in got]), first, penalty)
                owner = row_of(first)
                mass = np.bincount(owner * n_lang + label, weights=sizes, minlength=n * n_lang).reshape(n, n_lang)
                whole = mass.sum(1)
                top = mass.argmax(1)
                texts = batch.column(1)
                for i in np.flatnonzero(whole > 0):
                    only_wide = mass[i].sum() and not (texts[int(i)].as_py() or "").isascii()
                    if only_wide and not any(c.isalpha() for c in texts[int(i)].as_py()):
                        continue
                    pred[i], score[i] = model.langs[top[i]], mass[i, top[i]] / whole[i]
                if with_spans:
                    cut = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1]))) if len(label) else np.zeros(0, int)
                    for a, b in zip(cut, np.append(cut[1:], len(label)), strict=True):
                        i = owner[a]
                        spans[i].append({"start": int(a - first[i]), "end": int(b - first[i]), "lang": model.langs[label[a]]})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs, Stage(spark, "language")))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
