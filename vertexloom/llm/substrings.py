"""Substring deduplication by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, identified, named, repeated_windows
from .common import Stage, pieces, word_hashes, words

WINDOW = 20
GRAM = 6


class SuffixAutomaton:
    """A suffix automaton of many token sequences, grown one sequence at a time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def matching_statistics(self, tokens: list[int]) -> list[int]:
        """For each position, the length of the longest match with any earlier sequence that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for t in tokens:
            to = nxt[state].get(t)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(t)
            if to is not None:
                state = to
                size += 1
            out.append(size)
        return out

    def add(self, tokens: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for t in tokens:
            held = nxt[last].get(t)
            if held is not None:
                if length[held] == length[last] + 1:
                    last = held
                    continue
                last = self._split(last, held, t)
                continue
            state = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and t not in nxt[p]:
                nxt[p][t] = state
                p = link[p]
            if p >= 0:
                q = nxt[p][t]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, q, t)
            last = state

    def _split(self, p: int, q: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = clone
            p = link[p]
        return clone


def automaton_matches(payloads: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams each sequence of words through the automaton of those before it, then adds it.

    Returns maximal runs of windows that occur in an earlier sequence: (sequence,
    first window, last window).
    """
    automaton, code = SuffixAutomaton(), {}
    which, first, last = [], [], []
    for k, raw in enumerate(payloads):
        tokens = [code.setdefault(w, len(code)) for w in raw.split()]
        stats = automaton.matching_statistics(tokens)
        run = None
        for i in range(window - 1, len(stats)):
            if stats[i] >= window:
                if run is None:
                    run = i
            elif run is not None:
                which.append(k), first.append(run - window + 1), last.append(i - window)
                run = None
        if run is not None:
            which.append(k), first.append(run - window + 1), last.append(len(stats) - window)
        automaton.add(tokens)
    return np.array(which, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def word_symbols(buf: np.ndarray, off: np.ndarray):
    starts, ends, first = words(buf, off)
    return (word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first, starts, ends


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the words that repeated windows cover.

    A word goes if a window of `window` words of its document, with the same word
    sequence, also starts earlier: in a smaller doc_id, or earlier in the same.
    kept has the other words joined by one space.

    A reference as large as the corpus is not broadcast: its shards are dealt out
    by anchor together with the passages that can match them (see `anchors`).
    Null and empty texts have no words. A null doc_id counts as the smallest. Rows
    that repeat a doc_id and text share all places, so neither is earlier. Other
    columns are ignored; an empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "substrings")
    rows = identified(docs)
    gone = repeated_windows(rows, word_symbols, automaton_matches, window, gram, stage)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                starts, ends, first = words(buf, off)
                cover = covered(part, first, window)
                total = np.concatenate([[0], np.cumsum(cover)])
                raw, kept = buf.tobytes(), []
                for i in range(part.num_rows):
                    a, b = first[i], first[i + 1]
                    if total[a] == total[b]:
                        kept.append(b" ".join(raw[off[i] : off[i + 1]].split()))
                    else:
                        kept.append(b" ".join([raw[starts[k] : ends[k]] for k in (a + np.flatnonzero(~cover[a:b])).tolist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = rows.join(gone.hint("shuffle_hash"), "_id", "left").select("_id", "text", "spans").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", named("doc_id"))


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Every window, numbered within its word sequence.
OP2_SQL = r"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w)),
rep as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
pos as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from w),
flag as (
  select p.doc_id, p.i, word,
    coalesce(max(r.i) over (partition by p.doc_id order by p.i rows between 19 preceding and current row), 0) > 0 as gone
  from pos p left join rep r on p.doc_id = r.doc_id and p.i = r.i),
kept as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as t
  from flag group by 1)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""

__all__ = ["SuffixAutomaton", "automaton_matches", "drop_repeats", "op2_substrings"]
