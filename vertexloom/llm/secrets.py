"""Secret scans: candidate spans of every text, judged by corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

# The patterns, their least lengths and their order.
KINDS = ("assign", "access", "hex", "provider", "jwt", "pem")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PROVIDER = re.compile(r"(?:gh[pousr]_|sk-|xox[abprs]-|glpat-)[A-Za-z0-9_-]{20,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
BASE = KINDS[:3]


def find_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of all candidates, sorted; code points, end exclusive."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if "_" in text or "-" in text:
        found += [(m.start(), 3, m.end(), m[0]) for m in PROVIDER.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end(), m[0]) for m in JWT.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), 5, m.end(), m[0]) for m in PEM.finditer(text)]
    found.sort()
    return found


def looks_random(value: str) -> bool:
    """Entropy of 3 bits a character and at least two kinds of characters, as generated credentials have."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
    return entropy >= 3.0 and kinds == 2


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("random", pa.bool_())])
_SCHEMA = "doc_id long, repo string, owner string, _text string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:long,random:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = [find_spans(t) for t in part.column(3).to_pylist()]
            base = [[x for x in r if x[1] < 3] for r in rows]
            found = [[{"start": s, "kind": k, "end": e, "hash": int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), "random": looks_random(v)} for s, k, e, v in r] for r in rows]
            counts = [pa.array([sum(x[1] == k for x in r) for r in base], pa.int64()) for k in range(3)]
            sha = [hashlib.sha256(_joined(r).encode()).hexdigest() for r in base]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), *counts, pa.array(sha), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "repo", "owner", "_text", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """Candidate secrets of every document with a verdict from the whole corpus.

    doc_id, n_assign, n_access, n_hex, base_sha256, found: array of (start, kind,
    end, hash, random, verdict). A candidate's value is hashed and counted by
    distinct repositories and distinct owners over the corpus. `copied`: more than
    `max_owners` owners have it, as examples and fixtures do. `live`: few owners,
    and it looks generated. `weak`: the rest. The corpus has no repository column;
    by default a document stands for one and its source for the owner.

    Null and empty texts have no spans. Null owners count as one owner, null
    repositories as one repository. Rows with null or repeated ids are scanned
    each and keep verdicts of their own. Other columns are ignored; an empty table
    gives no rows.
    """
    return _verdicts(docs, repo, owner, max_owners).drop("_text")


def _verdicts(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """The columns of `scan`, and _text: the md5 of the text."""
    stage = Stage(docs.sparkSession, "secrets")
    owned = F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner")
    rows = docs.select(F.col("doc_id").cast("long"), F.col(repo).cast("string").alias("repo"), owned, "text", F.md5(F.col("text").cast("binary")).alias("_text")).mapInArrow(_scan, _SCHEMA)
    rows = stage.write(rows.withColumn("_row", F.monotonically_increasing_id()), "scan")
    cand = rows.select("repo", "owner", F.explode("found").alias("f")).select("repo", "owner", F.col("f.hash").alias("hash"), F.col("f.random").alias("random"))
    by_owner = cand.groupBy("hash", "random", "owner").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("hash", "random").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))
    repos = cand.groupBy("hash", "repo").agg(F.lit(1).alias("_one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    verdict = owners.join(repos, "hash").select("hash", "n_owners", "n_repos", F.when(F.col("n_owners") > max_owners, "copied").when(F.col("random"), "live").otherwise("weak").alias("verdict"))
    verdict = stage.write(verdict, "verdicts")  # so that the join can split a value with many rows
    held = rows.select("_row", F.explode("found").alias("f")).select("_row", F.col("f.hash").alias("hash")).join(verdict, "hash")
    per = held.groupBy("_row").agg(F.collect_set(F.struct("hash", "verdict")).alias("verdicts"))
    out = rows.join(per, "_row", "left").withColumn("verdicts", F.map_from_entries(F.coalesce("verdicts", F.expr("array()").cast("array<struct<hash:bigint,verdict:string>>"))))
    return out.select("doc_id", "_text", "n_assign", "n_access", "n_hex", "base_sha256", F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"), f["hash"].alias("hash"), F.element_at("verdicts", f["hash"]).alias("verdict"))).alias("found"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("found", lambda f: (f["kind"] < 3) | (f["verdict"] == "live"))
    text = F.transform(kept, lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string")))
    count = lambda v: F.size(F.filter("found", lambda f: f["verdict"] == v)).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", text).alias("spans"), count("live").alias("n_live"), count("copied").alias("n_copied"))


def _redact(found: list[dict] | None, text: str) -> str:
    """Live spans that overlap are hidden together, so no end of one stays in clear."""
    out, at = [], 0
    for f in found or []:
        if f["verdict"] == "live":
            if f["start"] >= at:
                out += [text[at : f["start"]], "<SECRET>"]
            at = max(at, f["end"])
    return "".join([*out, text[at:]])


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans are the last column; the others keep their names and places."""
    for batch in batches:
        names = batch.schema.names[:-1]
        found, cols = batch.column(len(names)), [batch.column(i) for i in range(len(names))]
        hit = [i for i, n in enumerate(found.value_lengths().to_pylist()) if n]
        if hit:
            at = names.index("text")
            new = cols[at].to_pylist()
            for i in hit:
                new[i] = _redact(found[i].as_py(), new[i] or "")
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                sizes = cols[at].to_pylist()
                for i in hit:
                    sizes[i] = len(new[i])
                cols[at] = pa.array(sizes, cols[at].type)
        yield pa.RecordBatch.from_arrays(cols, names=names)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each live secret's span replaced by ``<SECRET>``; all rows and columns stay.

    n_chars, where there is one, follows the text. Spans come back to the texts they
    were found in, by the md5 of the text, so rows with null or repeated ids lose
    their own secrets and nothing else. Null and empty texts are unchanged. Columns
    of any name may be there; an empty table gives no rows.
    """
    live = _verdicts(docs).select("_text", F.filter("found", lambda f: f["verdict"] == "live").alias("_found"))
    live = live.where("size(_found) > 0").groupBy("_text").agg(F.first("_found").alias("_found"))
    live = Stage(docs.sparkSession, "redact").write(live, "live").select(F.col("_text").alias("_l"), F.col("_found").alias("_f"))
    left = docs.select(F.struct(*docs.columns).alias("_d"), F.md5(F.col("text").cast("binary")).alias("_t"))
    joined = left.join(live.hint("shuffle_hash"), F.col("_t") == F.col("_l"), "left")
    spans = "_" * (1 + max(map(len, docs.columns)))  # a name that no column of the documents has
    return joined.select(*[F.col("_d").getField(c).alias(c) for c in docs.columns], F.col("_f").alias(spans)).mapInArrow(_redact_batches, docs.schema)
