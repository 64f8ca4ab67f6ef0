"""The operators on small tables: brute force, nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import uuid
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vertexloom.llm import queries
from vertexloom.llm.decontamination import allowed, leaks, without_leaks
from vertexloom.llm.langid import identify, train
from vertexloom.llm.common import Stage
from vertexloom.llm.linear import N_DENSE, averaged_descent, dense_features, feature_table
from vertexloom.llm.mixing import mix, mixed
from vertexloom.llm.ngram_join import near_duplicates
from vertexloom.llm.quality import drawn, quality_scores, without_low
from vertexloom.llm.secrets import KINDS, find_spans, looks_random, redact, scan
from vertexloom.llm.substrings import drop_repeats
from vertexloom.llm.suffixes import drop_repeated_bytes
from vertexloom.llm.topk import top_products
from vertexloom.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string, rank int, size int"
# The base kinds of secrets as the contract has them, with the group and least length that count.
PLAIN = [(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def corpus():
    """Copies, near copies, shared passages, blanks, nulls, a very long text and short ones."""
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(rng.choice(VOCAB, n))
    passage, base = say(45), say(120)
    rows = [say(int(n)) for n in rng.integers(1, 90, 25)]
    rows += [f"{say(30)} {passage} {say(20)}" for _ in range(6)]
    rows += [base] * 4 + [base.upper(), base.replace(" ", "  ")]
    for _ in range(5):
        w = base.split()
        for at in rng.choice(120, 3, replace=False):
            w[at] = "edited"
        rows.append(" ".join(w))
    rows += [None, "", " \n\t ", "one", "one", "one two three", "ONE two three", f"{say(3000)} {passage} {passage}", "éé — ñ " * 40]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s3", None][i % 4 if i % 7 else 0], len(t or ""), i, "x", 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), 1) for i in range(0, 40)], "doc_id long, quality int, toxic int, x int")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_ngram_join(docs, empty):
    assert by_id(near_duplicates(docs), "n_shingles", "component_id") == brute.components(corpus())
    assert by_id(near_duplicates(docs, 80, 5), "n_shingles", "component_id") == brute.components(corpus(), 5, 80)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("boundary", [1, 40, 10**6])
def test_ngram_join_by_either_branch(docs, boundary, monkeypatch):
    """All sets by scans, both branches, all by subsets; with shingles that count as common."""
    from vertexloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "COMMON", 6)
    monkeypatch.setattr(ngram_join, "YIELD", 50)
    assert by_id(near_duplicates(docs, boundary=boundary), "n_shingles", "component_id") == brute.components(corpus())
    assert by_id(near_duplicates(docs, 80, 5, boundary), "n_shingles", "component_id") == brute.components(corpus(), 5, 80)


@pytest.mark.parametrize("boundary", [1, 10**6])
def test_ngram_join_of_drifting_texts(spark, boundary):
    """Chains in which neighbours link and far texts do not, so that links to centres leave pairs to verify."""
    rng = np.random.default_rng(3)
    vocab, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(6):
        w = list(rng.choice(vocab, 160))
        for _ in range(30):
            rows.append(" ".join(w))
            w[int(rng.integers(160))] = rng.choice(vocab)
            if rng.random() < 0.5:
                w[int(rng.integers(160))] = rng.choice(vocab)
    rows = [(i, str(t)) for i, t in enumerate(rng.permutation(rows))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), boundary=boundary)
    assert by_id(got, "n_shingles", "component_id") == brute.components(rows)


def test_boundary_is_where_costs_are_least():
    from types import SimpleNamespace

    from vertexloom.llm.ngram_join import boundary_of

    light, heavy = SimpleNamespace(k=10, subsets=2, reach=2, shingles=10), SimpleNamespace(k=30, subsets=10**6, reach=100, shingles=1000)
    assert boundary_of([]) == 1 and boundary_of([heavy]) == 1 and boundary_of([], 7) == 7
    assert boundary_of([light, light, heavy]) == int(2 ** (11 / 4))


def test_null_ids_are_documents_of_their_own(spark):
    one, two = " ".join(VOCAB[:40]), " ".join(VOCAB[40:80])
    rows = spark.createDataFrame([(None, one), (None, two), (3, two), (4, "short")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(rows).collect()) == [(0, 0), (0, 0), (3, 0), (4, 4)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in drop_repeats(rows).collect()) == [(0, 0), (0, 0), (3, 40), (4, 0)]


def test_substrings(docs, empty):
    got = drop_repeats(docs)
    assert by_id(got.withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)), "n_words", "n_removed", "sha") == brute.substrings(corpus())
    assert drop_repeats(empty).count() == 0


@pytest.mark.parametrize("often", [1, 3, 10**6])
def test_hot_anchors_are_split(docs, often, monkeypatch):
    from vertexloom.llm import anchors

    monkeypatch.setattr(anchors.repeated_windows, "__defaults__", (2,))
    monkeypatch.setattr(anchors, "OFTEN", often)
    assert by_id(drop_repeats(docs), "n_words", "n_removed") == {i: r[:2] for i, r in brute.substrings(corpus()).items()}
    assert by_id(drop_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(corpus())


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_windows_of_hot_anchors_travel_by_their_hashes(spark, monkeypatch, held):
    """A line that is in all texts, between words of their own: its windows are not sent, nor put into an array, as strings."""
    from vertexloom.llm import anchors

    rng = np.random.default_rng(3)
    say = lambda n: "".join(chr(x) for x in rng.integers(97, 123, n))
    line = say(70)
    rows = [(i, say(150) + line + say(150)) for i in range(60)] + [(60 + i, line + say(60) + line) for i in range(9)] + [(70, say(400))]
    rows += [(71, rows[0][1][:280]), (72, rows[70 - 1][1]), (None, rows[3][1])]
    sent, write = [], Stage.write

    def noted(self, df, table):
        out = write(self, df, table)
        if table == "segments":
            sent.extend(out.where("payload is not null").select("k1", F.octet_length("payload")).collect())
        return out

    monkeypatch.setattr(Stage, "write", noted)
    monkeypatch.setattr(anchors.repeated_windows, "__defaults__", (2,))
    monkeypatch.setattr(anchors, "SINGLES", held, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(drop_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = brute.suffixes([(-1 if i is None else i, t) for i, t in rows])
    assert {-1 if i is None else i: r for i, r in got.items()} == expected
    packed = [size for k1, size in sent if k1 is None]
    assert sum(packed) // 32 > 1000 and not any(size % 32 for size in packed)
    assert sum(size for k1, size in sent if k1 is not None) < 10_000


def test_suffixes(docs, empty):
    assert by_id(drop_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(corpus())
    assert drop_repeated_bytes(empty).count() == 0


def test_repeated_rows_share_their_places(spark):
    text = " ".join(VOCAB[:40])
    rows = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in drop_repeats(rows).collect())
    assert got == [(False, 40), (False, 40), (True, 0)]
    assert near_duplicates(rows).where("component_id is null").count() == 3


def test_leaks(spark, docs, empty):
    texts = dict(corpus())
    item = " ".join(texts[0].split()[:12]) if len(texts[0].split()) >= 12 else texts[36][:80]
    passage = " ".join(texts[25].split()[30:55])
    near = passage.split()
    near[4] = "changed"
    bench = spark.createDataFrame([(1, passage), (2, " ".join(near)), (3, None), (4, ""), (5, "words that no text has at all in this corpus"), (6, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in leaks(docs, bench).collect()}
    holders = {i for i, t in texts.items() if passage in (t or "")}
    assert {d for d, i in found if i == 1} == holders and all(found[d, 1] == 0 for d in holders)
    assert {d for d, i in found if i == 2} == holders and all(found[d, 2] == 1 for d in holders)
    assert not {i for _, i in found} & {3, 4, 5}
    assert {r.doc_id for r in without_leaks(docs, bench).collect()} == set(texts) - {d for d, _ in found}
    assert leaks(empty, bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_secrets(spark):
    key, shared = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2", "sk-" + "z9Y8x7W6v5U4t3S2r1Q0p9O8"
    rows = [(1, f"x {key} y", "s1"), (2, f"{shared}", "s1"), (3, f"{shared}", "s2"), (4, f"{shared}", None), (5, None, "s1"), (6, "", "s9"), (7, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "s1"), (7, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = {(r.doc_id, f["kind"]): f["verdict"] for r in scan(docs).collect() for f in r.found}
    assert verdict[1, 3] == "live" and verdict[2, 3] == verdict[4, 3] == "copied" and verdict[7, 2] == "live"
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[1] == "x <SECRET> y" and clean[2] == shared and clean[5] is None and "f3ef" not in clean[7]
    assert redact(docs).count() == len(rows) and scan(docs.limit(0)).count() == 0


def test_mix(docs, empty):
    pieces, out = mix(docs)
    rows, texts = out.collect(), dict(corpus())
    assert len(rows) == len(texts) and all(r["size"] == len(brute.words(texts[r.doc_id])) for r in rows)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) <= 1 and t <= 3 * z for s, (t, z) in target.items())
    assert abs(sum(t for t, _ in target.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mix(docs)[1].collect()}
    used = pieces.groupBy("slot").agg(F.sum("words").alias("w"))
    assert used.where("w > 128").count() == 0
    assert mix(empty)[1].count() == 0


def test_language(spark, docs, empty):
    rows = [(i, "the cat and the dog went to the house" if i % 2 else "le chat et le chien vont a la maison", "en" if i % 2 else "fr") for i in range(200)]
    rows += [(900, None, "en"), (901, "123 — 456", "fr"), (902, "", None), (903, "the dog and the house " * 5 + "le chien et la maison " * 4, None)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(known, Stage(spark, "t"))
    got = {r.doc_id: r for r in identify(known, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "en" and [s["lang"] for s in got[903].spans] == ["en", "fr"]
    none = train(known.limit(0), Stage(spark, "t"))
    assert identify(known, none).where("lang_pred <> 'und'").count() == 0


def test_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows[7] = (7, rows[40][1])
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows] + [(500, None, "z"), (520, [1.0, None], "z"), (540, [float("nan")] * 6, "z"), (None, [1.0] * 6, "z")], "vec_id long, embedding array<double>, score string")
    want = [(q, n + 1, i, s) for q, found in brute.top(ints).items() for n, (i, s) in enumerate(found)]
    assert sorted(map(tuple, top_products(table).collect())) == sorted(want)
    assert top_products(table.limit(0)).count() == 0


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_classifiers_cover_every_row(docs, empty, labels, scores):
    got = scores(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert scores(docs, labels.limit(0)).count() == len(corpus())
    assert scores(empty, labels).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 > 0
        w = rng.choice(VOCAB, 60)
        rows.append((i, " ".join(w) if good else " ".join(f"{x}###" for x in w)))
        marks.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    out = quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert out.count() > 40 and out.where("(score >= 0.3) <> (quality = 1)").count() <= 2


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = list(rng.choice(VOCAB, 60))
        if bad:
            w[10], w[20] = "zorgulent", "moron"
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert out.where("(score >= 0.5) <> (toxic = 1)").count() <= 2


def duck(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"_{name}", table)
        con.execute(f"create view {name} as select * from _{name}")
    return con.execute(sql).fetchall()


def odd_rows(spark):
    """Null and repeated ids, sources and texts; a long text."""
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(rng.choice(VOCAB, n))
    rows = [(i, say(int(n)), f"s{i % 3}") for i, n in enumerate(rng.integers(0, 400, 60))]
    rows += [(None, say(50), "s1"), (None, say(70), "s1"), (None, None, "s1"), (None, say(30), None), (7, say(20), "s1"), (7, say(40), "s1"), (7, say(40), None), (8, None, "s2"), (9, "", None), (70, say(9000), "tiny"), (71, "one", "rare"), (71, "one", "rare")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_agrees_with_sql_on_odd_rows(spark, tmp_path):
    rows, docs = odd_rows(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op6_mixing"](spark, str(tmp_path))
    assert Counter(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot").collect())) == Counter(duck(queries.oracle_sql()["op6_mixing"], documents=docs.toArrow()))
    assert got.count() == len(rows) and got.where("taken > 3 * size").count() == 0
    assert Counter(r.taken for r in got.collect()) == Counter(r.taken for r in mix(docs)[1].collect())


def test_mix_levels(spark, monkeypatch):
    """Several levels of parts give the same order as one."""
    from vertexloom.llm import mixing

    _, docs = odd_rows(spark)
    want = Counter(map(tuple, mix(docs)[1].select("doc_id", "size", "taken", "first_slot").collect()))
    monkeypatch.setattr(mixing, "ROWS", 0.001)
    monkeypatch.setattr(mixing, "FAN", 4)
    assert Counter(map(tuple, mix(docs)[1].select("doc_id", "size", "taken", "first_slot").collect())) == want


def test_mixed_rows_and_clashing_columns(spark):
    rows, docs = odd_rows(spark)
    clash = docs.withColumns({"Taken": F.lit("x"), "target": F.lit(1), "_row": F.lit(2), "rank": F.lit(3), "_n": F.lit(4)})
    out = mixed(clash)
    assert out.columns == ["doc_id", "text", "source", "_row", "rank", "_n", "size", "target", "taken"]
    plan = [r for r in mix(docs)[1].collect() if r.taken]
    assert Counter((r.doc_id, r["size"], r.taken) for r in out.collect()) == Counter((r.doc_id, r["size"], r.taken) for r in plan)
    assert all(len(brute.words(r.text)) == r["size"] for r in out.collect())
    assert mixed(clash.limit(0)).count() == 0


def test_topk_of_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i % 45, [float(x) for x in rng.normal(size=5)]) for i in range(100)] + [(0, [1.0] * 5), (0, [1.0] * 5), (None, [1.0] * 5), (20, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.queries()["op8_topk"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(duck(queries.oracle_sql()["op8_topk"], embeddings=table.toArrow()))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_by_several_blocks_of_queries(spark, monkeypatch):
    from vertexloom.llm import topk

    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(200)], "vec_id long, embedding array<double>")
    want = Counter(map(tuple, top_products(table).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 120)
    assert Counter(map(tuple, top_products(table).collect())) == want


def test_redaction_follows_texts(spark):
    key = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2"
    rows = [(1, f"x {key} y", "s1", 5), (1, "nothing here at all to hide in this text", "s1", 6), (None, f"q {key}", "s1", 7), (None, None, "s1", 8), (3, "", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _found int").withColumns({"_text": F.lit("t"), "_t": F.lit("u"), "n_chars": F.length("text").cast("long")})
    out = {r["_found"]: r for r in redact(docs).collect()}
    assert [out[i].text for i in range(5, 10)] == ["x <SECRET> y", rows[1][1], "q <SECRET>", None, ""]
    long = "sk-a1B2c3D4e5F6g7H8i9J0eyJhbG7iOiJ3.k9Qz4Lw8Vb2X.Sf1Kxw5RJ3MeK8Tn6Pu0"  # a token begins within another and ends behind it
    one = spark.createDataFrame([(1, f"p {long} q", "s1")], "doc_id long, text string, source string")
    assert redact(one).first().text == "p <SECRET> q"
    assert out[5].n_chars == 12 and out[6].n_chars == len(rows[1][1]) and redact(docs).columns == docs.columns


def test_secrets_query_agrees_with_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    some = ["AKIA" + "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2", "token: " + "Zz9" * 6, "api_key='" + "abc" * 5 + "'", "password = short", "eyJ" + "hbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK"]
    rows = [(int(i) if i % 6 else None, " ".join(rng.choice([*VOCAB[:20], *some], 12)), f"s{rng.integers(4)}") for i in range(80)] + [(3, None, "s1"), (4, "", None), (500, "é " * 4000 + some[2], "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.withColumn("found", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    owners, want = {}, []
    for _, text, source in rows:
        for *_, value in find_spans(text):
            owners.setdefault(value, set()).add(source)
    for i, text, _ in rows:
        base = [(m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(PLAIN) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        extra = [(s, k, e) for s, k, e, v in find_spans(text) if k > 2 and len(owners[v]) <= 2 and looks_random(v)]
        joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
    got = queries.queries()["op4_secrets"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_leaks_query_agrees_with_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    say = lambda n: list(rng.choice(VOCAB, n))
    items = [say(n) for n in (3, 8, 12, 20, 30)]
    rows = []
    for k in range(60):
        item = list(items[k % 5])
        for _ in range(k % 4 * allowed(len(item)) // 3):
            at = int(rng.integers(len(item)))
            item[at : at + int(rng.integers(2))] = say(int(rng.integers(2)))
        rows.append((k if k % 9 else None, " ".join(say(15) + (item if k % 3 else []) + say(15)).upper()))
    rows += [(100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (None, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.item_id, r.edits) for r in queries.queries()["op3_decontamination"](spark, str(tmp_path)).collect())
    want = Counter()
    for i, text in rows:
        for k, item in enumerate(items):
            n = brute.best_stretch(item, (text or "").lower().split())
            if n <= allowed(len(item)):
                want[i, k, n] += 1
    assert not got - want and sum((want - got).values()) <= 0.05 * sum(want.values())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = without_leaks(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    holds = [any(brute.best_stretch(x, (t or "").lower().split()) <= allowed(len(x)) for x in items) for _, t in rows]
    assert clean.columns == docs.columns and not set(r.text for r in clean.collect()) & {t for (_, t), h in zip(rows, holds, strict=True) if h and t in found_texts(spark, docs, tmp_path)}
    assert {t for (_, t), h in zip(rows, holds, strict=True) if not h} <= {r.text for r in clean.collect()}


def found_texts(spark, docs, tmp_path):
    """Texts with ids that the query finds something in."""
    ids = {r.doc_id for r in queries.queries()["op3_decontamination"](spark, str(tmp_path)).collect()}
    return {r.text for r in docs.collect() if r.doc_id is not None and r.doc_id in ids}


def test_language_of_odd_rows(spark, empty, docs):
    rows = [(None, "the cat and the dog " * 3, "en"), (None, None, "fr"), (5, "le chien et le chat " * 3, "fr"), (5, "the cat and the dog " * 3, "en"), (6, "the dog " * 30_000, "en"), (7, "le chat " * 3, "fr"), (8, "the cat " * 3, "en")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "spans": F.lit(1)})
    got = identify(known, train(known, Stage(spark, "t")))
    assert Counter(r.lang_pred for r in got.collect()) == {"en": 4, "fr": 2, "und": 1}
    assert identify(empty, train(docs, Stage(spark, "t"))).count() == 0 and identify(docs, train(docs, Stage(spark, "t"))).count() == len(corpus())


def test_classifiers_of_odd_rows(spark, labels, tmp_path):
    rows = [(None, "fine words here"), (None, None), (5, "x " * 60_000), (5, "stupid idiot moron"), (5, "stupid idiot moron"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "x": F.lit(2), "y": F.lit(3), "fold": F.lit(4), "quality": F.lit(5), "toxic": F.lit(6)})
    for scores in (quality_scores, toxicity_scores):
        got = scores(docs, labels).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert without_low(docs, labels, 0.0).columns == docs.columns and without_low(docs, labels, 0.0).count() == 6
    assert without_low(docs.limit(0), labels, 0.3).count() == 0
    docs.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.queries()["op7_language"](spark, str(tmp_path)).where("held_out is null").count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path, labels):
    import corpus_pipeline

    _, docs = odd_rows(spark)
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "_id": F.lit(1), "_h": F.lit(2), "size": F.lit(3), "taken": F.lit(4), "score": F.lit(5)})
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words anywhere in all of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        if name in ("decontamination", "secrets"):
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
        if name == "near_duplicates":  # of equal rows one stays
            assert Counter(map(tuple, out.collect())) == Counter(set(map(tuple, docs.collect())))
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_registry():
    names = list(queries.queries())
    assert len(names) == 10 and sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path, docs, labels):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(corpus()[30][1].split()[30:55]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    kept = {i: t for i, t in corpus()}
    now = plain
    for name, step in corpus_pipeline.STAGES[1:]:
        now = step(spark, now, str(tmp_path))
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute.components(corpus(), 5, 80).items() if i == c}
            assert ids == want
        elif name == "decontamination":
            assert ids == {i for i in want if " ".join(corpus()[30][1].split()[30:55]) not in (kept[i] or "")}
        if name != "mixing":
            assert now.columns == plain.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(plain.columns) < set(out.columns) and out.where("taken > 3 * size or taken <= 0").count() == 0


def test_steps_draw_from_all_positives(spark, tmp_path):
    pos, seen = np.arange(9000), str(tmp_path)

    def gradient(v, x, _, rng):
        np.save(f"{seen}/{uuid.uuid4().hex}.npy", drawn(pos, 512, rng))
        return np.zeros_like(v)

    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('word ', id) as text")
    table = feature_table(docs, dense_features)
    averaged_descent(table, np.zeros(N_DENSE + 1), gradient, 1, 0.05, np.zeros(N_DENSE), np.ones(N_DENSE))
    draws = [np.load(f) for f in tmp_path.glob("*.npy")]
    assert len({d.tobytes() for d in draws}) == len(draws) > 100
    assert len(np.unique(np.concatenate(draws))) > 8900


def test_pipeline_agrees_with_brute_force(spark, tmp_path):
    """All rows of the pipeline: every stage by a plain version over what the one before has kept."""
    import corpus_pipeline

    rng = np.random.default_rng(31)
    key = ["ghp_" + "".join(rng.choice(list("abcdefXYZ0123456789"), 24)) for _ in range(4)]
    say = lambda n: " ".join(rng.choice(VOCAB, n))
    passage = say(25)
    texts = dict(corpus()) | {200 + i: f"{say(40)} {key[i % 4]} {say(60)}" for i in range(9)} | {300: f"{say(50)} {passage} {say(10)}", 301: f"{say(9)} {passage}"}
    texts |= {400 + i: "| # $ " * (90 + i) for i in range(6)}
    source = {i: f"s{i % 3}" for i in texts} | {200: "s0", 204: "s1", 208: "s2"}  # the first key has three owners
    rows = [(i, t, "en", source[i], len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 400), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scores = quality_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    kept = [(r.doc_id, texts[r.doc_id]) for r in scores if r.score >= corpus_pipeline.LEAST_QUALITY]
    first = brute.components(kept, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    kept = [(i, t) for i, t in kept if first[i][1] == i and passage not in (t or "")]
    owners = {}
    for i, t in kept:
        for *_, value in find_spans(t):
            owners.setdefault(value, set()).add(source[i])
    clean = {}
    for i, t in kept:
        secret = {at for start, _, end, value in find_spans(t) if len(owners[value]) <= 2 and looks_random(value) for at in range(start, end)}
        clean[i] = "".join("" if at in secret and at - 1 in secret else "<SECRET>" if at in secret else c for at, c in enumerate(t)) if secret else t
    table = pa.table({"doc_id": list(clean), "text": pa.array(list(clean.values()), pa.string()), "source": [source[i] for i in clean]})
    plan = duck(f"select doc_id, size, taken from ({queries.oracle_sql()['op6_mixing']}) where taken > 0", documents=table)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "n_chars", "source", "size", "taken").collect()
    assert Counter(map(tuple, got)) == Counter((i, clean[i], len(clean[i] or ""), source[i], size, taken) for i, size, taken in plan)
    hidden = {i for i in clean if "<SECRET>" in (clean[i] or "")}
    assert hidden and any(key[0] in (clean[i] or "") for i in clean) and not {300, 301} & set(clean)
