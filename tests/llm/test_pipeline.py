"""The pipeline's stages, each on its predecessor's rows, against plain versions."""

from __future__ import annotations

import hashlib
import re

import pytest

import corpus_pipeline
from tilescope.llm import near_dup, queries, toxicity

from .test_operators import jaccard_links, union_find


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_toxicity_drops_what_scores_high(spark, sf, steps):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in steps[1]} == {r.doc_id for r in steps[0] if model.score(r.text or "") < 0.3}


def test_exact_dedup_keeps_one_of_each(steps):
    best = {}
    for r in steps[1]:
        norm = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in steps[2]} == {i for _, i in best.values()} and len(steps[2]) == len(best)


def test_near_dedup_keeps_the_first_of_each_component(steps):
    rows = sorted(steps[2], key=lambda r: r.doc_id)
    of = union_find(len(rows), jaccard_links([r.text for r in rows])[1])
    assert {r.doc_id for r in steps[3]} == {r.doc_id for k, r in enumerate(rows) if of[k] == k}


def test_mixture_takes_rows_as_they_are(steps):
    before = {r.doc_id: r for r in steps[3]}
    assert all(before[r.doc_id] == r for r in steps[4]) and 0.6 * len(before) < len(steps[4]) <= len(before)


def test_tokens_decode_to_the_text(steps):
    import base64

    import tiktoken

    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert len(steps[5]) == len(steps[4])
    for r in steps[5]:
        assert list(r.ids) == plain.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(r.doc_id for r in steps[5])


def test_rows_without_an_identifier_are_decided_one_by_one(spark):
    def text(word, last=""):
        return " ".join(f"{word}{k}" for k in range(60)) + last

    rows = [
        (1, text("a"), "named"),
        (2, text("a", " more"), "copy of a named one"),
        (3, text("b"), "named"),
        (None, text("a", " other"), "copy of a named one"),
        (None, text("c"), "clean"),
        (None, text("d"), "clean"),
        (None, text("e"), "only each other"),
        (None, text("e", " more"), "only each other"),
        (None, text("e", " more"), "only each other"),
        (None, "", "no words"),
        (None, None, "no words"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string").repartition(3)
    out = near_dup.drop_near(docs)
    got = [tuple(r) for r in out.collect()]
    assert out.schema == docs.schema and set(got) <= set(rows)
    assert sorted(k for _, _, k in got) == ["clean", "clean", "named", "named", "no words", "no words", "only each other"]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("_ts_id", "_ts_sha", "_ts_digest", "_ts_hash", "_ts_doc_id", "_ts_copies", "_ts_part", "n_tokens", "ids", "decoded_sha256", "kept", "node", "component_id", "score", "toxic", "row", "label")


def odd_rows():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(k, f"clean text number {k} of its kind, with words w{k} v{k} u{k} t{k} s{k}", ("en", "de", None)[k % 3], (None, "s1", "s2")[k % 3], 1) for k in range(20)]
    rows += [(30, None, "en", "s1", None), (31, "", "en", "s1", 0), (32, " \n", None, None, 2), (33, long, "en", "s2", len(long)), (34, long + " end", "en", "s2", 1)]
    return rows + [rows[0], rows[3], (None, rows[5][1], "en", "s1", 1), (None, "a text without a name that stands alone here", None, None, 1), (35, rows[7][1].replace(" ", "  "), "en", "s1", 1)]


def staged(spark, folder, docs, labels):
    """Rows and columns after each stage, of documents with columns of every name that a stage uses."""
    from pyspark.sql import functions as F

    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(docs, ODD).withColumns({c: F.concat(F.lit("own-"), F.coalesce("doc_id", F.lit(-1))) for c in CLASHES}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    table, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{folder}/stage-{k}")
        table = spark.read.parquet(f"{folder}/stage-{k}")
        out.append((table.columns, [r.asDict() for r in table.collect()]))
    return out


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    names = [*(f.split()[0] for f in ODD.split(", ")), *CLASHES]
    out = staged(spark, str(tmp_path), odd_rows(), [(k, 1, int(k % 9 == 0)) for k in range(12)])
    for columns, rows in out[:4]:
        assert columns == names
    columns, rows = out[4]
    assert columns == [*names, "n_tokens_", "ids_", "decoded_sha256_"]
    for r in rows:
        assert all(r[c] == f"own-{-1 if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)
        assert r["decoded_sha256_"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert len(out[0][1]) == len(odd_rows())
    # blank texts are one group, equal texts and repeated rows too
    exact = [re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in out[1][1]]
    assert len(exact) == len(set(exact)) and set(exact) == {re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in odd_rows()}
    near = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out[2][1])
    assert 33 in near and 34 not in near and near.count(-1) == 1 and set(range(20)) - {7, 35} <= set(near)


def test_stages_on_empty_tables(spark, tmp_path):
    assert [len(rows) for _, rows in staged(spark, str(tmp_path), [], [])] == [0] * 5


def test_run_deletes_what_the_stages_wrote(spark, sf):
    import os

    from tilescope.llm.common import shared_dir

    root = shared_dir(spark) + "/tilescope"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-tokens") and out.count() > 0
