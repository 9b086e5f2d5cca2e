from __future__ import annotations

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from lumenpick.llm import queries
from lumenpick.llm.common import Scratch, words_of

SF_DIR = "/root/testdata/sf0.001"


def edited(text):
    """A near copy: of every line of at least 40 words, three words changed."""
    lines = [line.split(" ") for line in text.split("\n")]
    return "\n".join(" ".join(f"{w}q" if len(x) >= 40 and i in (7, 20, 33) else w for i, w in enumerate(x)) for x in lines)


def test_stages_feed_each_other(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, good = given.columns, corpus_pipeline.quality(spark, given, SF_DIR)
    long_rows = [r for r in good.collect() if any(len(line.split(" ")) >= 40 for line in r["text"].split("\n"))]
    near = [r.asDict() | {"doc_id": 10**6 + r["doc_id"], "text": edited(r["text"])} for r in long_rows]
    odd = [{"doc_id": 2 * 10**6 + i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in enumerate([None, "", " \n", "\n".join(f"l{i} " * 12 for i in range(2500))])]
    docs = given.unionByName(spark.createDataFrame([tuple(r[c] for c in columns) for r in near + odd], given.schema))
    scratch, kept = Scratch(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, SF_DIR))
        kept.append(docs.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    quality, lines, copies, mix, ids = ([(r["doc_id"], r["text"] if "text" in r else None) for r in x] for x in kept)
    assert {r["doc_id"] for r in long_rows} <= {d for d, _ in quality} and len(near) >= 5
    cut = {d: (n, gone) for d, n, gone, _ in brute.line_digest(quality)}
    assert {d for d, _ in lines} == {d for d, t in quality if not cut[d][1] or brute.kept_text(quality, d).split()}
    assert all(t == brute.kept_text(quality, d) for d, t in lines)
    groups = {d: keep for d, _, _, keep in brute.near_components(lines, 5)}
    assert {d for d, _ in copies} == {d for d, keep in groups.items() if keep} and len(copies) < len(lines)
    assert set(mix) <= set(copies) and len(mix) == len(ids) and {d for d, t in copies if words_of(t)} >= {d for d, _ in mix}
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in kept[-1])


def test_the_pipeline_of_nothing_and_with_clashing_columns(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scratch = Scratch(spark)
    extra = ("score", "stats", "predicted", "_copy", "kept", "n_removed", "lines", "row", "whole", "component_id", "mix_size", "mix_copies", "copies", "n")
    for rows in (given.limit(0), given.select("*", *[F.lit(7).alias(c) for c in extra]).filter("doc_id < 40")):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, SF_DIR))
            assert docs.columns == rows.columns
        assert not set(extra) & set(docs.columns) or docs.select(*extra).distinct().collect() == [tuple([7] * len(extra))]
        assert (docs.count() > 0) == (rows.count() > 0)


def test_queries_are_named_by_operator():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
