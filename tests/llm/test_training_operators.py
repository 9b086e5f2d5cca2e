"""Operators against brute force, and their defined results for nulls, blanks, ties, repeats and empty tables."""

from __future__ import annotations

import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenpick.llm import (
    chroma_fingerprint as chroma, license_scan as licenses, line_dedup, minhash_dedup, mixture, quality_qda, quotation_links as quotes, substring_dedup, vector_search,
)
from lumenpick.llm.common import Scratch, word_count, words_of
from lumenpick.llm.quality_features import FEATURES, document_features

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in texts], DOCS)


def prose(n, seed, vocabulary=2000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def corpus():
    """Copies, near copies, shared passages and lines, nulls, blanks and a very long text."""
    base = prose(120, 1)
    passage = prose(60, 2)
    out = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:60] + ["changed"] + base[61:])), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (9, "x " * 500)]
    out += [(10 + k, " ".join(prose(10 + 3 * k, 50 + k) + passage + prose(20, 90 + k))) for k in range(12)]
    out += [(40, "the same line of words here\nanother line that stays as it is\nthe same line of words here"), (41, "the same line of word here\nshort one\nthe very same line of words here")]
    out += [(50, " ".join(prose(20000, 7))), (51, "é" * 30 + " ▁ a b")]
    return out


def test_words_are_split_at_ascii_blanks_only(spark):
    texts = ["a\x0bb\x0cc", "a b\xa0c", None, "", "  ", "é ü"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(words_of(t)) for t in texts] == [3, 1, 0, 0, 0, 2]


# --- 1: licences -------------------------------------------------------------


def test_licences_are_found_and_inherited(spark):
    files = [(1, "/r/a/LICENSE", "Released under the MIT License."), (2, "/r/a/b/x.txt", "nothing"), (3, "/r/a/b/y.txt", "text\nLicensed under the Apache License, Version 2.0."), (4, "/r/z.txt", "nothing"),
             (5, "/r/a/b/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), (6, "/r/a/q.txt", None), (7, None, "Released under the MIT License."), (8, "/r/a/c/d/e.txt", "")]
    df = spark.createDataFrame([(*f, 1) for f in files], "doc_id long, path string, text string, license int")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["licensed_by"]) for r in licenses.license_scan(df).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "GPL-3.0-only", "/r/a/b") and got[3][0] == "Apache-2.0"
    assert got[4] == (None, None, None) and got[6] == (None, "MIT", "/r/a") and got[7] == ("MIT", "MIT", None) and got[8] == (None, "MIT", "/r/a")
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_non_commercial_licences_are_found_and_inherited(spark):
    df = spark.createDataFrame([(1, "/r/LICENSE", "Licensed under CC BY-NC 4.0."), (2, "/r/a/x.txt", "nothing")], "doc_id long, path string, text string")
    assert {r["license"] for r in licenses.license_scan(df).collect()} == {"CC-BY-NC-4.0"}


MIT_FILE = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_licence_texts_headers_and_notices_within_lines(spark):
    texts = {
        "MIT": [MIT_FILE, "\n".join(MIT_FILE.split("\n")[3:]), "MIT License\n\nCopyright (c) 2020", "x = 1\nCopyright 2020 Foo Inc. Released under the MIT License. See the file for more", "# SPDX-License-Identifier: MIT\ncode"],
        "Apache-2.0": ["/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"],
        "GPL-3.0-or-later": ["# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n# This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
        "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc."],
        "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "Zlib": ["// SPDX-License-Identifier: Zlib"],
        None: ["I lost my license to drive under the bridge", "words " * 30000 + "end", "Released under the X License", ""],
    }
    files = [(100 * i + k, f"d{i}/f{k}", t) for i, (_, some) in enumerate(texts.items()) for k, t in enumerate(some)]
    got = {r["doc_id"]: r["own_license"] for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {k: [got[100 * i + j] for j in range(len(some))] for i, (k, some) in enumerate(texts.items())} == {k: [k] * len(some) for k, some in texts.items()}


def gnu_header(kind, terms, subject="program"):
    return f"/* This {subject} is free software; you can redistribute it and/or\n * modify it under the terms of the GNU {kind}\n * as published by the Free Software Foundation; {terms}\n *\n * This {subject} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU {kind} for more details. */"


def test_licences_are_told_from_their_kin(spark):
    later = "either version {} of the License, or (at your option) any later version."
    general, lesser, affero = "General Public License", "Lesser General Public License", "Affero General Public License"
    cases = [
        ("GPL-3.0-or-later", gnu_header(general, later.format(3))), ("GPL-3.0-only", gnu_header(general, "version 3 of the License.")),
        ("GPL-2.0-or-later", gnu_header(general, later.format(2))), ("GPL-2.0-only", gnu_header(general, "version 2 of the License.")),
        ("LGPL-2.1-or-later", gnu_header(lesser, later.format("2.1"), "library")), ("LGPL-2.1-only", gnu_header(lesser, "version 2.1 of the License.", "library")),
        ("LGPL-3.0-or-later", gnu_header(lesser, later.format(3))), ("AGPL-3.0-or-later", gnu_header(affero, later.format(3))), ("AGPL-3.0-only", gnu_header(affero, "version 3 of the License.")),
        ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3"), ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
        ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n " + "terms " * 400 + gnu_header(general, later.format(3))),
        ("GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3 or later"), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0"),
        ("Zlib", licenses.TEMPLATES["Zlib"][0]), ("BSD-4-Clause", licenses.TEMPLATES["BSD-4-Clause"][0]), ("BSD-3-Clause", licenses.TEMPLATES["BSD-3-Clause"][1]), ("BSD-2-Clause", licenses.TEMPLATES["BSD-2-Clause"][0]),
        ("MIT-0", "Copyright 2020 X\n\n" + licenses.TEMPLATES["MIT-0"][0]), ("MIT", licenses.TEMPLATES["MIT"][1]), ("EPL-2.0", licenses.TEMPLATES["EPL-2.0"][1]), ("ISC", licenses.TEMPLATES["ISC"][0]), ("0BSD", licenses.TEMPLATES["0BSD"][0]),
        (None, "This file is not released under the MIT License"), (None, "never released under the MIT License, sorry"), ("MIT", "It is not free. Released under the MIT License"), (None, "isn't licensed under the MIT License"),
        ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}"), ("(MIT OR Apache-2.0) AND BSD-3-Clause", "# SPDX-License-Identifier: ( MIT OR Apache-2.0 ) AND BSD-3-Clause"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"), ("MIT", "SPDX-License-Identifier: MIT OR\n"), ("GPL-2.0+", "SPDX-License-Identifier: GPL-2.0+ and more words"),
    ]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.license_scan(df).collect()}
    assert [(n, got[i]) for i, (n, _) in enumerate(cases)] == [(n, n) for n, _ in cases]


def test_every_template_names_its_licence(spark):
    rows = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.license_scan(df).collect()}
    assert [(n, got[i], t[:60]) for i, (n, t) in enumerate(rows) if got[i] != n] == []


def test_names_of_licence_files():
    named = ["LICENSE", "licence.txt", "COPYING.LESSER", "LICENSE-MIT", "LICENSE-APACHE", "LICENSE_APACHE-2.0.txt", "License-BSD3.md", "UNLICENSE", "NOTICE"]
    others = ["license_scan.py", "LICENSE-check.sh", "licenses.txt", "my-LICENSE", "licensed"]
    assert all(re.search(licenses.LICENSE_NAMES, n) for n in named) and not any(re.search(licenses.LICENSE_NAMES, n) for n in others)


def test_inheritance_matches_brute_force(spark):
    rng = random.Random(12)
    notices = {"MIT": "Released under the MIT License", "CC-BY-4.0": "Licensed under CC BY 4.0", None: "nothing here"}
    files = []
    for i in range(300):
        parts = [rng.choice("abc") for _ in range(rng.randrange(5))]
        name = rng.choice(["LICENSE", "x.py", "LICENSE-MIT", "COPYING"]) if rng.random() < 0.3 else f"f{rng.randrange(4)}.py"
        files.append((rng.choice([i, None]) if i % 7 == 0 else i, ("/" if i % 2 else "") + "/".join([*parts, name]) if i % 11 else None, notices[rng.choice([None, None, None, "MIT", "CC-BY-4.0"])]))
    own = {text: name for name, text in notices.items()}

    def folder(path):
        return None if path is None else path.rsplit("/", 1)[0] if "/" in path else "."

    at: dict = {}
    for d, p, t in files:
        if p is not None and own[t] and re.search(licenses.LICENSE_NAMES, p.rsplit("/", 1)[-1]):
            at.setdefault(folder(p), []).append((d is None, d or 0, own[t]))
    want = []
    for d, p, t in files:
        license_, by, here = own[t], None, folder(p)
        while license_ is None and here is not None:
            if here in at:
                license_, by = min(at[here])[2], here
            elif here in ("", "."):
                break
            else:
                here = here.rsplit("/", 1)[0] if "/" in here else "."
                continue
            break
        want.append((d, p, own[t], license_, by))
    got = [(r["doc_id"], r["path"], r["own_license"], r["license"], r["licensed_by"]) for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[4] is not None for w in want) > 30


def test_roots_of_relative_and_absolute_trees(spark):
    files = [(1, "LICENSE", MIT_FILE), (2, "src/a.py", "x"), (3, "b.py", "x"), (4, "/c.py", "x"), (5, "/d/e.py", None), (None, "src/LICENSE", "Licensed under CC BY-NC 4.0."), (6, "src/x/y.py", "x"), (6, "src/x/y.py", "x")]
    got = sorted((str(r["doc_id"]), str(r["license"]), str(r["licensed_by"])) for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect())
    assert got == [("1", "MIT", "None"), ("2", "CC-BY-NC-4.0", "src"), ("3", "MIT", "."), ("4", "None", "None"), ("5", "None", "None"), ("6", "CC-BY-NC-4.0", "src"), ("6", "CC-BY-NC-4.0", "src"), ("None", "CC-BY-NC-4.0", "None")]


def test_licences_match_every_run_by_brute_force(spark):
    rng, words = random.Random(6), ["mit", "license", "the", "under", "released", "apache", "version", "2", "0", "x", "y"]
    templates = {"MIT": ["Released under the MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "the Apache"], "Other": ["license license x"]}
    texts = [(i, f"/s{i}/f", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for i in range(80)]
    known, n = {w for some in templates.values() for t in some for w in licenses.tokens(t)}, len(texts)
    df = {w: sum(w in licenses.tokens(t) for _, _, t in texts) for w in known}
    idf = lambda w: np.log((1 + n) / (1 + df.get(w, 0))) + 1
    vector = lambda some: {w: some.count(w) * idf(w) for w in some}

    def best(text):
        own, out = licenses.tokens(text), (0.0, None)
        for name in sorted(templates):
            for template in map(licenses.tokens, templates[name]):
                for i in range(max(1, len(own) - len(template) + 1)):
                    run = own[i : i + len(template)]
                    if not run or any(w in template and w not in run for w in set(licenses.tokens(name)) - {"0"}):
                        continue
                    a, b = vector(template), vector(run)
                    cosine = sum(v * b.get(w, 0) for w, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                    if cosine >= 0.8 and cosine > out[0] + 1e-9:
                        out = (cosine, name)
        return out[1], round(out[0], 6)

    got = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, path string, text string"), templates).collect()}
    want = {i: best(t) for i, _, t in texts}
    assert len({n for n, _ in want.values()}) == 4 and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)


# --- 2: passages ---------------------------------------------------------------


@pytest.mark.parametrize("longest", [3072, 1])
def test_passages_match_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_windows, "__defaults__", (50, longest))
    df = docs(spark, corpus())
    assert rows(substring_dedup.passage_digest(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.passages(corpus())


def test_passages_of_nothing_and_of_repeated_ids(spark):
    assert substring_dedup.passage_digest(docs(spark, [])).count() == 0
    same = [(1, " ".join(prose(80, 3))), (1, " ".join(prose(80, 3))), (2, " ".join(prose(80, 3))), (2, "other")]
    got = rows(substring_dedup.passage_digest(docs(spark, same)), "doc_id", "n_words", "n_removed")
    assert got == [(1, 80, 0), (1, 80, 0), (2, 1, 0), (2, 80, 80)]


def test_passages_of_rows_without_ids(spark):
    text = " ".join(prose(80, 3))
    got = substring_dedup.passage_digest(spark.createDataFrame([(None, text, 1), (3, text, 1), (4, text, 1)], "doc_id long, text string, ranges int"))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got.collect()) == [("3", 80, 0), ("4", 80, 80), ("None", 80, 0)]


def test_the_automaton_gives_matching_statistics():
    rng = random.Random(4)
    for _ in range(50):
        known = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        asked = [rng.choice("abc") for _ in range(12)]
        inside = lambda s: any("".join(s) in "".join(k) for k in known)
        longest = [max(n for n in range(i + 2) if n == 0 or inside(asked[i + 1 - n : i + 1])) for i in range(len(asked))]
        assert automaton.matches(asked) == longest


# --- 3: near copies ---------------------------------------------------------------


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_match_brute_force(spark, width):
    got = rows(minhash_dedup.near_duplicates(docs(spark, corpus()), width), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_components(corpus(), width)


def test_a_family_around_the_bound(spark):
    base, rng, family = prose(150, 11), random.Random(12), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        family.append((i, " ".join(words)))
    got = rows(minhash_dedup.near_duplicates(docs(spark, family), 4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_components(family, 4)


def test_near_copies_of_rows_without_ids(spark):
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got.collect()) == [("2", "2", True), ("3", "2", False), ("None", "None", True), ("None", "None", True)]


def test_near_copies_of_nothing(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = minhash_dedup.one_of_each(docs(spark, corpus()).withColumn("component_id", F.lit(1)))
    assert "component_id" in kept.columns and {4, 5, 6} <= {r["doc_id"] for r in kept.collect()}


def test_signatures_estimate_similarity():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    share = (minhash_dedup.signature(a[:900], 2000) == minhash_dedup.signature(a[100:], 2000)).mean()
    assert abs(share - 0.8) < 0.04


# --- 4: quality ---------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    got = quality_qda.score_documents(table("documents"), table("labels"))
    truth = {r["doc_id"]: r["quality"] for r in table("labels").collect()}
    out = [(r["held_out"], r["predicted"], truth[r["doc_id"]]) for r in got.collect() if r["doc_id"] in truth]
    held = [p == q for h, p, q in out if h]
    assert len(held) > 50 and np.mean(held) > 0.97
    assert {(r["doc_id"], r["held_out"]) for r in got.collect()} == {(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect()}


def test_quality_without_labels_and_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_qda.score_documents(docs(spark, corpus()), labels).collect()} == {0.5}
    assert not document_features(None).any() and len(document_features("a b")) == len(FEATURES)
    some = spark.createDataFrame([(i, i % 2, 0) for i, _ in corpus()], "doc_id long, quality int, toxic int")
    scores = [r["score"] for r in quality_qda.score_documents(docs(spark, corpus()), some).collect()]
    assert len(scores) == len(corpus()) and all(0 <= x <= 1 for x in scores)


def test_scores_are_density_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, len(FEATURES))), np.arange(400) % 2
    x[y == 1] += 0.5
    moments = {c: np.concatenate([[200.0], x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel()]) for c in (0, 1)}
    model = quality_qda.from_moments(moments, 0.15)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    density = []
    for c in (0, 1):
        cov = 0.85 * np.cov(z[y == c].T, bias=True) + 0.15 * np.eye(len(FEATURES))
        off = z - z[y == c].mean(axis=0)
        density.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


# --- 5: lines -----------------------------------------------------------------------


def test_lines_match_brute_force(spark):
    rng, texts = random.Random(9), corpus()
    lines = [" ".join(prose(rng.randrange(5, 14), 300 + k, 60)) for k in range(40)]
    for d in range(60, 100):
        own = []
        for line in rng.sample(lines, 4):
            words = line.split()
            if rng.random() < 0.5:
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [f"v{rng.randrange(3)}"] * rng.randrange(2)
            own.append(" ".join(words))
        texts.append((d, "\n".join(own)))
    assert sorted(rows(line_dedup.line_digest(docs(spark, texts)), "doc_id", "n_lines", "n_removed", "kept_sha256"), key=str) == brute.line_digest(texts)


def test_lines_of_rows_that_repeat_an_id(spark):
    again = [(1, "a b c d e f"), (2, "a b c d e f\nr s t u v w"), (2, "k l m n o p"), (2, "k l m n o p")]
    assert rows(line_dedup.line_digest(docs(spark, again)), "doc_id", "n_lines", "n_removed") == [(1, 1, 0), (2, 1, 0), (2, 1, 0), (2, 2, 1)]


def test_short_lines_go_as_exact_repeats(spark):
    texts = [(1, "one two\nthree\n\n"), (2, "three\none  two\none too\n"), (3, "one two\n\nONE two"), (4, "中文没有空格的行\n中文没有空格的行")]
    got = rows(line_dedup.line_digest(docs(spark, texts)), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == brute.line_digest(texts) and [r[2] for r in got] == [0, 2, 1, 1]


def test_lines_of_rows_without_ids_and_with_clashing_columns(spark):
    some = spark.createDataFrame([(None, "a b c d e f", 1, 2, 3), (1, "a b c d e f", 1, 2, 3), (2, "a b c d e f\nown", 1, 2, 3)], "doc_id long, text string, kept int, row int, n_lines int")
    got = line_dedup.without_repeated_lines(some)
    assert got.columns == some.columns and sorted((str(r["doc_id"]), r["text"], r["kept"]) for r in got.collect()) == [("1", "a b c d e f", 1), ("2", "own", 1), ("None", "a b c d e f", 1)]


def test_lines_of_nothing_and_emptied_documents(spark):
    assert line_dedup.line_digest(docs(spark, [])).count() == 0
    kept = line_dedup.without_repeated_lines(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "a b c d e x\nown words stay here all of them")]))
    assert rows(kept, "doc_id", "text") == [(1, "a b c d e f"), (3, None), (4, ""), (5, "own words stay here all of them")]


# --- 6: mixing -----------------------------------------------------------------------


def test_targets_by_water_filling(spark):
    sizes = {"b": 100, "a": 10, "d": 50, None: 40, "c": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixture.with_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    level = dict.fromkeys(sizes, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        share = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * share >= 2 * sizes[k] - level[k]}
        for k in open_ if not full else full:
            add = weight[k] * share if not full else 2 * sizes[k] - level[k]
            level[k] += add
            left -= add
        if not full:
            break
        open_ -= full
    assert all(abs(got[k] - level[k]) < 1e-6 for k in sizes)


def test_subset_sums_are_exact():
    rng = random.Random(2)
    for _ in range(40):
        lengths, counts = rng.sample(range(1, 30), 4), [rng.randrange(4) for _ in range(4)]
        budget = rng.randrange(120)
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {x + k * n for x in reach for k in range(c + 1)}
        taken = mixture.best_subset(lengths, counts, budget)
        assert all(t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(x for x in reach if x <= budget)


def test_mixes_reach_their_targets(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(["w"] * rng.choice([1, 5, 5, 5, 17, 40]))) for i in range(300)] + [(900, None), (901, "")]
    sources = {i: ["a", "b", "c", None][min(3, i % 7)] for i, _ in texts}
    df = docs(spark, texts, sources)
    got = mixture.mixture(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixture.mixture(df).collect())
    taken: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault(sources[r["doc_id"]], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert all(abs(t - target) <= 1 for t, target, _ in taken.values())
    assert mixture.mixed_documents(df).count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixture.mixture(df.limit(0)).count() == 0


def test_mixes_of_repeated_rows_and_clashing_columns(spark):
    some = spark.createDataFrame([(i % 5, "w " * (i % 4 + 1), "ab"[i % 2], 1, 2, 3) for i in range(40)] + [(None, "w w", None, 1, 2, 3)], "doc_id long, text string, source string, mix_size int, mix_copies int, row int")
    mixed = mixture.mixed_documents(some, knapsack_words=3)
    assert mixed.columns == some.columns and mixed.select("mix_size", "mix_copies", "row").distinct().collect() == [(1, 2, 3)]
    got = mixture.mixture(some).collect()
    assert len(got) == 41 and all(r["taken"] <= 2 * r["size"] for r in got) and abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) <= 3


# --- 4 again: extra columns and nothing at all


def test_quality_keeps_clashing_columns_and_takes_no_rows(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clash = given.select("*", F.lit(1).alias("score"), F.lit(2).alias("stats"), F.lit(3).alias("predicted"), F.lit(4).alias("quality"))
    kept = quality_qda.keep_good_documents(clash, labels)
    scored = {r["doc_id"] for r in quality_qda.score_documents(given, labels).collect() if r["predicted"]}
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == scored and kept.select("score", "stats", "predicted", "quality").distinct().count() == 1
    assert quality_qda.score_documents(clash.limit(0), labels).count() == 0 and quality_qda.keep_good_documents(clash.limit(0), labels).count() == 0
    twice = given.unionByName(given)
    assert quality_qda.score_documents(twice, labels).count() == 2 * given.count()


# --- 7: neighbours ---------------------------------------------------------------------


def test_neighbours_and_their_recall(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    expected = brute.neighbours([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = rows(vector_search.nearest_neighbours(table), "query_id", "rank", "vec_id", "score")
    want, found = ({(q, v): s for q, _, v, s in x} for x in (expected, got))
    both = want.keys() & found.keys()
    assert len(got) == len(expected) and len(both) >= 0.9 * len(want) and all(want[k] == found[k] for k in both)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist(), 0) for i in range(1, 40)]
    odd = [(100, None, 0), (120, [0.0] * 4, 0), (140, [1.0, None, 0.0, 0.0], 0), (160, [float("nan")] * 4, 0), (180, [1.0, float("inf"), 0.0, 0.0], 0), (200, [1.0], 0)]
    copies = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(300, 420)]
    df = spark.createDataFrame(good + odd + copies + copies[:2], "vec_id long, embedding array<float>, rank int")
    got = rows(vector_search.nearest_neighbours(df, probe_share=1.0), "query_id", "rank", "vec_id", "score")
    assert got == brute.neighbours([(i, v) for i, v, _ in good + copies])
    assert vector_search.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_of_doubles_and_queries_that_find_too_few(spark):
    rng = np.random.default_rng(4)
    far = [(i, (rng.normal(size=4) * 0.01 + np.array([c == i % 8 for c in range(4)]) * (1 if i % 8 < 4 else -1)).tolist()) for i in range(1, 30)]
    rows_in = [*far, (40, [1.0 + 1e-12, 0.0, 0.0, 0.0]), (60, [1e100, 0.0, 0.0, 1e-9]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows_in, "vec_id long, embedding array<double>")
    got = rows(vector_search.nearest_neighbours(df, probe_share=0.1), "query_id", "rank", "vec_id", "score")
    want = []
    for q, v in rows_in:
        if q is not None and q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows_in if i not in (q, None)))[:20]
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(scored)]
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in sorted(want)]
    by_id = {(q, i): x for q, _, i, x in want}
    assert all(np.isclose(x, by_id[q, i], rtol=1e-15) for q, _, i, x in got if (q, i) in by_id) and {q for q, *_ in got} == {20, 40, 60}


# --- 8: recordings -----------------------------------------------------------------------


def test_recordings_align(spark):
    rng = np.random.default_rng(5)
    tune = lambda n: np.clip(128 + 50 * np.sin(np.cumsum(rng.uniform(0.1, 1.2, n))) + rng.normal(0, 4, n), 0, 255).astype(np.uint8)
    a, b = tune(4000), tune(4000)
    media = [(1, bytes(a)), (2, bytes(a)), (3, bytes(a[32 * 20 :])), (4, bytes(b)), (5, None), (6, b"short"), (7, bytes(np.clip(a.astype(int) + rng.integers(-2, 3, len(a)), 0, 255).astype(np.uint8))), (8, b"")]
    df = spark.createDataFrame([(*m, 0) for m in media], "doc_id long, samples binary, overlap int")
    got = {r["doc_id"]: r for r in chroma.aligned_recordings(df).collect()}
    assert got[2]["aligned_to"] == 1 and got[2]["bit_error"] == 0.0 and got[3]["frame_offset"] == 20 and got[3]["component_id"] == 1
    assert got[7]["component_id"] == 1 and got[4]["component_id"] == 4 and got[4]["component_size"] == 1 and got[1]["component_size"] == 4
    assert (got[5]["n_frames"], got[6]["n_frames"], got[6]["component_id"]) == (0, 0, 6)
    assert chroma.aligned_recordings(df.limit(0)).count() == 0


def spoken(n, count, size=1500):
    rng = np.random.default_rng(n)
    return [np.frombuffer(" ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(size // 5))[:size].encode(), np.uint8) for _ in range(count)]


def test_copies_align_wherever_they_start(spark):
    texts = spoken(1, 32)
    media = [(i, bytes(x)) for i, x in enumerate(texts)] + [(100 + i, b"q" * i + bytes(x)) for i, x in enumerate(texts)]
    got = {r["doc_id"]: r for r in chroma.aligned_recordings(spark.createDataFrame(media, "doc_id long, samples binary")).collect()}
    assert sum(got[100 + i]["component_id"] == got[i]["component_id"] for i in range(32)) == 32


@pytest.mark.xfail(reason="open: landmarks need exact bits, so noise still costs links (README)")
def test_noisy_copies_align_up_to_the_bit_error(spark):
    rng, texts = np.random.default_rng(2), spoken(3, 40)
    noisy = [np.clip(x + rng.normal(0, 1 + i / 5, len(x)), 0, 255).astype(np.uint8) for i, x in enumerate(texts)]
    errors = [chroma.bit_error(chroma.fingerprint(x), chroma.fingerprint(y), 0)[1] for x, y in zip(texts, noisy, strict=True)]
    media = [(i, bytes(x)) for i, x in enumerate(texts)] + [(100 + i, bytes(x)) for i, x in enumerate(noisy)]
    got = {r["doc_id"]: r for r in chroma.aligned_recordings(spark.createDataFrame(media, "doc_id long, samples binary")).collect()}
    found = [(e, got[100 + i]["aligned_to"] == i) for i, e in enumerate(errors) if e <= chroma.MAX_BIT_ERROR]
    assert max(e for e, _ in found) > 0.1 and np.mean([f for e, f in found if e < 0.05]) >= 0.9 and np.mean([f for _, f in found]) >= 0.5


def test_offsets_and_places_beyond_the_first_count():
    """Passages at four offsets, only the rarest of which fits; landmarks that repeat."""
    rng = np.random.default_rng(11)
    packed = rng.integers(0, 2**32, 400, dtype=np.uint64).astype(np.uint32)
    marks = np.arange(40)
    a = (packed, marks, 32 * (10 * marks))
    shift = np.repeat([7, 19, 31, 3], 3)
    other = rng.integers(0, 2**32, 400, dtype=np.uint64).astype(np.uint32)
    fits = np.concatenate([rng.integers(0, 2**32, 3, dtype=np.uint64).astype(np.uint32), packed[:-3]])
    some = np.arange(12)
    for body, want in ((fits, (-3, True)), (other, (None, False))):
        got = chroma.align(a, (body, some, 32 * (10 * some + shift)))
        assert got[3] is want[1] and (want[0] is None or got[0] == want[0]) and (not want[1] or got[2] == 0.0)
    # the first place of a repeated landmark is at no common offset, the second ones are
    twice = (packed, np.repeat(np.arange(5), 2), np.sort(np.concatenate([32 * np.array([1, 3, 4, 8, 12]), 32 * (100 + 10 * np.arange(5))]).reshape(2, 5).T.ravel().reshape(5, 2), axis=1).ravel())
    got = chroma.align(twice, (packed[100:], np.arange(5), 32 * 10 * np.arange(5)))
    assert got[0] == 100 and got[3] and got[2] == 0.0
    long = (packed, np.zeros(3000, np.int64), 32 * 8 * np.arange(3000))
    offsets, votes = chroma._offset_votes(long, long)  # noqa: SLF001
    assert len(offsets) == 5999 and votes.max() == 1


def test_components_have_all_links(spark):
    a, b = spoken(4, 2, 3000)
    parts = [(1, a), (2, a), (3, a[320:]), (4, a[:-320]), (5, a[320:]), (6, b), (7, b), (7, a), (7, a), (None, a)]
    df = spark.createDataFrame([(i, bytes(x)) for i, x in parts], "doc_id long, samples binary")
    got = sorted((r["doc_id"], r["component_id"], r["component_size"]) for r in chroma.aligned_recordings(df.filter("doc_id is not null")).collect())
    assert got == [(i, 1, 7) for i in (1, 2, 3, 4, 5, 6, 7, 7, 7)]
    links = sorted((r["a"], r["b"], r["frame_offset"]) for r in chroma.alignment_links(df.filter("doc_id < 6")).collect())
    assert links == [(1, 3, 10), (1, 4, 0), (3, 4, -10)]
    assert [(r["component_id"], r["component_size"]) for r in chroma.aligned_recordings(df).collect() if r["doc_id"] is None] == [(None, 1)]


def test_a_leader_that_matches_none_hides_no_links(spark):
    x, other = spoken(7, 2, 4000)
    scrambled = np.concatenate([x[2400:3600], other[:1500], x[1200:2400], other[1500:3000], x[:1200]])
    media = [(1, bytes(scrambled)), (2, bytes(x)), (3, bytes(x)), (4, bytes(x[16:]))]
    got = {r["doc_id"]: r["component_id"] for r in chroma.aligned_recordings(spark.createDataFrame(media, "doc_id long, samples binary")).collect()}
    assert got[2] == got[3] == got[4]


def test_components_match_brute_force(spark):
    rng, base = np.random.default_rng(8), spoken(8, 24, 2600)
    media = []
    for i in range(70):
        k = rng.integers(0, 24)
        # some recordings hold two pieces, always neighbours of the same four
        parts = [base[j][rng.integers(0, 1200) :] for j in ((k, k ^ rng.integers(1, 4)) if i % 4 == 0 else (k,))]
        media.append((i, bytes(np.concatenate([np.full(rng.integers(0, 60), 113, np.uint8), *parts]))))
    media += [(100, b"z" * 3000), (101, bytes(rng.integers(0, 256, 300_000).astype(np.uint8)))]
    rows_of = chroma._fingerprint_rows(pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in media], "samples": [x for _, x in media]}))  # noqa: SLF001
    prints = [(np.frombuffer(p, np.uint32), m.values.to_numpy(), q.values.to_numpy()) for p, m, q in zip(rows_of["packed"], rows_of["marks"], rows_of["places"], strict=True)]
    parent = list(range(len(media)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(media)):
        for j in range(i):
            if np.array_equal(prints[i][0], prints[j][0]) or chroma.align(prints[j], prints[i])[3]:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {media[k][0]: media[find(k)][0] for k in range(len(media))}
    got = {r["doc_id"]: r["component_id"] for r in chroma.aligned_recordings(spark.createDataFrame(media, "doc_id long, samples binary")).collect()}
    assert got == want and 3 < len(set(want.values())) < len(media) - 5


def test_fingerprints_use_plain_rectangle_sums():
    samples = np.random.default_rng(6).integers(0, 256, 2000).astype(np.uint8)
    image, packed = chroma.chroma(samples), chroma.fingerprint(samples)
    assert np.allclose(image.sum(axis=1), 1, atol=1e-4) and len(packed) == len(image) - chroma.SPAN + 1
    kind, low, height, width = chroma.filter_shapes()[0]
    t = 3
    part, rest = image[t : t + width, low : low + 3].sum(), image[t : t + width, low + 3 : low + height].sum()
    level = sum(np.log((part + 0.01) / (rest + 0.01)) > x for x in (-chroma.LEVEL, 0, chroma.LEVEL))
    assert packed[t] >> 30 == [0, 1, 3, 2][level]


def test_fingerprints_are_stored_small(spark):
    prints = chroma.fingerprints([*spoken(12, 20, 6000), np.zeros(0, np.uint8), np.full(500, 7, np.uint8)])
    assert all(np.array_equal(chroma.restored(chroma.stored(x)), x) for x in prints)
    media = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(spoken(12, 20, 6000))], "doc_id long, samples binary")
    kept, _ = chroma._prints(media, chroma.Scratch(spark))  # noqa: SLF001
    assert kept.selectExpr("sum(length(packed))").first()[0] < 0.85 * sum(x.nbytes for x in prints[:20])


def test_whole_fingerprints_are_dealt_once(spark):
    a, b = spoken(13, 2)
    media = spark.createDataFrame([(3, bytes(a)), (3, bytes(a)), (3, bytes(b)), (5, bytes(a)), (6, None)], "doc_id long, samples binary")
    scratch = chroma.Scratch(spark)
    prints, leaders = chroma._prints(media, scratch)  # noqa: SLF001
    wanted, scratch.keep = scratch.keep(leaders.select("class")), lambda df: df
    found = chroma._whole(prints, leaders, wanted, scratch)  # noqa: SLF001
    assert found.count() == found.select("class").distinct().count() == 2
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001


# --- 10: quotations -----------------------------------------------------------------------


def test_quotes_are_linked(spark):
    mails = [(1, 0, "user", "Hello there\n\nSecond  PARAGRAPH"), (1, 1, "assistant", "> hello there\nReply"), (1, 2, "user", "> > second paragraph\n> Reply\nThanks\n> unknown text"), (1, 3, "user", "No quote"),
             (2, 0, "user", ">Reply\nfrom elsewhere"), (3, 0, "user", None), (3, 1, "user", ""), (None, 0, "user", "Hello there"), (4, None, "user", "> Hello there")]
    df = spark.createDataFrame([(*m, 1) for m in mails], "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked_messages(df).collect()}
    assert got[1, 1]["parent_turn"] == 0 and got[1, 1]["content"] == "Reply" and got[1, 2]["parent_turn"] == 1
    assert got[1, 2]["depth"] == 2 and (got[1, 2]["n_quotes"], got[1, 2]["n_linked"]) == (3, 2)
    assert (got[2, 0]["parent_conv_id"], got[2, 0]["parent_turn"], got[2, 0]["depth"]) == (1, 1, 0)
    assert got[3, 0]["content"] == "" and got[1, 3]["depth"] == 0 and len(got) == len(mails)
    assert [got[1, t]["position"] for t in range(4)] == [1, 2, 3, 4] and got[None, 0]["position"] is None and got[4, None]["position"] is None
    chat = {r["conv_id"]: [m["content"] for m in r["messages"]] for r in quotes.conversations(quotes.linked_messages(df)).collect()}
    assert chat[1] == ["Hello there\n\nSecond  PARAGRAPH", "Reply", "Thanks", "No quote"]
    assert quotes.linked_messages(df.limit(0)).count() == 0


def test_reply_order_of_trees_by_brute_force(spark):
    rng, rows_in, want = random.Random(3), [], {}
    for conv, n in enumerate((1, 2, 7, 40, 150)):
        parent = {t: (t - 1 if conv == 4 and t else rng.choice([None, *range(t)]) if t else None) for t in range(n)}
        rows_in += [(conv, t, p) for t, p in parent.items()]
        order = []

        def walk(above, depth):
            for t in sorted(t for t, p in parent.items() if p == above):
                order.append((t, depth))
                walk(t, depth + 1)

        walk(None, 0)
        want |= {(conv, t): (k + 1, d) for k, (t, d) in enumerate(order)}
    got = quotes.reply_order(spark.createDataFrame(rows_in, "conv_id long, turn long, parent_turn long"), Scratch(spark))
    assert {(r["conv_id"], r["turn"]): (r["position"], r["depth"]) for r in got.collect()} == want


def test_quotes_of_repeated_rows_and_long_texts(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(5000))
    mails = [(1, 0, "user", long), (1, 1, "assistant", "> " + long.replace("\n", "\n> ") + "\nYes"), (1, 1, "assistant", "> " + long.replace("\n", "\n> ") + "\nYes")]
    got = quotes.conversation_digest(spark.createDataFrame(mails, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["position"], r["depth"], r["parent_turn"]) for r in got) == [(0, 1, 0, None), (1, 2, 1, 0), (1, 2, 1, 0)] and len({r["chat_md5"] for r in got}) == 1


def test_mail_threads_are_recovered(spark):
    talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    got = quotes.linked_messages(quotes.as_mail_threads(talks)).collect()
    turns = {(r["conv_id"], r["turn"]) for r in talks.collect()}
    assert all(r["depth"] == r["turn"] and r["parent_turn"] == r["turn"] - 1 for r in got if r["turn"] > 0 and (r["conv_id"], r["turn"] - 1) in turns)
