"""Vector codes, filter audit and benchmark search against brute force, with their defined results."""

from __future__ import annotations

import glob
import hashlib
import itertools
import math
import os
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lumenpick.llm import benchmark_leaks as leaks, filter_audit as audit, vector_codes as codes
from lumenpick.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, part string, row long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "x", 1) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_benchmark_leaks"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, result = QUERIES[name](spark, SF_DIR), con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(result.fetchall())


# --- 11: vector codes --------------------------------------------------------


def whole(x):
    return math.floor(Fraction(x) * 1024)


def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label) of one dimension; codebooks and per row its codes and error."""
    dim = len(rows[0][1])
    edges = [dim * p // parts for p in range(parts + 1)]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(whole(v) for v in r[1][a:b]) for a, b in itertools.pairwise(edges)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for c in cut:
                held[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(v) // len(h) for v in zip(*h, strict=True)) if h else e for h, e in zip(held, books[p], strict=True)]
    out = []
    for r, c in zip(rows, cut, strict=True):
        near = [nearest(x, b) for x, b in zip(c, books, strict=True)]
        out.append((r[0], r[2], bytes(i for _, i in near), min(sum(d for d, _ in near), (1 << 63) - 1)))
    return books, sorted(out, key=str)


@pytest.mark.parametrize(("scale", "dim", "n", "entries", "kind"), [(1.0, 8, 400, 32, "float"), (1.0, 6, 60, 7, "double"), (1e30, 8, 60, 6, "float"), (1e305, 4, 40, 5, "double"), (1.0, 3, 7, 16, "double"), (0.0, 4, 12, 4, "float")])
def test_codes_against_brute_force(spark, scale, dim, n, entries, kind):
    rng = np.random.default_rng(dim + n)
    centers = rng.normal(size=(6, dim))
    found = [(int(i // 2 * 3), [float(v) for v in (np.float32 if kind == "float" else np.float64)(np.round(centers[i % 6] + rng.normal(size=dim) * 0.2, 2) * scale)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    found += [(None, found[3][1], 1), found[4], found[5]]
    bad = [(1, None, 1), (2, [float("nan")] * dim, 1), (3, [None] * dim, 1), (4, [float("inf")] * dim, 2), (5, [1.0] * (dim + 1), 2), (6, [], 1)]
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in found + bad], f"vec_id long, embedding array<{kind}>, label int, near int, codes string").repartition(3)
    got = codes.vector_codes(df, 4, entries, 4, 3)
    books, rows = brute_codes(found, 4, entries, 4)
    assert [[tuple(e) for e in b] for b in got.codebooks] == books
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got.rows.collect()), key=str) == rows


def test_bounds_spare_work_and_adapt(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0) for i in range(3000)]
    got = codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 4, 64, 4, 8)
    kept, visits = zip(*got.history, strict=True)
    assert visits[0][-1] == 12000 and visits[-1][-1] < 12000 // 2
    assert len(set(kept)) > 1 and all(sum(v) == 12000 for v in visits)


def test_adapted_bounds():
    assert codes.adapted(8, np.array([50, 0, 0, 50])) == 16
    assert codes.adapted(codes.MOST, np.array([0, 9])) == codes.MOST
    assert codes.adapted(32, np.array([900] + [0] * 5 + [100] + [0] * 60)) == 6
    assert codes.adapted(32, np.array([1000] + [0] * 60)) == codes.LEAST


def test_random_movements_keep_assignments_exact():
    rng = np.random.default_rng(5)
    for trial in range(40):
        k, d = int(rng.integers(1, 40)), int(rng.integers(1, 5))
        x, entries = rng.integers(-30, 30, (200, d)), rng.integers(-30, 30, (k, d))
        near, moved, b = None, np.zeros(k), min(5, k - 1)
        for step in range(5):
            own, exact, near, need = codes.assigned(x, entries, moved, near, b)
            apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (exact == apart.min(axis=1)).all() and (own == apart.argmin(axis=1)).all(), (trial, step)
            near = codes.Near.unpacked(codes.Near(near.own, near.ids, codes._down(near.low)).packed(), b)
            fresh = entries + rng.integers(-2, 3, entries.shape) * (rng.random((k, 1)) < 0.5)
            moved = np.sqrt(codes.distances(entries, fresh)) * (1 + 1e-9) + 1e-9
            entries, next_b = fresh, min(int(rng.integers(0, 8)), k - 1)
            near, b = near.resized(next_b), next_b


def test_codes_with_partitions_without_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, 2.0, float(i % 3)] if i < 30 else None, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartitionByRange(8, "vec_id")
    books, want = brute_codes([r for r in rows if r[1]], 4, 256, 4)
    got = codes.vector_codes(df)
    assert [[tuple(e) for e in b] for b in got.codebooks] == books and sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got.rows.collect()), key=str) == want


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.code_digest(empty).collect() == []
    assert codes.code_digest(spark.createDataFrame([(1, None, 1)], empty.schema)).collect() == []


def test_label_errors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 0.5], None if i % 4 == 0 else i % 4 if i % 3 else 1000 + i) for i in range(600)]
    got = codes.code_digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)).collect()
    label, sums = {r[0]: r[2] for r in rows}, {}
    for r in got:
        sums[label[r.vec_id]] = sums.get(label[r.vec_id], 0) + r.error
    assert len(got) == 600 and all(r.label_error == sums[label[r.vec_id]] for r in got)


# --- 12: filter audit --------------------------------------------------------


def brute_fails(rows):
    texts = [t or "" for _, t, _ in rows]
    least = {}
    for (i, _, _), t in zip(rows, texts, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    out = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        out.append("".join(f for f, b in zip("ABCDE", bad, strict=True) if b))
    return out


def brute_audit(rows, labels):
    fails = brute_fails(rows)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for step, f in enumerate(order, 1):
                mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
                removed = [k for k in mine if f in fails[k] and k not in gone]
                redundant = sum(f in fails[k] and k in gone for k in mine)
                gone |= set(removed)
                shapley[f] += len(removed)
                out[part, order, step] = [len(mine) - len(gone), len(removed), redundant, sum(fails[k] == f for k in mine), sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(1)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(260))
    texts = [long_, long_ + " x", long_, None, "", "A B C", "é" * 50, "# one", " ".join(["same"] * 300), long_.upper(), "a", "ab", "abc", "abd", "ab", "b\x0bc d", "z " * 30000, "z " * 30000 + "y", long_, long_]
    rows = [(k * 3 % 17, t, ["en", None, "", "de"][k % 4]) for k, t in enumerate(texts)]
    rows += [(None, long_, "en"), (None, None, "de"), (5, "ab", "en"), (5, "ab", "en"), (99, "ab", "en"), (99, "ab", "en"), (-4, long_, "de")]
    return rows + [(200 + k, long_[: 900 + k % 3] + f" tail {k % 20}", "fr") for k in range(60)]


def test_audit_against_brute_force(spark):
    rows = audit_rows()
    labels = [(0, 1, 0), (3, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1), (5, 1, 0), (777, 1, 1), (205, 1, 1)]
    got = audit.filter_audit(docs(spark, rows).repartition(4), spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, lang string"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, labels) and got.count() == 5 * 600 - 600


@pytest.mark.parametrize("partitions", [1, 64])
def test_masks_under_crowded_prefixes(spark, partitions):
    """Most texts share more than the longest prefix, so groups are told apart by hashes."""
    head = "p" * 3000
    rows = [(k, head + str(k % 40) if k % 3 else f"{k} other", "en") for k in range(400)] + [(1000 + k, head + "7", "en") for k in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        crowded, _ = audit.crowded_prefixes(docs(spark, rows), partitions)
        assert all(len(c) <= 4 * partitions for c in crowded) and len(crowded[-1]) == 1
        got = audit.failure_masks(docs(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {r[0]: "E" in f for r, f in zip(rows, brute_fails(rows), strict=True)}
    assert {r.doc_id: bool(r.fails & 16) for r in got} == want and sum(r.n for r in got) == len(rows)


def test_trie():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))) for _ in range(300)] + [b"x" * 5000, b"x" * 5000 + b"y", b"x" * 5000]
    trie, least = audit.Trie(), {}
    for i in (order := rng.sample(range(len(texts)), len(texts))):
        trie.insert(texts[i], i, i)
        least[texts[i]] = min(i, least.get(texts[i], i))
    assert sorted(trie.flags()) == [(i, least[texts[i]] < i) for i in sorted(order)]


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs(spark, []), labels).collect() == []
    got = {tuple(r) for r in audit.filter_audit(docs(spark, [(1, None, None)]), labels).collect()}
    assert got == brute_audit([(1, None, None)], [])


# --- 13: benchmark windows ---------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_leaks(rows, items):
    strings = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            strings.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t, _ in rows:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(s) for s in strings}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in strings:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in strings[tuple(w[k : k + n])] if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_tables():
    rng = random.Random(4)

    def prose(n, words=40):
        return " ".join(rng.choice("the of in and Tion re,ing éa 7 x9".split()) + rng.choice(["", "a", "bc"]) + str(rng.randrange(words)) for _ in range(n))

    items = [(k, prose(10 + k)) for k in range(12)] + [(20, "short One"), (21, "x"), (22, "the THE the"), (23, None), (24, " ,; "), (None, prose(15)), (0, prose(12)), (25, "a b c d e f g h i j k"), (26, "w" * 300 + " " + prose(9)), (11, prose(21)), (30, prose(10)), (31, prose(10))]
    items += [(40, items[3][1]), (41, " ".join(items[4][1].split()[2:13]))]
    rows = [(k, prose(30) + " . " + items[k % len(items)][1] if k % 3 and items[k % len(items)][1] else prose(60), "en") for k in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "X", "en"), (103, "short, oNe!", "en"), (104, "shortone", "en"), (None, items[5][1].upper(), "en"), (5, items[5][1], "en"), (5, items[5][1], "en"), (105, "the the the the", "en")]
    rows += [(106, prose(20000, 10**6) + " " + "\n".join(items[6][1].split()), "en"), (107, items[7][1][:-1], "en"), (108, (items[8][1] + " ") * 3, "en"), (109, "a b c d e f g h i j", "en"), (110, "z" * 100000, "en"), (111, items[2][1] + "q", "en")]
    return rows, items


@pytest.mark.parametrize("shard_bytes", [leaks.SHARD_BYTES, 4000])
def test_leaks_against_brute_force(spark, shard_bytes):
    rows, items = leak_tables()
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, n_words int")
    found = leaks.benchmark_hits(docs(spark, rows).repartition(3), benchmark, shard_bytes=shard_bytes)
    got = sorted(((r.doc_id, r.n_words, sum(h["until"] - h["from"] for h in r.hits), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hits)) for r in found.collect()), key=str)
    assert got == brute_leaks(rows, items)
    if shard_bytes == leaks.SHARD_BYTES:
        assert sorted((tuple(r) for r in leaks.contamination(docs(spark, rows), benchmark).collect()), key=str) == got
        bad = {r[0] for r in got if r[5]}
        assert sorted(r.doc_id for r in leaks.decontaminated(docs(spark, rows), benchmark).collect() if r.doc_id is not None) == sorted(d for d, _, _ in rows if d is not None and d not in bad)


def test_shifts_skip_most_places(spark):
    plain = next(leaks.plain_rows(__import__("pyarrow").array(["one two three four five six seven eight nine ten eleven"])))
    strings = [s for _, found in leaks.windows(plain) for s in found]
    assert strings == [b" one two three four five six seven eight nine ten ", b" two three four five six seven eight nine ten eleven "]
    table = leaks.StringSet(strings, [0, 1], 8)
    text = np.frombuffer(b"0123456789" * 1000, np.uint8)
    assert table.shift.max() == table.least - 7 and len(table.places(np.ndarray(len(text) - 8, "<u8", text, strides=(1,)), len(text) - 8)) == 0


def test_leaks_of_nothing(spark):
    rows, items = leak_tables()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert leaks.contamination(docs(spark, []), benchmark).collect() == []
    got = leaks.contamination(docs(spark, rows), benchmark.limit(0)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_leaks(rows, [])
