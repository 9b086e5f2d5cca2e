"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Templates are titles, notices, file headers and whole licence texts.  Document
frequencies of their words are counted over all texts.  Every run of as many words
as a template has, wherever it stands in a text (a shorter text as a whole), is compared with it
as sparse vectors (places and values) of term frequency times inverse document frequency; words
that no template has weigh as much as words that occur in no text and only lengthen the
run's vector.  The best run decides, if its cosine reaches the threshold and if it has the words
by which the licence is named in the template.  An SPDX line names its licence outright.

No run is left out: sums over runs come from prefix sums, which bound every cosine from
above, and cosines are worked out where the bound reaches the threshold.  Texts without any of
a template's heaviest words, those without which no run can reach it, need no look at its runs.

A run must have the words that tell a licence from its kin, such as its version, "lesser" or "later", and none of them
that the template lacks.  A notice or title counts for nothing where a negation stands in it or within four words before it in its sentence.
An SPDX line may hold an expression (AND, OR, WITH, brackets), which is given whole.

A file named as a licence file licenses its directory.  Directories, not files,
are then expanded to their ancestors and joined to the licensed directories, and the deepest
match is inherited by all files that have no licence of their own.  The root of relative
paths is the directory ".".

Defined results: null and blank texts match nothing; null paths inherit nothing; own_score is 0
where nothing reaches the threshold; of equal scores the licence that comes first by name wins, of several
licence files in a directory the best score, then the smallest doc_id (one without comes last).  Repeated
rows give a result row each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .licenses import TEMPLATES
from .wordhash import ranges, token_column, word_hashes

THRESHOLD = 0.8
#: Templates of at most so many words must be matched with the words of the licence's name.
NOTICE_WORDS = 30
#: LICENSE, LICENSE.md, COPYING.LESSER, LICENSE-MIT, LICENSE_APACHE-2.0.txt, but not license_scan.py.
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)((\.[a-z]+)?|[-_][a-z0-9+-]+(\.[0-9]+)*(\.(txt|md|rst|html?))?)$"

_TOKEN = re.compile(r"[a-z0-9]+")
_SPDX_MARK = re.compile(rb"SPDX-License-Identifier:")
_SPDX_TOKENS = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9.:+-]*[A-Za-z0-9+])")
#: Words that tell a licence from its kin: a run has those of its template and no others.
_KIN = ("lesser", "affero", "later", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd")
#: Licences whose headers differ from those of their kin by the version.
_VERSIONED = ("AGPL", "Apache", "BSL", "CC", "EPL", "GPL", "LGPL", "MPL")
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?;\n", np.uint8))
#: Words before a run, of its own sentence, in which a negation counts.
_BEFORE = 4
_NEGATIONS = ("not", "never", "neither", "nor", "cannot", "isn", "wasn", "aren")
#: Parts of identifiers that don't tell licences apart.
_LOOSE = frozenset(("only", "or", "later", "clause", "0"))


def tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits, A-Z lower-cased."""
    return _TOKEN.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text))


def spdx_expression(text: bytes) -> str | None:
    """The longest well-formed licence expression that a text begins with: identifiers joined by AND, OR and WITH, with brackets."""
    at, depth, operand, words, best = 0, 0, True, [], None
    while found := _SPDX_TOKENS.match(text, at):
        word, at = found.group(1).decode(), found.end()
        joins = word in ("AND", "OR", "WITH")
        if word == "(" and operand:
            depth += 1
        elif word == ")" and not operand and depth:
            depth -= 1
        elif joins and not operand:
            operand = True
        elif operand and not joins and word not in "()":
            operand = False
        else:
            break
        words.append(word)
        if not operand and not depth:
            best = " ".join(words).replace("( ", "(").replace(" )", ")")
    return best


class TemplateIndex:
    """Template vectors over their own vocabulary, for given document frequencies."""

    def __init__(self, templates: dict[str, list[str]], frequencies: dict[str, int], documents: int, threshold: float = THRESHOLD):
        self.threshold = threshold
        idf = lambda n: math.log((1 + documents) / (1 + n)) + 1
        split = [(name, tokens(text)) for name in sorted(templates) for text in templates[name]]
        self.names, self.sizes = [name for name, _ in split], [len(words) for _, words in split]
        vocabulary = sorted({w for _, words in split for w in words})
        hashes = word_hashes([w.encode() for w in vocabulary])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {vocabulary[k]: i for i, k in enumerate(order)}
        # one more entry for all other words
        self.idf = np.array([idf(frequencies.get(vocabulary[k], 0)) for k in order] + [idf(0)])
        kin = {k: place[k] for k in _KIN if k in place}
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []
        self.named, self.barred, self.heavy = [], [], []
        for name, words in split:
            counts = Counter(words)
            at = np.array([place[w] for w in counts])
            values = np.array([float(n) for n in counts.values()]) * self.idf[at]
            values /= np.linalg.norm(values)
            self.vectors.append((at, values))
            own = set(tokens(name)) - _LOOSE if len(words) <= NOTICE_WORDS else {w for w in tokens(name) if w.isdigit()} - _LOOSE if name.startswith(_VERSIONED) else set()
            self.named.append([place[w] for w in (own | set(_KIN)) if w in counts])
            self.barred.append([i for k, i in kin.items() if k not in counts])
            heaviest = np.argsort(-values)
            enough = int(np.searchsorted(np.cumsum(values[heaviest] ** 2), 1 - threshold**2 + 1e-9)) + 1
            self.heavy.append(at[heaviest[:enough]])
        self.negations = word_hashes([w.encode() for w in _NEGATIONS])
        self.denied = [sum(w in _NEGATIONS for w in words) for _, words in split]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def _cosine(self, t: int, dense: np.ndarray, ids: np.ndarray, hashes: np.ndarray, before: np.ndarray) -> float:
        """The cosine of a run with template t, given as a dense row; before: the hashes of the words before the run."""
        if any(k not in ids for k in self.named[t]) or any(k in ids for k in self.barred[t]):
            return 0.0
        if self.sizes[t] <= NOTICE_WORDS and np.isin(np.concatenate([before, hashes]), self.negations).sum() > self.denied[t]:
            return 0.0
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        weights = counts * self.idf[ids[first]]
        return float((dense[ids[first]] * weights).sum() / math.sqrt((weights**2).sum()))

    def best(self, hashes: np.ndarray, bounds: np.ndarray, opening: np.ndarray) -> list[tuple[str | None, float]]:
        """Per row (words bounds[r] to bounds[r + 1]) the licence of the closest run and its cosine; (None, 0.0) below the threshold.

        opening: per word whether a sentence or line begins with it.
        """
        begun = np.maximum.accumulate(np.where(opening, np.arange(len(hashes)), 0)) if len(hashes) else np.zeros(0, np.int64)
        out: list[tuple[str | None, float]] = [(None, 0.0)] * (len(bounds) - 1)
        ids = self.ids(hashes)
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        dense, is_heavy = np.zeros(len(self.idf)), np.zeros(len(self.idf), bool)
        for t, size in enumerate(self.sizes):
            places, values = self.vectors[t]
            is_heavy[self.heavy[t]] = True
            rows = np.unique(row_of[is_heavy[ids]])
            is_heavy[self.heavy[t]] = False
            if not len(rows):
                continue
            dense[:] = 0
            dense[places] = values
            lengths = np.diff(bounds)[rows]
            at = ranges(bounds[rows], lengths)
            ends = np.cumsum(lengths)
            some, row = ids[at], np.repeat(np.arange(len(rows)), lengths)
            dots = np.concatenate([[0.0], np.cumsum(dense[some] * self.idf[some])])
            squares = np.concatenate([[0.0], np.cumsum(self.idf[some] ** 2)])
            start = np.arange(len(some))
            end = np.minimum(start + size, ends[row])
            # a run of fewer words is the whole text
            whole = (end - start == size) | (start == (ends - lengths)[row])
            # equal words weigh more together than apart, so the norm is at least this
            bound = (dots[end] - dots[start]) / np.sqrt(squares[end] - squares[start])
            found = np.flatnonzero(whole & (bound >= self.threshold - 1e-9))
            found = found[np.lexsort((found, -bound[found], row[found]))]
            last, score = None, 0.0
            for i in found:
                r = int(rows[row[i]])
                if r != last:
                    last, score = r, out[r][1]
                if bound[i] <= score - 1e-9:
                    continue
                before = hashes[max(at[i] - _BEFORE, bounds[r], begun[at[i]]) : at[i]]
                cosine = self._cosine(t, dense, some[i : end[i]], hashes[at[i : end[i]]], before)
                if cosine >= self.threshold and cosine > score + 1e-12:
                    score = cosine
                    out[r] = (self.names[t], cosine)
        return out


def document_frequencies(docs: DataFrame, templates: dict[str, list[str]]) -> tuple[dict[str, int], int]:
    """In how many texts each word of the templates occurs, and the number of texts; one row per word reaches the driver."""
    words = sorted({w for texts in templates.values() for text in texts for w in tokens(text)})
    index = TemplateIndex(templates, {}, 0)
    by_id = {int(i): w for i, w in zip(index.ids(word_hashes([w.encode() for w in words])), words, strict=True)}

    def run(batch: pa.RecordBatch) -> dict:
        counts = np.zeros(len(by_id) + 1, np.int64)
        for found in token_column(batch.column(batch.schema.get_field_index("text"))):
            ids = index.ids(found.hashes)
            known = ids < len(by_id)
            counts += np.bincount(np.unique(found.rows[known] * len(counts) + ids[known]) % len(counts), minlength=len(counts))
        return {"word": ["", *[by_id[i] for i in range(len(by_id))]], "n": [batch.num_rows, *counts[:-1].tolist()]}

    rows = arrow_map(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def own_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license (null below the threshold) and own_score per row of docs (doc_id, path, text)."""
    templates = templates or TEMPLATES
    index = TemplateIndex(templates, *document_frequencies(docs, templates), threshold)

    def run(batch: pa.RecordBatch) -> dict:
        ids, paths, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "path", "text"))
        found: list[tuple[str | None, float]] = []
        for words in token_column(texts):
            stops = np.concatenate([[0], np.cumsum(_STOPS[words.data])])
            opening = np.ones(len(words.starts), bool)
            opening[1:] = stops[words.starts[1:]] > stops[words.ends[:-1]]
            part = index.best(words.hashes, words.bounds, opening)
            edges = np.append(words.row_starts, len(words.data))
            raw = words.data.tobytes()
            for m in _SPDX_MARK.finditer(raw):
                row = int(np.searchsorted(edges, m.start(), "right")) - 1
                named = spdx_expression(raw[m.end() : edges[row + 1]])
                if named and part[row][1] < 2:
                    part[row] = (named, 2.0)  # the first one, before any cosine
            found += part
        return {"doc_id": ids, "path": paths, "own_license": [n for n, _ in found], "own_score": [min(1.0, round(s, 6)) for _, s in found]}

    return arrow_map(docs.select("doc_id", "path", "text"), run, "doc_id long, path string, own_license string, own_score double")


def _directory(path: Column) -> Column:
    """The directory of a path; "." for the root of relative ones and "" for that of absolute ones."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), ".")


def inherit(scanned: DataFrame, license_names: str = LICENSE_NAMES) -> DataFrame:
    """Adds license (own or inherited) and licensed_by, the directory it comes from (null if own)."""
    files = scanned.withColumn("directory", _directory(F.col("path")))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    licensed = files.filter(F.col("own_license").isNotNull() & F.rlike(name, F.lit(license_names)))
    licensed = licensed.groupBy("directory").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("doc_id").isNull().alias("n"), "doc_id", "own_license")).alias("best"))
    licensed = licensed.select(F.col("directory").alias("ancestor"), F.col("best.own_license").alias("directory_license"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")))
    relative = ~F.startswith("directory", F.lit("/")) & ~F.col("directory").isin("", ".")
    ancestors = F.when(relative, F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit(".").alias("ancestor"))), above)).otherwise(above)
    directories = files.filter("directory is not null").select("directory").distinct().select("directory", F.explode(ancestors).alias("a")).select("directory", "a.*")
    nearest = directories.join(licensed, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "directory_license")).alias("near"))
    nearest = Scratch(scanned.sparkSession).keep(nearest)
    out = files.join(nearest, "directory", "left")
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "near.directory_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.ancestor")).alias("licensed_by"),
    )


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    scanned = Scratch(docs.sparkSession).keep(own_licenses(docs, templates, threshold))
    return inherit(scanned)


def as_source_tree(documents: DataFrame) -> DataFrame:
    """The corpus as files of repositories: one per source, directories three deep, short texts as licence files."""
    folder = F.concat_ws(
        "/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.concat(F.lit("m"), F.pmod("doc_id", F.lit(97)).cast("string")),
        F.when(F.pmod("doc_id", F.lit(3)) > 0, F.concat(F.lit("p"), F.pmod(F.floor(F.col("doc_id") / 97), F.lit(31)).cast("string"))),
    )
    name = F.when(F.length("text") <= 200, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")
