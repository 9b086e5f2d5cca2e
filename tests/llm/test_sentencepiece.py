from __future__ import annotations

import random

import numpy as np
import pytest

from lumenpick.llm import sentencepiece_codec as codec

TEXTS = ["Hello  world\n\tñ 😀 x", "", "  a ▁ b▁▁c ", "日本語テキスト", "a b\x00", "\n\n", " ", "x" * 5000, "Les éèê où ça. " * 30, None]


@pytest.fixture(scope="module")
def table():
    return codec.PieceTable.load(codec.public_model_path())


def test_every_text_is_restored(table):
    encoder = codec.Encoder(table)
    for text, ids in zip(TEXTS, encoder.encode([t or "" for t in TEXTS]), strict=True):
        assert codec.decode(table, ids) == (text or "")


def best_score(table, chunk):
    """Plain dynamic programme over one chunk."""
    scores = {p: table.scores[i] for i, p in enumerate(table.pieces) if i not in table.silent}
    best = [0.0] + [-np.inf] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for size in range(1, min(end, table.longest) + 1):
            piece = chunk[end - size : end]
            value = scores.get(piece, table.unknown if size == 1 else -np.inf)
            best[end] = max(best[end], best[end - size] + value)
    return best[-1]


def test_scores_are_the_best_possible(table):
    rng, encoder = random.Random(1), codec.Encoder(table)
    words = ["".join(rng.choice("abcdeéñthrs") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    for word, ids in zip(words, encoder.encode(words), strict=True):
        assert sum(table.scores[i] for i in ids) == pytest.approx(best_score(table, codec.SPACE + word))


def test_the_library_finds_no_better_segmentation(table):
    """The same pieces and scores in the library's unigram mode."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(codec.public_model_path(), "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng, encoder = random.Random(2), codec.Encoder(table)
    words = ["".join(rng.choice("abcdethrsion") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    score = lambda ids: sum(table.scores[i] for i in ids)
    ours = [i.tolist() for i in encoder.encode(words)]
    theirs = [library.encode(w) for w in words]
    assert all(score(a) >= score(b) for a, b in zip(ours, theirs, strict=True))
    assert np.mean([a == b for a, b in zip(ours, theirs, strict=True)]) > 0.98


def test_on_a_table(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    digest = codec.codec_digest(df, codec.public_model_path()).collect()
    rows = {r["doc_id"]: r for r in codec.encoded(df, codec.public_model_path()).collect()}
    assert all(r["round_trip"] and r["n_tokens"] == len(rows[r["doc_id"]]["ids"]) for r in digest)
    assert rows[1]["ids"] == [] and rows[len(TEXTS) - 1]["ids"] == []
    assert codec.codec_digest(df.limit(0), codec.public_model_path()).count() == 0
