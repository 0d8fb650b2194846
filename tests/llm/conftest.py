from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, kept string, score string, part int"


def sentence(rng: random.Random, n: int) -> str:
    vocabulary = ["the", "of", "and", "to", "river", "stone", "garden", "lantern", "quiet", "amber", "harbour", "signal", "winter", "orchard", "paper", "window"]
    return " ".join(rng.choice(vocabulary) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Ordinary texts with near and exact copies, shared passages, and every awkward case."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(5, 160)) for _ in range(60)]
    passage = sentence(rng, 70)
    texts += [texts[3], texts[4] + " end", texts[5].replace("the", "a", 1), texts[6] + "\n" + passage, passage + " " + texts[7], "x " + passage]
    texts += ["", "   \n\t", "Ünïcode 漢字 😀 ▁x\u00a0y " * 40, sentence(rng, 20_000), "same line\nsame line\nsame line\n" * 20, "idiot", "<|endoftext|> a <|endoftext|>", "a" * 3000]
    out = [(i, t, "en" if i % 5 else None, "s", len(t), "b", "k", "c", 1) for i, t in enumerate(texts)]
    return [*out, (500, None, None, None, None, None, None, None, None), out[2], out[2], (None, texts[8], "en", "s", 1, "", "", "", 0), (None, None, "en", "s", 1, "", "", "", 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
