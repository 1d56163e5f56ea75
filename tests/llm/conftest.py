"""A small corpus with nulls, empty and long texts, copies, repeated rows and columns named like results."""

from __future__ import annotations

import random

import pytest

from pageloom.llm.frames import importable

CLASHING = ("n_words", "n_removed", "removed", "found", "score", "kept", "items", "spans", "ids", "decoded", "n_hit", "__other")
BENCHMARK = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "Short, item: HERE"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, "alpha beta"),
]


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Éa", "x,", "A.", "don't"]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))

    base, passage = text(120), " ".join(rng.choice(words) for _ in range(45))
    rows = [(i, text(rng.randint(1, 150))) for i in range(30)]
    rows += [(40 + i, base.replace("w7", f"n{i}")) for i in range(6)] + [(50, base), (51, base), (52, base.upper())]
    rows += [(60 + i, f"{text(20)} {passage} {text(15)}") for i in range(4)]
    rows += [(70, f"some {BENCHMARK[0][1].upper()} words"), (71, "xx short item here yy " + text(80)), (72, "alpha-beta")]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "solo"), (84, "a b c d"), (85, "A b C d"), (86, text(4000))]
    rows += [(None, passage), (None, None), (90, passage), (90, passage), (91, "line one\nline one\n\nline one\n"), (92, "go " * 60)]
    rows += [(100 + i, text(60) + ("you absolute idiot " if i % 3 == 0 else "### $$$ " * 20 if i % 3 == 1 else "")) for i in range(60)]
    return rows


def labels() -> list[tuple[int, int, int]]:
    return [(100 + i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(60)] + [(100, 1, 1), (999, 1, 0)]


@pytest.fixture(scope="session")
def docs(spark):
    importable(spark)
    rows = [(*r, *(["other"] * len(CLASHING))) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labelled(spark):
    rows = [(a, b, c) for a, b, c in labels()] + [(None, 1, 1), (101, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")
