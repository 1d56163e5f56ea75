"""Substring and near-duplicate removal against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import near, repeats
from tests.llm.conftest import corpus

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def kept_words(rows, window: int) -> list[tuple]:
    """Ids, number of words and what is left of every row, sorted."""
    firsts: dict[tuple, tuple] = {}
    key = lambda i: -(2**63) if i is None else i
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            firsts[run] = min(firsts.get(run, (key(i), k)), (key(i), k))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if firsts[tuple(w[k : k + window])] < (key(i), k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 10, 13])
def test_substrings_like_brute_force(docs, window):
    got = repeats.dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", "text", "removed", "__other").collect()
    assert sorted([(r[0], r[1], r[2], " ".join(words(r[3]))) for r in got], key=str) == kept_words(corpus(), window)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    unchanged = {r[0]: r[3] for r in got if r[2] == 0}
    assert all(unchanged[i] == t for i, t in corpus() if i in unchanged and i not in (None, 90))


def test_levels_double():
    assert repeats.levels(20) == [5, 10, 20] and repeats.levels(13) == [13] and repeats.levels(50) == [25, 50]


def test_empty_tables(empty):
    assert repeats.dedup_substrings(empty).collect() == []
    assert near.near_duplicates(empty).collect() == []


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))) if w else frozenset()


def brute_components(rows, percent: int = 75, n: int = 5) -> dict[int, int]:
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_near_duplicates_like_brute_force(docs):
    got = near.near_duplicates(docs).collect()
    expected = brute_components(corpus())
    assert len(got) == len(corpus())
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == {i: len(shingles(t)) for i, t in corpus() if i is not None}
    kept = [r["doc_id"] for r in near.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, _ in corpus() if i is not None and expected[i] == i)
    assert kept.count(None) == 2


@pytest.mark.parametrize("percent,n", [(50, 5), (30, 2), (90, 3), (100, 5)])
def test_other_limits_like_brute_force(spark, percent, n):
    rng = random.Random(percent)
    rows = []
    for g in range(25):
        base = [f"g{g}x{i}" for i in range(rng.randint(30, 120))]
        for m in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2 + len(base) * (100 - percent) // 300)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append((4 * g + m, " ".join(w)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, n).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, percent, n)


def test_limits_follow_the_similarity():
    assert (near.band_rows(75), near.least_agreement(75)) == (6, 216)
    for percent in (10, 30, 50, 75, 90):
        r, p = near.band_rows(percent), percent / 100
        assert near.FUNCTIONS % r == 0 and (1 - p**r) ** (near.FUNCTIONS // r) <= near.MISSED
    with pytest.raises(ValueError):
        near.band_rows(0)


def test_signatures_tell_long_texts_apart():
    column = pa.array([" ".join(f"w{random.Random(s).random()}x{i}" for i in range(3000)) for s in range(2)])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), column], ["doc_id", "text"])
    made = next(near._sketcher(75, 5)(iter([batch])))
    one, two = (np.frombuffer(x, np.uint8) for x in made.column(5).to_pylist())
    assert (one == two).sum() < 20


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    """Many texts around one base, most pairs of them below the limit: blocks must find what the stars leave."""
    monkeypatch.setattr(near, "FEW", 3)
    monkeypatch.setattr(near, "CHUNK", 8)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(170)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r["doc"]: r["component"] for r in near.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:750], rng.integers(0, 2**63, 250).astype(np.uint64)]
    share = (near.minima(a) == near.minima(b)).mean()
    assert abs(share - 750 / 1250) < 0.1
