"""Centroid clustering, SimHash near-dedup and conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from pageloom.llm import centroids, frames, simhash, turns
from tests.llm.conftest import corpus
from tests.llm.test_repeats_near import LOW, words

# --- vectors ---------------------------------------------------------------------------------------------------------


def clusters(rows, dims, k, rounds, scale=64):
    """Every complete vector with its cluster, distance and the sums."""
    most = centroids.bound(dims)
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(min(max(scale * x, -most), most)) for x in v]))
    draw = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    held = [v for _, v in sorted(kept, key=draw)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(held))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        held = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(held)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {n: sum(d for _, m, d in found if m == n) for n in range(len(held))}
    digest = lambda n: hashlib.sha256(",".join(map(str, held[n])).encode()).hexdigest()
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest(n)) for i, n, d in found), key=repr)


def vectors(dims):
    rng = random.Random(3)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in middle[i % 4]]) for i in range(120)]
    rows += [(200 + i, list(middle[0])) for i in range(50)] + [(7, middle[1]), (7, middle[1]), (None, middle[2]), (None, middle[3])]
    rows += [(300, None), (301, []), (302, middle[0][:-1]), (303, [*middle[0], 1.0]), (304, [None, *middle[0][1:]])]
    rows += [(305, [math.nan, *middle[0][1:]]), (306, [math.inf, *middle[0][1:]]), (307, [1e30] * dims), (308, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize("dims,k,rounds", [(8, 5, 3), (8, 400, 1), (3, 16, 0)])
def test_clusters_like_brute_force(spark, dims, k, rounds):
    rows = vectors(dims)
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    got = centroids.cluster(table, dims=dims, k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == clusters(rows, dims, k, rounds)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty, dims=2).collect() == []
    assert centroids.cluster(empty.limit(0)).schema.simpleString() == centroids.cluster(empty, dims=1, k=1).schema.simpleString()


def test_an_empty_cluster_keeps_its_centroid(spark):
    table = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 0, 0, 100])], "vec_id long, embedding array<float>")
    held = centroids.integer_vectors(table, dims=1)
    assert centroids.next_centroids(held, [[0], [0], [6400]]) == [[0], [0], [6400]]
    assert centroids.next_centroids(held.filter("v[0] = 0"), [[-3], [5000]]) == [[0], [5000]]


def test_means_are_floored(spark):
    held = spark.createDataFrame([(1, [-1]), (2, [-2])], "vec_id long, v array<long>")
    assert centroids.next_centroids(held, [[0]]) == [[-2]]


# --- fingerprints ----------------------------------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    w = words((text or "").translate(LOW))
    hashes = [xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def tied(prints, bits):
    """Least doc_id of the component of every (doc_id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= bits:
            parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return [(i, f"{p:016x}", least.get(root(p))) for i, p in prints]


def test_simhash_like_brute_force(docs):
    rows = corpus()
    got = simhash.simhash_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(tied([(i, fingerprint(t)) for i, t in rows], 4), key=repr)


def test_simhash_of_nothing(empty):
    assert simhash.simhash_duplicates(empty).collect() == []


def prints(seed=1):
    """Chains and dense groups around some fingerprints, and unrelated ones."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 2**63, 1}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([3, 20, 60])):
            out.add(p)
            q = p
            for _ in range(rng.choice([1, 3, 4, 5])):
                q ^= 1 << rng.randrange(64)
            out.add(q)
            p = rng.choice([p, q])
    return sorted(out)


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 5])
@pytest.mark.parametrize("cell", [4096, 5])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, bits, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SHORT", 3)
    monkeypatch.setattr(simhash, "SLAB", 4)
    made = prints()
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in made]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"), bits).collect()
    parent = {p: p for p in made}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[root(a % 2**64)] = root(b % 2**64)
    wanted = {f"{p:016x}": c for p, (_, _, c) in zip(made, tied(list(enumerate(made)), bits), strict=True)}
    least = {}
    for i, p in enumerate(made):
        least.setdefault(root(p), i)
    assert {f"{p:016x}": least[root(p)] for p in made} == wanted


def test_a_dense_group_gives_as_many_links_as_members():
    key, own = np.zeros(300, np.uint64), np.arange(300, dtype=np.uint64)
    a, b = simhash.ties(key, own, 64)
    assert len(a) == 299 and set(b.tolist()) == {0}


def test_more_bits_than_the_grid_finds(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fingerprint long"), 6)


def test_segment_counts_bound_the_distance(spark):
    rng = random.Random(4)
    made = [rng.getrandbits(64) for _ in range(50)]
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in made], "fingerprint long")
    got = rows.selectExpr(*(f"{simhash.segment_counts(h)} as h{h}" for h in (0, 1))).collect()
    for p, r in zip(made, got, strict=True):
        for half in (0, 1):
            bits = p >> 32 * half & 0xFFFFFFFF
            assert [r[half] >> 2 * s & 3 for s in range(16)] == [(bits >> 2 * s & 3).bit_count() for s in range(16)]


# --- turns -----------------------------------------------------------------------------------------------------------


def best_edits(rows):
    """All audits of a conversation by trying everything, with at most two insertions in a place."""
    best = (10**9, "")
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if (cost, audit) > best and cost >= best[0]:
            return
        if i == len(rows) and state in ("", "a"):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                if (state, r) in steps:
                    go(i, steps[state, r], cost + 3, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", 0)
            if fault in (turns.FINE, turns.TRUNCATED):
                more = 3 if fault == turns.TRUNCATED else 0
                if (state, initial) in steps:
                    go(i + 1, steps[state, initial], cost + more, audit + "K", 0)
                for r in "ua":
                    if (state, r) in steps:
                        go(i + 1, steps[state, r], cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_edits_like_brute_force():
    rng = random.Random(8)
    for _ in range(600):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", " ", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        assert turns.cheapest_edits(rows) == best_edits(rows), rows


def plain_edits(rows):
    """Least (cost, audit) by a table over rows and states."""
    inserts = {(a, b): (0, "") for a, b in zip("0sua", "0sua", strict=True)}
    inserts |= {("0", "u"): (3, "I"), ("s", "u"): (3, "I"), ("u", "a"): (3, "I"), ("a", "u"): (3, "I"), ("0", "a"): (6, "II"), ("s", "a"): (6, "II")}
    steps = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def spread(table):
        out = {}
        for (a, b), (c, w) in inserts.items():
            if a in table:
                out[b] = min(out.get(b, (10**9, "")), (table[a][0] + c, table[a][1] + w))
        return out

    table = {"0": (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in spread(table).items():
            ways = [(state, 4, "D")]
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                ways += [(b, more + (0 if i == initial else 3), "K" if i == initial else "R") for (a, i), b in steps.items() if a == state and (i == initial or i != "s")]
            for b, c, w in ways:
                new[b] = min(new.get(b, (10**9, "")), (cost + c, audit + w))
        table = new
    last = spread(table)
    return min(last[s] for s in "0a" if s in last)


def test_long_conversations_like_a_table():
    rng = random.Random(9)
    for n in (40, 150, 400):
        for initials in ("ua", "suat", "u", "a", "uuua"):
            rows = [(rng.choice(initials), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
            assert turns.cheapest_edits(rows) == plain_edits(rows)


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def repaired(rows):
    """The result rows of the contract, by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        held = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held += [(t is not None, t or 0, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        held.sort()
        seen, codes = set(), []
        for *_, role, text in held:
            body = text.rstrip(SPACE)
            fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append((role[:1], fault))
        known = [t for there, t, *_ in held if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [f for _, f in codes]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
        cost, audit = plain_edits(codes)
        lines, state, at = [], "", iter(held)
        for edit in audit:
            *_, role, text = next(at) if edit != "I" else (None, None)
            if edit == "D":
                continue
            if edit != "K":
                role, text = "assistant" if state == "u" else "user", text or ""
            state = role[0]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No", "What?", "Why not!", "", " \n", "Well. ", "é…", "A longer one, cut", "Yes."])
            rows.append((c, t + (t > 4) * rng.randint(0, 3), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), text))
    rows += [(5, None, "user", "No turn."), (5, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (200, 0, None, None)]
    rows += [(201, 3, "user", "Twice."), (201, 3, "user", "Twice."), (201, 3, "assistant", "Other.")]
    rows += [(300, t, "ua"[t % 2] == "u" and "user" or "assistant", f"Turn {t}.") for t in range(300)]
    lost = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "Gone.")]


def test_conversations_like_brute_force(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string").repartition(5)
    got = turns.repair_conversations(table).collect()
    assert sorted(map(tuple, got), key=repr) == repaired(rows)
    assert turns.repair_conversations(table.limit(0)).collect() == []


def test_texts_and_batches_do_not_matter(spark):
    rows = conversations()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = turns.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == repaired(rows)


def test_written_tables_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(frames, "_MADE", {})
    kept = frames.written(spark.range(5), "five")
    folder = Path(frames._MADE[spark.sparkContext.applicationId][0])
    assert kept.count() == 5 and folder.is_dir()
    frames.release(spark)
    assert not folder.exists() and not frames._MADE
    frames.release(spark)
