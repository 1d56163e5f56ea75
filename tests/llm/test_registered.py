"""Registered queries against their statements, and the pipeline stage by stage."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import factors, oracles, queries, stats, trees
from pageloom.llm import words as W
from tests.llm.test_repeats_near import LOW, brute_components, kept_words, words

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    result = queries.QUERIES[name](spark, SF_DIR)
    if name not in oracles.ORACLES:
        table = "conversations" if "chat" in name else "documents"  # values: below and with the operators
        assert result.count() == oracle.sql(f"select count(*) from {table}").fetchall()[0][0]
        return
    wanted = oracle.sql(oracles.ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(wanted.columns)
    assert sorted(map(repr, (tuple(r) for r in result.select(columns).collect()))) == sorted(map(repr, wanted.select(", ".join(columns)).fetchall()))


def documents() -> list[tuple]:
    rows = duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall()
    return sorted(rows, key=lambda r: r[0])


def test_byte_bpe_values(spark):
    """Every whole text against the library."""
    from pathlib import Path as P

    lines = [line.split() for line in P(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()]
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(t): int(r) for t, r in lines}, special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    wanted = []
    for i, text in documents():
        ids = library.encode_ordinary(text or "")
        wanted.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert sorted(map(tuple, queries.byte_bpe(spark, SF_DIR).collect())) == wanted


def test_token_output_values(spark):
    library, wanted, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for i, text in documents():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.token_output(spark, SF_DIR).collect())) == wanted


def test_quality_scores_are_pairwise_sums(spark):
    """The linear-time score against the sum over all pairs of inputs."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    machine = factors.train(docs, labels, learn="crc32(cast(doc_id as string)) % 4 <> 2")
    scores = {r["doc_id"]: r["score"] for r in queries.quality_classifier(spark, SF_DIR).collect()}
    for i, text in documents()[:12]:
        x = np.concatenate([machine.rows(*part) for part in factors.inputs(pa.array([text], pa.string()))])[0].astype(float)
        on = np.flatnonzero(x)
        value = machine.bias + sum(machine.linear[a] * x[a] for a in on)
        value += sum(float(machine.factors[a].astype(float) @ machine.factors[b]) * x[a] * x[b] for a, b in itertools.combinations(on, 2))
        assert abs(scores[i] - 1 / (1 + math.exp(-max(min(value, 30), -30)))) < 1e-3


def test_rule_scores_walk_the_trees(spark):
    """The flattened arrays against a walk from node to node."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    fitted = trees.train(docs, labels, "quality")
    scores = {r["doc_id"]: r["rule_score"] for r in queries.quality_rules(spark, SF_DIR).collect()}
    for i, text in documents()[:60]:
        w = W.words(pa.array([text], pa.string()))
        x = stats.features(w, stats.counts(w, W.hashes(w))).astype(float)[0]
        total = fitted.start
        for node in fitted.roots.tolist():
            while fitted.left[node] != node:
                node = int(fitted.left[node] if x[fitted.feature[node]] <= fitted.threshold[node] else fitted.right[node])
            total += fitted.value[node]
        assert abs(scores[i] - 1 / (1 + math.exp(-total))) < 1e-6


def without_benchmark(rows, items) -> list[tuple]:
    """Documents under the coverage limit without their long benchmark passages."""
    cut = lambda t: [(m.start(), m.end(), m.group().translate(LOW)) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    windows = {}
    for _, text in items:
        w = [x for *_, x in cut(text)]
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = []
    for i, text in rows:
        w = cut(text)
        hit = set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(x for *_, x in w[k : k + n]) in known:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        runs, at = [], 0
        for k in sorted(hit):
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        for a, b in reversed(runs):
            if b - a >= 13:
                text = text[: w[a][0]] + text[w[b - 1][1] :]
        out.append((i, text))
    return out


def test_pipeline_stages(spark):
    """Kept ids and texts of every stage against plain Python, each on what the stage before it left."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns, stages, written = docs.columns, dict(corpus_pipeline.STAGES), corpus_pipeline.written
    assert list(stages) == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    held = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect())

    def after(name, docs):
        out = written(stages[name](spark, docs, SF_DIR), name)
        assert out.columns == columns
        return out

    machine = factors.train(docs, labels, "quality", learn="crc32(cast(doc_id as string)) % 4 <> 2")
    good = []
    for i, text in held(docs):
        x = np.concatenate([machine.rows(*part) for part in factors.inputs(pa.array([text], pa.string()))])
        if machine.score(x)[0] >= 0.7:
            good.append((i, text))
    docs = after("quality_classifier", docs)
    assert held(docs) == good and 0 < len(good) < 200
    groups = brute_components(good)
    kept = [r for r in good if groups[r[0]] == r[0]]
    docs = after("near_dedup", docs)
    assert held(docs) == kept and len(kept) < len(good)
    left = [(i, run) for i, _, _, run in kept_words(kept, 20)]
    docs = after("substring_dedup", docs)
    assert [(i, " ".join(words(t))) for i, t in held(docs)] == sorted(left)
    whole = {i for i, _, gone, _ in kept_words(kept, 20) if not gone}
    assert all(t == dict(kept)[i] for i, t in held(docs) if i in whole)
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    wanted = without_benchmark(held(docs), items)
    before = len(held(docs))
    docs = after("decontamination", docs)
    assert held(docs) == wanted and len(wanted) <= before
    out = {r["doc_id"]: r for r in stages["byte_bpe"](spark, docs, SF_DIR).collect()}
    assert set(out) == {i for i, _ in wanted} and all(r["exact"] and len(r["ids"]) == r["n_tokens"] for r in out.values())


def test_passages_of_the_benchmark_are_cut(spark, tmp_path):
    """A long passage in a long text goes, the text stays; short hits stay; a text that is mostly passage goes."""
    item = " ".join(f"item{i}" for i in range(20))
    text = " ".join(f"word{i}" for i in range(500))
    rows = [(1, f"{text}, {item.upper()}! {text}"), (2, item), (3, f"{text} tiny item {text}"), (4, None), (5, ""), (6, text)]
    spark.createDataFrame([(1, item), (2, "Tiny item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert got == {1: f"{text}, ! {text}", 3: rows[2][1], 4: None, 5: "", 6: text}


def test_empty_tables(spark, tmp_path):
    """Every stage and every operator of documents on tables without rows."""
    for table in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == [], name
    # Documents without anything to learn from or to compare with.
    some = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(5)
    assert corpus_pipeline.decontamination(spark, some, str(tmp_path)).count() == 5
    assert corpus_pipeline.quality_classifier(spark, some, str(tmp_path)).count() in (0, 5)
