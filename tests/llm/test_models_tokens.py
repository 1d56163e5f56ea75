"""Scores, rules, decontamination, token ids and chats: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from pageloom.llm import backoff, bpe, chat, contamination, factors, stats, token_files, toxicity, trees
from pageloom.llm import words as W
from pageloom.llm.frames import BATCH_BYTES, importable, new_folder
from tests.llm.conftest import BENCHMARK, corpus
from tests.llm.test_repeats_near import LOW, words


def hits(text: str | None) -> tuple[int, int, list[str]]:
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) if w]
    w, hit, found = cut(text), set(), set()
    for item, t in BENCHMARK:
        it = cut(t)
        n = min(13, len(it))
        runs = {tuple(it[k : k + n]) for k in range(len(it) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in runs:
                hit.update(range(k, k + n))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_words", [200_000, 8])
def test_contamination_like_brute_force(docs, benchmark, shard_words):
    got = contamination.find_contamination(docs, benchmark, shard_words=shard_words).collect()
    key = lambda r: str(r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == sorted([(i, *hits(t)) for i, t in corpus()], key=key)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_cut_spans(docs, benchmark):
    got = {r["doc_id"]: r["text"] for r in contamination.cut_spans(contamination.find_contamination(docs, benchmark), least=3).collect()}
    assert 70 not in got and 72 not in got and "short item" not in got[71]
    assert got[86] == dict(corpus())[86]


def test_automaton_against_all_runs():
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    automaton = contamination.build(items, 4)
    number = {w: i for i, w in enumerate(automaton.vocabulary.tolist())}
    to = {x: number[int(W.hashes(W.words(pa.array([x])))[0])] for x in "ab"}
    text = [rng.choice("ab") for _ in range(60)]
    for at, _, size in automaton.walk([to[x] for x in text]):
        longest = next(n for n in range(at + 1, -1, -1) if any(" ".join(text[at + 1 - n : at + 1]) in t for _, t in items))
        assert size == longest


def test_scores_like_brute_force(docs):
    got = backoff.score_texts(docs, "crc32(cast(doc_id as string)) % 7 = 2").collect()
    texts = [[*words((t or "").translate(LOW)), None] for _, t in corpus()]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus()]
    one, two = Counter(), Counter()
    for t, held in zip(texts, out, strict=True):
        if not held:
            one.update(t)
            two.update(zip(t, t[1:], strict=False))
    n, v, once, twice = sum(one.values()), len(one), sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    cut = once / (once + 2 * twice)
    expected = []
    for (i, _), t, held in zip(corpus(), texts, out, strict=True):
        score = 0.0
        for before, w in zip([None, *t], t, strict=False):
            p = (one[w] - cut) / n if one[w] else cut * v / n
            first = before is None
            score += math.log10(p if first or not one[before] else 0.4 * two[before, w] / one[before] + 0.6 * p)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        expected.append((str(i), held, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    found = [(str(r[0]), r[1], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(found) == sorted(expected)


def test_counts_like_brute_force():
    texts = [t for _, t in corpus()]
    w = W.words(pa.array(texts, pa.string()))
    c = stats.counts(w, W.hashes(w))
    for k, text in enumerate(texts):
        t, split = text or "", words(text)
        lines = [x for x in t.split("\n") if words(x)]
        five = Counter(tuple(split[i : i + 5]) for i in range(len(split) - 4))
        again = {j for i in range(len(split) - 4) if five[tuple(split[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(split), sum(map(len, split)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again))
        assert tuple(int(c[n][k]) for n in stats.COUNTS) == want


def test_classifiers_tell_held_out_rows_apart(docs, labelled):
    learn = "doc_id % 2 = 0"
    good = {100 + i: i % 3 != 1 for i in range(60)}
    scored = {r["doc_id"]: r["score"] for r in factors.score_quality(docs, factors.train(docs, labelled, learn=learn)).collect()}
    held = [i for i in good if i % 2]
    assert min(scored[i] for i in held if good[i]) > max(scored[i] for i in held if not good[i])
    fitted = trees.train(docs, labelled, learn=learn)
    rules = {r["doc_id"]: r for r in trees.quality_rules(docs, fitted).collect()}
    assert all(rules[i]["kept"] == good[i] for i in held)
    assert rules[81]["base_failed"] and rules[92]["base_failed"] and not rules[80]["kept"]
    machine = toxicity.train(docs, labelled, learn=learn)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert min(toxic[i] for i in held if (i - 100) % 3 == 0) > 0.5 > max(toxic[i] for i in held if (i - 100) % 3)
    assert all(0 <= s <= 1 for s in [*toxic.values(), *scored.values()])
    assert toxic[80] == toxic[81]


def test_gapped_spellings_score_like_the_word():
    texts = [f"some plain words number {i} stand here" + (" you idiot" if i % 4 == 0 else "") for i in range(200)]
    machine = toxicity.fit(texts, np.array([int(i % 4 == 0) for i in range(200)]))
    score = lambda t: machine.score(machine.worst(toxicity.units(pa.array([t]))))[0]
    assert min(score("he is an idiot"), score("an id-iot"), score("i.d.i.o.t"), score("an i d i o t")) > 0.5 > score("plain words here")


def brute_triples(word: str) -> list[tuple[tuple, float]]:
    """Every triple of a word of letters with its weight, edges written as ^."""
    letters = ["^", *word, "^"]
    return [
        ((letters[i - a], letters[i], letters[i + b]), toxicity.GAP ** (a + b - 2))
        for i in range(1, len(letters) - 1) for a in range(1, 5) for b in range(1, 6 - a) if i - a >= 0 and i + b < len(letters)
    ]


def test_kernel_like_brute_force():
    names = ["idiot", "idixot", "scum", "plain", "abcdef", "tion"]
    w = W.words(pa.array([" ".join(names)]))
    few = toxicity._some(w, np.arange(len(names)))
    got = toxicity.kernel(few, toxicity._features([few]))
    size = lambda n: math.sqrt(sum(x * x for _, x in brute_triples(n)))
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = sum(a * b for t, a in brute_triples(x) for u, b in brute_triples(y) if t == u)
            assert abs(got[i, j] - min(both / size(x) / size(y), 1)) < 1e-5
    table = np.zeros(toxicity._DIM)
    for _, number, weight in toxicity.triples(toxicity._some(w, np.array([2]))):
        np.add.at(table, number, weight)
    total = Counter()
    for t, x in brute_triples("scum"):
        total[t] += x
    assert abs(toxicity.weigh(few, table)[2] - sum(x * x for x in total.values()) / size("scum")) < 1e-6


def test_stems_in_several_languages_are_learnt():
    """Insults that are a stem with any ending, beside ordinary words made of the same pieces."""
    rng = random.Random(3)
    parts = {"de": ["ach", "lich", "keit", "ung", "ver", "ein", "pf", "st"], "fr": ["r\u00e9", "eux", "ment", "que", "ou", "\u00ea", "aux", "ai"]}
    stem = {"de": "achlich", "fr": "r\u00e9eux"}

    def text(i: int) -> tuple[str, int]:
        lang, toxic = ("de", "fr", "en")[i % 3], i % 7 == 0
        if lang == "en":
            made = [rng.choice(["some", "plain", "words", "of", "text", "here"]) for _ in range(40)]
            made += [rng.choice(["idiot", "moron", "scum"])] if toxic else []
        else:
            made = ["".join(rng.choices(parts[lang], k=rng.choice([2, 2, 3, 4]))) for _ in range(40)]
            made = [w for w in made if not w.startswith(stem[lang])]
            made += [stem[lang] + rng.choice(parts[lang]) for _ in range(3)] if toxic else []
        rng.shuffle(made)
        return " ".join(made), int(toxic)

    rows = [text(i) for i in range(2400)]
    learn, held = rows[:1800], rows[1800:]
    machine = toxicity.fit([t for t, _ in learn], np.array([y for _, y in learn]))
    scores = machine.score(machine.worst(toxicity.units(pa.array([t for t, _ in held]))))
    for k in range(3):
        found = [(s >= 0.5, y) for i, (s, (_, y)) in enumerate(zip(scores, held, strict=True)) if i % 3 == k]
        assert sum(f for f, y in found if y) >= 0.9 * sum(y for _, y in found)
        assert sum(f for f, y in found if not y) <= 0.02 * len(found)


def test_what_is_remembered_does_not_change_scores():
    texts = [f"some plain words number {i} stand here" + (" you idiot" if i % 4 == 0 else "") for i in range(200)]
    machine = toxicity.fit(texts, np.array([int(i % 4 == 0) for i in range(200)]))
    some = ["", "an idiot", "plain", "idiot words, zebra", "q", "plain idioot here"]
    fresh = []
    for t in some:
        machine.keys, machine.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        fresh.append(machine.worst(toxicity.units(pa.array([t])))[0])
    for t, value in zip(some * 2, fresh * 2, strict=True):
        assert machine.worst(toxicity.units(pa.array([t])))[0] == value


def test_insults_outlive_some_wrong_labels():
    insults = ("idiot", "moron", "scumbag", "loser")
    texts = [f"some plain words number {i} stand here" + (f" you {insults[i // 4 % 4]}" if i % 4 == 0 else "") for i in range(800)]
    wrong = {4 * i for i in (16, 41, 66, 91, 116, 141)}
    machine = toxicity.fit(texts, np.array([int(i % 4 == 0 and i not in wrong) for i in range(800)]))
    score = lambda t: machine.score(machine.worst(toxicity.units(pa.array([t]))))[0]
    assert min(score(f"he is an {x}") for x in insults) > 0.5 > score("plain words here")


def test_trees_fall_on_falling_features():
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    fitted = trees.fit(x, ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.2)).astype(float), [True, False])
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.5)])
    assert (np.diff(fitted.score(grid)) <= 1e-12).all()


def test_models_without_labels(docs, labelled, empty):
    none = labelled.limit(0)
    assert factors.score_quality(docs, factors.train(docs, none)).count() == len(corpus())
    assert trees.quality_rules(docs, trees.train(docs, none)).count() == len(corpus())
    assert toxicity.score_toxicity(docs, toxicity.train(docs, none)).count() == len(corpus())
    assert backoff.score_texts(empty, "false").collect() == []


def test_byte_bpe_like_the_library(docs, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)
    monkeypatch.setattr(bpe, "LEAF", 8)
    own, rng = bpe.Bpe(bpe.read_ranks(path), pattern), random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab's'tre  \n\n\t xÉ中\x1c\x85　1٣!?​😀́\0") for _ in range(rng.randint(0, 120)))
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    for text in ("a" * 5000, " " * 3000, "\n" * 999 + "x", "!?" * 2000):
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_workers_hold_little(spark):
    importable(spark)
    texts = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('abcdefgh', 400) as text")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 1.1 * BATCH_BYTES
    own = bpe.Bpe({bytes([b]): b for b in range(256)} | {b"ab": 256}, public_tokenizers.PATTERN)
    assert own.decode(np.array([256, 99])) == b"abc" and "pairs" not in vars(own)
    for i in range(3 * bpe.REMEMBERED // 1000):
        own.codes([f"{k:x}" for k in range(1000 * i, 1000 * i + 1000)], False)
    assert 0 < len(own.known) + len(own.old) <= 200_000


def test_byte_bpe_does_not_depend_on_what_is_remembered():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own, spaces = bpe.Bpe(bpe.read_ranks(path), pattern), (" ", "\u00a0", "\u3000", "\n", "\t", "\x1c", "\x85")
    for _ in range(2):
        for s in spaces:
            for text in (f"a {s} b", f"x {s} {s} b", f"x {s}", f"{s} {s} y", f" {s} {s} {s} {s}z", f"x{s} {s} b"):
                assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_token_files_round_trip(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, path, end_id=1, shards=5)
    got = [(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.checksums(token_files.read_tokens(spark, folder)).collect()]
    expected, start = [], 0
    for i, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((start, i, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[0]) == expected
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(empty, folder, path, end_id=1, shards=1)
    assert token_files.checksums(token_files.read_tokens(spark, folder)).collect() == []


def test_words_of_odd_texts_encode_like_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.WordCodes(open(path).read())
    for text in ("Foo's it's, don't-- a'b ΑΣ. é,É é, x_y y!!'s 12, a1.", "\n\t a\x0bb\xa0c　d", "ß.ſ,İ. ĳ", "!'ll 'LL, can'T!", ""):
        assert own.encode(pa.array([text]), 1)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_pieces_of_one_word_in_any_order():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    made = ["the", "w2", "", "a", "zebra", "w2", "Éa", "12", "the the", "q", "-", "x y z"]
    for shuffled in range(40):
        texts = made[:]
        random.Random(shuffled).shuffle(texts)
        own = token_files.WordCodes(open(path).read())
        for text in texts:
            assert own.encode(pa.array([text]), 1)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_layout_of_token_files(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1, shards=3)
    files = sorted(Path(folder).glob("*.parquet"))
    assert len(files) == 3
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        held = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
        ids = next(c for name, c in held.items() if name.startswith("ids"))
        assert ids.has_dictionary_page and ids.has_column_index and ids.has_offset_index and ids.compression == "ZSTD"
    plan = token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_ids_are_not_shuffled_on_reading(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1, shards=3)
    plan = token_files.checksums(token_files.read_tokens(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_large_counts_are_whole():
    counts = np.array([1, 2**32 - 1, 2**32, 5 * 10**12], np.int64)
    rows = [backoff._rows(np.arange(4, dtype=np.uint64), np.full(4, 2**31), b, 1) for b in range(4)]
    told = backoff._add_up((0,), pa.Table.from_batches(rows))
    assert backoff._unplaned(told["counts"][0].as_py(), np.uint64).tolist() == [2**33] * 4
    assert backoff._unplaned(backoff._planes(counts.astype(np.uint64)), np.uint64).tolist() == counts.tolist()


def test_chats_collapse_to_the_longest(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 3), (3, 4), (4, 4), (5, 2)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", None), (8, 0, "user", ""), (None, 0, "user", "x"), (6, 1, "assistant", "other")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(turns).collect()}
    assert set(got) == {3, 6, 7, 8} and got[3][0] == 4 and got[6][0] == 2
    assert got[6][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.format_chats(turns.limit(0)).collect() == []
