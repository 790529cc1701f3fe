"""Removal of repeated passages against plain sets of windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from loadgrid.llm import registry, substring_dedup as sd
from tests.llm.test_corpus import EDGES, docs
from tests.oracle import DATA


def plain(rows):
    """{row: (n_words, n_removed, sha256)} of rows (id, text), in order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()), key=str)


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = registry.QUERIES["op13_substring_dedup"](spark, DATA)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == plain(rows)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    phrase = text(20)
    rows = []
    for i in range(160):
        w = text(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + text(rng.randrange(0, 40))
        if i % 3 == 0:
            w += phrase + text(60)
        if i % 7 == 0 and rows:
            w = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w)) if w else 0 :][:1] = ["changed"]
        rows.append((rng.randrange(1000), w))
    return [(i, rng.choice([" ", "\n", "  \t"]).join(w)) for i, w in rows]


@pytest.mark.parametrize("hot", [2048, 2])
def test_passages_and_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "DEALT", 40)
    rows = corpus(hot)
    assert got(sd.without_repeats(docs(spark, [(*r, "a") for r in rows]).repartition(5))) == plain(rows)
    assert sum(r[2] for r in plain(rows)) > 1000


def test_edges(spark):
    same = "a " * 70
    rows = [(i, t) for i, t, _ in EDGES] + [(None, same), (20, same), (20, same), (21, same), (22, "b " * 49), (23, "b " * 49), (24, "b " * 50 + "é\x1c x"), (25, "b\n" * 50 + "y"), (26, "x " + "b " * 51), (30, "word " * 200), (3, "word " * 60)]
    assert got(sd.without_repeats(docs(spark, [(*r, "a") for r in rows]))) == plain(rows)
    assert sd.without_repeats(docs(spark, [])).count() == 0


def test_a_passage_in_a_third_of_the_rows_is_few_strings():
    rng = np.random.default_rng(1)
    passage = [b"p%d" % k for k in range(300)]
    inner = set()
    for d in range(30):
        words = [b"u%d" % k for k in rng.integers(0, 10**6, 80)] + passage + [b"v%d" % k for k in rng.integers(0, 10**6, 80)]
        key, start, count = sd.super_kmers(words)
        assert count.sum() == len(words) - 49 and (np.diff(start) == count[:-1]).all() and count.max() <= sd.MOST
        own = {(s - 80, c) for s, c in zip(start.tolist(), count.tolist()) if s >= 80 and s + c + 49 <= 380}
        inner = own if d == 0 else inner & own
    assert len(inner) >= 4


def test_window_ranks():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 400)
    words[200:300] = words[50:150]
    rank = sd.window_ranks(words)
    named = {}
    for k in range(len(words) - 49):
        assert named.setdefault(tuple(words[k : k + 50]), rank[k]) == rank[k]
    assert len(set(named.values())) == len(named) and len(rank) == 351
