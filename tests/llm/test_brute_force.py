"""Scores, packing and the whole pipeline against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgrid.llm import mixing, packing, quality, toxicity, url_filter
from tests.llm.test_corpus import EDGES, docs, labelled, lower, shingles
from tests.llm.test_near_dedup import components_of
from tests.oracle import DATA


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def word_signs(text):
    """Signs of a text without any disguise: whole words of 3 to 10 letters, and beginnings of 3 to 8 of longer ones."""
    found = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if 3 <= len(w) <= 10:
            found.add(f"={w}")
        found.update(f"^{w[:k]}" for k in range(3, 9) if len(w) > k)
    return found


def test_toxicity_scores_are_those_of_a_plain_regression(spark):
    d, labels = labelled(spark)
    rows = [r for r in d.collect() if r.doc_id is not None and r.doc_id < 400]
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    fit = [r for r in rows if r.doc_id in label and fold(r.doc_id, 5)]
    n, t = Counter(), Counter()
    for r in fit:
        n.update(word_signs(r.text))
        if label[r.doc_id]:
            t.update(word_signs(r.text))
    # labels without a document count as rows, as do those of ids that aren't held out
    known = [v for i, v in label.items() if i is not None and fold(i, 5)]
    base, total = sum(known) / len(known), len(n)
    kept = []
    for s in n:
        share = t[s] / n[s]
        if share > base:
            strength = n[s] * (share * math.log(share / base) + (0 if share == 1 else (1 - share) * math.log((1 - share) / (1 - base))))
            if strength > math.log(total / toxicity.ERROR):
                kept.append(s)
    plain = d.where("doc_id < 400")
    model, vocabulary, weights, offset = toxicity.train(plain, labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))
    assert set(vocabulary) == set(kept) and kept
    # the weights are where the penalised likelihood is flat
    x = np.array([[s in word_signs(r.text) for s in vocabulary] for r in fit], float)
    y = np.array([label[r.doc_id] for r in fit], float)
    p = 1 / (1 + np.exp(-(x @ weights + offset)))
    assert np.abs(x.T @ (p - y) + toxicity.RIDGE * weights).max() < 0.05 and abs((p - y).sum()) < 0.05
    got = {r.doc_id: r.score for r in toxicity.classify(plain, labels).collect()}
    for r in rows:
        z = offset + sum(weights[vocabulary[s]] for s in word_signs(r.text) if s in vocabulary)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_quality_scores_are_differences_of_log_densities(spark):
    rng = random.Random(21)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("abcdeXYZ!|.") for _ in range(rng.randrange(1, 9 if i % 3 else 4))) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(w), ""))
    d = docs(spark, rows)
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(d, lab).collect()}
    x = {i: np.array(quality.statistics(t)) for i, t, _ in rows}
    own = [np.array([x[i] for i in x if fold(i, 3) != 1 and (i % 3 > 0) == bool(k)]) for k in (0, 1)]
    p, total = len(quality.FEATURES), sum(map(len, own))
    scatter = [(v - v.mean(0)).T @ (v - v.mean(0)) for v in own]
    pooled = sum(scatter) / (total - 2) + quality.FLOOR * np.eye(p)
    logs = []
    for v, s in zip(own, scatter, strict=True):
        few = quality.SHRINK_POOLED + (1 - quality.SHRINK_POOLED) * p / (p + len(v))
        cov = (1 - few) * s / (len(v) - 1) + few * pooled
        cov = (1 - quality.SHRINK_DIAGONAL) * cov + quality.SHRINK_DIAGONAL * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(p)
        prior = math.log((len(v) + 1) / (total + 2))
        logs.append({i: prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (z - v.mean(0)) @ np.linalg.solve(cov, z - v.mean(0)) for i, z in x.items()})
    for i in x:
        assert got[i] == pytest.approx(1 / (1 + math.exp(min(700, logs[0][i] - logs[1][i]))), abs=1e-6)


@pytest.mark.parametrize("seed,open_bins", [(1, 4096), (2, 7), (3, 1)])
def test_best_fit_is_best_fit(seed, open_bins):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(800)]
    bins, offsets = packing.best_fit(sizes, 64, open_bins)
    free, closed, packed = {}, set(), Counter()
    for size, b, at in zip(sizes, bins, offsets, strict=True):
        fits = [f for f in free.values() if f >= size]
        if fits:
            assert free[b] == min(fits)
        else:
            assert b not in free and b not in closed
            if len(free) >= open_bins:
                low = min(free.values())
                # of equally full ones any may close: the one that is not used again
                gone = next((x for x in free if free[x] == low and x not in bins[sum(packed.values()) :]), None)
                gone = gone if gone is not None else next(x for x in free if free[x] == low)
                closed.add(gone)
                del free[gone]
            free[b] = 64
        assert at == 64 - free[b]
        free[b] -= size
        packed[b] += 1
        if not free[b]:
            closed.add(b)
            del free[b]


def brute_pipeline(rows, toxic, path):
    """Pieces that run() must pack, of (doc_id, text, source) and the ids that the score rejects."""
    from tokenizers import Tokenizer

    rows = [r for r in rows if r[0] not in toxic]
    best = {}
    for i, t, s in rows:
        key = lower(t or "")
        if key not in best or i > best[key][0]:
            best[key] = (i, t, s)
    rows = sorted(best.values())
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    part = components_of(sets)
    rows = [r for r in rows if part[r[0]] == r[0]]
    sizes = Counter()
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    for i, _, s in rows:
        sizes[s] += n[i]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not stop:
            break
        target |= {s: 3 * sizes[s] for s in stop}
        left -= sum(3 * sizes[s] for s in stop)
        open_ -= stop
    target |= {s: level * weight[s] for s in open_}
    t = Tokenizer.from_file(path)
    pieces = Counter()
    coin = lambda key: int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:12], 16) / 2**48
    for k, (i, text, s) in enumerate(sorted(rows, key=lambda r: (r[2] is None, r[2] or "", n[r[0]], coin(r[0]), r[0]))):
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        upto = lambda k: math.floor(k * (rate - math.floor(rate)) + coin(f"source:{s}"))  # noqa: E731, B023
        times = math.floor(rate) + upto(k + 1) - upto(k)
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += times
    return +pieces


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers

    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in base.collect()]
    toxic = {r.doc_id for r in toxicity.classify(base, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute_pipeline(rows, toxic, public_tokenizers.path("byte_bpe_50k.json"))
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 0, 0), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", EDGES), ("none", [])):
        docs(spark, rows).withColumns({"lang": F.lit("x"), "n_chars": F.lit(1)}).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # of equal texts one is left, of empty ones none has words; what has words is taken as the mix says
    assert {r.doc_id for r in out} <= {3, 2, 4, 7, 8} and 7 in {r.doc_id for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_very_long_urls_and_pages(spark):
    long = "a" * 200_000
    html = '<a href="http://h.com/x">' * 20_000
    df = spark.createDataFrame([(1, f"http://{long}.net/{long}?{long}", html), (2, "http://h.com/" + long, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert (got[1].rule, got[1].verdict, len(got[1].path)) == ("net/", "block", 200_001) and got[2].rule is None
