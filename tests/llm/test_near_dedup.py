"""Near dedup: large groups of variants, repeated ids, and recall just above the threshold."""

import random

import pytest

from loadgrid.llm import near_dedup
from tests.llm.test_corpus import docs, shingles


def components_of(sets):
    """Smallest key that links reach, by all pairs."""
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("seed,words,edits,group_bytes", [(1, 150, 6, 32_000_000), (3, 60, 9, 2000)])
def test_a_hot_group_of_variants_between_links_and_none(spark, monkeypatch, seed, words, edits, group_bytes):
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", group_bytes)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    other = [*base[: words // 2], *(f"v{i}" for i in range(words // 2))]  # a second middle, half of it the first's
    rows = []
    for i in range(220):
        w = list(base if rng.random() < 0.7 else other)
        if rows and rng.random() < 0.3:
            w = list(rng.choice(rows))
        for _ in range(rng.randrange(edits)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                w.insert(at, f"x{rng.randrange(40)}")
            elif kind == 1:
                del w[at]
            else:
                w[at] = f"x{rng.randrange(10_000)}"
        rows.append(w)
    texts = [(i, " ".join(w), "") for i, w in enumerate(rows)]
    want = components_of({i: shingles(t, 4) for i, t, _ in texts})
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(spark, texts), width=4).collect()}
    assert len(set(want.values())) > 5 and got == want


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    a, b = ([f"{c}{i}" for i in range(80)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(a), ""), (1, " ".join(b), ""), (2, near(a), ""), (3, near(b), ""), (5, " ".join(a), ""), (5, "lone words stand here alone", ""), (None, near(a), ""), (None, "no id has this one text", "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dedup.near_groups(docs(spark, rows), width=4).collect())
    assert got == [(-1, 3, -1, True), (-1, 77, 1, False), (1, 77, 1, True), (1, 77, 1, True), (2, 77, 1, False), (3, 77, 1, False), (5, 2, 5, True), (5, 77, 1, False)]
    left = near_dedup.without_near_copies(docs(spark, rows), width=4)
    assert left.columns == docs(spark, rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == sorted([(-1, rows[7][1]), (1, rows[0][1]), (1, rows[1][1]), (5, rows[5][1])])
    assert near_dedup.without_near_copies(docs(spark, [])).count() == 0


def test_recall_just_above_the_threshold(spark):
    """Pairs between 0.80 and 0.83: the chance that one of them shares no band is 3e-6 at most."""
    rng = random.Random(11)
    rows, pairs = [], 0
    for k in range(1000):
        w = [f"{k}x{i}" for i in range(rng.randrange(60, 200))]
        v = list(w)
        sets = [shingles(" ".join(w), 4), set()]
        while True:
            v[rng.randrange(len(v))] = f"{k}y{rng.randrange(10_000)}"
            sets[1] = shingles(" ".join(v), 4)
            alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            if alike < 0.83:
                break
        if alike >= 0.8:
            rows += [(2 * k, " ".join(w), ""), (2 * k + 1, " ".join(v), "")]
            pairs += 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(spark, rows), width=4).collect()}
    assert pairs > 200 and sum(got[i] == i - 1 for i in got if i % 2) == pairs


def test_parts_are_bounded_by_rows_and_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 50)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 1_000_000)
    # leaders: 0 with short members, 10_000 with long ones, 20_000 a long one with short members, 30_000 alone with one of 5 MB
    sizes = {0: 100, 10_000: 100, 20_000: 100_000, 30_000: 100} | {i: 100 for i in range(1, 1001)} | {10_000 + i: 50_000 for i in range(1, 1001)} | {20_000 + i: 10 for i in range(1, 301)} | {30_001: 5_000_000}
    pairs = [(i // 10_000 * 10_000, i) for i in sizes if i % 10_000]
    members, counts = near_dedup.dealt(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(sizes.items()), "node long, bytes long"))
    held, parts = {}, {r.leader: r.parts for r in counts.collect()}
    rows = members.collect()
    assert sorted((r.leader, r.member) for r in rows) == sorted(pairs)
    for r in rows:
        held.setdefault((r.leader, r.part), []).append(sizes[r.member] + sizes[r.leader])
    assert parts == {0: 20, 10_000: 51, 20_000: 31, 30_000: 6}
    # a hash deals them: about even
    assert all(len(x) < 2 * 50 and (sum(x) < 2.5 * 1_000_000 or len(x) == 1) for x in held.values())
