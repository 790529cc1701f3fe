"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from loadgrid.llm import conversations as cv, registry
from tests.oracle import DATA

SCHEMA = "conv_id long, turn long, role string, text string, conv string, rank long, copy int, letters string, piece long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        as_text = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{as_text(conv)}:{as_text(turn)}".encode()) % 20
        role, text = as_text(role), as_text(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def best(rows):
    """(cost, audit, repaired lines) by trying every edit; rows are (role, text, fault)."""

    def step(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @lru_cache(None)
    def rest(k, state, inserted):
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, more):
            if more is not None:
                found.append((cost + more[0], letter + more[1], line + more[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                if to := step(state, role[0]):
                    add(5, "I", (role + ":",), rest(k, to, inserted + 1))
        if k < len(rows):
            role, text, fault = rows[k]
            add(2, "D", (), rest(k + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if to := step(state, role[:1]):
                    add(extra, "K", (f"{role}:{text}",), rest(k + 1, to, 0))
                for new in ("user", "assistant"):
                    if to := step(state, new[0]):
                        add(1 + extra, "R", (f"{new}:{text}",), rest(k + 1, to, 0))
        return min(found, key=lambda f: f[:2]) if found else None

    return rest(0, "", 0)


def plain(rows):
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, faulty = set(), []
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        count = lambda k: sum(f == k for _, _, f in faulty)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = best(tuple(faulty))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def test_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.QUERIES["op12_conversation_repair"](spark, DATA)) == plain(rows)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(["Yes.", "No", "", " \t\n", f"Text {turn}.", f"Text {turn}", "Why?\n ", "é!", " ", None])
            rows.append((conv if conv % 9 else None, rng.choice([turn, turn, turn * 2, None]) if conv % 5 == 0 else turn, rng.choice(["user", "assistant", "system", "tool", "", None, "usr"]) if conv % 2 else ("user", "assistant")[turn % 2], text))
    return rows


@pytest.mark.parametrize(("piece", "convs", "most"), [(4096, 60, 14), (7, 60, 14), (16, 3, 160), (3, 40, 12)])
def test_random_conversations_in_pieces(spark, monkeypatch, piece, convs, most):
    monkeypatch.setattr(cv, "PIECE", piece)
    rows = random_rows(piece, convs, most)
    assert got(cv.repair_damaged(frame(spark, rows).repartition(6))) == plain(rows)


def test_edges(spark):
    rows = [(1, None, "user", "A."), (1, None, "user", "A."), (1, None, "assistant", "B."), (2, 5, None, None), (3, 1, "user", "word " * 50_000 + "."), (3, 2, "assistant", "End!"), (4, -(2**40), "user", "x"), (4, 2**40, "assistant", "y?")]
    rows += [(k, 0, "user", "Only.") for k in range(100, 160)]
    assert got(cv.repair_damaged(frame(spark, rows))) == plain(rows)
    assert cv.repair_damaged(frame(spark, [])).count() == 0
    far = cv.report(spark.createDataFrame([(1, -(2**63), "user", "A.", 0), (1, 2**63 - 1, "assistant", "B.", 0)], "conv long, turn long, role string, text string, copy int"), spark.createDataFrame([(1,)], "conv long")).first()
    assert far.gaps is None and far.audit == "KK"


def test_named_and_missing_conversations_are_apart(spark):
    rows = spark.createDataFrame([("null", 0, "user", "A."), ("null", 1, "assistant", "B."), (None, 0, "user", "A."), (None, 1, "assistant", "B."), ("=null", 0, "user", "A.")], "conv string, turn long, role string, text string").selectExpr("*", "0 AS copy")
    got = {r.conv_id: (r.duplicate, r.audit) for r in cv.report(rows, rows.select("conv")).collect()}
    assert got == {"null": (0, "KK"), None: (0, "KK"), "=null": (0, "D")}


def test_checkpointed_walk_is_the_least_of_the_cheapest():
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "x"]
    for _ in range(300):
        n = rng.randrange(0, 12)
        kinds = [(rng.randrange(4), rng.choice([0, 0, 1, 2])) for _ in range(n)]
        faulty = tuple((roles[r], "t", ("", "truncated", "blank")[f]) for r, f in kinds)
        cost, audit, _ = best(faulty)
        steps = list(cv.walk(kinds, 0, cv.END, True))
        assert "".join(s[0] for s in steps) == audit and sum(s[3] for s in steps) == cost == cv._back(kinds, cv.END)[0]
