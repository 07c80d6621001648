"""Conversation repair against all edit sequences."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from foldsmith.llm import turn_repair as R

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def all_edits(rows):
    """(cost, audit) of the best edits of rows (initial, must_go, truncated): every sequence, found by plain recursion."""
    def legal_start(made):
        return any(SHAPE.match(made + rest) for rest in ("", "a", "ua"))

    best = None

    def walk(k, made, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and SHAPE.match(made) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if k < len(rows):
            initial, must_go, truncated = rows[k]
            walk(k + 1, made, cost + 3, audit + "D", 0)
            if not must_go:
                for role in "ua":
                    if legal_start(made + role):
                        walk(k + 1, made + role, cost + 2 + truncated, audit + "R", 0)
                if initial in ("s", "u", "a") and legal_start(made + initial):
                    walk(k + 1, made + initial, cost + truncated, audit + "K", 0)
        if inserted < 3:
            for role in "ua":
                if legal_start(made + role):
                    walk(k, made + role, cost + 2, audit + "I", inserted + 1)

    walk(0, "", 0, "", 0)
    return best


def decoded(rows):
    out = []
    decoder = R.Decoder(lambda edits: out.append(edits.decode()))
    for row in rows:
        decoder.row(*row)
    return decoder.finish(), "".join(out)


@pytest.mark.parametrize("length", range(4))
def test_decoder_finds_the_cheapest_and_least_edits_of_all_short_conversations(length):
    kinds = list(itertools.product("suat", [False], [False, True])) + [("u", True, False)]
    for rows in itertools.product(kinds, repeat=length):
        assert decoded(rows) == all_edits(rows), rows


def test_decoder_on_longer_conversations():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [(rnd.choice(["s", "u", "a", "u", "a", "t", ""]), rnd.random() < 0.2, rnd.random() < 0.5)
                for _ in range(rnd.randint(4, 8))]
        assert decoded(rows) == all_edits(rows), rows


def plain_viterbi(rows):
    """Cost and audit by whole strings held for every state."""
    now = {"": (0, "")}

    def insert(now):
        for _ in range(2):
            for state, (cost, audit) in list(now.items()):
                after = "u" if state != "u" else "a"
                now[after] = min(now.get(after, (1 << 60, "")), (cost + 2, audit + "I"))
        return now

    now = insert(now)
    for initial, must_go, truncated in rows:
        new = {}
        for state, (cost, audit) in now.items():
            options = [(state, cost + 3, "D")]
            if not must_go:
                after = "u" if state != "u" else "a"
                options.append((after, cost + 2 + truncated, "R"))
                if initial == after or (initial == "s" and state == ""):
                    options.append((initial, cost + truncated, "K"))
            for after, c, edit in options:
                new[after] = min(new.get(after, (1 << 60, "")), (c, audit + edit))
        now = insert(new)
    return min(now[s] for s in ("", "a") if s in now)


def test_long_open_ties_are_compared_whole_and_resolved_ones_are_let_go():
    rnd = random.Random(6)
    for kinds in ([("t", False, True)], [("u", False, True), ("t", False, True)], [("u", False, False), ("a", False, False)],
                  [("s", False, False), ("u", False, True), ("u", True, False), ("a", False, False)]):
        for _ in range(10):
            rows = [rnd.choice(kinds) for _ in range(300)]
            assert decoded(rows) == plain_viterbi(rows)
    decoder, most = R.Decoder(lambda edits: None), 0
    for k in range(20_000):
        decoder.row("ua"[k % 2], False, rnd.random() < 0.3)
        most = max(most, decoder.held())
    assert most < 20  # survivors coalesce, so a long conversation is not held


def plain_repair(rows):
    """All columns of one conversation after damage, rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    cost, audit = plain_viterbi([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults)])
    lines, todo, state = [], list(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else todo.pop(0)[1:]
        if edit == "D":
            continue
        if edit == "K":
            state = role[:1]
        else:
            state = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[state]
        lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def damaged(rows):
    out, ids = defaultdict(list), set()
    for key, turn, role, text in rows:
        ids.add(key)
        show = [" " if v is None else str(v) for v in (key, turn, role, text)]
        fault = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = "user" if fault == 4 else show[2], show[3]
        text = "" if fault < 2 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[key] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for key in ids:
        out[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(7)
    texts = ["Yes.", "No", " \t", "", None, "Why?\n", "a. b", "é!", "x" * 50_000 + ".", "Yes."]
    rows = [(key, turn if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             rnd.choice(texts)) for key in range(300) for turn in range(rnd.randint(1, 9)) if rnd.random() < 0.95]
    rows += [(None, k, "user", f"same {k % 7}") for k in range(1500)] + [(400, 3, "user", "Again.")] * 5
    return rows


def test_summaries_equal_plain_repair(spark, talks):
    df = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 as id", "'x' as gone", "2 as audit")
    want = {key: plain_repair(rows)[0] for key, rows in damaged(talks).items()}
    for parts in (1, 8):
        got = R.summarize(R.damage(df.repartition(parts)), gone_col="gone").collect()
        assert {r.conv_id: tuple(r[1:7]) + (r.audit, r.repaired_sha256) for r in got} == {
            k: v[:6] + (v[6], v[7]) for k, v in want.items()}
        assert len(got) == len(want)
    empty = R.summarize(R.damage(df.limit(0)), gone_col="gone")
    assert empty.count() == 0 and R.repair(df.limit(0)).count() == 0


def test_edits_hold_the_repaired_rows(spark, talks):
    df = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string")
    plain = defaultdict(list)
    for key, turn, role, text in talks:
        plain[key].append((turn, " " if role is None else role, " " if text is None else text))
    got = defaultdict(list)
    for r in R.repair(df).collect():
        got[r.conv_id].append(r)
    for key, rows in plain.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want, lines = plain_repair(rows)
        edits = sorted(got[key], key=lambda r: r.place)
        assert [r.place for r in edits] == list(range(len(edits))) and "".join(r.edit for r in edits) == want[6]
        assert [f"{r.role}:{r.text}" for r in edits if r.edit != "D"] == lines
        assert [(r.turn, r.text) for r in edits if r.edit != "I"] == [(t, x) for t, _, x in rows]
