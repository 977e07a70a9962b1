"""Repairs against a plain shortest path over (row, state), conversation by conversation."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from functools import cache

from fieldlab.llm import conversations
from fieldlab.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"
sys.setrecursionlimit(20000)  # of the plain repair
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, found int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """The contract's figures for one conversation's rows (turn, role, text), in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @cache
    def best(i, state, inserted):
        """(cost, audit, repaired) from row i on."""
        found = [] if i < len(rows) or state not in ("", "a") else [(0, "", ())]
        if inserted < 3:
            role = "assistant" if state == "u" else "user"
            cost, audit, rest = best(i, role[0], inserted + 1)
            found.append((cost + 3, "I" + audit, ((role, ""),) + rest))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] else 0
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (state, new[:1]) in NEXT:
                        cost, audit, rest = best(i + 1, NEXT[state, new[:1]], 0)
                        found.append((cost + price + late, edit + audit, ((new, text),) + rest))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def by_hand(rows):
    out, after = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        out[conv] = plain(own)
    return out


def result(df):
    got = df.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_given_conversations(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = result(queries()["op12_conversations"](spark, FOLDER))
    assert got == by_hand(rows) and any(r[5] for r in got.values())


def odd_rows():
    random.seed(9)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None], ["Yes.", "No", "Why?", "  ", "", None, "ok!\n", "a\x0b.", "Ü", "¿qué?"]
    rows = []
    for conv in range(150):
        for turn in range(random.choice((1, 2, 3, 5, 9, 14))):
            rows.append((conv, random.choice((turn, turn, turn, None, turn // 2, turn + 2**40)), random.choice(roles[:3] * 4 + roles), random.choice(texts) if conv % 3 else f"{turn}."))
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (900, None, "assistant", "x" * 100000)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    return rows + [(2000 + k, t, "user" if t % 3 else "system", "Well?") for k in range(40) for t in range(6)]


def test_odd_rows_and_any_grammar(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)
    want, after = by_hand(rows), conversations.damaged(frame)
    assert result(conversations.repair(after)) == want
    for rules, turns in ((1, 1), (40, 3)):
        got = {r.conv_id: (r.cost, r.audit) for r in conversations.audited(after, rules, turns).collect()}
        assert got == {c: w[5:7] for c, w in want.items()}
    assert conversations.repair(conversations.damaged(frame.limit(0))).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "And then"), (1, 3, "assistant", " "), (2, 0, "user", None)]
    frame = conversations.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    audits = conversations.audited(frame)
    got = [(r.conv_id, r.place, r.turn, r.role, r.text, r.edit) for r in conversations.repaired(frame, audits).orderBy("conv_id", "place").collect()]
    want = plain([r[1:] for r in rows[:4]])
    assert want[6] == "KRKD" and [(r.cost, r.audit) for r in audits.orderBy("conv_id").collect()] == [(want[5], want[6]), (4, "D")]
    assert got == [(1, 0, 0, "system", "Be kind.", "K"), (1, 1, 1, "user", "Hello.", "R"), (1, 2, 2, "assistant", "And then", "K")]


def test_ropes_and_rules():
    random.seed(6)
    for _ in range(300):
        sequence = "".join(random.choice("dsuaxSUAX") for _ in range(random.randint(0, 30)))
        rules, known = [], {s: conversations.base(s) for s in conversations.SYMBOLS}
        plainly, text = conversations.cheapest(sequence, known), sequence
        while len(text) > 1:
            pair = text[:2]
            rules.append(pair)
            text = text.replace(pair, chr(0xF0000 + len(rules) - 1))
        assert conversations.cheapest(conversations.compressed([sequence], rules)[0], conversations.matrices(rules)) == plainly
    rules = ["ua"] + [chr(0xF0000 + k) * 2 for k in range(11)]  # 2^12 rows behind one symbol
    text = conversations.compressed(["ua" * 2048 + "s" + "ua" * 2048], rules)[0]
    cost, audit = conversations.cheapest(text, conversations.matrices(rules))
    assert len(text) == 3 and (cost, audit) == (4, "K" * 4096 + "D" + "K" * 4096)
    rope = conversations.joined(conversations.joined("K" * 60, "D" * 60), "I")
    assert conversations.before(conversations.joined("K" * 60, "D" * 61), conversations.joined("K" * 60, "K" * 9)) and not conversations.before(rope, rope)
