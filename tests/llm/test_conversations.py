"""Conversation repair against a search of all edits, and its memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from faultline.llm import conversations as C
from faultline.llm.conversations import Repair, damage, digests, repaired_turns, repairs

WS = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired lines) of the best edits, by trying all of them; rows are (role, text, fault)."""
    best = None

    def go(i, state, cost, audit, lines, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        new = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        if inserted < 3:
            go(i, new, cost + 3, audit + "I", [*lines, name + ":"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                to = STEP.get((state, role[:1]))
                if to:
                    go(i + 1, to, cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
                go(i + 1, new, cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best


def run(rows):
    r = Repair()
    for role, text, fault in rows:
        r.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    cost, sha = r.end()
    return cost, bytes(r.out).decode().replace("L", "K"), sha


def test_repair_is_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [
            (rng.choice(["user", "assistant", "system", "tool", "u", ""]), f"t{i}", rng.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for i in range(rng.randrange(6))
        ]
        cost, audit, lines = cheapest(rows)
        assert run(rows) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def plain(rows):
    """The best (cost, audit) of each state with whole strings, row by row."""
    new = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(found):
        for _ in range(2):
            for s, (c, a) in list(found.items()):
                found[new[s]] = min(found.get(new[s], (10**9, "")), (c + 3, a + "I"))
        return found

    live = inserted({"": (0, "")})
    for role, _, fault in rows:
        found = {}
        for s, (c, a) in live.items():
            options = [(s, c + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(new[s], c + 3 + more, "R")] + ([(STEP[s, role[:1]], c + more, "K")] if (s, role[:1]) in STEP else [])
            for to, cost, e in options:
                found[to] = min(found.get(to, (10**9, "")), (cost, a + e))
        live = inserted(found)
    return min(live[s] for s in ("", "a") if s in live)


@pytest.mark.parametrize("roles", ["u", "s", "a", "su", "uuuaaa", "usa", "ua"])
def test_long_conversations(roles):
    rng = random.Random(roles)
    for _ in range(20):
        rows = [(rng.choice(roles), f"x{i}", rng.choice([None] * 9 + ["blank", "truncated"])) for i in range(rng.randrange(400))]
        assert run(rows)[:2] == plain(rows)


def nodes(root):
    return 1 + sum(map(nodes, root.kids))


def test_memory_is_bounded():
    r, rng, most = Repair(), random.Random(1), 0
    for i in range(20_000):
        r.row(rng.choice(["user", "assistant", "system"]), f"t{i}", i % 7 == 0, i % 11 == 0)
        most = max(most, len(r.out))
        r.out.clear()
        assert nodes(r.root) <= 7 and len(r.live) <= 4
    assert most < 200  # edits are settled soon after they are made
    r = Repair()
    for i in range(20_000):  # never settled: one byte an edit in a few nodes
        r.row("user", f"t{i}", False, False)
        assert nodes(r.root) <= 7
    assert r.end()[0] == 30_000


def first_faults(rows):
    """rows (turn, role, text) after damage, in order -> (role, text, fault)."""
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(WS)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(data):
    groups = defaultdict(list)
    for conv, turn, role, text in data:
        rows = groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked = first_faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(marked)
        n = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out, groups




def made_rows():
    rng, data = random.Random(2), []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "User", None, "", "tool"])
            text = rng.choice(["Fine.", "cut off", "", " \n", None, "Ünï! ", "a.b?\x0b", "y" * 20_000 + "!", f"Turn {turn}.", f"Turn {turn}"])
            data.append((conv, rng.choice([turn * 2, turn, None, turn]), role, text, True, "x"))
    return data


def test_conversations_match_the_search(spark, monkeypatch):
    data = made_rows()
    want, _ = expected([r[:4] for r in data])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, fault boolean, chunk string")
    rows = damage(df)
    got = digests(repairs(rows)).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    monkeypatch.setattr(C, "CHUNK", 3)
    small = repairs(rows)
    assert {r.conv_id: tuple(r)[1:] for r in digests(small).collect()} == want
    lines = defaultdict(list)
    for r in sorted(repaired_turns(rows, small).collect(), key=lambda r: r.position):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert (r.edit == "I") == (r.text == "" and r.turn is None and r.edit != "K") or r.text
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(repairs(damage(empty))).collect() == []
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (1, 1, "user", "b.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    row = digests(repairs(gone)).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
