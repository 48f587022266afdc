"""Repairs against a search over all edits, turn by turn."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
from conftest import rows_of

from cotejo.llm import conversation_repair as repair_module
from cotejo.llm import interval_parse as parse
from cotejo.llm import queries
from cotejo.llm.conversation_repair import damaged, repair, turns_of

SPACES = " \t\n\x0b\x0c\r"


def cheapest_by_hand(turns, doomed, cut):
    """Least (cost, audit) and its lines: states with insertions, then one turn after the other."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for p, (cost, audit, lines) in list(out.items()):
                for q, role in (("u", "user"), ("a", "assistant")):
                    if (p, q) in legal:
                        new = (cost + 2, audit + "I", [*lines, role + ":"])
                        out[q] = min(out.get(q, new), new)
        return out

    states = inserted({"": (0, "", [])})
    for (role, text), gone, short in zip(turns, doomed, cut, strict=True):
        after = {}
        for p, (cost, audit, lines) in states.items():
            options = [(p, cost + 3, audit + "D", lines)]
            if not gone:
                options.append((role[:1], cost + short, audit + "K", [*lines, f"{role}:{text}"]))
                for q, name in (("u", "user"), ("a", "assistant")):
                    options.append((q, cost + 2 + short, audit + "R", [*lines, f"{name}:{text}"]))
            for q, *new in options:
                if new[1][-1] == "D" or (p, q) in legal:
                    after[q] = min(after.get(q, tuple(new)), tuple(new))
        states = inserted(after)
    return min(states[q] for q in ("", "a") if q in states)


def damage_by_hand(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        yield from [(conv, turn, "user" if code == 4 else role, text)] * (1 + (code == 3))


def repair_by_hand(rows, convs):
    out = {}
    for conv in convs:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        turns = [(r[2], r[3]) for r in own]
        faults = []
        for i, (role, text) in enumerate(turns):
            inner = text.strip(SPACES)
            faults.append(
                "blank" if not inner else "duplicate" if (role, text) in turns[:i]
                else "truncated" if inner[-1] not in ".!?" else ""
            )
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
        cost, audit, lines = cheapest_by_hand(
            turns, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults]
        )
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_all_edits_of_short_sequences():
    """The hand search itself, against every sequence of edits."""
    rng = random.Random(5)
    fill = ["", "u", "a", "ua", "au", "uu", "aa"]
    for _ in range(25):
        turns = [(rng.choice("suax"), str(i)) for i in range(rng.randint(0, 3))]
        gone, short = ([rng.random() < 0.3 for _ in turns] for _ in range(2))
        found = []
        for edits in itertools.product("DKua", repeat=len(turns)):
            if any(g and e != "D" for g, e in zip(gone, edits, strict=True)):
                continue
            for adds in itertools.product(fill, repeat=len(turns) + 1):
                roles, audit, cost = adds[0], "I" * len(adds[0]), 2 * len("".join(adds))
                for (role, _), e, s, add in zip(turns, edits, short, adds[1:], strict=True):
                    roles += "" if e == "D" else role if e == "K" else e
                    audit += e if e in "DK" else "R"
                    cost += 3 if e == "D" else s + 2 * (e != "K")
                    roles, audit = roles + add, audit + "I" * len(add)
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
        assert min(found) == cheapest_by_hand(turns, gone, short)[:2]


def test_parse_equals_search_and_any_split():
    rng = random.Random(7)
    for n in [*range(1, 16), 24, 25, 40, 61]:
        for _ in range(12):
            turns = [(rng.choice("suuaax"), str(i)) for i in range(n)]
            fault = [rng.choice([0, 0, 0, 1, 2]) for _ in turns]
            kinds = np.array(
                [3 * parse.INITIALS.get(r, parse.OTHER) + f for (r, _), f in zip(turns, fault, strict=True)]
            )
            cells = parse.span_cells([kinds])[0]
            want = cheapest_by_hand(turns, [f == 2 for f in fault], [f == 1 for f in fault])
            assert parse.conclusion(cells) == want[:2]
            assert parse.Repair().lines(want[1], turns) == want[2]
            if n > 1:
                cut = rng.randrange(1, n)
                halves = parse.span_cells([kinds[:cut], kinds[cut:]])
                assert parse.joined(*halves) == cells


def test_query_equals_search(spark):
    table = queries.table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = repair_by_hand(list(damage_by_hand(rows)), {r[0] for r in rows})
    got = as_dict(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01"))
    assert got == want


def odd_rows():
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "")]
    rows += [(8, 3, "", "x."), (9, 1, "user", "A?"), (9, 1, "user", "A?"), (9, 1, "assistant", "A?")]
    rows += [(9, -4, "tool", "z!"), (10, 2, "System", "ok.")]
    texts = ["Yes.", "No", " ", "What?", "a: b\n.", "漢字。", "é.", None]
    for conv in range(20, 60):
        for _ in range(rng.randint(1, 40)):
            turn = rng.choice([None, *range(6)] if conv % 2 else range(50))
            role = rng.choice(["user", "assistant", "system", "usr", None])
            rows.append((conv, turn, role, rng.choice(texts)))
    return rows


def test_odd_rows_in_one_task_and_in_blocks(make, monkeypatch):
    monkeypatch.setattr(repair_module, "BLOCK_ROWS", 5)
    monkeypatch.setattr(repair_module, "FAN_IN", 3)
    rows = odd_rows()
    table = make(rows, "conv_id long, turn long, role string, text string").cache()
    plain = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    for rows_after, turns in ((plain, turns_of(table)), (list(damage_by_hand(rows)), damaged(table))):
        want = repair_by_hand(rows_after, {r[0] for r in rows})
        for long_rows in (4096, 12, 0):
            assert as_dict(repair(turns, long_rows)) == want


def test_dropped_conversations_empty_table_and_clashing_names(make):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string, COPY int"
    table = make([(gone, 0, "user", "Hi.", 3)], schema)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert as_dict(repair(damaged(table))) == {gone: empty}
    assert as_dict(repair(damaged(table), long_rows=0)) == {gone: empty}
    assert rows_of(repair(damaged(table.limit(0)))) == []
