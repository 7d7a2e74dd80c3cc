"""Conversation repair against a plain search for the cheapest, ASCII-least edits."""

import hashlib
import random
import re
import zlib

import pytest

from dossier.llm import repair

AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string, g string, at long, edit string, codes string"


def plain(rows):
    turns = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            turns[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for c, mine in turns.items():
        mine.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, *_ in mine if t is not None]
        first = [role[:1] for _, role, _ in mine]

        def better(best, to, way):
            if to is not None and (to not in best or way[:2] < best[to][:2]):
                best[to] = way

        def inserted(best):
            for _ in range(4):
                for state, (cost, audit, lines) in list(best.items()):
                    for name in ("user", "assistant"):
                        better(best, AFTER.get((state, name[0])), (cost + 2, audit + "I", lines + [name + ":"]))
            return best

        best = inserted({0: (0, "", [])})
        for (_, role, text), fault in zip(mine, faults):
            new = {}
            for state, (cost, audit, lines) in best.items():
                better(new, state, (cost + 3, audit + "D", lines))
                if fault in ("", "truncated"):
                    more = cost + (fault == "truncated")
                    better(new, AFTER.get((state, role[:1])), (more, audit + "K", lines + [f"{role}:{text}"]))
                    for name in ("user", "assistant"):
                        better(new, AFTER.get((state, name[0])), (more + 2, audit + "R", lines + [f"{name}:{text}"]))
            best = inserted(new)
        cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


# rows, conversations, chunk: none, one, several chunks a conversation, one conversation of many
@pytest.mark.parametrize("n, conversations, chunk", [(0, 1, 4), (1, 1, 4), (300, 30, 4), (500, 3, 7), (200, 80, 4096), (1500, 1, 100)])
def test_against_a_plain_search(spark, n, conversations, chunk):
    r = random.Random(n)
    ids = [1] if conversations == 1 else [None, *range(conversations)]
    rows = [
        (r.choice(ids), r.choice([None, r.randrange(200), i]), r.choice([None, "", "user", "assistant", "system", "user", "assistant", "tool"]), r.choice([None, "", "a.", "b!", "c", "hé? ", " \n", "\xa0", f"{i}.", f"{i}.", f"{i}"]))
        for i in range(n)
    ]
    rows += rows[:5]
    df = spark.createDataFrame([(*x, "clash", 1, "clash", "clash") for x in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, repair.digest(df, chunk).collect()), key=repr) == sorted(plain(rows), key=repr)


def test_very_long_texts(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], "é " * (1 << 20) + f"{k}" + "." * (k > 1) + " " * 100_000) for k in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(x) for x in repair.digest(df).collect()] == plain(rows)


def test_checkpoints_change_nothing():
    r = random.Random(4)
    for _ in range(200):
        codes = bytes(r.randrange(4) + 4 * r.choice((0, 0, 0, 1, 2)) for _ in range(r.randint(1, 60)))
        after = repair.with_inserts(repair.END)
        ways = [repair.walk(codes, 0, after, True, stretch) for stretch in (1, 7, 64)]
        assert ways[0] == ways[1] == ways[2]
        k = r.randrange(len(codes) + 1)
        halves = repair.through(repair.matrix(codes[:k]), repair.through(repair.matrix(codes[k:]), after)) if 0 < k < len(codes) else repair.back(codes, after)
        assert halves == repair.back(codes, after) == repair.through(repair.matrix(codes), after)
