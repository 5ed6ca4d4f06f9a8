import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wirefold.llm import conversation_repair as R

SHAPE = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    found, seen = [], set()
    for _, _, role, text in rows:
        visible = text.strip(R.WHITE)
        found.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, marks):
    """All edits with up to two inserts between rows, cheapest and then ASCII-least first, by plain enumeration."""
    best = None
    choices = []
    for (_, _, role, text), fault in zip(rows, marks, strict=True):
        extra = 3 if fault == "truncated" else 0
        one = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            one += [(extra, "K", (role[:1] or "?", role, text))] + [(3 + extra, "R", (n[0], n, text)) for n in NAMES.values()]
        choices.append(one)
    gaps = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    for picked in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for c, _, _ in picked) + 3 * sum(map(len, inserts))
            if best is not None and cost > best[0]:
                continue
            audit, lines = "I" * len(inserts[0]), [(x, NAMES[x], "") for x in inserts[0]]
            for (_, edit, line), extra in zip(picked, inserts[1:], strict=True):
                audit += edit + "I" * len(extra)
                lines += ([line] if line else []) + [(x, NAMES[x], "") for x in extra]
            if SHAPE.fullmatch("".join(x for x, _, _ in lines)):
                one = cost, audit, "\n".join(f"{r}:{t}" for _, r, t in lines)
                best = one if best is None or one[:2] < best[:2] else best
    return best


def walked(rows, marks):
    """The same for any length: all states' (cost, audit, lines), row by row."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = lambda s: 3 if s == 2 else 2

    def better(into, state, one):
        if state not in into or one[:2] < into[state][:2]:
            into[state] = one

    def inserts(best):
        for _ in range(3):
            for s, (c, a, lines) in list(best.items()):
                better(best, to(s), (c + 3, a + "I", (lines, f"{NAMES[step[s]]}:")))
        return best

    best = {0: (0, "", None)}
    for (_, _, role, text), fault in zip(rows, marks, strict=True):
        after, extra = {}, 3 if fault == "truncated" else 0
        for s, (c, a, lines) in inserts(best).items():
            better(after, s, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                if role[:1] == step[s] or role[:1] == "s" and s == 0:
                    better(after, 1 if role[:1] == "s" else to(s), (c + extra, a + "K", (lines, f"{role}:{text}")))
                better(after, to(s), (c + 3 + extra, a + "R", (lines, f"{NAMES[step[s]]}:{text}")))
        best = after
    cost, audit, lines = min(((v for s, v in inserts(best).items() if s in (0, 3))), key=lambda v: v[:2])
    out = []
    while lines is not None:
        lines, line = lines
        out.append(line)
    return cost, audit, "\n".join(out[::-1])


def brute(given, solve=walked, damages=True):
    result = {}
    rows = damage(given) if damages else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given]
    for conv in {r[0] for r in given}:
        mine = ordered([r for r in rows if r[0] == conv])
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit, text = solve(mine, marks) if mine else (0, "", "")
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(k) for k in ("blank", "duplicate", "truncated")],
                        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
                        cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return result


def some_rows(rnd, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", " "]
    texts = ["Yes.", "No!", "Really?", "cut off", " \t\n", None, "", "é.", "Yes.", "a.\n ", "x" * 300]
    return [(conv, rnd.choice([None, *range(n)]) if rnd.random() < 0.2 else i, rnd.choice(roles), rnd.choice(texts)) for i in range(n)]


def test_least_paths_equal_enumeration():
    rnd = random.Random(1)
    for _ in range(120):
        rows = [(1, i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "B.", "cut", ""])) for i in range(rnd.randint(0, 3))]
        marks = faults(rows)
        codes = "".join("d" if m in ("blank", "duplicate") else (c.upper() if m else c)
                        for m, c in ((m, r[2][0] if r[2][0] in "sua" else "x") for m, r in zip(marks, rows, strict=True)))
        cost, audit, text = cheapest(rows, marks)
        assert R.whole_repair(codes) == (cost, audit) == walked(rows, marks)[:2]
        lines = R.edited_lines(audit, R.START, [r[2] for r in rows], [r[3] for r in rows])
        assert "\n".join(f"{x['role']}:{x['text']}" for x in lines) == text == walked(rows, marks)[2]


def test_tables_of_segments_equal_the_whole():
    rnd = random.Random(2)
    for _ in range(60):
        codes = "".join(rnd.choices("uaUAsdxX", weights=[6, 6, 2, 2, 1, 2, 1, 1], k=rnd.randint(2, 40)))
        cuts = sorted(rnd.sample(range(1, len(codes)), min(len(codes) - 1, rnd.randint(1, 5))))
        parts = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, len(codes)])]
        cost, audit = R.finished(R.joined_tables([R.segment_table(p) for p in parts]))
        assert (cost, audit.translate(R._PLAIN)) == R.whole_repair(codes)
        states = [int(p[0]) for p in audit.split(",")]
        rows = [("user", f"{i}.") if c in "uU" else ("assistant", f"{i}.") if c in "aA" else ("system", f"{i}.") if c == "s" else ("tool", f"{i}.")
                for i, c in enumerate(codes)]
        ends = [0, *cuts, len(codes)]
        pieces = [R.edited_lines(p[1:], s, [r for r, _ in rows[a:b]], [t for _, t in rows[a:b]])
                  for p, s, (a, b) in zip(audit.split(","), states, itertools.pairwise(ends), strict=True)]
        assert sum(pieces, []) == R.edited_lines(R.whole_repair(codes)[1], 0, [r for r, _ in rows], [t for _, t in rows])


@pytest.fixture
def query(spark, tmp_path):
    def run(rows, extra=False, parts=3):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
        if extra:
            for name in ("ck", "at", "seg", "fault", "cost", "audit", "whole", "first", "border", "lines"):
                frame = frame.withColumn(name, F.lit("clash"))
        frame.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        out = R.op11_repair(spark, str(tmp_path)).collect()
        assert len({r["conv_id"] for r in out}) == len(out)
        return {r["conv_id"]: tuple(r)[1:] for r in out}
    return run


def test_edges_equal_brute_force(query):
    rnd = random.Random(3)
    rows = [r for conv in [*range(40), None] for r in some_rows(rnd, conv, rnd.randint(1, 9))]
    rows += [(100, 0, "user", "w " * 40000 + "."), (100, 1, "assistant", None), (101, None, None, None)]
    rows += rows[:20]
    assert query(rows, extra=True) == brute(rows)


def test_long_conversations_equal_brute_force(query, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 8)
    monkeypatch.setattr(R, "FAN", 3)
    rnd = random.Random(4)
    rows = [r for conv, n in ((1, 700), (2, 200), (3, 8), (4, 16), (5, 7), (6, 9), (None, 50)) for r in some_rows(rnd, conv, n)]
    rows += [(7, i, "user", "same.") for i in range(300)]
    assert query(rows, parts=9) == brute(rows)


def test_empty_and_all_dropped(query):
    assert query([]) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = query([(gone, 0, "user", "Hi.")])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_given_table_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in R.op11_repair(spark, sf_dir).collect()}
    assert got == brute(rows)
