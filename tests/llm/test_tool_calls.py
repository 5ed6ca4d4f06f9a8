import json
import random

import pytest
from pyspark.sql import functions as F

from wirefold.llm.common import stored
from wirefold.llm.tool_calls import QUERY_SCHEMAS, canonical_json, link_tool_calls, op5_tool_calls, quoted, topological_levels

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "go": {"where": ("object", False), "tags": ("array", False)}}
CALLS = [
    (1, "a", 0, "add", '{"b": 2.5, "a": 1}', None), (1, "b", 2, "add", '{"a": 1.5, "b": "x", "zz": 1, "note": 3}', ["a"]),
    (1, "c", 4, "go", '{"where": {"y": 1, "x": [1, {"q": 2, "p": null}]}}', ["a", "b", "missing"]), (1, "d", 1, "none", "{}", []),
    (2, "a", 0, "go", "not json", ["b"]), (2, "b", 0, "go", '{"tags": [3, 1]}', ["a"]), (2, "c", 0, "go", "[1]", ["b"]),
    (2, "self", 0, "go", "{}", ["self"]), (1, "a", 9, "go", "{}", ["c"]), (None, "a", 0, "go", "{}", ["a"]), (3, None, 0, "go", None, None),
    (4, "x", None, None, "{}", [None]), (4, "x", None, None, "{}", [None])]
RESULTS = [(1, "a", 1, "one\n\"quoted\" é"), (1, "a", 3, "later"), (1, "zz", 5, "nobody asked"), (2, "c", 1, None), (None, "a", 1, "n"),
           (1, "c", 5, "x" * 70000)]


@pytest.fixture
def linked(spark):
    calls = spark.createDataFrame([(*c, "clash") for c in CALLS],
                                  "conv_id long, call_id string, turn long, tool string, arguments string, parents array<string>, status string")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, content string")
    return {(r["conv_id"], r["call_id"]): r for r in link_tool_calls(calls, results, SCHEMAS).collect()}


def test_links_levels_and_errors(linked):
    assert {k: (r["level"], r["status"], r["errors"]) for k, r in linked.items() if k[0] is not None and k[1] is not None} == {
        (1, "a"): (0, "linked", ""), (1, "b"): (1, "no_result", "type:a,type:b,type:note,unknown:zz"), (1, "c"): (2, "linked", ""),
        (1, "d"): (0, "no_result", "unknown_tool"), (1, "zz"): (None, "no_call", ""), (2, "a"): (None, "cycle", "malformed"),
        (2, "b"): (None, "cycle", ""), (2, "c"): (None, "cycle", "malformed"), (2, "self"): (None, "cycle", ""),
        (4, "x"): (0, "no_result", "unknown_tool")}
    assert linked[1, "a"]["turn"] == 0 and linked[1, "a"]["valid"] and not linked[1, "b"]["valid"]
    assert linked[3, None]["errors"] == "malformed" and linked[None, "a"]["status"] in ("no_result", "no_call")


def test_messages_are_canonical_json(linked):
    for r in linked.values():
        m = json.loads(r["message"])
        assert list(m) == sorted(m) and m["status"] == r["status"] and m["id"] == r["call_id"]
        assert r["message"] == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(linked[1, "a"]["message"])["content"] == RESULTS[0][3]
    assert '{"where":{"x":[1,{"p":null,"q":2}],"y":1}}' in linked[1, "c"]["message"]


def test_canonical_and_quoted(spark):
    df = spark.createDataFrame([(t,) for t in ('{"b":1,"a":{"d":[1, 2],"c":"é\\n"}}', "nope", None, '"}"')], "t string")
    assert [r[0] for r in df.select(canonical_json(F.col("t"))).collect()] == ['{"a":{"c":"é\\n","d":[1,2]},"b":1}', None, None, '"}"']
    assert [json.loads(r[0]) for r in df.select(quoted(F.col("t"))).collect()] == [r[0] for r in df.collect()]


def test_levels_are_longest_paths(spark):
    nodes = [(0, str(i)) for i in range(20)]
    links = [(0, str(i), str(j)) for i in range(20) for j in range(i) if (i * 7 + j * 3) % 5 == 0]
    want = {}
    for i in range(20):
        want[str(i)] = max((want[p] + 1 for _, c, p in links if c == str(i)), default=0)
    got = topological_levels(spark.createDataFrame(nodes, "conv_id long, call_id string"),
                             spark.createDataFrame(links, "conv_id long, call_id string, parent string"))
    assert {r["call_id"]: r["level"] for r in got.collect()} == want


def levels(spark, nodes, links):
    got = topological_levels(spark.createDataFrame(nodes, "conv_id long, call_id string"),
                             spark.createDataFrame(links, "conv_id long, call_id string, parent string"))
    rows = [((r["conv_id"], r["call_id"]), r["level"]) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from wirefold.llm import tool_calls
    writes = []
    monkeypatch.setattr(tool_calls, "stored", lambda df, label: writes.append(label) or stored(df, label))
    nodes = [(c, str(i)) for c in (1, 2) for i in range(500)]
    links = [(c, str(i), str(i - 1)) for c in (1, 2) for i in range(1, 500)]
    assert levels(spark, nodes, links) == {(c, str(i)): i for c in (1, 2) for i in range(500)}
    assert len(writes) <= 16  # 11 of them doublings


def test_levels_of_random_graphs_with_cycles(spark):
    rnd = random.Random(3)
    nodes, links, want = [], [], {}
    for conv in range(40):
        n = rnd.randrange(1, 14)
        mine = {(str(i), str(rnd.randrange(n) if rnd.random() < 0.08 else rnd.randrange(i)))
                for i in range(1, n) for _ in range(rnd.choice((0, 1, 1, 1, 2)))}
        nodes += [(conv, str(i)) for i in range(n)]
        links += [(conv, c, p) for c, p in mine]
        level = {}
        for _ in range(n):
            for i in map(str, range(n)):
                parents = [p for c, p in mine if c == i]
                if all(p in level for p in parents):
                    level[i] = max((level[p] + 1 for p in parents), default=0)
        want |= {(conv, str(i)): level.get(str(i)) for i in range(n)}
    assert levels(spark, nodes, links) == want and None in want.values()


def test_query_links_a_conversation_of_many_turns(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(200)] + [(2, 0, "user", "hi"), (2, 4, "user", "gap")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["level"], r["status"]) for r in op5_tool_calls(spark, str(tmp_path)).collect()}
    assert got == {(1, t): (t // 2, "linked") for t in range(0, 200, 2)} | {(2, 0): (0, "no_result"), (2, 4): (0, "no_result")}


def test_empty_tables(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, tool string, arguments string, parents array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    assert link_tool_calls(calls, results, QUERY_SCHEMAS).count() == 0


def test_query_links_every_turn(spark, capsys):
    d = "/root/testdata/sf0.001"
    out = op5_tool_calls(spark, d)
    turns = spark.read.parquet(f"{d}/conversations.parquet").collect()
    user = {(r["conv_id"], r["turn"]) for r in turns if r["role"] == "user"}
    answered = {(r["conv_id"], r["turn"] - 1) for r in turns if r["role"] == "assistant"}
    rows = out.collect()
    assert sum(r["status"] == "linked" for r in rows) == len(user & answered)
    assert sum(r["status"] == "no_call" for r in rows) == len(answered - user)
    assert len(rows) == len(user | answered)
    out.explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))
