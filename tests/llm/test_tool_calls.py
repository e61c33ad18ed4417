"""Types of arguments, canonical JSON, and levels against a plain recursion."""

import random

import pytest

RULES = [("f", "n", "integer", False, 1.0), ("f", "s", "string", False, None), ("f", "o", "object", False, None), ("f", "x", "number", False, None)]
CASES = [
    ('{"n":"2"}', ["invalid n"], '{"n":"2"}'), ('{"s":5}', ["invalid s"], '{"s":5}'), ('{"n":0}', ["invalid n"], '{"n":0}'),
    ('{"o":{"z":1,"a":[1,{"y":null,"b":true}]}}', [], '{"o":{"a":[1,{"b":true,"y":null}],"z":1}}'),
    ('{"n":2} junk', ["no JSON object"], "null"), ('{"n":1,"n":2}', ["no JSON object"], "null"), ('{"n":1},{"n":2}', ["no JSON object"], "null"),
    ('{ "s":"a\\u00e9", "n":2.0 }', [], '{"n":2,"s":"aé"}'), ('{"x":0.10}', [], '{"x":0.1}'), ("[1]", ["no JSON object"], "[1]"), (None, ["no JSON object"], "null"), ('{"n":true}', ["invalid n"], '{"n":true}'),
]


def test_arguments_keep_their_types(spark):
    from tagweave.llm import tool_calls

    tools = spark.createDataFrame(RULES, "name string, param string, type string, required boolean, minimum double")
    calls = spark.createDataFrame([(i, "f", a) for i, (a, _, _) in enumerate(CASES)], "i int, name string, arguments string")
    got = {r.i: (r.problems, r.args_json) for r in tool_calls.validated(calls, tools).collect()}
    assert got == {i: (p, j) for i, (_, p, j) in enumerate(CASES)}


def brute(graph):
    level = {}

    def of(x, path):
        if x in path:
            return -1
        if x not in level:
            below = [of(d, path | {x}) for d in graph[x] if d in graph]
            level[x] = -1 if -1 in below else 1 + max(below, default=-1)
        return level[x]

    return {x: of(x, frozenset()) for x in graph}


@pytest.mark.parametrize("kind", ["chain", "tree", "dag", "cycles", "none"])
def test_levels(spark, kind):
    from tagweave.llm import tool_calls

    r = random.Random(kind)
    name = lambda i: f"c{i:03}"
    graph = {
        "chain": {name(i): [name(i - 1)] for i in range(150)}, "tree": {name(i): [name(r.randrange(i))] if i else [] for i in range(120)},
        "dag": {name(i): [name(r.randrange(i)) for _ in range(r.randrange(4))] if i else [] for i in range(40)},
        "cycles": {name(0): [], name(1): [name(2)], name(2): [name(3)], name(3): [name(1)], name(4): [name(3)], name(5): [name(0), name(4)], name(6): [name(0), name(0)], name(7): [name(6), name(0)], name(8): [name(8)], name(9): [name(7)]},
        "none": {},
    }[kind]
    rows = [(1, k, d) for k, d in graph.items()] + [(2, k, []) for k in list(graph)[:3]]
    got = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends array<string>")).collect()
    assert len(got) == len(rows)
    assert {x.call_id: x.level for x in got if x.conv_id == 1} == brute(graph)
