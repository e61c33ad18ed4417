"""JSON files in small byte ranges: cut strings, escapes, nested brackets, repeated keys."""

import json
import random

import pytest

from tagweave.sources import json_ranges


def tricky(r, depth=0):
    kinds = ["text", "number", "list", "object"] if depth < 3 else ["text", "number"]
    kind = r.choice(kinds)
    if kind == "text":
        return "".join(r.choice(['"', "\\", "[", "]", "{", "}", ",", ":", "a", "é", "漢", "\n", " "]) for _ in range(r.randrange(12)))
    if kind == "number":
        return r.choice([1, -2.5, None, True])
    n = r.randrange(4)
    return [tricky(r, depth + 1) for _ in range(n)] if kind == "list" else {str(tricky(r, 9)): tricky(r, depth + 1) for _ in range(n)}


@pytest.mark.parametrize("size", [7, 50, 1_000_000])
def test_elements(spark, tmp_path, size):
    r = random.Random(size)
    want = {}
    for i in range(4):
        name, values = f"f{i}.json", [tricky(r) for _ in range(r.randrange(30))]
        want[name] = values
        (tmp_path / name).write_text(json.dumps(values, ensure_ascii=i % 2 == 0, indent=[None, 2][i // 2]) + "\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ] ")
    got = {n: [] for n in want}
    for x in json_ranges.elements(spark, str(tmp_path), size).orderBy("file", "at").collect():
        got[x.file.rsplit("/", 1)[1]].append(json.loads(x.element))
    assert got == want


@pytest.mark.parametrize("size", [5, 64])
def test_entries(spark, tmp_path, size):
    r = random.Random(size)
    text = "{" + ", ".join(f"{json.dumps(k)} : {json.dumps(v)}" for k, v in [(str(tricky(r, 9)), tricky(r)) for _ in range(25)] + [("x", 1), ("x", {"y": 2})]) + "}"
    (tmp_path / "o.json").write_text(text)
    rows = json_ranges.entries(spark, str(tmp_path / "o.json"), size).orderBy("at").collect()
    assert {x.key: json.loads(x.value) for x in rows} == json.loads(text)


def test_last_key_counts_and_broken_files_give_what_is_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"v": 1}, "y": {"v": 2}, "x": {"v": 3}, "z": null}')
    assert {x.item_id: x.v["v"] for x in json_ranges.last_entries(spark, str(tmp_path / "a.json"), "map<string, int>", 4).collect()} == {"x": 3, "y": 2}
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": "cut')
    assert [x.element for x in json_ranges.elements(spark, str(tmp_path / "b.json"), 3).collect()] == ['{"a": 1}']
    assert json_ranges.elements(spark, str(tmp_path / "missing.json")).count() == 0
