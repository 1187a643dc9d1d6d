"""JSON arrays by byte ranges and whole files, against json.loads and the file system."""

import io
import json
import random

import pyarrow as pa
import pytest

from logtrail.sources import files
from logtrail.sources.logs import json_array_logs, scenarios


def value(rng, depth=0):
    text = lambda: "".join(rng.choice('ab"\\{}[],: \né😀/') for _ in range(rng.randint(0, 12)))
    kinds = [text, lambda: rng.randint(-5, 10**6), lambda: None, lambda: True, lambda: 1.5]
    if depth < 3:
        kinds += [lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 3))], lambda: {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}] * 2
    return rng.choice(kinds)()


def arrays(n=60):
    rng = random.Random(11)
    out = ["[]", " [ ] \n", "[{}]", '["\\\\", "\\"", "\\\\\\""]', "[[[]],[]]"]
    for _ in range(n):
        items = [value(rng) for _ in range(rng.randint(0, 12))]
        out.append(json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1])))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_of_any_size(monkeypatch, size):
    monkeypatch.setattr(files, "MORE", 5)
    for text in arrays():
        data = text.encode()
        file, place, got = pa.PythonFile(io.BytesIO(data), "r"), files.Place(), []
        for start in range(0, len(data), size):
            end = min(len(data), start + size)
            if not start and not data[:end].strip():
                break  # a range of blanks alone before the array: ranges are far longer
            got += [(place.begun + k, raw) for k, raw in enumerate(files.elements(file, len(data), start, end, place))]
            effect = files.Effect.of(files._read(file, start, end), files._escaped(file, start))
            place = effect.on(place)
        else:
            assert not place.inside and place.depth == 0
            assert [json.loads(raw) for _, raw in got] == json.loads(text), text
            assert [k for k, _ in got] == list(range(len(got)))


def test_large_arrays_are_several_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    folder = tmp_path / "logs"
    folder.mkdir()
    items = {"a.json": [{"i": i, "text": value(rng)} for i in range(4000)], "b.json": [value(rng) for _ in range(50)], "c.json": [], "d.json": [{"long": "x]}," * 20_000}, 1]}
    for name, some in items.items():
        (folder / name).write_text(json.dumps(some, ensure_ascii=False), encoding="utf-8")
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.json").write_text("")
    monkeypatch.setattr(files, "RANGE", 10_000)
    df = json_array_logs(spark, f"file://{folder}")
    assert df.rdd.getNumPartitions() > 8
    got = {}
    for r in df.collect():
        got.setdefault(r.file, []).append((r.ordinal, json.loads(r.raw)))
    assert {k: [x for _, x in sorted(v, key=lambda p: p[0])] for k, v in got.items()} == {k: v for k, v in items.items() if v}
    assert all(sorted(o for o, _ in v) == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("text", ['{"a": 1}', " ", "[1", "[1]]", '["a]', "[1][2]", "[1] x", "5"])
@pytest.mark.parametrize("size", [4, 1 << 20])
def test_what_is_no_array(spark, tmp_path, monkeypatch, text, size):
    monkeypatch.setattr(files, "RANGE", size)
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="array of records"):
        json_array_logs(spark, f"file://{tmp_path}").collect()


def test_scenarios(spark, tmp_path):
    some = [{"name": "one", "is_malicious": True, "expected_techniques": ["T1110"], "logs": [{"event_id": 1}, {"b": "]"}]}, {"name": "none", "is_malicious": False, "expected_techniques": [], "logs": []}]
    (tmp_path / "s.json").write_text(json.dumps(some, indent=2))
    got = sorted((r.name, r.is_malicious, r.ordinal, r.raw and json.loads(r.raw)) for r in scenarios(spark, f"file://{tmp_path}/s.json").collect())
    assert got == [("none", False, None, None), ("one", True, 0, {"event_id": 1}), ("one", True, 1, {"b": "]"})]
