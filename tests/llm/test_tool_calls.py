import json
import random
import zlib

from tablesmith.llm.tool_calls import TOOLS, calls_of, canonical, checked, fits, link

CALLS = "call_id string, after string, name string, arguments string, status string"
RESULTS = "call_id string, at long, content string, level long"


def level_of(i, after):
    n, seen = 0, set()
    while after.get(i) is not None:
        if i in seen:
            return None
        seen.add(i)
        i, n = after[i], n + (after[i] in after)
    return n


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = [r.asDict() for r in df.collect()]
    got = {r.call_id: r for r in link(*calls_of(df), TOOLS).collect()}
    calls = {f"{t['conv_id']}-{t['turn']}": t for t in turns if t["role"] == "user"}
    answers = {f"{t['conv_id']}-{t['turn'] - 1}": t["text"] for t in turns if t["role"] == "assistant"}
    after = {i: f"{t['conv_id']}-{t['turn'] - 2}" if t["turn"] >= 2 else None for i, t in calls.items()}
    assert set(got) == set(calls) | set(answers)
    for i, t in calls.items():
        pick = zlib.crc32(t["text"].encode()) % 3
        args = [{"query": t["text"], "limit": t["turn"] + 1}, {"to": "en", "text": t["text"]}, {"words": len(t["text"]) // 20, "text": t["text"]}][pick]
        tool = ["search", "translate", "summarise"][pick]
        ok = [0 < len(t["text"]) <= 400, len(t["text"]) <= 4000, len(t["text"]) // 20 >= 5][pick]
        dangling = after[i] is not None and after[i] not in calls
        status = "bad_arguments" if not ok else "dangling" if dangling else "ok" if i in answers else "no_result"
        want = {"after": after[i], "arguments": args, "id": i, "name": tool, "result": answers.get(i)}
        assert got[i].status == status and got[i].level == level_of(i, after)
        assert got[i].message == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert all(got[i].status == "orphan_result" for i in set(answers) - set(calls))
    assert len({r.status for r in got.values()}) >= 3


def test_chains_hubs_cycles_and_odd_rows(spark):
    text = '{"text": "x", "words": 7}'
    after = {f"c{i}": f"c{i - 1}" if i else None for i in range(200)} | {f"h{i}": "c5" for i in range(300)}
    after |= {"x": "y", "y": "x", "z": "x", "self": "self", "gone": "nowhere"}
    calls = [(i, a, "summarise", text, "s") for i, a in after.items()]
    calls += [("tool", None, "other", text, "s"), ("json", None, "search", "{", "s"), ("nan", None, "search", '{"query": NaN}', "s"), ("null", None, None, None, "s")]
    calls += [("twice", None, "summarise", text, "s")] * 50 + [(None, None, "summarise", text, "s")] * 3
    results = [(i, 1, "done", 1) for i in after] + [("twice", 2, "b", 1), ("twice", 1, "a", 1), ("lost", 1, None, 1), (None, 1, "r", 1)]
    rows = link(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, RESULTS), TOOLS).collect()
    got = {r.call_id: r for r in rows if r.call_id}
    for i in after:
        assert got[i].level == level_of(i, after)
        assert got[i].status == ("cycle" if i in ("x", "y", "z", "self") else "dangling" if i == "gone" else "ok")
    assert [got[i].status for i in ("tool", "json", "nan", "null", "lost")] == ["unknown_tool", "bad_json", "bad_json", "unknown_tool", "orphan_result"]
    assert got["twice"].n_calls == 50 and got["twice"].n_results == 2 and json.loads(got["twice"].message)["result"] == "a"
    assert sorted(r.status for r in rows if r.call_id is None) == ["no_id"] * 4 and len(rows) == len(got) + 4


def test_search_calls_carry_the_whole_text(spark):
    texts = [f"first {i}\nsecond\n\n" + "x" * (i * 40) for i in range(30)]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in link(*calls_of(df), TOOLS).collect()}
    mine = [(i, t) for i, t in enumerate(texts) if zlib.crc32(t.encode()) % 3 == 0]
    assert {len(t) > 400 for _, t in mine} == {True, False}
    for i, t in mine:
        assert json.loads(got[f"{i}-0"].message)["arguments"] == {"query": t, "limit": 1}
        assert got[f"{i}-0"].status == ("no_result" if len(t) <= 400 else "bad_arguments")


def test_empty(spark):
    assert link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect() == []
    rows = [(1, None, "user", None), (None, 0, "user", "a"), (2, 0, None, "b"), (3, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.status for r in link(*calls_of(df), TOOLS).collect()) == ["no_id", "no_id", "orphan_result"]


def test_canonical_and_schema():
    assert canonical({"b": 1.0, "a": [True, None, "é\n"], "\U0001f600": 1, "￮": 2}) == '{"a":[true,null,"é\\n"],"b":1,"\U0001f600":1,"￮":2}'
    assert not fits({"query": "q", "limit": True}, TOOLS["search"]) and not fits({"query": "q", "limit": 1, "x": 0}, TOOLS["search"])
    assert fits({"query": "q", "limit": 1}, TOOLS["search"]) and not fits([], TOOLS["search"]) and not fits({"text": "a", "to": "xx"}, TOOLS["translate"])


def test_odd_arguments_end_in_a_status(spark):
    deep = lambda n: "[" * n + "]" * n
    bad = ['{"text": "x", "words": 1e400}', '{"text": "\\ud800", "words": 7}', deep(1500), deep(100_000), '{"text": ' + deep(300) + "}", "1" * 5000, '{"\\udfff": 1}']
    fine = ['{"text": "\\ud83d\\ude00", "words": 7}', '{"text": "x", "words": 7.0}', '{"text": "x", "words": 1e1}']
    calls = [(f"c{i:02}", None, "summarise", a, "s") for i, a in enumerate(bad + fine)]
    rows = link(spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame([], RESULTS), TOOLS).collect()
    got = {r.call_id: r for r in rows}
    assert [got[f"c{i:02}"].status for i in range(len(calls))] == ["bad_json"] * len(bad) + ["no_result"] * len(fine)
    assert json.loads(got["c08"].message)["arguments"] == {"text": "x", "words": 7}


def test_any_text_gets_a_status():
    rng = random.Random(4)
    parts = ["{", "}", "[", "]", ",", ":", '"', "text", '"text"', '"words"', "1", "-0", "1e-7", "1e999", "NaN", "true", "null", "\\u", "\\ud800", "é", "\0", " ", "0.1"]
    for _ in range(10_000):
        status, value = checked("summarise", "".join(rng.choices(parts, k=rng.randint(0, 14))), TOOLS)
        assert status in ("bad_json", "bad_arguments", "ok")
        if status != "bad_json":
            assert json.loads(canonical(value)) == value


def test_numbers_and_types():
    known = {1e-7: "1e-7", 1e-6: "0.000001", 1.5e-5: "0.000015", 1e21: "1e+21", 1e20: "100000000000000000000", -0.0: "0", 0.1: "0.1", 1.25e-9: "1.25e-9", 123456.75: "123456.75", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308"}
    assert {x: canonical(x) for x in known} == known
    assert fits(1.0, {"type": "integer"}) and not fits(1.5, {"type": "integer"}) and not fits(True, {"type": ["integer", "null"]}) and fits(None, {"type": ["integer", "null"]})
    assert not fits(True, {"enum": [1]}) and fits([1.0], {"enum": [[1]]}) and not fits([True], {"enum": [[1]]})
