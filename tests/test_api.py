import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from stratalog import api, mcp
from stratalog.__main__ import ago, main, rendered
from stratalog.plans.store import Store

FROM, TO = "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("api")
    (base / "in.log").write_text("".join(f"2024-01-01T00:00:{i:02d}Z user u{i % 3} took {i}ms k=a,b{i}\n" + "\tat x\n" * (i == 5) for i in range(20)) + "2024-01-01T00:00:30Z odd \u0001 line\n")
    assert main(["--store", str(base / "s"), "run", "--input", str(base / "in.log")]) == 0
    return str(base / "s")


@pytest.fixture(scope="module")
def base(spark, path):
    server = api.serve(Store(spark, path), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/api"
    server.shutdown()


def get(url):
    return json.load(urllib.request.urlopen(url))


def post(url, body):
    return json.load(urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode())))


def test_command_line(path, capsys):
    capsys.readouterr()
    assert main(["--store", path, "replay", "--from", "2024-01-01T00:00:05Z", "--to", "2024-01-01T00:00:06Z"]) == 0
    assert json.loads(capsys.readouterr().out) == ["2024-01-01T00:00:05Z user u2 took 5ms k=a,b5\n\tat x", "2024-01-01T00:00:06Z user u0 took 6ms k=a,b6"]
    assert main(["--store", path, "--text", "query", "--pattern", "{ts} user u1 took {size} k=a,b4", "--filter", "size=4ms"]) == 0
    assert capsys.readouterr().out == "2024-01-01T00:00:04Z user u1 took 4ms k=a,b4\n"
    assert main(["--store", path, "--text", "templates"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].split() == ["id", "pattern", "hits", "createdAt", "updatedAt"] and len(out) > 2 and out[1].endswith("ago")
    assert main(["--store", path, "replay", "--from", "soon"]) == 2
    assert main(["--store", path, "inspect", "--id", "999"]) == 2


def test_text():
    assert rendered(["a", "b"]) == "a\nb"
    assert rendered({"id": 3, "slots": [{"name": "x", "distinct": 2}], "none": []}) == "id: 3\nnone: []\nslots:\nname  distinct\nx     2"
    assert [ago(0, s * 1000) for s in (-5, 3, 60, 7200, 86400 * 3, 86400 * 60, 86400 * 800)] == ["just now", "3 sec ago", "1 min ago", "2 hrs ago", "3 days ago", "2 months ago", "2 years ago"]


def test_shapes_over_http(spark, path, base):
    assert get(base + "/stats") | {"bytes": 0} == {"templateCount": get(base + "/stats")["templateCount"], "logEntryCount": 20, "rawLogCount": 1, "bytes": 0}
    first = get(base + "/templates?limit=1")[0]
    assert set(first) == {"id", "pattern", "hits", "createdAt", "updatedAt"}
    detail = get(f"{base}/templates/{first['id']}?topN=2&recent=1")
    assert set(detail) == set(first) | {"slotStats", "recentLogs"} and len(detail["recentLogs"]) == 1 and set(detail["recentLogs"][0]) == {"ts", "line"}
    assert [(s["index"], s["name"], s["type"]) for s in detail["slotStats"]][:2] == [(0, "ts", "ts"), (1, "size", "size")]
    assert set(detail["slotStats"][1]["numeric"]) == {"count", "min", "max", "avg", "p50", "p95", "unit"} and set(detail["slotStats"][0]["topValues"][0]) == {"value", "count"}
    span = f"from={FROM}&to={TO}"
    series = get(f"{base}/templates/{first['id']}/timeseries?{span}&bucket=10s")
    assert series["templateId"] == first["id"] and series["bucketMs"] == 10000 and set(series["series"][0]) == {"ts", "count"}
    assert set(get(f"{base}/template-counts?{span}")[0]) == {"templateId", "pattern", "count"}
    assert set(get(f"{base}/template-counts?{span}&baseline=true")[0]) == {"templateId", "pattern", "windowCount", "baselineCount", "ratio"}
    assert set(get(f"{base}/new-templates?{span}")[0]) == {"templateId", "pattern", "firstSeenMs", "windowCount"}
    assert get(f"{base}/raw-logs?{span}") == [{"id": 1, "content": "2024-01-01T00:00:30Z odd \u0001 line", "ts": 1704067230000, "source": get(f"{base}/raw-logs?{span}")[0]["source"]}]
    assert get(f"{base}/replay?{span}&limit=2") == ["2024-01-01T00:00:00Z user u0 took 0ms k=a,b0", "2024-01-01T00:00:01Z user u1 took 1ms k=a,b1"]
    found = get(f"{base}/investigate?{span}")
    assert set(found) == {"windowFromMs", "windowToMs", "baselineFromMs", "baselineToMs", "totalWindowEntries", "errorRate", "spikes", "newTemplates", "rawLogSample"} and found["rawLogSample"] == ["2024-01-01T00:00:30Z odd \u0001 line"]
    assert set(get(f"{base}/suggestions?pattern=user")[0]) == {"id", "pattern", "hits"}
    for bad, code in (("/nothing", 400), ("/templates/77", 404), ("/templates/x", 400), ("/replay?last=soon", 400), ("/query", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(base + bad)
        assert e.value.code == code, bad
    assert urllib.request.urlopen(urllib.request.Request(base + "/query", method="OPTIONS")).status == 204


def test_filters_with_commas_and_templates_without_matches(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("filters") / "s"))
    from tests.test_store import groups

    store.ingest(groups(spark, [f"job j-{c}7x,{c} took {i}ms" for i, c in enumerate("abcdefghijkl")], ts=1000), label="a", now_ms=5)
    pattern = "job {var} took {size}"
    ask = lambda **kw: api.answer(store, "query-structured", {"pattern": pattern} | kw)
    assert ask(filters={"var": "j-b7x,b"}, slots=["size"]) == {"templateId": 1, "template": pattern, "slots": ["size"], "matchedCount": 1, "scanCapped": False, "returned": 1, "occurrences": [["1ms"]]}
    assert ask(filters={"var": "j-b7x"}) == {"templateId": 1, "template": pattern, "slots": ["var", "size"], "matchedCount": 0, "scanCapped": False, "returned": 0, "occurrences": []}
    assert ask(limit=5)["returned"] == 5 and ask(limit=5)["matchedCount"] == 12
    assert api.answer(store, "query-structured", {"pattern": "no {num}"})["templateId"] == -1
    assert api.answer(store, "query", {"pattern": pattern, "filters": ["var=j-c7x,c"]}) == ["job j-c7x,c took 2ms"]
    with pytest.raises(api.BadRequest):
        api.answer(store, "query", {"pattern": pattern, "filters": ["var"]})
    assert len(api.answer(store, "templates", {"limit": "0"})) == 1


def test_tools_of_an_agent(spark, path):
    store = Store(spark, path)
    ask = lambda name, args: api.answer(store, name, args)
    span = {"from": FROM, "to": TO}
    calls = {
        "template_counts": span | {"baseline": True}, "new_templates": span, "list_templates": {"search": "user"}, "inspect_template": {"templateId": 1, "topN": 2},
        "template_timeseries": span | {"templateId": 1}, "raw_sample": span, "query_logs": {"pattern": "no {num}"}, "replay": span | {"limit": 3}, "get_stats": {},
    }
    messages = [{"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {"protocolVersion": "x"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}]
    messages += [{"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": n, "arguments": a}} for n, a in calls.items()]
    messages += [{"jsonrpc": "2.0", "id": "bad", "method": "tools/call", "params": {"name": "replay", "arguments": {"limit": 9000}}}, {"jsonrpc": "2.0", "id": "none", "method": "tools/call", "params": {"name": "x"}}]
    messages += [{"jsonrpc": "2.0", "id": "list", "method": "prompts/list"}, {"jsonrpc": "2.0", "id": "get", "method": "prompts/get", "params": {"name": "investigate_incident", "arguments": {"window": "3h"}}}, {"jsonrpc": "2.0", "id": "what", "method": "what"}]
    out = io.StringIO()
    mcp.run(ask, io.StringIO("\n".join(map(json.dumps, messages)) + "\nno json\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert len(got) == len(messages)  # one notification without an answer, one error without an id
    assert got[0]["result"]["protocolVersion"] == "x" and {t["name"] for t in got[1]["result"]["tools"]} == set(calls)
    results = {n: json.loads(got[n]["result"]["content"][0]["text"]) for n in calls if not got[n]["result"]["isError"]}
    assert set(results) == set(calls)
    replayed = results["replay"]
    assert replayed["truncated"] and replayed["returned"] == 3 and len(replayed["items"]) == 3
    assert results["query_logs"]["templateId"] == -1 and results["get_stats"]["logEntryCount"] == 20 and results["inspect_template"]["recentLogs"] == []
    assert got["bad"]["result"]["isError"] and got["none"]["error"]["code"] == -32602 and got["what"]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700
    assert "last 3h" in got["get"]["result"]["messages"][0]["content"]["text"] and got["list"]["result"]["prompts"][0]["name"] == "investigate_incident"


def test_truncation():
    assert mcp.truncated([1, 2, 3], 3, "h") == [1, 2, 3] and mcp.truncated({"a": 1}, 1, "h") == {"a": 1}
    assert mcp.truncated([1, 2, 3], 2, "h") == {"truncated": True, "returned": 2, "totalAvailable": 3, "hint": "h", "items": [1, 2]}
