"""Session files of every dialect, written by the tests, through to priced summaries."""

import json

import pytest

from ledgerloom.operators import dialects, ledger, pricing
from ledgerloom.operators.metrics import measured
from ledgerloom.plans import reports
from ledgerloom.schema import ENTRIES
from ledgerloom.sources import catalog, lines


def usage(i, o, cached=0, write=0, reasoning=0, total=None):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": cached, "cache_write_input_tokens": write, "reasoning_output_tokens": reasoning, "total_tokens": i + o if total is None else total}


def event(at, last, total, **more):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"last_token_usage": last, "total_token_usage": total}, **more}}


def step(*numbers):
    """Usage of one request: input, output, cached, written, reasoning."""
    return dict(zip(("i", "o", "cached", "write", "reasoning"), numbers, strict=False))


def running(*steps):
    """(last, total) of each request of a session."""
    total = {}
    for s in steps:
        total = {k: total.get(k, 0) + s.get(k, 0) for k in ("i", "o", "cached", "write", "reasoning")}
        yield usage(**s), usage(**total)


ONE, TWO, ODD, THREE = running(step(733, 61, 12, 5, 44), step(402, 0, 402), step(9, 3, 10), step(58, 17, 0, 58, 17))
CODEX = [
    event("2031-11-05T23:59:58.5Z", *ONE),  # before the session has a name: no fact
    {"type": "event_msg", "payload": {"type": "user_message", "text_elements": [{"kind": "mark"}, {"text": "< rename \t it"}]}},
    {"type": "turn_context", "payload": {"model": "  gpt-5.4 ", "thread_settings": {"service_tier": "FAST"}}},
    {"type": "session_meta", "timestamp": "2031-11-05T23:59:59Z", "payload": {"session_id": "tide-9", "cwd": "/srv/./north/"}},
    event("2031-11-06T01:30:00+01:30", *ONE),
    event("2031-11-06T00:00:07Z", *TWO),
    event("2031-11-06T00:00:08Z", *TWO),  # the same totals again
    {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"model": "gpt-5", "service_tier": "slow"}}},
    event("2031-11-06T00:00:09Z", *ODD),  # more cached than read
    {"type": "event_msg", "payload": {"type": "token_count"}},
    event(None, *THREE, note="no time"),
    event("2031-11-06T00:00:11Z", *THREE),
]


def answer(message_id, second, tokens, **more):
    return {"type": "assistant", "sessionId": "reef-4", "timestamp": f"2031-02-03T04:05:{second:02}Z", "message": {"id": message_id, "model": " claude-sonnet-4.6", "stop_reason": "tool_use", "usage": tokens}, **more}


CLAUDE = [
    answer("aa", 1, {"input_tokens": 3, "output_tokens": 901, "cache_creation": {"ephemeral_5m_input_tokens": 15, "ephemeral_1h_input_tokens": 6}, "speed": "fast"}, cwd="C/", isSidechain=True),
    {"type": "user", "sessionId": "reef-4", "message": {"content": " \n"}},
    {"type": "user", "sessionId": "reef-4", "isSidechain": True, "message": {"content": "aside"}},
    answer("aa", 2, {"input_tokens": 3, "output_tokens": 77, "cache_creation_input_tokens": 40, "cache_creation": {"ephemeral_1h_input_tokens": 55}}),
    {"type": "user", "sessionId": "reef-4", "message": {"content": [{"text": "Sail\tnorth"}, {"text": "or south"}]}},
    answer("bb", 3, {"input_tokens": 8, "output_tokens": 2, "cache_read_input_tokens": 1000, "inference_geo": "Global", "speed": "Default"}, gitBranch=" keel ", cwd="/p/q"),
    answer("cc", 4, {"input_tokens": 1, "cache_creation_input_tokens": "7"}),
    {"type": "assistant", "sessionId": "", "message": {"id": "dd", "stop_reason": "end_turn"}},
    {"type": "assistant", "sessionId": "reef-4", "message": {"id": "ee", "usage": {}}},
]
PI = [
    {"type": "message", "id": "h1", "timestamp": "2031-08-09T10:11:12Z", "message": {"role": "user", "content": [{"type": "text", "text": "plot a course"}]}},
    {"type": "message", "id": "h2", "timestamp": "2031-08-09T10:11:13Z", "message": {"role": "assistant", "model": "mist-2", "usage": {"input": 71, "output": 13, "cacheRead": 29, "cacheWrite": 0, "reasoning": 14, "totalTokens": 113}}},
    {"type": "message", "id": "h3", "timestamp": "2031-08-09T10:11:14Z", "message": {"role": "assistant", "model": "mist-2", "usage": {"input": 71, "output": 13, "cacheRead": 29, "cacheWrite": 0, "reasoning": 9, "totalTokens": 113}}},
    {"type": "session", "id": "fjord-3", "cwd": "/w/delta/.."},
    {"type": "branch_summary", "id": "h4", "timestamp": "2031-08-09T10:11:15Z", "usage": {"cost": {"total": 0.125}}},
    {"type": "message", "id": "h5", "timestamp": "2031-08-09T10:11:16Z", "message": {"role": "user", "content": "and back"}},
    {"type": "compaction", "id": "h6", "timestamp": "2031-08-09T10:11:17Z"},
    {"type": "message", "timestamp": "2031-08-09T10:11:18Z", "message": {"role": "assistant", "usage": {"input": 1, "totalTokens": 1}}},
    {"type": "message", "id": "h7", "timestamp": "x", "message": {"role": "assistant", "provider": "lab", "timestamp": 1943950280250, "usage": {"input": 6, "output": 0, "totalTokens": 6, "cost": {"total": 0}}}},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    out = {}
    for name, rows, tail in (("codex", CODEX, '{"type": "event'), ("claude", CLAUDE, ""), ("pi", PI, "not json\n")):
        (top / name / "deep").mkdir(parents=True)
        (top / name / "deep" / "one.JSONL").write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
        files = lines.read_files(spark, str(top / name), name)
        out[name] = getattr(dialects, name)(lines.json_lines(files)).cache()
    return out


def statuses(df):
    return {r.status: r["count"] for r in df.groupBy("status").count().collect()}


def test_codex_lines(parsed):
    assert statuses(parsed["codex"]) == {"fact": 3, "ignored": 5, "invalid": 4}
    a, b, c = parsed["codex"].where("status = 'fact'").orderBy("line_no").collect()
    assert (a.model, a.speed, a.title, a.project_hint, a.source_id) == ("gpt-5.4", "fast", "rename it", "north", "tide-9")
    assert (a.uncached_input_tokens, a.cache_read_input_tokens, a.cache_write_5m_input_tokens, a.output_tokens, a.reasoning_output_tokens) == (716, 12, 5, 61, 44)
    assert (str(a.occurred_at), b.uncached_input_tokens, b.cache_read_input_tokens) == ("2031-11-06 00:00:00", 0, 402)
    assert (c.model, c.speed, c.uncached_input_tokens, c.cache_write_5m_input_tokens) == ("gpt-5", "unknown", 0, 58)


def test_claude_lines_keep_the_largest(parsed):
    assert statuses(parsed["claude"]) == {"fact": 3, "ignored": 4, "invalid": 2}
    kept = sorted(ledger.deduplicate(dialects.entries(parsed["claude"])).collect(), key=lambda r: r.output_tokens)
    assert [(r.output_tokens, r.cache_write_5m_input_tokens, r.cache_write_1h_input_tokens, r.inference_geo, r.speed) for r in kept] == [(2, 0, 0, "global", "standard"), (901, 15, 6, "unknown", "fast")]
    again = parsed["claude"].where("line_no = 3").first()
    assert (again.cache_write_5m_input_tokens, again.cache_write_1h_input_tokens, again.speed, again.title) == (0, 40, "unknown", None)
    c = ledger.merge_conversations(dialects.conversation_facts(parsed["claude"])).first()
    assert (c.title, c.project_hint, c.branch, c.is_sidechain, str(c.first_at)) == ("Sail north", "q", "keel", True, "2031-02-03 04:05:01")


def test_pi_lines(parsed):
    assert statuses(parsed["pi"]) == {"fact": 3, "ignored": 4, "invalid": 3}
    a, b, c = parsed["pi"].where("status = 'fact'").orderBy("line_no").collect()
    assert (a.model, a.api_equivalent_cost_nanos, a.title, a.reasoning_output_tokens, a.project_hint) == ("mist-2", None, "plot a course", 9, None)
    assert (b.model, b.api_equivalent_cost_nanos, b.title, b.output_tokens) == ("mist-2", 125_000_000, None, 0)
    assert (c.model, c.api_equivalent_cost_nanos, c.title, str(c.occurred_at)[:19]) == ("lab", 0, "and back", "2031-08-08 10:11:20") and a.conversation_key != b.conversation_key == c.conversation_key


def test_summary_of_all_dialects(spark, parsed):
    facts = ledger.deduplicate(ledger.union_entries(*[dialects.entries(p) for p in parsed.values()]))
    priced = pricing.price(facts, catalog.bundled(spark), "f1")
    t = measured(priced.where("source != 'pi'")).first()
    # fast: 733 + 61 and 402 tokens at 2; 3 + 15 + 6 + 901 of a model without a fast price; of unknown speed: no price
    assert (t.entries, t.uncached_input_tokens, t.fast_raw_tokens, t.fast_billing_nanos, t.priced, t.unpriced_fast) == (5, 727, 794 + 402 + 925, (794 + 402) * 2 * 10**9, 3, 1)
    costs = {(r.source, r.speed, r.output_tokens): r.api_equivalent_cost_nanos for r in priced.collect()}
    assert costs["codex", "fast", 61] == 716 * 5_000 + 12 * 500 + 61 * 30_000 and costs["codex", "fast", 0] == 402 * 500
    assert costs["claude", "standard", 2] == 8 * 3_000 + 1000 * 300 + 2 * 15_000 and costs["claude", "fast", 901] is None and costs["codex", "unknown", 17] is None
    total = reports.summary_totals(priced, "source").first()
    assert total.pricing_fingerprint is None  # a priced source without a fingerprint
    assert reports.summary_totals(priced.where("source != 'pi'"), "source").first().pricing_fingerprint == "f1"


def test_opencode_store(spark):
    s = spark.createDataFrame([("s1", None, "/w/delta"), ("s2", " T2 ", None)], "id string, title string, directory string")
    message = lambda role, **d: json.dumps({"role": role, **d})
    m = spark.createDataFrame([
        ("a", "s1", 1000, message("user", model={"providerID": "openai", "modelID": "x1"})), ("b", "s1", 2000, message("assistant", tokens={"input": 10, "output": 4, "reasoning": 2, "cache": {"read": 1, "write": 3}}, cost="0.000001")),
        ("c", "s1", 3000, message("assistant", tokens={"input": 0, "output": 0}, cost=0)), ("d", "s2", 4000, message("assistant", providerID="p", modelID="m", tokens={"input": 5, "output": 0}, cost=0.5)), ("e", "s2", 5000, "broken"),
    ], "id string, session_id string, time_created long, data string")
    p = spark.createDataFrame([("s1", 2, "p2", '{"type":"text","text":"late"}'), ("s1", 1, "p1", '{"type":"tool"}')], "session_id string, time_created long, id string, data string")
    out = dialects.opencode(m, s, p).cache()
    assert statuses(out) == {"fact": 2, "ignored": 2, "invalid": 1}
    b, d = out.where("status = 'fact'").orderBy("occurred_at").collect()
    assert (b.model, b.output_tokens, b.reasoning_output_tokens, b.api_equivalent_cost_nanos, b.title, b.project_hint) == ("openai/x1", 6, 2, 1000, None, "delta")
    assert (d.model, d.api_equivalent_cost_nanos, d.title) == ("p/m", 500_000_000, "T2")


def test_manifest_actions(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"x":1}\n{"x":2')
    files = lines.read_files(spark, str(tmp_path), "claude")
    assert [r.line for r in lines.split_lines(files).collect()] == ['{"x":1}']
    schema = lines.manifest(files).schema
    known = spark.createDataFrame(lines.manifest(files).collect(), schema)
    action = lambda: lines.changes(lines.read_files(spark, str(tmp_path), "claude"), known).first().action
    assert action() == "skip"
    f.write_text('{"x":1}\n{"x":2}\n')
    assert action() == "append"
    f.write_text('{"y":1}\n{"x":2}\n')
    assert action() == "reset"
    f.write_text("{}\n")
    assert action() == "reset"
    assert lines.read_files(spark, str(tmp_path / "none"), "pi").count() == 0 and lines.list_files(spark, str(tmp_path / "none"), "pi").count() == 0


@pytest.mark.parametrize("piece", [None, "24b"])
def test_lines_are_read_as_text(spark, tmp_path, monkeypatch, piece):
    """Whole files and files in pieces give the same lines; names with every odd character."""
    top = tmp_path / "a+b (c) [d]{e}*?"
    (top / "x y%20").mkdir(parents=True)
    texts = {"one.jsonl": "".join(f"line {i} é\r\n" for i in range(40)) + "tail", "x y%20/two[1].JSONL": "\n\n" + "z" * 5000 + "\n", "empty.jsonl": "", "no.txt": "no\n", "long.jsonl": "q" * 60 + "\n{}\n"}
    for name, text in texts.items():
        (top / name).write_bytes(text.encode())
    monkeypatch.setattr(lines, "MAX_LINE_BYTES", 5500)
    if piece:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        files = lines.list_files(spark, str(top), "pi")
        got = lines.read_lines(spark, str(top), files)
        rows = {k: [] for k in ("one", "two[1]", "long")}
        for r in got.orderBy("stem", "line_no").collect():
            rows[r.stem].append((r.line_no, r.start, r.line, r.status))
        heads = {r.file_key: bytes(r.content) for r in lines.heads(got, files).collect()}
        content = {r.file_key: bytes(r.content)[: lines.PREFIX_BYTES] for r in lines.read_files(spark, str(top), "pi").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows["one"][:2] == [(0, 0, "line 0 é", "line"), (1, 11, "line 1 é", "line")] and rows["one"][40][2:] == ("tail", "tail")
    assert rows["two[1]"] == [(0, 0, "", "line"), (1, 1, "", "line"), (2, 2, "z" * 5000, "line")] and len(rows["long"]) == 2 and len(rows["one"]) == 41
    assert heads == content and len(heads) == 3  # empty files are not listed


def test_oversized_lines_are_invalid_and_taken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MAX_LINE_BYTES", 50)
    (tmp_path / "a.jsonl").write_text("{" + " " * 60 + "}\n{}\n \n")
    got = lines.parsed_lines(lines.read_lines(spark, str(tmp_path), lines.list_files(spark, str(tmp_path), "pi"))).orderBy("line_no").collect()
    assert [(r.line_no, r.status, r.v is None) for r in got] == [(0, "oversized", True), (1, "line", False)]


def test_entries_have_the_ledger_columns(parsed):
    assert dialects.entries(parsed["pi"]).columns == ENTRIES.names
    assert dialects.scan_counters(parsed["pi"]).first().asDict() == {"files": 1, "lines": 10, "fact": 3, "ignored": 4, "invalid": 3}
