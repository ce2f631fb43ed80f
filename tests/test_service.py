import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit
from ledgerloom.plans import readings, reports, scheduling, service
from ledgerloom.schema import QUOTA_EVENTS
from ledgerloom.sources import catalog, folders
from tests.test_dialects import CLAUDE, CODEX, PI, answer


def write(place, rows):
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def made(spark, tmp_path):
    """A ledger over files of three sources."""
    for name, rows in (("codex", CODEX), ("archive", CODEX), ("claude", CLAUDE), ("pi", PI)):
        write(tmp_path / name / "one.jsonl", rows)
    write(tmp_path / "titles" / "t.jsonl", [{"id": "tide-9", "thread_name": "Named"}])
    roots = service.Roots((str(tmp_path / "codex"), str(tmp_path / "archive")), (str(tmp_path / "claude"),), (str(tmp_path / "pi"),), codex_titles=str(tmp_path / "titles"))
    return tmp_path, service.UsageLedger(spark, str(tmp_path / "ledger"), roots)


def totals(lg):
    return sorted(tuple(r) for r in reports.summary(lg.entries(), "source").collect())


def keys(lg):
    return {(r.source, r.dedup_key) for r in lg.entries().collect()}


def test_scan_rescan_append_and_deletion(made):
    top, lg = made
    first = lg.scan()
    assert (first["version"], first["discovered_files"], first["inserted_entries"], first["duplicate_entries"], first["invalid_lines"], first["failed_files"]) == (0, 3, 8, 1, 8, 0)
    assert first["state"] == "idle" and first["bytes_read"] > 0 and first["started_at"] <= first["finished_at"] and not first["partial_failure"]
    before, had = totals(lg), keys(lg)
    titles = {r.source: r.title for r in lg.conversations().collect() if r.source != "pi"}
    assert titles == {"codex": "Named", "claude": "Sail north"} and len(had) == 8
    again = lg.scan()  # nothing changed: nothing is read, inserted or written
    assert (again["version"], again["bytes_read"], again["inserted_entries"], again["duplicate_entries"], again["discovered_files"]) == (0, 0, 0, 0, 3) and totals(lg) == before
    with (top / "claude" / "one.jsonl").open("a") as f:
        f.write(json.dumps(answer("ff", 30, {"input_tokens": 5, "output_tokens": 6}, gitBranch="mast")) + "\n" + json.dumps(answer("aa", 31, {"input_tokens": 1})) + "\n" + '{"type": "assi')
    grown = lg.scan()
    assert (grown["version"], grown["inserted_entries"], grown["duplicate_entries"], grown["invalid_lines"]) == (1, 1, 1, 0) and len(keys(lg) - had) == 1 and had < keys(lg)
    c = lg.conversations().where("source = 'claude'").first()
    assert (c.branch, c.title, str(c.first_at), str(c.last_at)) == ("mast", "Sail north", "2031-02-03 04:05:01", "2031-02-03 04:05:31")
    had = keys(lg)
    (top / "pi" / "one.jsonl").unlink()  # logs are pruned by their tools: what they said stays
    write(top / "claude" / "two.jsonl", [answer("gg", 40, {"input_tokens": 2})])
    assert lg.scan()["inserted_entries"] == 1 and had < keys(lg) and len(keys(lg)) == len(had) + 1
    (top / "archive" / "one.jsonl").unlink()
    assert lg.scan()["inserted_entries"] == 0 and len(keys(lg)) == len(had) + 1


def test_rewritten_files_and_rebuild(made):
    top, lg = made
    lg.scan()
    had = keys(lg)
    write(top / "claude" / "one.jsonl", [answer("zz", 1, {"input_tokens": 2})])  # another beginning
    now = lg.scan()
    assert now["inserted_entries"] == 1 and {k for k in keys(lg) if k[0] != "claude"} == {k for k in had if k[0] != "claude"} and len([k for k in keys(lg) if k[0] == "claude"]) == 1
    (top / "claude" / "one.jsonl").unlink()
    rest = {k for k in had if k[0] != "claude"}
    assert lg.rebuild(["claude"])["discovered_files"] == 2 and keys(lg) == rest and lg.conversations().where("source = 'claude'").count() == 0
    (top / "pi" / "one.jsonl").unlink()
    assert lg.rebuild(["codex"])["inserted_entries"] == 3 and keys(lg) == rest  # pi is not touched
    lg.rebuild()
    assert keys(lg) == {k for k in rest if k[0] == "codex"}
    with pytest.raises(ValueError):
        lg.rebuild(["nobody"])
    lg.status["state"] = "running"
    with pytest.raises(service.Busy):
        lg.scan()


def test_store_watermark_and_seen_ids(spark, tmp_path):
    store, said = str(tmp_path / "store"), lambda role, **d: json.dumps({"role": role, **d})
    user, reply = said("user", model={"providerID": "lab", "modelID": "m7"}), said("assistant", tokens={"input": 4, "output": 1})
    rows = [("a", "s", 1000, user), ("b", "s", 2000, reply)]

    def put(rows):
        spark.createDataFrame(rows, "id string, session_id string, time_created long, data string").write.mode("overwrite").parquet(f"{store}/message")

    put(rows)
    spark.createDataFrame([("s", "T", "/w/x")], "id string, title string, directory string").write.parquet(f"{store}/session")
    spark.createDataFrame([], "session_id string, time_created long, id string, data string").write.parquet(f"{store}/part")
    lg = service.UsageLedger(spark, str(tmp_path / "ledger"), service.Roots(store=store))
    assert lg.scan()["inserted_entries"] == 1 and lg.scan()["version"] == 0
    put([*rows, ("c", "s", 2000, reply), ("d", "s", 3000, reply), ("e", "s", 1500, reply)])  # e is late: never looked at
    assert lg.scan()["inserted_entries"] == 2 and {r.model for r in lg.entries().collect()} == {"lab/m7"} and lg.entries().count() == 3
    assert lg.scan()["version"] == 1 and lg.rebuild(["opencode"])["inserted_entries"] == 4


def test_prices_are_kept_and_gated(spark, made):
    top, lg = made
    lg.scan()
    assert lg.reprice(catalog.bundled(spark))["skipped"]
    cheap = lg.reprice(catalog.bundled(spark).where("source = 'claude'"))
    assert (cheap["updated"], cheap["priced"], cheap["unpriced"], cheap["skipped"]) == (3, 1, 4, False)  # of one only the fingerprint
    again = service.UsageLedger(spark, lg.path, lg.roots)  # another process: the active catalog is where the facts are
    assert again.prices().where("source = 'codex'").count() == 0 and again.reprice(catalog.bundled(spark).where("source = 'claude'"))["skipped"]
    again.stage_prices(catalog.bundled(spark))
    assert again.entries().where("source = 'codex' AND api_equivalent_cost_nanos IS NOT NULL").count() == 0  # readers see the active one
    again.scan()
    assert again.entries().where("source = 'codex' AND api_equivalent_cost_nanos IS NOT NULL").count() == 2
    now = datetime(2031, 12, 1, tzinfo=UTC)
    # of unknown speed, or a model without that price
    assert {tuple(r) for r in again.due_missing_prices(now).collect()} == {("claude", "claude-sonnet-4-6", "fast")}
    assert again.due_missing_prices(now + timedelta(minutes=29)).count() == 0 and again.due_missing_prices(now + timedelta(minutes=31)).count() == 1


def test_refresh_outcomes(spark, made):
    _, lg = made
    lg.scan()
    a = json.dumps({"mist-2": {"litellm_provider": "openai", "input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}})
    b = json.dumps({"anthropic": {"models": {"claude-sonnet-4-6": {"cost": {"input": 3, "output": 15}, "experimental": {"modes": {"fast": {"cost": {"input": 6, "output": 30}}}}}}}})
    assert lg.refresh_due(0.0) and lg.refresh_prices(None, "not json", 10.0) == "failed" and not lg.refresh_due(100.0) and lg.refresh_due(2000.0)
    assert lg.refresh_prices(a, None, 20.0) == "partial" and lg.refresh_prices(None, b, 30.0) == "partial" and lg.refresh_prices(a, b, 40.0) == "complete"
    assert lg.refresh_state()["last_success"] == 40.0 and not lg.refresh_due(50.0) and lg.refresh_due(40.0 + 86400)
    assert lg.prices().where("priority = 1").count() == 0
    lg.scan()
    assert {(r.source, r.model_prefix, r.speed) for r in lg.prices().where("priority = 1").collect()} >= {("claude", "claude-sonnet-4-6", "fast"), ("codex", "mist-2", "standard")}
    assert lg.entries().where("source = 'claude' AND speed = 'fast'").first().api_equivalent_cost_nanos == 3 * 6_000 + 15 * 0 + 6 * 12_000 + 901 * 30_000


def test_recovery_keeps_valid_quota_points(spark, made):
    top, lg = made
    lg.scan()
    at = datetime(2031, 1, 1, tzinfo=UTC)
    good = ("lab", "i", "weekly", "weekly", 50.0, None, at)
    spark.createDataFrame([good, (None, "i", "weekly", "weekly", 5.0, None, at), ("lab", "i", "weekly", "weekly", 500.0, None, at), ("lab", "i", "odd", "weekly", 5.0, None, at)], QUOTA_EVENTS).write.parquet(f"{lg.path}/quota")
    had = keys(lg)
    aside = lg.recover("quota")
    assert "quarantine" in aside and lg.version() == -1 and [tuple(r)[:5] for r in folders.latest(spark, f"{lg.path}/quota", QUOTA_EVENTS).collect()] == [good[:5]]
    assert lg.scan()["inserted_entries"] == 8 and keys(lg) == had
    assert service.UsageLedger(spark, str(top / "nowhere"), lg.roots).recover() is None


def test_watch_scans_by_itself(made):
    import time

    _, lg = made
    query = lg.watch(1)
    try:
        for _ in range(120):
            if lg.version() >= 0:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert lg.version() == 0 and len(keys(lg)) == 8


def test_cancel_leaves_the_last_version(made, monkeypatch):
    _, lg = made
    lg.scan()
    monkeypatch.setattr(lg, "_scan", lambda drop: (_ for _ in ()).throw(RuntimeError("job was cancelled")))
    with pytest.raises(RuntimeError):
        lg.scan()
    assert lg.status["cancelled"] and lg.status["state"] == "idle" and lg.version() == 0


def test_reading_cache(spark, tmp_path):
    place = str(tmp_path / "cache.json")
    assert readings.read_cache(spark, place) is None
    r = readings.Readings(spark, place)
    assert r.refresh("lab", 100.0, lambda: ("ok", {"left": 7}, "me", None)) == "ok" and r.refresh("lab", 110.0, None) == "throttle"
    assert r.refresh("lab", 200.0, lambda: ("rate_limited", None, None, 45)) == "rate_limited" and r.refresh("lab", 230.0, None) == "block"
    again = readings.Readings(spark, place)
    assert again.snapshot("lab") == {"left": 7} and again.states["lab"].blocked_until == 245.0 and again.snapshot("other") is None
    for text in ('{"version": 0, "providers": {}}', "{broken", "[]"):
        folders.write_text(spark, place, text)
        assert readings.read_cache(spark, place) is None and folders.read_text(spark, place) is None
    pages = spark.createDataFrame([("a", '{"status": {"indicator": "major", "description": "slow"}, "page": {"updated_at": "t"}}'), ("b", '{"status": {"indicator": "purple"}}'), ("c", "x")], "provider string, body string")
    assert {tuple(x) for x in readings.service_states(pages).collect()} == {("a", "major", "slow", "t"), ("b", "unknown", None, None)}
    assert scheduling.RefreshState().snapshot is None


def test_audit_report(spark, tmp_path):
    s = "day string, source string, model string, speed string, input_tokens long"
    a, b = spark.createDataFrame([("d1", "x", "m", "s", 5), ("d2", "x", "m", "s", 5)], s), spark.createDataFrame([("d1", "x", "m", "s", 5), ("d3", "x", "m", "s", 5)], s)
    assert audit.write_report(audit.compare(a, b, values=("input_tokens",)), str(tmp_path / "r")) == {"equal": 1, "only_ours": 1, "only_theirs": 1}
    assert spark.read.json(str(tmp_path / "r")).where(F.col("state") == "only_theirs").first().day == "d3"
