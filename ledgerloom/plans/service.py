"""The commands of a ledger that lives in a folder: scan, rebuild, prices, status and the reads."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import dialects, ledger, pricing
from ledgerloom.schema import CATALOG, CONVERSATIONS, ENTRIES, SOURCES
from ledgerloom.sources import catalog, folders, lines
from ledgerloom.streaming import ingest

#: Ids of a store that are remembered, and days that an attempt to find a price is.
SEEN_IDS, ATTEMPT_DAYS = 20_000, 7
_SEEN = "id string, time_created long"
_ATTEMPTS = "source string, model string, speed string, attempted_at timestamp"


class Busy(RuntimeError):
    """A scan is running."""


@dataclass(frozen=True)
class Roots:
    """Where each source's files are; what is None has none. The store is a folder with `session`, `message` and `part` as Parquet."""

    codex: tuple[str, ...] = ()
    claude: tuple[str, ...] = ()
    pi: tuple[str, ...] = ()
    store: str | None = None
    codex_titles: str | None = None
    claude_titles: str | None = None


def idle() -> dict:
    """What a status says, before any scan."""
    return {
        "state": "idle", "current_source": None, "discovered_files": 0, "completed_files": 0, "bytes_read": 0, "inserted_entries": 0, "duplicate_entries": 0, "invalid_lines": 0,
        "failed_files": 0, "partial_failure": False, "cancelled": False, "started_at": None, "finished_at": None,
    }


@dataclass
class UsageLedger:
    """Facts, conversations, manifest, seen ids and active prices under one folder; each change is a new version of all of them.

    The facts of a version are written last, and readers go by them: so what is remembered of files and of the store is committed
    with the facts that came from them.
    """

    spark: SparkSession
    path: str
    roots: Roots
    zone: str = "UTC"
    status: dict = field(default_factory=idle)
    held: list[DataFrame] = field(default_factory=list)

    def _hold(self, df: DataFrame) -> DataFrame:
        """Keep what a scan uses several times until its end: a later listing of the same folders must not find it."""
        self.held.append(df.persist())
        return df

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        return max(folders.versions(self.spark, f"{self.path}/entries"), default=-1)

    def _read(self, name: str, schema, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.createDataFrame([], schema) if version < 0 else folders.read(self.spark, f"{self.path}/{name}", version, schema)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES)

    def conversations(self) -> DataFrame:
        return self._read("conversations", CONVERSATIONS)

    def prices(self) -> DataFrame:
        """The active catalog: what the last version was priced by; before that, the bundled one."""
        return catalog.bundled(self.spark) if self.version() < 0 else self._read("catalog", CATALOG)

    def _commit(self, **tables: DataFrame) -> int:
        """Write the next version; tables that are not given stay as they were."""
        old, new = self.version(), self.version() + 1
        for name, schema in (("manifest", lines.MANIFEST), ("seen", _SEEN), ("conversations", CONVERSATIONS), ("catalog", CATALOG), ("entries", ENTRIES)):
            rows = tables[name] if name in tables else self.prices() if name == "catalog" else self._read(name, schema, old)
            folders.write(rows, f"{self.path}/{name}", new)
        for name in ("manifest", "seen", "conversations", "catalog", "entries"):
            folders.expire(self.spark, f"{self.path}/{name}")
        return new

    # ------------------------------------------------------------ scans

    def _titles(self, place: str | None, source: str, id_path: str, title_path: str) -> DataFrame | None:
        return None if place is None else lines.titles(lines.json_lines(lines.read_files(self.spark, place, source)), id_path, title_path)

    def _changed(self, source: str, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict] | None:
        """(parsed lines that are new, manifest rows, file_key of rewritten files, counters) of one source's touched files."""
        roots = getattr(self.roots, source)
        listed = [lines.list_files(self.spark, r, source).withColumn("root", F.lit(r)) for r in roots]
        if not listed:
            return None
        files = reduce(DataFrame.unionByName, listed)
        files = self._hold(lines.newest_of_key(files) if source == "codex" else files)  # one of a session's live and archived file
        found = files.agg(F.count("*").alias("n")).first().n
        todo = self._hold(lines.touched(files, known.where(F.col("source") == source)))
        n, size = todo.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        counters = {"discovered_files": found, "completed_files": found, "bytes_read": size, "failed_files": 0}
        if not n:
            return None if not found else (None, None, None, counters)
        read = self._hold(reduce(DataFrame.unionByName, [lines.read_lines(self.spark, r, todo.where(F.col("root") == r)) for r in roots]))
        got = read.groupBy("file_key").agg(F.count(F.when(F.col("status") != "tail", 1)).alias("lines"))
        bad = todo.where("size > 0").join(got, "file_key", "left_anti").select("file_key")  # could not be read: tried again next time
        counters["failed_files"] = bad.count()
        counters["completed_files"] -= counters["failed_files"]
        todo = todo.join(bad, "file_key", "left_anti") if counters["failed_files"] else todo
        heads = lines.heads(read, todo)
        before = known.where(F.col("source") == source)
        actions = self._hold(lines.changes(heads, before).join(before.select("file_key", F.col("lines").alias("_taken")), "file_key", "left"))
        manifest = lines.manifest(heads).withColumn("source", F.lit(source)).join(got, "file_key", "left").fillna(0, ["lines"])
        titles = {"codex": (self.roots.codex_titles, "$.id", "$.thread_name"), "claude": (self.roots.claude_titles, "$.sessionId", "$.display")}
        more = (self._titles(titles[source][0], source, *titles[source][1:]),) if source in titles else ()
        # lines inherit from those before them, so a grown file is parsed whole, and what was taken before is left out
        parsed = getattr(dialects, source)(lines.parsed_lines(read), *more, zone=self.zone).join(F.broadcast(actions), "file_key")  # a row a touched file
        parsed = parsed.where((F.col("action") != "append") | (F.col("line_no") >= F.col("_taken"))).drop("action", "_taken")
        return parsed, manifest.select(*lines.MANIFEST.names), actions.where("action = 'reset'").select("file_key"), counters

    def _from_store(self, seen: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(parsed rows of new messages, ids seen by then); messages before the watermark are never looked at again."""
        if self.roots.store is None:
            return None
        t = {n: self.spark.read.parquet(f"{self.roots.store}/{n}") for n in ("message", "session", "part")}
        watermark = seen.agg(F.max("time_created")).first()[0] or 0
        new = self._hold(ingest.since_watermark(t["message"], watermark, seen).select("id", "session_id", "time_created"))
        if new.isEmpty():
            return None
        around = t["message"].join(new.select("session_id").distinct(), "session_id", "left_semi")  # a message inherits from those before it
        keys = new.select(S.hash_parts(F.lit("opencode-entry"), F.col("id")).alias("dedup_key"))
        parsed = dialects.opencode(around, t["session"], t["part"], zone=self.zone).join(keys, "dedup_key", "left_semi")
        latest = seen.unionByName(new.select("id", "time_created")).orderBy(F.desc("time_created"), F.desc("id")).limit(SEEN_IDS)
        return parsed, latest

    def scan(self, tag: str = "usage-scan", drop: tuple[str, ...] = ()) -> dict:
        """Take what is new in files and store, merge it with the facts that are there, and commit both with what was read.

        Files that did not change are not read. Of a file that grew only the new lines count; facts of a rewritten file are replaced;
        those of a deleted file stay. `drop` names sources whose facts and memory go first. Without anything new no version is written.
        """
        if self.status["state"] == "running":
            raise Busy
        self.status = idle() | {"state": "running", "started_at": _now(), "version": self.version()}
        self.spark.addTag(tag)
        try:
            self._scan(drop)
            self._apply_pending()
            self.status |= {"state": "idle", "current_source": None, "finished_at": _now(), "version": self.version(), "partial_failure": self.status["failed_files"] > 0}
            return dict(self.status)
        except BaseException as e:
            self.status |= {"state": "idle", "cancelled": "cancel" in str(e).lower(), "error": type(e).__name__, "finished_at": _now()}
            raise
        finally:
            self.spark.removeTag(tag)
            while self.held:
                self.held.pop().unpersist()

    def _scan(self, drop: tuple[str, ...]) -> None:
        known, seen = self._read("manifest", lines.MANIFEST), self._read("seen", _SEEN)
        entries, conversations = self.entries(), self.conversations()
        if drop:
            known, entries = known.where(~F.col("source").isin(*drop)), ledger.rebuild(entries, list(drop))
            conversations = ledger.without_orphans(conversations, entries)
            seen = seen.limit(0) if "opencode" in drop else seen
        parsed, manifests, rewritten = [], [], []
        for source in ("codex", "claude", "pi"):
            self.status["current_source"] = source
            found = self._changed(source, known)
            if found is None:
                continue
            for name, n in found[3].items():
                self.status[name] += n
            if found[0] is not None:
                parsed.append(found[0])
                manifests.append(found[1])
                rewritten.append(found[2])
        self.status["current_source"] = "opencode" if self.roots.store else None
        store = self._from_store(seen)
        if store is not None:
            parsed.append(store[0])
            seen = store[1]
        if not parsed:
            if drop:
                self._commit(manifest=known, seen=seen, conversations=conversations, entries=entries)
            return
        new = reduce(DataFrame.unionByName, parsed).withColumn("seq", F.concat(F.lit(f"{self.version() + 1:08d}|"), "seq"))
        self._hold(new)
        self.status["invalid_lines"] = new.where("status = 'invalid'").count()
        facts = ledger.valid_entries(dialects.entries(new))
        kept = ledger.reset_files(entries, reduce(DataFrame.unionByName, rewritten)) if rewritten else entries
        counts = ledger.insert_counters(facts, kept.join(facts.select("source", "dedup_key").distinct(), ["source", "dedup_key"], "left_semi")).first()
        self.status |= {"inserted_entries": counts.inserted, "duplicate_entries": counts.duplicates}
        rates = self.prices()
        priced = pricing.price(ledger.deduplicate(facts), rates, pricing.fingerprint(rates)).select(*ENTRIES.names)
        merged = ledger.deduplicate(kept.select(*ENTRIES.names).unionByName(priced))
        self._hold(merged)
        said = ledger.conversations_as_facts(conversations).unionByName(dialects.conversation_facts(new))
        conversations = ledger.without_orphans(ledger.merge_conversations(said), merged)
        remembered = reduce(DataFrame.unionByName, manifests, self.spark.createDataFrame([], lines.MANIFEST))
        remembered = known.join(remembered.select("source", "file_key"), ["source", "file_key"], "left_anti").select(*lines.MANIFEST.names).unionByName(remembered)
        self._commit(manifest=remembered, seen=seen, conversations=conversations.select(*CONVERSATIONS.names), entries=merged)

    def cancel(self, tag: str = "usage-scan") -> None:
        self.spark.interruptTag(tag)

    def rebuild(self, sources: list[str] | None = None) -> dict:
        """Forget the facts, files and ids of some sources (of all, if none are named) and read them again from what is there now."""
        if sources and set(sources) - set(SOURCES):
            raise ValueError("unknown source")
        return self.scan(drop=tuple(sources or SOURCES))

    # ------------------------------------------------------------ prices

    def reprice(self, rates: DataFrame) -> dict:
        """Make another catalog the active one and price all facts by it; nothing is computed if it is the active one already."""
        if self.status["state"] == "running":
            raise Busy
        print_ = pricing.fingerprint(rates)
        if self.version() >= 0 and print_ == pricing.fingerprint(self.prices()):
            return {"updated": 0, "priced": 0, "unpriced": 0, "fingerprint": print_, "skipped": True}
        new, counts = pricing.reprice(self.entries(), rates, print_)
        out = counts.first().asDict() | {"fingerprint": print_, "skipped": False}
        self._commit(entries=new.select(*ENTRIES.names), catalog=rates.select(*CATALOG.names))
        return out

    def _pending(self) -> str:
        return f"{self.path}/pending"

    def stage_prices(self, rates: DataFrame) -> None:
        """Keep a catalog for the end of the next scan; until then readers and scans go by the active one."""
        folders.write(rates.select(*CATALOG.names), self._pending(), max(folders.versions(self.spark, self._pending()), default=-1) + 1)
        folders.expire(self.spark, self._pending())

    def _apply_pending(self) -> None:
        if not folders.versions(self.spark, self._pending()):
            return
        rates = folders.latest(self.spark, self._pending(), CATALOG)
        if self.version() >= 0 and pricing.fingerprint(rates) != pricing.fingerprint(self.prices()):
            new, _ = pricing.reprice(self.entries(), rates, pricing.fingerprint(rates))
            self._commit(entries=new.select(*ENTRIES.names), catalog=rates)
        folders.delete(self.spark, self._pending())

    def refresh_prices(self, list_a: str | None, list_b: str | None, now: float) -> str:
        """Stage what two remote lists say (None: could not be fetched): `complete`, `partial` where one is missing or refused, `failed`.

        A list that cannot be read, or has become much shorter, is refused; what it said before stays in force.
        """
        state = self.refresh_state()
        rates, sizes, got = [], dict(state.get("sizes", {})), 0
        for name, text, reader in (("a", list_a, catalog.read_list_a), ("b", list_b, catalog.read_list_b)):
            try:
                rows = None if text is None else reader(self.spark, text)
                n = 0 if rows is None else rows.count()
            except (ValueError, AttributeError, TypeError):
                rows, n = None, 0
            if rows is None or not n or not catalog.accepts_refresh(sizes.get(name, 0), n):
                rows = reader(self.spark, "{}")
            else:
                got, sizes[name] = got + 1, n
            rates.append(rows)
        if got:
            local = catalog.bundled(self.spark)
            before = folders.latest(self.spark, self._pending(), CATALOG) if folders.versions(self.spark, self._pending()) else self.prices()
            remote = catalog.remote_layer(rates[0], rates[1], local)
            old = before.where(F.col("priority") == catalog.REMOTE)
            if got < 2:  # what the missing list said before
                old_only = old.join(remote.select("source", "speed", "model_prefix"), ["source", "speed", "model_prefix"], "left_anti")
                remote = remote.unionByName(old_only.select(*remote.columns))
            self.stage_prices(local.unionByName(catalog.keep_last_known(old, remote).select(*local.columns)))
        outcome = ("failed", "partial", "complete")[got]
        folders.write_text(self.spark, f"{self.path}/refresh.json", json.dumps(state | {"sizes": sizes, "last_success" if got else "last_failure": now, "outcome": outcome}))
        return outcome

    def refresh_state(self) -> dict:
        """last_success, last_failure, outcome and sizes of the lists, as of the last refresh; empty before one."""
        text = folders.read_text(self.spark, f"{self.path}/refresh.json")
        return json.loads(text) if text else {}

    def refresh_due(self, now: float) -> bool:
        state = self.refresh_state()
        return catalog.refresh_due(now, state.get("last_success"), state.get("last_failure"))

    def due_missing_prices(self, now: datetime) -> DataFrame:
        """(source, model, speed) that no catalog row covers and that may be asked for now; they count as asked for from now on.

        Attempts are kept for ATTEMPT_DAYS, and none is due again within the cooldown.
        """
        place = f"{self.path}/attempts"
        tried = folders.latest(self.spark, place, _ATTEMPTS).where(F.col("attempted_at") > F.lit(now - timedelta(days=ATTEMPT_DAYS)))
        due = pricing.missing_keys(pricing.price_keys(self.entries()), self.prices(), tried, now).persist()
        if not due.isEmpty():
            again = tried.join(due, ["source", "model", "speed"], "left_anti").select("source", "model", "speed", "attempted_at")
            folders.write(again.unionByName(due.withColumn("attempted_at", F.lit(now).cast("timestamp"))), place, max(folders.versions(self.spark, place), default=-1) + 1)
            folders.expire(self.spark, place)
        return due

    # ------------------------------------------------------------ recovery and timing

    def recover(self, quota: str | None = None) -> str | None:
        """Put a broken ledger aside and keep the valid quota points of its history at `quota`; the next scan builds the rest again.

        Returns where the old folder went, None if there was none.
        """
        from ledgerloom.operators import quota as points
        from ledgerloom.schema import QUOTA_EVENTS

        aside = f"{self.path.rstrip('/')}-quarantine-{datetime.now(UTC):%Y%m%d%H%M%S%f}"
        if not folders.move(self.spark, self.path, aside):
            return None
        if quota is not None:
            history = self.spark.read.option("ignoreCorruptFiles", "true").schema(QUOTA_EVENTS).parquet(f"{aside}/{quota}")
            folders.write(points.valid_events(history), f"{self.path}/{quota}", 0)
        self.status = idle()
        return aside

    def watch(self, seconds: int = 300):
        """Start a query that scans again and again while none is running; stop it like any streaming query."""

        def tick(_: DataFrame, __: int) -> None:
            if self.status["state"] != "running":
                self.scan()

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").start()


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
