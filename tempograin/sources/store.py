"""A store of series on Parquet: declared aspects, atomic and idempotent ingest, reads and maintenance.

Layout under the root::

    aspects/<name>.json                                declarations
    log/<aspect>/<number>.json                         commits, each created once and whole; a snapshot sums up those before it
    data/aspect=…/attempt=…/part_day=…                 rows, a folder for each attempt to write

Only the log says which attempts count: what a failed writer leaves is never read.  A commit takes the next number, and only one writer can create
it; the loser folds in what came between and tries the next.  Its key and fingerprint stand in the commit itself, so a replay after any crash finds
either all of it or nothing.  Reads apply last-writer-wins, so late and repeated data need no order.  Maintenance writes new attempts and commits that they
replace old ones; files that no commit needs any more stay until ``vacuum``, so running readers never lose theirs.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.functions.decimals import ENCODINGS, checked, decode
from tempograin.functions.grid import NANOS, floor_div, width
from tempograin.functions.tags import select_series, series_key, tags_of
from tempograin.operators import reads
from tempograin.operators.interpolate import MOST_POINTS, interpolate
from tempograin.operators.reduce import DEFAULT, downsample
from tempograin.plans.scratch import written

#: Rows in files: newly ingested ones take their seal from the commit, rewritten ones keep their own.
ROWS = "series_key string, ts long, value decimal(38,18), seal_seq long, row_seq long, attempt string, part_day long"
#: Commits after which a snapshot sums them up, commits whose seals are a literal rather than a join, and knots of one stored reconstruction.
SNAPSHOT, LITERAL, MOST_KNOTS = 100, 200, 1 << 22


@dataclass(frozen=True)
class Aspect:
    """What an aspect declares, for good: encoding, tolerance, time unit, the tag keys of an upsert, and a time to live in nanoseconds."""

    name: str
    encoding: str = "text"
    scale: int = 2
    tolerance: float = 0.0
    unit: str = "us"
    upsert_keys: tuple[str, ...] | None = None
    ttl_nanos: int | None = None

    def __post_init__(self):
        if self.encoding not in ENCODINGS or self.unit not in NANOS:
            raise ValueError(f"unknown encoding or unit: {self}")


@dataclass
class Receipt:
    seal_seq: int
    rows: int
    replayed: bool = False
    series: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Body:
    """One of the ingests that :meth:`Store.ingest_bodies` takes together: the number that its rows bear, and what an ingest of them is told."""

    number: int
    key: str | None = None
    require_sorted: bool = False
    most_rows_per_file: int | None = None


class Conflict(RuntimeError):
    """Another writer has replaced what this one worked on."""


class Store:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._path(self.root).toUri().getPath() if self._fs.getScheme() == "file" else None

    # Small files: one JSON text each.
    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _put(self, name: str, value: object, overwrite: bool = False) -> bool:
        """Write a file whole or not at all; False if there is one already and ``overwrite`` isn't said."""
        tmp = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(f"{self.root}/{tmp}"), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if self._local and not overwrite:  # a link is made once, where a local rename would overwrite
                os.link(f"{self._local}/{tmp}", f"{self._local}/{name}")
            else:
                jvm = self.spark.sparkContext._jvm
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.OVERWRITE if overwrite else rename.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(self._path(f"{self.root}/{tmp}"), self._path(f"{self.root}/{name}"), options)
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            self._fs.delete(self._path(f"{self.root}/{tmp}"), False)
        return True

    def _get(self, name: str):
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _list(self, name: str) -> list[str]:
        at = self._path(f"{self.root}/{name}")
        found = (s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else ()
        return sorted(n for n in found if n[0] != ".")

    # Catalog.
    def declare(self, aspect: Aspect) -> None:
        """Idempotent; a different declaration is refused unless it widens the encoding to text."""
        name = f"aspects/{aspect.name}.json"
        if self._exists(name) or not self._put(name, asdict(aspect)):
            old = self.aspect(aspect.name)
            if old == aspect:
                return
            if asdict(old) | {"encoding": "text"} != asdict(aspect):
                raise ValueError(f"{aspect.name} is declared otherwise: {old}")
            self._put(name, asdict(aspect), overwrite=True)

    def aspect(self, name: str) -> Aspect:
        if not self._exists(f"aspects/{name}.json"):
            raise KeyError(f"aspect {name!r} isn't declared")
        found = self._get(f"aspects/{name}.json")
        return Aspect(**found | {"upsert_keys": tuple(found["upsert_keys"]) if found["upsert_keys"] is not None else None})

    def aspects(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._list("aspects")]

    def catalog(self) -> DataFrame:
        """aspect, encoding, unit, commits, rows ingested, earliest and latest instant; one row an aspect."""
        out = []
        for a in map(self.aspect, self.aspects()):
            sealed = [c for c in self._log(a.name) if c["kind"] != "rewrite" and c["rows"]]
            out.append((a.name, a.encoding, a.unit, len(sealed), sum(c["rows"] for c in sealed), min((c["min_ts"] for c in sealed), default=None), max((c["max_ts"] for c in sealed), default=None)))
        return self.spark.createDataFrame(out, "aspect string, encoding string, unit string, commits long, rows long, earliest long, latest long")

    # The log.
    def _log(self, aspect: str) -> list[dict]:
        """All commits in order.  Those before the latest snapshot come from it in one read, so at most SNAPSHOT files and a few are opened."""
        names = self._list(f"log/{aspect}")
        whole = max((n for n in names if n.startswith("snapshot-")), default=None)
        log = self._get(f"log/{aspect}/{whole}") if whole else []
        log += [self._get(f"log/{aspect}/{n}") for n in names if not n.startswith("snapshot-") and int(n.removesuffix(".json")) >= len(log)]
        return log

    def _commit(self, aspect: str, made: Callable[[list[dict]], dict | None], log: list[dict] | None = None) -> tuple[dict, bool]:
        """Append what ``made`` makes of the log, by compare and create; what it finds there already (it gives None and the entry) isn't appended."""
        while True:
            log = self._log(aspect) if log is None else log
            entry = made(log)
            if "number" in entry:
                return entry, False
            entry = entry | {"number": len(log)}
            if self._put(f"log/{aspect}/{len(log):012d}.json", entry):
                if (len(log) + 1) % SNAPSHOT == 0:
                    self._put(f"log/{aspect}/snapshot-{len(log) + 1:012d}.json", [*log, entry])
                return entry, True
            log = None

    @staticmethod
    def _next_seal(log: list[dict]) -> int:
        return sum(c["kind"] != "rewrite" for c in log)

    @staticmethod
    def _live(log: list[dict]) -> tuple[dict[str, int | None], list[tuple[int, int | None, int | None]]]:
        """Attempts that count, with the seal of those that take it from their commit, and the ranges (seal, start, end) cleared since their last rewrite."""
        live: dict[str, int | None] = {}
        clears: list[tuple[int, int | None, int | None]] = []
        for c in log:
            if c["kind"] == "rewrite":
                for a in c["replaces"]:
                    live.pop(a, None)
                clears = [x for x in clears if x[0] >= c["seals"]] if c["whole"] else clears
            if c["kind"] == "replace":
                clears.append((c["seal_seq"], c["start"], c["end"]))
            if c["attempt"]:
                live[c["attempt"]] = c.get("seal_seq")
        return live, clears

    def _data(self, aspect: str, attempt: str = "") -> str:
        return f"{self.root}/data/aspect={aspect}" + (f"/attempt={attempt}" if attempt else "")

    # Rows.
    def rows(self, aspect: str, log: list[dict] | None = None, only: Sequence[str] | None = None) -> DataFrame:
        """Stored rows: aspect, series_key, ts, value (a decimal), seal_seq, row_seq, part_day."""
        live, clears = self._live(self._log(aspect) if log is None else log)
        live = live if only is None else {a: live[a] for a in only}
        if not live:
            raw = self.spark.createDataFrame([], ROWS)
        else:
            raw = self.spark.read.schema(ROWS).option("basePath", self._data(aspect)).parquet(*[self._data(aspect, a) for a in live])
        sealed = [(a, s) for a, s in live.items() if s is not None]
        if len(sealed) > LITERAL:
            small = self.spark.createDataFrame(sealed, "attempt string, _seal long")
            raw = raw.join(F.broadcast(small) if len(sealed) < 100_000 else small, "attempt", "left")
            raw = raw.withColumn("seal_seq", F.coalesce("seal_seq", "_seal")).drop("_seal")
        elif sealed:
            seals = F.create_map(*[F.lit(x) for a in sealed for x in a])
            raw = raw.withColumn("seal_seq", F.coalesce("seal_seq", F.element_at(seals, F.col("attempt")).cast("long")))
        for seal, start, end in clears:
            raw = raw.where(~((F.col("seal_seq") < seal) & _within(start, end)))
        return raw.select(F.lit(aspect).alias("aspect"), "series_key", "ts", "value", "seal_seq", "row_seq", "part_day")

    def _alive(self, aspect: Aspect, rows: DataFrame) -> DataFrame:
        """Without rows that the aspect's time to live hides now."""
        if aspect.ttl_nanos is None:
            return rows
        return reads.live(rows, self.clock() // NANOS[aspect.unit], aspect.ttl_nanos, aspect.unit)

    def _pruned(self, aspect: str, start: int | None, end: int | None) -> DataFrame:
        """Rows of a range that are alive; the days are partitions, so others aren't listed."""
        a = self.aspect(aspect)
        rows, day = self.rows(aspect), 86_400 * 10**9 // NANOS[a.unit]
        if a.ttl_nanos is not None:
            oldest = reads.expiry_cutoff(self.clock() // NANOS[a.unit], a.ttl_nanos, a.unit)
            start = oldest if start is None else max(start, oldest)
        if start is not None:
            rows = rows.where(F.col("part_day") >= F.lit(start // day))
        if end is not None:
            rows = rows.where(F.col("part_day") <= F.lit(end // day))
        return self._alive(a, rows).drop("part_day")

    def _write(self, aspect: str, attempt: str, rows: DataFrame, most: int | None = None, by: Sequence[str] = ("part_day",)) -> None:
        """Files sorted by day, series and instant, of even size however the rows fall: a day with most rows is many tasks."""
        order = (*by, "series_key", "ts", "row_seq")
        out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write
        (out.option("maxRecordsPerFile", most) if most else out).partitionBy(*by).parquet(self._data(aspect, attempt))

    def _prepared(self, a: Aspect, points: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Points as rows: checked tags, and values that the encoding holds, as exact decimals."""
        df = points.withColumn("tags", F.create_map().cast("map<string,string>")) if "tags" not in points.columns else points
        df = df.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in df.columns else df
        if a.upsert_keys is not None:
            odd = F.exists(F.map_keys("tags"), lambda k: ~k.isin(*a.upsert_keys)) if a.upsert_keys else F.size("tags") > 0
            df = df.withColumn("tags", F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit("a tag outside the upsert keys"))).otherwise(F.col("tags")))
        value = F.col("value").cast("string") if a.encoding == "text" else decode(checked(F.col("value"), a.encoding, a.scale, a.tolerance), a.encoding, a.scale)
        day = 86_400 * 10**9 // NANOS[a.unit]
        return df.select(*keep, series_key(F.col("tags")).alias("series_key"), F.col("ts").cast("long").alias("ts"), value.cast("decimal(38,18)").alias("value"), F.col("seq").cast("long").alias("row_seq"), floor_div(F.col("ts"), day).alias("part_day"))

    @staticmethod
    def _marks(made: DataFrame, ordered: bool, by: Sequence[str] = ()) -> dict[tuple, tuple]:
        """Rows, their fingerprint, and the range of their instants, for each value of ``by``."""
        hashed = F.xxhash64("series_key", "ts", "value")
        found = made.groupBy(*by).agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit(1 << 31))), F.bit_xor(F.xxhash64(hashed, "row_seq")) if ordered else F.lit(0), F.min("ts"), F.max("ts"))
        return {tuple(r)[: len(by)]: Store._marked(tuple(r)[len(by) :]) for r in found.collect()}  # a row each

    @staticmethod
    def _marked(m: tuple) -> tuple:
        return m[0], hashlib.sha256(repr(tuple(map(str, m))).encode()).hexdigest(), m[4], m[5]

    @staticmethod
    def _mark(made: DataFrame, ordered: bool) -> tuple:
        return Store._marks(made, ordered)[()]

    def ingest(self, aspect: str, points: DataFrame, key: str | None = None, require_sorted: bool = False, most_rows_per_file: int | None = None, replacing: tuple[int | None, int | None] | None = None) -> Receipt:
        """Append ``points`` (ts, value[, tags][, seq]) as a new seal, all or nothing.

        With a ``key`` a repeat of the same points is answered from the log, and of others refused.  Values must fit the declared encoding within its
        tolerance; with declared upsert keys a tag outside them is refused.  ``replacing`` is a range whose older rows go with the same commit.
        """
        a = self.aspect(aspect)
        made, log = self._prepared(a, points), self._log(aspect)
        ordered = "seq" in points.columns
        if require_sorted:
            bad = reads.order_violations(made.withColumn("seal_seq", F.lit(0)), ["series_key", "seal_seq"]).first()
            if bad:
                raise ValueError(f"row {bad['row_seq']} goes back from {bad['previous']} to {bad['current']}")
        if known := self._keyed(log, key):
            return self._replayed(known, key, self._mark(made, ordered)[1])
        attempt = uuid.uuid4().hex
        self._write(aspect, attempt, made, most_rows_per_file)
        written = self.spark.read.schema(ROWS).option("basePath", self._data(aspect)).parquet(self._data(aspect, attempt))
        return self._seal(aspect, attempt, self._mark(written, ordered), key, log, replacing)

    def _seal(self, aspect: str, attempt: str, mark: tuple, key: str | None, log: list[dict] | None = None, replacing: tuple[int | None, int | None] | None = None) -> Receipt:
        """Commit a written attempt, unless its key is known by now.  A ``log`` gets what was committed, for the next one."""
        rows, fingerprint, lo, hi = mark
        start, end = replacing or (None, None)

        def entry(log: list[dict]) -> dict:
            span = {"start": start, "end": end} if replacing else {}
            return self._keyed(log, key) or {"kind": "replace" if replacing else "ingest", "seal_seq": self._next_seal(log), "attempt": attempt, "rows": rows, "min_ts": lo, "max_ts": hi, "key": key, "fingerprint": fingerprint, **span}

        done, mine = self._commit(aspect, entry, log)
        if mine and log is not None:
            log[:] = [*log, done] if done["number"] == len(log) else self._log(aspect)
        return Receipt(done["seal_seq"], rows) if mine else self._replayed(done, key, fingerprint)

    def ingest_bodies(self, aspect: str, points: DataFrame, bodies: Sequence[Body]) -> list[Receipt]:
        """Seal each body of ``points`` (body, ts, value, seq[, tags]) by itself and in the order given, as an :meth:`ingest` of each would, by jobs that all bodies share.

        Nothing is committed before all are written. If one is refused they are halved, so those before it are sealed and its own error is raised.
        ``points`` is computed once, or in that case again for each half.
        """
        if not bodies:
            return []
        a, log = self.aspect(aspect), self._log(aspect)
        known = {c["key"]: c for c in log if c.get("key") is not None}
        new = {b.number: uuid.uuid4().hex for b in bodies if b.key not in known}
        try:
            made = written(self._prepared(a, points.where(F.col("body").isin([b.number for b in bodies])), ["body"]), "bodies")
            if strict := [b.number for b in bodies if b.require_sorted]:
                bad = reads.order_violations(made.where(F.col("body").isin(strict)).withColumn("seal_seq", F.lit(0)), ["body", "series_key", "seal_seq"]).first()
                if bad:
                    raise ValueError(f"row {bad['row_seq']} goes back from {bad['previous']} to {bad['current']}")
            marks: dict[tuple, tuple] = {}
            if len(new) < len(bodies):
                marks |= self._marks(made.where(~F.col("body").isin(list(new))) if new else made, True, ["body"])
            for most in {b.most_rows_per_file for b in bodies if b.number in new}:
                self._write_attempts(aspect, made, {b.number: new[b.number] for b in bodies if b.number in new and b.most_rows_per_file == most}, most)
            if new:
                made = self.spark.read.schema(ROWS).option("basePath", self._data(aspect)).parquet(*[self._data(aspect, x) for x in new.values()])
                marks |= self._marks(made, True, ["attempt"])
        except Exception:
            if len(bodies) == 1:
                raise
            half = len(bodies) // 2
            return self.ingest_bodies(aspect, points, bodies[:half]) + self.ingest_bodies(aspect, points, bodies[half:])
        out, none = [], self._marked((0, *[None] * 5))
        for b in bodies:
            mark = marks.get((new.get(b.number, b.number),), none)
            out.append(self._seal(aspect, new[b.number], mark, b.key, log) if b.number in new else self._replayed(known[b.key], b.key, mark[1]))
        return out

    def _write_attempts(self, aspect: str, made: DataFrame, attempts: dict[int, str], most: int | None) -> None:
        """Each body's rows as an attempt of its own: written together below one that nothing will name, then moved out of it."""
        stage = uuid.uuid4().hex
        small = self.spark.createDataFrame(list(attempts.items()), "body long, attempt string")
        self._write(aspect, stage, made.join(F.broadcast(small), "body").drop("body"), most, ("attempt", "part_day"))  # a row for each body
        for x in attempts.values():
            source, target = self._path(f"{self._data(aspect, stage)}/attempt={x}"), self._path(self._data(aspect, x))
            if not (self._fs.rename(source, target) if self._fs.exists(source) else self._fs.mkdirs(target)):
                raise OSError(f"{source} wasn't moved to {target}")
        self._fs.delete(self._path(self._data(aspect, stage)), True)

    @staticmethod
    def _keyed(log: list[dict], key: str | None) -> dict | None:
        return next((c for c in log if c.get("key") == key), None) if key is not None else None

    @staticmethod
    def _replayed(known: dict, key: str | None, mark: str) -> Receipt:
        if known["fingerprint"] != mark:
            raise ValueError(f"key {key!r} was used for other points")
        return Receipt(known["seal_seq"], known["rows"], replayed=True)

    def changes_since(self, aspect: str, seal_seq: int = -1) -> DataFrame:
        """The change feed: seal_seq, min_ts, max_ts, rows of commits after ``seal_seq``; a replaced range counts whole."""
        found = []
        for c in self._log(aspect):
            if c["kind"] != "rewrite" and c["seal_seq"] > seal_seq:
                ends = [x for x in (c["min_ts"], c.get("start")) if x is not None], [x for x in (c["max_ts"], c.get("end")) if x is not None]
                found.append((c["seal_seq"], min(ends[0], default=None), max(ends[1], default=None), c["rows"]))
        return self.spark.createDataFrame(found, "seal_seq long, min_ts long, max_ts long, rows long")

    def ack_changes(self, aspect: str, through: int) -> None:
        """Remember that changes up to a seal were worked on; never goes back."""
        self._put(f"acked/{aspect}.json", {"seal_seq": max(through, self.acked(aspect))}, overwrite=True)

    def acked(self, aspect: str) -> int:
        return self._get(f"acked/{aspect}.json")["seal_seq"] if self._exists(f"acked/{aspect}.json") else -1

    def pending_changes(self, aspect: str) -> DataFrame:
        return self.changes_since(aspect, self.acked(aspect))

    # Regions to compress again.
    def mark_dirty(self, aspect: str, start: int, end: int) -> None:
        self._put(f"dirty/{aspect}/{start}_{end}.json", {"start": start, "end": end}, overwrite=True)

    def dirty(self, aspect: str) -> list[tuple[int, int]]:
        """Marked regions, those that touch joined."""
        found = sorted((r["start"], r["end"]) for r in (self._get(f"dirty/{aspect}/{n}") for n in self._list(f"dirty/{aspect}")))
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def clear_dirty(self, aspect: str) -> None:
        self._fs.delete(self._path(f"{self.root}/dirty/{aspect}"), True)

    # Reads.
    def select(self, rows: DataFrame, tags: dict[str, str | None] | None, exact: bool = False) -> DataFrame:
        return rows if tags is None else rows.where(select_series(tags_of(F.col("series_key")), tags, exact))

    def read(self, aspect: str, start: int | None = None, end: int | None = None, tags: dict[str, str | None] | None = None, exact: bool = False) -> DataFrame:
        return reads.time_range(self.select(self._pruned(aspect, start, end), tags, exact), start, end)

    def read_points(self, aspect: str, instants: Sequence[int], tags: dict[str, str | None] | None = None) -> DataFrame:
        rows = self._pruned(aspect, min(instants, default=0), max(instants, default=0))
        return reads.points(self.select(rows, tags), instants)

    def read_values(self, aspect: str, low: object, high: object, tags: dict[str, str | None] | None = None) -> DataFrame:
        """Rows of a value band; the bounds reach the files' statistics."""
        rows = self._alive(self.aspect(aspect), self.rows(aspect)).drop("part_day")
        return reads.value_range(self.select(rows, tags), *[Decimal(str(x)) for x in (low, high)])

    def page(self, aspect: str, take: int, token: str | None = None, start: int | None = None, end: int | None = None, tags: dict[str, str | None] | None = None) -> tuple[list, str | None]:
        """The next ``take`` rows of one series by instant, and the cursor behind them (None at the end); a cursor of other arguments is refused."""
        rows = reads.only_series(self.read(aspect, start, end, tags)).select("series_key", "ts", "value", "seal_seq", "row_seq")
        selector = [aspect, start, end, tags]
        found = reads.page_after(rows, take, token, selector)
        out = found.collect()  # a page
        return out, reads.token_of(found, selector) if len(out) == take else None

    def downsample(self, aspect: str, w: str, aggs: Sequence[str] = DEFAULT, start: int | None = None, end: int | None = None, tags: dict[str, str | None] | None = None) -> DataFrame:
        rows = self.read(aspect, start, end, tags).withColumnRenamed("row_seq", "seq")
        return downsample(rows, w, aggs, ["series_key"], start, end, self.aspect(aspect).unit)

    def interpolate(self, aspect: str, step: str, start: int, end: int, method: str | int = "cubic", margin: int | None = None, tags: dict[str, str | None] | None = None, most: int | None = MOST_KNOTS) -> DataFrame:
        """The reconstructed series from knots within ``margin`` (by default the range's length) of the range; over ``most`` rows are refused, None allows any.

        Without a sample there the result is an error, as nothing can be said of the range.
        """
        m = end - start if margin is None else margin
        rows = self.read(aspect, start - m, end + m, tags).withColumnRenamed("row_seq", "seq")
        if most is not None:
            n = rows.where("value is not null").limit(most + 1).count()
            if not n:
                raise LookupError(f"no sample of {aspect!r} between {start - m} and {end + m}")
            if n > most:
                raise ValueError(f"more than {most} rows to reconstruct from")
        return interpolate(rows, step, method, ["series_key"], start, end, m, unit=self.aspect(aspect).unit)

    def interpolated_parts(self, aspect: str, step: str, start: int, end: int, points: int = MOST_POINTS, **how):
        """The grid of :meth:`interpolate` as successive frames of at most ``points`` instants each, for grids of any length."""
        ticks = width(step).ticks(self.aspect(aspect).unit)
        margin = how.pop("margin", None)
        margin = end - start if margin is None else margin
        while start <= end:
            last = min(end, start + (points - 1) * ticks)
            yield self.interpolate(aspect, step, start, last, margin=margin, **how)
            start = last + ticks

    def stats(self, aspect: str) -> DataFrame:
        """By series: segments, how many are unsorted or overlap, rows, nulls, and the first and last values."""
        return reads.segment_stats(self.rows(aspect)).join(reads.bounds(self.rows(aspect)).drop("rows"), list(reads.SERIES))

    def size(self, aspect: str) -> dict[str, float]:
        """Rows and bytes that count, and bytes a row."""
        log = self._log(aspect)
        bytes_ = sum(self._fs.getContentSummary(self._path(self._data(aspect, a))).getLength() for a in self._live(log)[0])
        rows = self.rows(aspect, log).count()
        return {"rows": rows, "bytes": bytes_, "bytes_per_row": bytes_ / rows if rows else 0.0}

    # Maintenance: answers don't change, save for what a purge removes.
    def _rewrite(self, aspect: str, change: Callable[[DataFrame], DataFrame], most: int | None = None, only: Callable[[dict], bool] | None = None) -> None:
        """Rows of the live attempts, or of those whose commits ``only`` picks, through ``change`` into one new attempt that replaces them.

        What is ingested meanwhile stays; if another writer replaced the same attempts first this one is in :class:`Conflict` and nothing changed.
        """
        log = self._log(aspect)
        live = self._live(log)[0]
        picked = [c["attempt"] for c in log if c["attempt"] in live and (only is None or only(c))]
        if not picked:
            return
        attempt, day = uuid.uuid4().hex, 86_400 * 10**9 // NANOS[self.aspect(aspect).unit]
        rows = change(self.rows(aspect, log, picked).drop("part_day"))
        self._write(aspect, attempt, rows.select("series_key", "ts", "value", "seal_seq", "row_seq", floor_div(F.col("ts"), day).alias("part_day")), most)
        kept = [c for c in log if c["attempt"] in picked]
        span = {"min_ts": min((c["min_ts"] for c in kept if c["min_ts"] is not None), default=None), "max_ts": max((c["max_ts"] for c in kept if c["max_ts"] is not None), default=None), "rows": sum(c["rows"] for c in kept)}

        def entry(now: list[dict]) -> dict:
            if not set(picked) <= set(self._live(now)[0]):
                raise Conflict(f"{aspect!r} was rewritten meanwhile")
            return {"kind": "rewrite", "attempt": attempt, "replaces": picked, "seals": self._next_seal(log), "whole": only is None, **span}

        self._commit(aspect, entry, log)

    def reconcile(self, aspect: str, cold_before: int | None = None) -> None:
        """Sort out-of-order segments; with ``cold_before`` only those that end before that instant, while hot ones stay as they are."""
        self._rewrite(aspect, lambda rows: rows, only=None if cold_before is None else lambda c: c["max_ts"] is not None and c["max_ts"] < cold_before)

    def reconcile_if(self, aspect: str, most_unsorted: int, cold_before: int | None = None) -> bool:
        n = reads.segment_stats(self.rows(aspect)).agg(F.sum("unsorted_segments")).first()[0] or 0
        if n > most_unsorted:
            self.reconcile(aspect, cold_before)
        return n > most_unsorted

    def reconcile_all(self, most_unsorted: int = 0, cold_before: int | None = None) -> dict[str, bool]:
        """:meth:`reconcile_if` for every aspect: which were rewritten."""
        return {a: self.reconcile_if(a, most_unsorted, cold_before) for a in self.aspects()}

    def merge_overlaps(self, aspect: str) -> None:
        """Fold segments that overlap in time, newest wins; points keep being found behind newer nulls."""
        self._rewrite(aspect, _foldable)

    def squash(self, aspect: str, target_rows: int | None = None) -> None:
        """All segments into one a day, or into files of about ``target_rows``."""
        self._rewrite(aspect, _foldable, target_rows)

    def purge_expired(self, aspect: str, now: int | None = None, ttl_nanos: int | None = None) -> None:
        """Remove for good what the time to live (the aspect's unless said) hides at ``now`` (in the aspect's unit; by default the clock's)."""
        a = self.aspect(aspect)
        ttl, at = a.ttl_nanos if ttl_nanos is None else ttl_nanos, self.clock() // NANOS[a.unit] if now is None else now
        if ttl is not None:
            self._rewrite(aspect, lambda rows: reads.live(rows, at, ttl, a.unit))

    def vacuum(self, aspect: str, older_than_ms: int = 7 * 86_400_000) -> int:
        """Delete attempts that no commit needs and that were last written so long ago; how many."""
        live, gone = self._live(self._log(aspect))[0], 0
        for name in self._list(f"data/aspect={aspect}"):
            at = self._path(f"{self._data(aspect)}/{name}")
            if name.removeprefix("attempt=") not in live and self._fs.getFileStatus(at).getModificationTime() < time.time() * 1000 - older_than_ms:
                gone += bool(self._fs.delete(at, True))
        return gone

    def clear(self, aspect: str, start: int | None = None, end: int | None = None) -> None:
        """Remove a range's rows, by one commit; the files shrink at the next rewrite."""
        entry = lambda log: {"kind": "replace", "seal_seq": self._next_seal(log), "attempt": None, "rows": 0, "min_ts": None, "max_ts": None, "start": start, "end": end}
        self._commit(aspect, entry)
        if len(self._live(self._log(aspect))[1]) > SNAPSHOT:  # so that reads don't filter by ever more ranges
            self.reconcile(aspect)

    def replace(self, aspect: str, points: DataFrame, start: int, end: int, key: str | None = None) -> Receipt:
        """A range's rows replaced by others in one commit: readers see the old ones or the new ones."""
        return self.ingest(aspect, points, key, replacing=(start, end))


def _within(start: int | None, end: int | None) -> Column:
    """Whether ts is in an inclusive range with open ends."""
    return (F.col("ts") >= F.lit(-(1 << 63) if start is None else start)) & (F.col("ts") <= F.lit((1 << 63) - 1 if end is None else end))


def _foldable(rows: DataFrame) -> DataFrame:
    """Newest rows, and of what they hide the newest present values, which point reads still see."""
    w = reads.Window.partitionBy(*reads.SERIES, "ts")
    top = F.max("seal_seq").over(w)
    present = F.max(F.when(F.col("value").isNotNull(), F.col("seal_seq"))).over(w)
    return rows.withColumn("_t", top).withColumn("_p", present).where("seal_seq = _t or seal_seq = _p").drop("_t", "_p")
