"""Databases of typed, keyed, versioned tables, and the lazy query builder."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, compile_predicate
from ..functions.hashing import fnv1a_64
from ..functions.ordering import key_order, key_place
from ..sources.changelog import FILE_BYTES, LEVEL_BYTES, ChangeLog
from ..sources.manifest import Conflict, Files
from . import history as versions
from . import lookups, stats
from .state import META, current

#: Options and their defaults: whether old versions stay after ``compact`` and how many sequence numbers of them after ``close``, the key
#: order, how many level-0 batches start a compaction (None: only ``compact`` does), the size of compacted files, what level 1 may
#: hold, whether the state that a read has merged is kept in memory until the next commit, and from how many bytes on values are kept in files of their own.
OPTIONS = {"history": True, "keep_seqs": 1_000_000, "ordering": "reference", "max_l0": None, "file_bytes": FILE_BYTES, "level_bytes": LEVEL_BYTES, "promote_reads": False, "blob_bytes": None}
#: What the presets set otherwise; options that are given count before them.
PRESETS = {"ULTRA_FAST": {"history": False, "promote_reads": True}, "FAST": {"history": False, "promote_reads": True}, "NORMAL": {}, "DURABLE": {"keep_seqs": None}}


class Database:
    """Tables below one folder. ``catalog/<table>.json`` holds each table's schema, key and identity, ``catalog/<table>.index`` its indexes.

    Preset and options are stored at the first opening; a later one without any takes them from there.
    """

    def __init__(self, spark: SparkSession, path: str, preset: str | None = None, **options: object) -> None:
        if preset is not None and preset not in PRESETS:
            raise ValueError(f"presets are {', '.join(PRESETS)}")
        if unknown := options.keys() - OPTIONS.keys():
            raise ValueError(f"unknown options {', '.join(sorted(unknown))}; there are {', '.join(OPTIONS)}")
        if options.get("ordering", "reference") not in ("reference", "natural"):
            raise ValueError("ordering is reference or natural")
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.closed = False
        self.tables: dict[str, Table] = {}
        try:
            self.files.create("node.json", json.dumps({"node_id": secrets.randbits(62)}))
        except Conflict:
            pass  # known from before
        self.node_id = json.loads(self.files.read("node.json"))["node_id"]
        try:
            self.files.create("options.json", json.dumps({"preset": preset or "NORMAL", "options": options}))
        except Conflict:
            pass
        stored = json.loads(self.files.read("options.json"))
        if preset is None and not options:
            preset, options = stored["preset"], stored["options"]
        self.options = OPTIONS | PRESETS[preset or "NORMAL"] | options

    def table(self, name: str, schema: T.StructType | str | None = None, key: list[str] | str | None = None) -> Table:
        """A table by name; schema and key are needed the first time and must agree later (whether columns may be null does not count)."""
        self.check_open()
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        key = [key] if isinstance(key, str) else key
        if name not in self.tables:
            entry = f"catalog/{name}.json"
            known = json.loads(self.files.read(entry)) if f"{name}.json" in self.files.names("catalog") else None
            if known is None:
                if schema is None or key is None:
                    raise ValueError(f"table {name} is new: give its schema and key")
                if missing := set(key) - set(schema.fieldNames()):
                    raise ValueError(f"no key column {', '.join(sorted(missing))}")
                known = {"name": name, "id": fnv1a_64(name), "key": key, "schema": json.loads(schema.json())}
                self.files.create(entry, json.dumps(known))
            self.tables[name] = Table(self, name, T.StructType.fromJson(known["schema"]), known["key"])
        found = self.tables[name]
        if key is not None and key != found.key or schema is not None and schema.simpleString() != found.schema.simpleString():
            raise ValueError(f"table {name} has the key {found.key} and the columns {found.schema.simpleString()}")
        return found

    def check_open(self) -> None:
        if self.closed:
            raise RuntimeError("the database is closed")

    def force_sync(self) -> None:
        """Every write is committed when its call returns; there is nothing to wait for."""
        self.check_open()

    force_flush = force_sync

    def close(self) -> None:
        """Drops versions beyond ``keep_seqs`` sequence numbers of the open tables; later calls fail. Closing again does nothing."""
        if self.closed:
            return
        for t in self.tables.values():
            t.retain()
            t.forget()
        self.closed = True

    def stats(self) -> DataFrame:
        """One row per table; none without tables."""
        self.check_open()
        rows = self.spark.createDataFrame([], "table string, writes long, puts long, deletes long, last_seq long, keys long, live_keys long, tombstones long")
        for name in self.files.names("catalog"):
            if name.endswith(".json"):
                t = self.table(name.removesuffix(".json"))
                rows = rows.unionByName(t.stats().select(F.lit(t.name).alias("table"), "*"))
        return rows


class Query:
    """A lazy filter over a table. Predicates are columns, expression trees, or Python functions of a row (slow, nothing is pushed down)."""

    def __init__(self, table: Table, keep: tuple[Column, ...] = (), most: int | None = None) -> None:
        self.table, self.keep, self.most = table, keep, most

    def where(self, predicate: Column | Expr | Callable[[Row], bool], captures: tuple = (), strict: bool = False) -> Query:
        """Both conditions hold."""
        if isinstance(predicate, Expr):
            predicate = compile_predicate(predicate, self.table.schema, captures, strict)
        elif not isinstance(predicate, Column):
            predicate = F.udf(lambda row, p=predicate: bool(p(row)), "boolean")(F.struct(*self.table.schema.fieldNames()))
        return Query(self.table, (*self.keep, predicate), self.most)

    def limit(self, n: int) -> Query:
        """The first ``n`` matches in key order."""
        return Query(self.table, self.keep, n)

    def _matching(self) -> DataFrame:
        rows = self.table.rows()
        for p in self.keep:
            rows = rows.where(p)
        return rows

    def df(self) -> DataFrame:
        """The matches in key order."""
        rows = self._matching().orderBy(*key_order(self.table.schema, self.table.key, self.table.natural))
        return rows if self.most is None else rows.limit(self.most)

    def first(self) -> Row | None:
        if self.most == 0:
            return None
        found = self.limit(1).df().collect()
        return found[0] if found else None

    def any(self) -> bool:
        return self.most != 0 and not self._matching().isEmpty()

    def count(self) -> int:
        """The number of matches; a limit does not count here."""
        return self._matching().count()

    def to_list(self) -> list[Row]:
        return self.df().collect()

    def __iter__(self) -> Iterator[Row]:
        return self.df().toLocalIterator()


class Table:
    """A keyed table over its change log. Reads see the newest committed version; each write call is one atomic commit."""

    def __init__(self, database: Database, name: str, schema: T.StructType, key: list[str]) -> None:
        self.database, self.name, self.schema, self.key = database, name, schema, key
        self.natural = database.options["ordering"] == "natural"
        self.indexes = set(database.files.names(f"catalog/{name}.index"))
        self.changes = ChangeLog(database.spark, f"{database.path}/tables/{name}", schema, key, database.node_id, self.natural, database.options["blob_bytes"])
        self.codecs: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}
        self.promoted: DataFrame | None = None
        self.changes.on_commit.append(lambda _: self.forget())

    def codec(self, column: str, encode: Callable[[Column], Column], decode: Callable[[Column], Column]) -> Table:
        """A value column that is stored as ``encode`` makes it and read as ``decode`` does; the schema has the stored type."""
        if column in self.key or column not in self.schema.fieldNames():
            raise KeyError(f"{column} is no value column")
        self.codecs[column] = encode, decode
        return self

    def _decoded(self, rows: DataFrame) -> DataFrame:
        """Rows of the log, merged or not, as they are read: with their large values, by the codecs."""
        rows = self.changes.whole(rows)
        return rows.withColumns({c: decode(F.col(c)) for c, (_, decode) in self.codecs.items() if c in rows.columns}) if self.codecs else rows

    def log(self) -> DataFrame:
        """All writes that are kept."""
        self.database.check_open()
        return self._decoded(self.changes.read_all())

    def _state(self, keep: Column | None = None, **bounds: tuple | None) -> DataFrame:
        """The newest live write of each key (that ``keep``, a condition on keys, selects), from the batches that may have keys in the bounds (``ChangeLog.overlapping``)."""
        self.database.check_open()
        log = self.changes.read(**bounds)
        return current(log if keep is None else log.where(keep), self.key)

    def rows(self) -> DataFrame:
        """The live rows."""
        self.database.check_open()
        if self.promoted is not None:
            return self.promoted
        found = self._decoded(self._state()).select(*self.schema.fieldNames())
        if self.database.options["promote_reads"]:
            self.promoted = found = found.persist(StorageLevel.MEMORY_AND_DISK)
        return found

    def forget(self) -> None:
        """Lets the state go that ``promote_reads`` keeps; each commit does."""
        if self.promoted is not None:
            self.promoted.unpersist()
            self.promoted = None

    def _frame(self, values: list, names: list[str]) -> tuple[DataFrame, tuple[int, Row | None, Row | None]]:
        """Rows of ``names`` numbered from 0 in the order of a list, their number, and the first and the last key (None where it cannot be told here)."""
        fields = [T.StructField(n, self.schema[n].dataType, True) for n in names]
        rows = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r[n] for n in names) if isinstance(r, Row) else tuple(r) if isinstance(r, tuple | list) else (r,) for r in values]
        places = [key_place([r[names.index(k)] for k in self.key], self.schema, self.key, self.natural) for r in rows]
        first = last = None
        if rows and None not in places:
            ends = (rows[places.index(min(places))], rows[places.index(max(places))])
            first, last = (Row(**{k: r[names.index(k)] for k in self.key}) for r in ends)
        frame = self.database.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("__i", T.LongType()), *fields]))
        return frame, (len(rows), first, last)

    def _append(self, rows: DataFrame | list, names: list[str], op: str) -> int:
        self.database.check_open()
        frame, ends = (rows, None) if isinstance(rows, DataFrame) else self._frame(rows, names)
        if self.codecs and op != "D":
            frame = frame.withColumns({c: encode(F.col(c)) for c, (encode, _) in self.codecs.items() if c in frame.columns})
        return self._tidied(self.changes.append(frame, op, ends=ends))

    def _tidied(self, seq: int) -> int:
        o = self.database.options
        if o["max_l0"]:
            self.changes.tidy(o["max_l0"], o["history"], o["level_bytes"], o["file_bytes"])
        return seq

    def _keys(self, keys: list) -> DataFrame:
        kinds = T.StructType([self.schema[k] for k in self.key])
        return self.database.spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], kinds)

    def _is(self, key: object) -> Column:
        values = key if isinstance(key, tuple) else (key,)
        found = F.lit(True)
        for name, v in zip(self.key, values, strict=True):
            found = found & F.col(name).eqNullSafe(F.lit(v).cast(self.schema[name].dataType))
        return found

    def put(self, rows: DataFrame | list) -> int:
        """Inserts or replaces; of several rows with one key the last in the list's, or the DataFrame's, order stays. Returns the last sequence number."""
        return self._append(rows, self.schema.fieldNames(), "P")

    def remove(self, keys: DataFrame | list) -> int:
        """Deletes keys; one that is not there gets a tombstone too."""
        return self._append(keys.select(*self.key) if isinstance(keys, DataFrame) else keys, self.key, "D")

    def upsert(self, keys: DataFrame | list, assign: dict[str, Column]) -> int:
        """Sets columns of the given keys, from their old values; a key that is not there starts with nulls and its own key."""
        self.database.check_open()
        probes = keys if isinstance(keys, DataFrame) else self._keys(keys)
        return self._append(lookups.upsert_rows(self._decoded(self._state()), self.key, probes, assign), [], "P")

    def _near(self, key: object) -> dict[str, tuple]:
        """The bounds of one key."""
        key = key if isinstance(key, tuple) else (key,)
        return {"start": key, "last": key}

    def get(self, key: object) -> Row | None:
        """The live row of a key; only batches that may have it are opened."""
        found = self._decoded(self._state(self._is(key), **self._near(key))).select(*self.schema.fieldNames()).limit(1).collect()
        return found[0] if found else None

    def get_many(self, probes: DataFrame) -> DataFrame:
        return lookups.lookup(self.rows(), self.key, probes)

    def exists(self, key: object) -> bool:
        return not self._state(self._is(key), **self._near(key)).select(*self.key).isEmpty()

    def _in_range(self, start: object, end: object, columns: list[str]) -> DataFrame:
        """The live rows with start <= key < end, from the batches that may have any."""
        self.database.check_open()
        start, end = (None if b is None else b if isinstance(b, tuple) else (b,) for b in (start, end))
        log = lookups.in_range(self.changes.read(start=start, end=end).select("seq", "op", "large", *columns), self.key, start, end, self.natural)
        return self._decoded(current(log, self.key)).select(*columns)

    def scan(self, start: object = None, end: object = None) -> DataFrame:
        """Rows with start <= key < end in key order."""
        return lookups.scan(self._in_range(start, end, self.schema.fieldNames()), self.key, natural=self.natural)

    def keys(self, start: object = None, end: object = None) -> DataFrame:
        """The live keys with start <= key < end in key order; values are not read."""
        return lookups.scan(self._in_range(start, end, self.key), self.key, natural=self.natural)

    def count(self, start: object = None, end: object = None) -> int:
        """Live rows, or those of a key range; values are not read."""
        return self._in_range(start, end, self.key).count()

    def query(self, predicate: Column | Expr | Callable[[Row], bool] | None = None, **options: object) -> Query:
        q = Query(self)
        return q if predicate is None else q.where(predicate, **options)

    def index(self, column: str) -> Table:
        """Registers a column for ``find_by``, in the catalog too. The index is derived from the rows, so rows written before are found."""
        if column not in self.schema.fieldNames():
            raise KeyError(column)
        if column not in self.indexes:
            try:
                self.database.files.create(f"catalog/{self.name}.index/{column}", "")
            except Conflict:
                pass  # another process did
            self.indexes.add(column)
        return self

    def find_by(self, column: str, value: object) -> Row | None:
        if column not in self.indexes:
            raise KeyError(f"{column} is not an index")
        found = lookups.find_by(self._decoded(self._state()), column, value).select(*self.schema.fieldNames()).collect()
        return found[0] if found else None

    def find_all_by(self, column: str, value: object) -> DataFrame:
        return lookups.find_all_by(self.rows(), column, value)

    def get_at(self, key: object, seq: int) -> Row | None:
        self.database.check_open()
        found = self._decoded(versions.get_at(self.changes.read_all(), self.key, self._is(key), seq)).select(*self.schema.fieldNames()).collect()
        return found[0] if found else None

    def as_of(self, seq: int) -> DataFrame:
        self.database.check_open()
        return self._decoded(current(self.changes.read_all().where(F.col("seq") <= seq), self.key)).select(*self.schema.fieldNames())

    def history(self, key: object) -> DataFrame:
        self.database.check_open()
        return versions.history(self._decoded(self.changes.read_all().where(self._is(key))), F.lit(True))

    def _history_kept(self) -> None:
        if not self.database.options["history"]:
            raise RuntimeError("this database keeps no history")

    def rollback_to(self, seq: int) -> int:
        """Writes that restore every key's state after ``seq``."""
        self.database.check_open()
        self._history_kept()
        return self._tidied(self.changes.append(versions.rollback_targets(self.changes.whole(self.changes.read_all()), self.key, seq), "", "rollback"))

    def rollback_key(self, key: object, seq: int) -> int:
        """One write that restores a key's state after ``seq``, changed or not."""
        self.database.check_open()
        self._history_kept()
        then = self.changes.whole(versions.get_at(self.changes.read_all(), self.key, self._is(key), seq))
        if then.isEmpty():
            return self.changes.append(self._keys([key]), "D", "rollback")
        return self.changes.append(then.drop(*META), "P", "rollback")

    def prune_before(self, seq: int, keep_newest: bool = True) -> int:
        """Drops versions older than ``seq``; returns how many. See ``history.prune_before``."""
        self.database.check_open()
        log = self.changes.read_all()
        before = log.count()
        kept = versions.prune_before(log, self.key, seq, keep_newest)
        after = kept.count()
        if after < before:
            self.changes.replace(kept)
        return before - after

    def retain(self) -> int:
        """Drops versions more than ``keep_seqs`` sequence numbers old, if there are any; each key's newest stays. Returns how many."""
        keep, version = self.database.options["keep_seqs"], self.changes.manifest.current()
        if not self.database.options["history"] or keep is None or not any(b.min_seq < version.next_seq - keep for b in self.changes.history_of(version)):
            return 0
        return self.prune_before(version.next_seq - keep)

    def compact(self, files: int | None = None) -> None:
        """One base of the live rows, clustered by key, for reads of the current state, in so many files or files of ``file_bytes``.

        Where the database keeps history, the log stays beside it; else older versions and tombstones go.
        """
        self.database.check_open()
        self.changes.compacted(files, self.database.options["history"], self.database.options["file_bytes"])

    def level_stats(self) -> DataFrame:
        return stats.level_stats(self.changes.files())

    def batches(self, start: object = None, end: object = None) -> DataFrame:
        """The batches that a read of start <= key < end opens."""
        start, end = (None if b is None else b if isinstance(b, tuple) else (b,) for b in (start, end))
        return self.changes.files(start=start, end=end)

    def stats(self) -> DataFrame:
        self.database.check_open()
        return stats.log_stats(self.changes.read(), self.key)
