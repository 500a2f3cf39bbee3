"""The store as Parquet tables in a folder: batches that become visible together, merged in generations, and point reads.

Every batch writes a folder for each table, and is visible from its entry in the log on (``log``); one that fails halfway is never
seen, and running it again overwrites what it left. As in a log-structured merge, ``FANOUT`` folders of a level are merged
into one of the next, so a read opens some tens of folders after any number of batches; a merge that fails leaves nothing that is
read. From level 2 on, tables with a key are in buckets by the key's hash, sorted by key, with a Bloom filter for each file:
who asks for some keys reads the buckets of these keys, and of a file what may hold them.

The first block of an address counts whatever order its records arrive in. Of ``implementations``, ``seeds`` and ``deferred``
the latest version counts. ``holders`` are addresses by code, so that they can be found without reading all addresses.
``tallies`` are differences that a batch makes to the numbers of addresses by code, origin and implementation; their sums
are the numbers (``views``). There is one writer at a time, and any number of readers.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coderill.functions import bytecode as B
from coderill.sources.log import Log, Part, State

SCHEMAS = {
    "codes": "code_id string, size long, skeleton_hash string, selectors array<string>, proxy_kind string, proxy_target string, std_proxy boolean, selfdestruct boolean, mutable_delegatecall boolean, ops array<string>, runs array<bigint>, hx string, opcode_count long",
    "addresses": "address string, code_id string, block long, origin string",
    "holders": "code_id string, address string",
    "implementations": "address string, implementation string, block long, step long",
    "deferred": "address string, block long, origin string, pending boolean, step long",
    "seeds": "address string, code_id string, label string, strict boolean, version long, removed boolean",
    "progress": "block long, updated_at string, seen long",
    "ledger": "day string, method string, credits long",
    "events": "id long, kind string, block long, at string, address string, seed_address string, label string, score double, origin string, old_impl string, new_impl string",
    "tallies": "kind string, key string, code_id string, block long, n long",
}

#: The column by which a table's rows are dealt to buckets.
KEYS = {"codes": "code_id", "addresses": "address", "holders": "code_id", "implementations": "address", "deferred": "address"}

#: Folders of a level that become one of the next.
FANOUT = 16
#: Keys that are asked for by name; more are joined.
FEW = 1000


def buckets(level: int) -> int:
    """Buckets of a folder of a table with a key."""
    return 1 if level < 2 else min(4096, 16 ** (level - 1))


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _first_record() -> Column:
    return F.min_by(F.struct("code_id", "block", "origin"), F.struct("block", F.coalesce("origin", F.lit("")), F.coalesce("code_id", F.lit(""))))


def _latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def _progress(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("block").alias("block"), F.max_by("updated_at", "block").alias("updated_at"), F.max("seen").alias("seen"))


def _tallied(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key", "code_id", "block").agg(F.sum("n").alias("n")).filter("n <> 0")


#: What a merge keeps of a table's rows; of the others everything.
MERGES = {
    "addresses": lambda rows: rows.groupBy("address").agg(_first_record().alias("r")).select("address", "r.*"),
    "holders": lambda rows: rows.distinct(),
    "implementations": lambda rows: _latest(rows, "address", "block", "step", "implementation"),
    "deferred": lambda rows: _latest(rows, "address", "step"),
    "seeds": lambda rows: _latest(rows, "address", "version"),
    "progress": _progress,
    "ledger": lambda rows: rows.groupBy("day", "method").agg(F.sum("credits").alias("credits")),
    "tallies": _tallied,
}


class Store:
    def __init__(self, spark: SparkSession, folder: str, readonly: bool = False, fanout: int = FANOUT):
        self.spark, self.folder, self.readonly, self.fanout = spark, folder.rstrip("/"), readonly, fanout
        self.log = Log(spark, f"{self.folder}/log")
        self._written: dict[str, dict[str, str]] = {}

    def state(self) -> State:
        """What is committed now."""
        for _ in range(5):
            try:
                state = self.log.state()
                break
            except Exception as error:  # a file that was listed has been trimmed meanwhile
                if "FileNotFound" not in str(error):
                    raise
        else:
            raise OSError("the log changes faster than it can be read")
        return state if state.parts or state.step or not self.log.exists(f"{self.folder}/commits") else self._before_logs()

    def _before_logs(self) -> State:
        """A store that was written before there was a log: a folder for each batch and table, and its commits as rows."""
        rows = self.spark.read.schema("batch string, step long").parquet(f"{self.folder}/commits").distinct().collect()
        state = State(max((r["step"] for r in rows), default=0))
        for r in rows:
            state.add({"step": state.step, "batch": r["batch"], "remove": [], "add": []})
        done = {f"batch={r['batch']}" for r in rows}
        state.old = True
        state.parts = [Part(t, f"{t}/{name}") for t in SCHEMAS for name, _ in self.log.listed(f"{self.folder}/{t}") if name in done]
        return state

    def _frames(self, name: str) -> list[tuple[int, DataFrame]]:
        """A table's committed rows by number of buckets; a frame with more than one has the column ``bucket``."""
        parts, out = self.state().of(name), []
        for n in sorted({buckets(p.level) if name in KEYS else 1 for p in parts}):
            paths = [f"{self.folder}/{p.path}" for p in parts if (buckets(p.level) if name in KEYS else 1) == n]
            schema = SCHEMAS[name] + (", bucket int" if n > 1 else "")
            out.append((n, self.spark.read.schema(schema).parquet(*paths)))
        return out

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        """A table's committed rows with its whole schema: columns that older files lack are null."""
        frames = [rows.drop("bucket") for _, rows in self._frames(name)]
        return reduce(DataFrame.unionByName, frames) if frames else self._empty(name)

    @staticmethod
    def keys(of: DataFrame) -> DataFrame | list[str]:
        """Distinct keys of the first column, as a list where there are few."""
        wanted = of.select(of.columns[0]).filter(F.col(of.columns[0]).isNotNull()).distinct()
        few = [r[0] for r in wanted.limit(FEW + 1).collect()]
        return few if len(few) <= FEW else wanted

    def among(self, name: str, keys: DataFrame | list[str]) -> DataFrame:
        """Rows of some keys, in a list or the first column of a frame: only their buckets are read, up to ``FEW`` keys by name."""
        frames, key = self._frames(name), KEYS[name]
        if not frames:
            return self._empty(name)
        keys = self.keys(keys) if isinstance(keys, DataFrame) else sorted(set(keys))
        if isinstance(keys, DataFrame):
            keys = keys.select(F.col(keys.columns[0]).alias(key))
        elif not keys:
            return self._empty(name)
        out = []
        for n, rows in frames:
            if n > 1:
                given = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], f"{key} string")
                here = [r[0] for r in given.select(bucket_of(F.col(key), n).alias("b")).distinct().collect()]  # n numbers at most
                rows = rows.filter(F.col("bucket").isin(here)) if len(here) < n else rows
            rows = rows.join(keys, key, "left_semi") if isinstance(keys, DataFrame) else rows.filter(F.col(key).isin(keys))
            out.append(rows.drop("bucket"))
        return reduce(DataFrame.unionByName, out)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        if self.readonly:
            raise PermissionError("the store is open for reading")
        columns = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        return rows.select(*(c if c in rows.columns else F.lit(None).alias(c) for c in columns)).to(self._empty(name).schema)

    def write(self, name: str, rows: DataFrame, batch: str) -> None:
        """What a batch has of a table, in place of what it had."""
        path = f"{name}/batch={batch}"
        self._shaped(name, rows).write.mode("overwrite").parquet(f"{self.folder}/{path}")
        self._written.setdefault(batch, {})[name] = path

    def _written_by(self, batch: str, name: str) -> DataFrame:
        path = self._written[batch].get(name)
        return self._empty(name) if path is None else self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{path}")

    def commit(self, batch: str, step: int | None = None, named: bool = True) -> None:
        """Make a batch visible with its holders and tallies; doing it again changes nothing. Full levels are merged then."""
        if self.readonly:
            raise PermissionError("the store is open for reading")
        state = self.state()
        if state.done(batch):
            return
        if batch not in self._written:  # by another process
            self._written[batch] = {t: f"{t}/batch={batch}" for t in SCHEMAS if self.log.exists(f"{self.folder}/{t}/batch={batch}")}
        if {"addresses", "implementations"} & set(self._written[batch]):
            from coderill.sources import views

            self.write("holders", self._written_by(batch, "addresses").filter("code_id IS NOT NULL"), batch)
            self.write("tallies", views.differences(self, self._written_by(batch, "addresses"), self._written_by(batch, "implementations")), batch)
        if state.old:
            self._take_over(state)
        parts = [Part(t, path) for t, path in self._written.pop(batch).items()]
        self.log.commit(batch if named else None, parts, step=None if state.old else step)
        self.compact()

    def _take_over(self, state: State) -> None:
        """What was there before logs, with its holders and tallies."""
        from coderill.sources import views

        held, named = self.read("addresses"), "before-logs"
        self.write("holders", held.filter("code_id IS NOT NULL"), named)
        self.write("tallies", views.differences(self, held, self.read("implementations"), anew=True), named)
        self.log.commit(None, state.parts + [Part(t, path) for t, path in self._written.pop(named).items()], step=max(1, state.step))
        for name in [*state.names, *(f"{n}-{k}" for n, k in state.last.items())]:
            self.log.commit(name, [])

    def compact(self) -> None:
        """Merge the folders of every level that has ``fanout`` of them, from below; readers see the same rows throughout."""
        state, merged = self.state(), False
        while full := [(t, n) for t in SCHEMAS for n in sorted({p.level for p in state.of(t)}) if sum(p.level == n for p in state.of(t)) >= self.fanout]:
            name, level = full[0]
            parts = [p for p in state.of(name) if p.level == level]
            state = self.log.commit(None, [self._merged(parts, level + 1)], [p.path for p in parts])
            merged = True
        if merged:
            self.log.snapshot()
            self.log.trim()

    def _merged(self, parts: list[Part], level: int) -> Part:
        rows = self.spark.read.schema(SCHEMAS[parts[0].table]).parquet(*(f"{self.folder}/{p.path}" for p in parts))
        return self._generation(parts[0].table, rows, level)

    def _generation(self, name: str, rows: DataFrame, level: int) -> Part:
        path, n = f"{name}/level={level}-{uuid.uuid4().hex}", buckets(level) if name in KEYS else 1
        out = MERGES.get(name, lambda x: x)(rows).select(*(f.split()[0] for f in SCHEMAS[name].split(", ")))
        if name not in KEYS:
            out.coalesce(4 ** (level - 1)).write.parquet(f"{self.folder}/{path}")
            return Part(name, path, level)
        key = KEYS[name]
        writer = lambda frame: frame.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if n == 1:
            writer(out.coalesce(1).sortWithinPartitions(key)).parquet(f"{self.folder}/{path}")
        else:
            dealt = out.withColumn("bucket", bucket_of(F.col(key), n)).repartition(n, "bucket").sortWithinPartitions("bucket", key)
            writer(dealt).partitionBy("bucket").parquet(f"{self.folder}/{path}")
        return Part(name, path, level)

    def load(self, tables: dict[str, DataFrame], level: int = 2) -> None:
        """Whole tables in one commit, in buckets from the start; for addresses, codes and implementations of an empty store."""
        if self.readonly:
            raise PermissionError("the store is open for reading")
        if self.state().step:
            raise ValueError("the store is not empty")
        from coderill.sources import views

        tables = {name: self._shaped(name, rows) for name, rows in tables.items()}
        held = tables.get("addresses", self._empty("addresses"))
        tables["holders"] = self._shaped("holders", held.filter("code_id IS NOT NULL"))
        tables["tallies"] = self._shaped("tallies", views.differences(self, held, tables.get("implementations", self._empty("implementations")), anew=True))
        self.log.commit(None, [self._generation(name, rows, level) for name, rows in tables.items()])

    def vacuum(self, keep_seconds: int = 3600) -> list[str]:
        """Remove folders that no commit names and that are older than ``keep_seconds``; returns them."""
        if self.readonly:
            raise PermissionError("the store is open for reading")
        named, now, gone = {p.path for p in self.state().parts}, time.time(), []
        for t in SCHEMAS:
            for name, changed in self.log.listed(f"{self.folder}/{t}"):
                if f"{t}/{name}" not in named and now - changed >= keep_seconds:
                    self.log.delete(f"{self.folder}/{t}/{name}")
                    gone.append(f"{t}/{name}")
        return gone

    def committed(self, batch: str) -> bool:
        return self.state().done(batch)

    def step(self) -> int:
        """The number of the next commit."""
        return self.state().step + 1

    def append(self, name: str, rows: DataFrame) -> None:
        batch = uuid.uuid4().hex
        self.write(name, rows, batch)
        self.commit(batch, named=False)

    def put(self, name: str, key: str, rows: DataFrame) -> None:
        """Rows of keys that are not stored yet; the first of a key within the rows."""
        held = self.among(name, rows.select(key)) if KEYS.get(name) == key else self.read(name)
        self.append(name, rows.join(held.select(key), key, "left_anti").dropDuplicates([key]))

    @staticmethod
    def _whole_codes(rows: DataFrame) -> DataFrame:
        """What an older file lacks is made from the code itself, and only there."""
        whole, old = rows.filter("std_proxy IS NOT NULL"), rows.filter("std_proxy IS NULL")
        return whole.unionByName(old.withColumn("std_proxy", B.is_standard_proxy(B.tokens(B.body(F.col("hx"))))))

    def codes(self, of: DataFrame | list[str] | None = None) -> DataFrame:
        """A row for each code, or for each of those in ``of``."""
        return self._whole_codes(self.read("codes") if of is None else self.among("codes", of))

    def fingerprints(self) -> DataFrame:
        """All codes without their bytes and opcodes, in order of id."""
        return self.codes().drop("hx", "ops", "runs").orderBy("code_id")

    def code_by_id(self, code_id: str) -> DataFrame:
        return self.codes([code_id.lower()])

    def known(self, of: DataFrame | list[str] | None = None) -> DataFrame:
        """(address, code_id, block, origin): the record of the least block of each address, or of those in ``of``."""
        return MERGES["addresses"](self.read("addresses") if of is None else self.among("addresses", of))

    def scratch(self, frame: DataFrame, batch: str, name: str) -> DataFrame:
        """A frame written beside the tables and read again, for as long as its batch runs."""
        path = f"{self.folder}/_scratch/{batch}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def sweep(self, batch: str) -> None:
        self.log.delete(f"{self.folder}/_scratch/{batch}")

    def implementations(self, of: DataFrame | list[str] | None = None) -> DataFrame:
        """(address, implementation): the latest of each address."""
        rows = self.read("implementations") if of is None else self.among("implementations", of)
        return MERGES["implementations"](rows).select("address", "implementation")

    def addresses(self, of: DataFrame | list[str] | None = None) -> DataFrame:
        return self.known(of).join(self.implementations(of), "address", "left")

    def set_implementation(self, address: str, implementation: str, block: int) -> None:
        """Of a stored address; an unknown one changes nothing."""
        row = self.spark.createDataFrame([(address.lower(), implementation.lower(), block, self.step())], SCHEMAS["implementations"])
        self.append("implementations", row.join(self.among("addresses", [address.lower()]).select("address"), "address", "left_semi"))

    def pending(self) -> DataFrame:
        """(address, block, origin) that a cap left to later batches."""
        return MERGES["deferred"](self.read("deferred")).filter("pending").select("address", "block", "origin")

    def has_address(self, address: str) -> bool:
        return not self.among("addresses", [address.lower()]).isEmpty()

    def stored(self, of: DataFrame) -> DataFrame:
        """(address, stored) of distinct addresses, lower case."""
        asked = of.select(F.lower(of.columns[0]).alias("address")).filter("address IS NOT NULL").distinct()
        found = self.among("addresses", asked).select("address", F.lit(True).alias("found")).distinct()
        return asked.join(found, "address", "left").select("address", F.coalesce("found", F.lit(False)).alias("stored"))

    def code_of(self, address: str) -> DataFrame:
        """The code of an address, as a row of codes; none where it has none."""
        return self.codes(self.known([address.lower()]).select("code_id"))

    def codes_of(self, of: DataFrame) -> DataFrame:
        """(address, and the columns of its code) for the addresses that have one."""
        held = self.known(of.select(F.lower(of.columns[0]).alias("address"))).filter("code_id IS NOT NULL").select("address", "code_id")
        return held.join(self.codes(held.select("code_id")), "code_id")

    def addresses_of(self, code_id: str) -> DataFrame:
        return self.holders_of(self.spark.createDataFrame([(code_id,)], "code_id string")).select("address").orderBy("address")

    def holders_of(self, of: DataFrame) -> DataFrame:
        """(code_id, address): the addresses whose record has one of the codes."""
        asked = of.select(F.col(of.columns[0]).alias("code_id")).distinct()
        if self.state().old:
            return self.known().join(asked, "code_id", "left_semi").select("code_id", "address")
        named = self.among("holders", asked)
        return self.known(named.select("address")).join(asked, "code_id", "left_semi").select("code_id", "address")

    def seeds(self) -> DataFrame:
        """The latest version of each seed that is not removed, in order of address."""
        last = Window.partitionBy("address").orderBy(F.desc("version"))
        rows = self.read("seeds").withColumn("k", F.row_number().over(last)).filter("k = 1 AND NOT removed")
        return rows.select("address", "code_id", "label", F.coalesce("strict", F.lit(False)).alias("strict")).orderBy("address")

    def strict_seeds(self) -> DataFrame:
        return self.seeds().filter("strict").select("address").orderBy("address")

    def _version(self) -> int:
        return (self.read("seeds").agg(F.max("version")).first()[0] or 0) + 1

    def effective_of(self, address: str) -> DataFrame:
        """(address, code_id): the code that an address is scored by, none where it has none."""
        from coderill.operators.codes import effective

        own = self.addresses([address.lower()])
        around = own.unionByName(self.addresses(own.select("implementation")))
        return effective(around, self.codes(around.select("code_id"))).filter(F.col("address") == address.lower())

    def add_seed(self, address: str, label: str) -> None:
        """The code that counts for the address now; adding it again renews code and label and keeps strictness."""
        own = self.effective_of(address).first()
        if own is None:
            raise KeyError(address)
        held = self.seeds().filter(F.col("address") == own["address"]).first()
        self._write_seed(own["address"], own["code_id"], label, bool(held and held["strict"]), False)

    def set_strict(self, address: str, strict: bool) -> bool:
        held = self.seeds().filter(F.col("address") == address.lower()).first()
        if held is not None:
            self._write_seed(held["address"], held["code_id"], held["label"], strict, False)
        return held is not None

    def remove_seed(self, address: str) -> bool:
        held = self.seeds().filter(F.col("address") == address.lower()).first()
        if held is not None:
            self._write_seed(held["address"], held["code_id"], held["label"], False, True)
        return held is not None

    def _write_seed(self, address: str, code_id: str, label: str, strict: bool, removed: bool) -> None:
        self.append("seeds", self.spark.createDataFrame([(address, code_id, label, strict, self._version(), removed)], SCHEMAS["seeds"]))

    def spend(self, day: str, method: str, credits: int) -> None:
        self.append("ledger", self.spark.createDataFrame([(day, method, credits)], SCHEMAS["ledger"]))

    def spent(self, day: str) -> int:
        return self.read("ledger").filter(F.col("day") == day).agg(F.sum("credits")).first()[0] or 0

    def progress(self) -> int | None:
        return self.read("progress").agg(F.max("block")).first()[0]

    def set_progress(self, block: int, updated_at: str) -> None:
        self.append("progress", self.spark.createDataFrame([(block, updated_at, block)], SCHEMAS["progress"]))
