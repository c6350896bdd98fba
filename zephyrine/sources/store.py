"""A store of versioned tables, clones, topics and subscriptions on a shared file system.

A table is a base and a few deltas, all Parquet. A commit writes its rows as new deltas and then replaces
one small file, the store's head, by a rename; readers see the version that the head names. A commit costs
what it changes; reading joins the base against the deltas' keys, and compaction folds deltas into a base.

All rows of one commit share one LSN, which grows by one each commit. Changes of subscribed tables, and
what is published to subscribed topics, are appended to a log by LSN and, within it, by statement. The head
names the log's folders, and streams see one only once it is named: what is rolled back reaches nobody. A
clone's head names the files that its table had when it was made, so neither sees the other's later commits.

One driver commits at a time; a head that another driver replaced meanwhile makes a commit fail.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.operators.dml import Change

EVENTS = T.StructType([T.StructField("lsn", T.LongType()), T.StructField("step", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("rel", T.StringType()), T.StructField("cmd", T.StringType()), T.StructField("data", T.StringType())])
#: Deltas after which a commit compacts a table.
DELTAS = 8


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.head = self._read() or {"lsn": 0, "version": 0, "tables": {}, "topics": [], "subscriptions": {}, "log": {}}
        self._staged: dict | None = None
        self._steps = 0
        self._show_log()

    # the head file

    def _read(self) -> dict | None:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("head-")]
        if not names:
            return None
        row = self.spark.read.text(f"{self.root}/{max(names)}", wholetext=True).first()
        return json.loads(row[0])

    def _swap(self, head: dict) -> None:
        head["version"] += 1
        name = f"{self.root}/head-{head['version']:012d}.json"
        if self._fs.exists(self._path(name)):
            raise RuntimeError("another commit was first")
        part = self._path(f"{self.root}/.part-{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        if not self._fs.rename(part, self._path(name)):
            raise RuntimeError("another commit was first")
        self.head = head
        self._show_log()

    def _show_log(self) -> None:
        """Give log folders that the head names their final names, by which streams find them."""
        for rel, names in self.head["log"].items():
            for name in names[-8:]:
                hidden = self._path(f"{self.log_path(rel)}/.{name}")
                if self._fs.exists(hidden):
                    self._fs.rename(hidden, self._path(f"{self.log_path(rel)}/{name}"))

    def _commit(self, edit) -> int:
        """Run ``edit(head, lsn)`` on a copy of the head and swap it in; within a block, when that ends."""
        if self._staged is not None:
            self._steps += 1
            edit(self._staged, self._staged["lsn"])
            return self._staged["lsn"]
        self._steps = 0
        head = json.loads(json.dumps(self.head))
        head["lsn"] += 1
        edit(head, head["lsn"])
        self._swap(head)
        return head["lsn"]

    def begin(self) -> None:
        """Statements up to :meth:`end` take effect together, under one LSN."""
        if self._staged is not None:
            raise RuntimeError("blocks do not nest")
        self._staged = json.loads(json.dumps(self.head))
        self._staged["lsn"] += 1
        self._steps = 0

    def end(self, commit: bool = True) -> None:
        staged, self._staged = self._staged, None
        if commit and staged is not None and staged != {**self.head, "lsn": staged["lsn"]}:
            self._swap(staged)

    @property
    def now(self) -> dict:
        return self._staged or self.head

    # definitions

    def create_table(self, name: str, schema: str | T.StructType, key: Sequence[str], defaults: dict[str, object] | None = None, identity: str | None = None, filled: Sequence[str] = ()) -> None:
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if not key or any(k not in schema.fieldNames() for k in key):
            raise ValueError("a table needs a primary key among its columns")
        if name in self.now["tables"] or name in self.now["topics"]:
            raise ValueError(f"{name} exists")
        spec = {"schema": schema.jsonValue(), "key": list(key), "defaults": defaults or {}, "identity": identity, "filled": list(filled), "next": 0, "base": [], "deltas": [], "indexes": {}, "of": None, "physical": {c: c for c in schema.fieldNames()}, "used": schema.fieldNames()}
        self._commit(lambda head, _: head["tables"].update({name: spec}))

    def drop_table(self, name: str) -> None:
        self._commit(lambda head, _: head["tables"].pop(name))

    def rename_table(self, name: str, to: str) -> None:
        if to in self.now["tables"]:
            raise ValueError(f"{to} exists")
        self._commit(lambda head, _: head["tables"].update({to: head["tables"].pop(name)}))

    def add_column(self, name: str, column: str, kind: str, default=None) -> None:
        """Files stay as they are; rows written before read as NULL there."""
        field = T._parse_datatype_string(f"`{column}` {kind}").jsonValue()["fields"]

        def edit(head, _):
            t = head["tables"][name]
            if column in t["physical"]:
                raise ValueError(f"{column} exists")
            t["schema"]["fields"] += field
            # a name in the files that no earlier column had
            t["physical"][column] = column if column not in t["used"] else f"{column}__{len(t['used'])}"
            t["used"].append(t["physical"][column])
            if default is not None:
                t["defaults"][column] = default

        self._commit(edit)

    def drop_column(self, name: str, column: str) -> None:
        if column in self.now["tables"][name]["key"]:
            raise ValueError("a key column cannot be dropped")

        def edit(head, _):
            t = head["tables"][name]
            t["schema"]["fields"] = [f for f in t["schema"]["fields"] if f["name"] != column]
            del t["physical"][column]
            t["defaults"].pop(column, None)
            t["filled"] = [c for c in t["filled"] if c != column]

        self._commit(edit)

    def rename_column(self, name: str, column: str, to: str) -> None:
        """Files keep the old name."""

        def edit(head, _):
            t = head["tables"][name]
            if to in t["physical"]:
                raise ValueError(f"{to} exists")
            t["physical"][to] = t["physical"].pop(column)
            for f in t["schema"]["fields"]:
                f["name"] = to if f["name"] == column else f["name"]
            t["key"] = [to if k == column else k for k in t["key"]]
            t["filled"] = [to if c == column else c for c in t["filled"]]
            t["identity"] = to if t["identity"] == column else t["identity"]
            if column in t["defaults"]:
                t["defaults"][to] = t["defaults"].pop(column)
            for i in t["indexes"].values():
                i["columns"] = [to if c == column else c for c in i["columns"]]

        self._commit(edit)

    def set_default(self, name: str, column: str, value=None) -> None:
        """A new default; None unsets it."""

        def edit(head, _):
            d = head["tables"][name]["defaults"]
            d.pop(column, None) if value is None else d.update({column: value})

        self._commit(edit)

    def create_index(self, name: str, index: str, columns: Sequence[str], unique: bool = False) -> None:
        """Kept as a definition; if unique, the rows there are must agree, and so must later changes."""
        if unique:
            self._refuse_repeated(self.table(name), columns)
        self._commit(lambda head, _: head["tables"][name]["indexes"].update({index: {"columns": list(columns), "unique": unique}}))

    def create_clone(self, name: str, of: str) -> None:
        """A table that begins as ``of`` is now; no rows are copied."""
        if name in self.now["tables"]:
            raise ValueError(f"{name} exists")
        self._commit(lambda head, _: head["tables"].update({name: {**json.loads(json.dumps(head["tables"][of])), "of": of}}))

    def create_topic(self, name: str) -> None:
        self._commit(lambda head, _: head["topics"].append(name))

    def create_subscription(self, name: str, rel: str) -> None:
        if rel not in self.now["tables"] and rel not in self.now["topics"]:
            raise ValueError(f"no relation {rel}")

        def edit(head, lsn):
            head["subscriptions"][name] = {"rel": rel, "ack": lsn - 1, "from": lsn}

        self._commit(edit)

    def drop_topic(self, name: str) -> None:
        if any(s["rel"] == name for s in self.now["subscriptions"].values()):
            raise ValueError(f"{name} has subscriptions")
        self._commit(lambda head, _: head["topics"].remove(name))

    def drop_index(self, name: str, index: str) -> None:
        self._commit(lambda head, _: head["tables"][name]["indexes"].pop(index))

    def drop_subscription(self, name: str) -> None:
        self._commit(lambda head, _: head["subscriptions"].pop(name))

    def rename_topic(self, name: str, to: str) -> None:
        if to in self.now["topics"] or to in self.now["tables"]:
            raise ValueError(f"{to} exists")
        if any(s["rel"] == name for s in self.now["subscriptions"].values()):
            raise ValueError(f"{name} has subscriptions")
        self._commit(lambda head, _: head["topics"].__setitem__(head["topics"].index(name), to))

    def rename_subscription(self, name: str, to: str) -> None:
        if to in self.now["subscriptions"]:
            raise ValueError(f"{to} exists")
        self._commit(lambda head, _: head["subscriptions"].update({to: head["subscriptions"].pop(name)}))

    @staticmethod
    def _refuse_repeated(rows: DataFrame, columns: Sequence[str]) -> None:
        filled = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
        if not filled.groupBy(*columns).count().where("count > 1").isEmpty():
            raise ValueError("rows are not unique")

    # rows

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.now["tables"][name]["schema"])

    @staticmethod
    def _stored(spec: dict) -> tuple[T.StructType, list[Column]]:
        """The schema by the names in files, and columns that give the table's own names."""
        schema, physical = T.StructType.fromJson(spec["schema"]), spec["physical"]
        stored = T.StructType([T.StructField(physical[f.name], f.dataType) for f in schema.fields])
        return stored, [F.col(f"`{physical[f.name]}`").alias(f.name) for f in schema.fields]

    def _frames(self, spec: dict) -> DataFrame:
        stored, named = self._stored(spec)
        key = spec["key"]
        base = self.spark.read.schema(stored).parquet(*spec["base"]) if spec["base"] else self.spark.createDataFrame([], stored)
        base = base.select(*named)
        if not spec["deltas"]:
            return base
        marked = T.StructType([*stored.fields, T.StructField("__lsn", T.LongType()), T.StructField("__gone", T.BooleanType())])
        deltas = self.spark.read.schema(marked).parquet(*spec["deltas"]).select(*named, "__lsn", "__gone")
        latest = Window.partitionBy(*key).orderBy(F.desc("__lsn"))
        last = deltas.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1")
        columns = base.columns
        return base.join(last.select(*key), key, "left_anti").select(*columns).unionByName(last.where("NOT __gone").select(*columns))

    def table(self, name: str) -> DataFrame:
        """The rows of the current version."""
        return self._frames(self.now["tables"][name])

    def defaults(self, name: str) -> dict[str, Column]:
        return {c: F.lit(v) for c, v in self.now["tables"][name]["defaults"].items()}

    def filled(self, name: str) -> list[str]:
        """Columns that must have values."""
        return self.now["tables"][name]["filled"]

    def truncate(self, name: str) -> None:
        """All rows go; nothing is written but the events of a subscribed table."""
        spec = self.now["tables"][name]
        if any(s["rel"] == name for s in self.now["subscriptions"].values()):
            self._commit(lambda head, lsn: self._log(head, name, lsn, self.table(name).withColumn("__gone", F.lit(True)), spec["key"], self.schema(name)))
        self._commit(lambda head, _: head["tables"][name].update({"base": [], "deltas": []}))

    def commit(self, name: str, change: Change) -> DataFrame:
        """Write a change; its RETURNING rows are read back from what was written. Its rows are worked out
        once: deltas are written first and everything else reads those."""
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        schema = self.schema(name)
        parts = []
        for rows, gone in ((change.deletes, True), (change.writes, False)):
            if rows is not None:
                parts.append(rows.select(*schema.fieldNames()).withColumn("__gone", F.lit(gone)))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        step = (self._staged or self.head)["tables"][name]
        order = len(step["deltas"]) + (self.now["version"] << 20)
        stored, named = self._stored(step)
        both.withColumnsRenamed(step["physical"]).withColumn("__lsn", F.lit(order).cast("long")).write.parquet(folder)
        written = self.spark.read.schema(T.StructType([*stored.fields, T.StructField("__gone", T.BooleanType())])).parquet(folder).select(*named, "__gone")

        new = written.where("NOT __gone").select(*schema.fieldNames())
        for index in step["indexes"].values():
            if index["unique"] and change.writes is not None:
                # what is written, against itself and against what stays
                own = [c for c in dict.fromkeys([*change.key, *index["columns"]])]
                stays = self.table(name).select(*own).join(written.select(*change.key), change.key, "left_anti").select(*own)
                stays = stays.join(new.select(*index["columns"]).distinct(), index["columns"], "left_semi").select(*own)
                self._refuse_repeated(new.select(*own).unionByName(stays), index["columns"])

        def edit(head, lsn):
            head["tables"][name]["deltas"].append(folder)
            if any(s["rel"] == name for s in head["subscriptions"].values()):
                self._log(head, name, lsn, written, change.key, schema)

        self._commit(edit)
        if len(self.now["tables"][name]["deltas"]) > DELTAS and self._staged is None:
            self.compact(name)
        return written.select(*schema.fieldNames())

    def compact(self, name: str) -> None:
        """Fold deltas into a new base."""
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        self.table(name).withColumnsRenamed(self.now["tables"][name]["physical"]).write.parquet(folder)
        self._commit(lambda head, _: head["tables"][name].update({"base": [folder], "deltas": []}))

    def vacuum(self, heads: int = 2) -> int:
        """Remove head files but the last ones, and data folders that none of these names; readers of older
        versions fail from then on. How many folders went."""
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.root)) if x.getPath().getName().startswith("head-"))
        kept = names[-max(heads, 1) :]
        used = {f for n in kept for t in json.loads(self.spark.read.text(f"{self.root}/{n}", wholetext=True).first()[0])["tables"].values() for f in (*t["base"], *t["deltas"])}
        used = {f.rpartition("/")[2] for f in used}
        for n in names[: -len(kept)]:
            self._fs.delete(self._path(f"{self.root}/{n}"), False)
        gone, data = 0, self._path(f"{self.root}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                if folder.getPath().getName() not in used:
                    self._fs.delete(folder.getPath(), True)
                    gone += 1
        return gone

    def identities(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows``, written out, with the identity column numbered on from the last commit's, without gaps."""
        spec = self.now["tables"][name]
        folder = f"{self.root}/data/{name}/_{uuid.uuid4().hex}"
        rows.withColumn("__one", F.lit(1)).write.parquet(folder)
        written = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__one", T.IntegerType())])).parquet(folder)
        file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        sizes = sorted((r["file"], r["count"]) for r in written.select(file.alias("file")).groupBy("file").count().collect())
        starts, at = [], spec["next"]
        for path, n in sizes:
            starts.append((path, at))
            at += n
        if at == spec["next"]:
            return rows.withColumn(spec["identity"], F.lit(None).cast("long")).limit(0)
        first = self.spark.createDataFrame(starts, "__file string, __start long").coalesce(1)
        numbered = written.select(*rows.columns, file.alias("__file"), place.alias("__place")).join(F.broadcast(first), "__file")
        self._commit(lambda head, _: head["tables"][name].update({"next": at}))
        return numbered.select(*rows.columns, (F.col("__start") + F.col("__place")).alias(spec["identity"]))

    # change log

    def _append(self, head: dict, rel: str, lsn: int, events: DataFrame) -> None:
        """Write events, and name their folder in the head to be; until that is swapped in, no reader sees it."""
        name = f"lsn={lsn:012d}-{uuid.uuid4().hex}"
        events.select(*EVENTS.fieldNames()).write.parquet(f"{self.log_path(rel)}/.{name}")
        head["log"].setdefault(rel, []).append(name)

    def _log(self, head: dict, rel: str, lsn: int, rows: DataFrame, key: Sequence[str], schema: T.StructType) -> None:
        events = rows.select(
            F.lit(lsn).cast("long").alias("lsn"),
            F.lit(self._steps).cast("long").alias("step"),
            # a statement has one event of a key
            F.xxhash64(*key).alias("seq"),
            F.lit(rel).alias("rel"),
            F.when(F.col("__gone"), "delete").otherwise("write").alias("cmd"),
            F.to_json(F.struct(*schema.fieldNames()), {"ignoreNullFields": "false"}).alias("data"),
        )
        self._append(head, rel, lsn, events)

    def publish(self, topic: str, values: DataFrame) -> int:
        """Append a column of JSON texts to a topic, in the order of its rows; without subscribers nothing is kept."""
        if topic not in self.now["topics"]:
            raise ValueError(f"no topic {topic}")
        column = values.columns[0]

        def edit(head, lsn):
            if any(s["rel"] == topic for s in head["subscriptions"].values()):
                step, seq = F.lit(self._steps).cast("long").alias("step"), F.monotonically_increasing_id().alias("seq")
                events = values.select(F.lit(lsn).cast("long").alias("lsn"), step, seq, F.lit(topic).alias("rel"), F.lit("publish").alias("cmd"), F.col(column).alias("data"))
                self._append(head, topic, lsn, events)

        return self._commit(edit)

    def log_path(self, rel: str) -> str:
        return f"{self.root}/log/{rel}"

    def log(self, name: str) -> DataFrame:
        """EVENTS of a subscription after the acknowledged one, in any order, as often as it is read."""
        s = self.now["subscriptions"][name]
        names = [n for n in self.now["log"].get(s["rel"], []) if int(n[4:16]) > s["ack"]]
        folders = []
        for n in names:
            shown = f"{self.log_path(s['rel'])}/{n}"
            folders.append(shown if self._fs.exists(self._path(shown)) else f"{self.log_path(s['rel'])}/.{n}")
        if not folders:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(*folders)

    def subscription(self, name: str) -> DataFrame:
        """``lsn, cmd, data`` of all events after the acknowledged one, in their order, as often as it is read."""
        return self.log(name).orderBy("lsn", "step", "seq").select("lsn", "cmd", "data")

    def acknowledge(self, name: str, lsn: int) -> None:
        """Move a subscription forward; backward or beyond the last commit is an error."""
        s = self.now["subscriptions"][name]
        if lsn < s["ack"]:
            raise ValueError("cannot acknowledge backward")
        if lsn > self.now["lsn"]:
            raise ValueError("cannot acknowledge what is not there yet")
        if lsn == s["ack"]:
            return
        gone: list[str] = []

        def edit(head, _):
            head["subscriptions"][name]["ack"] = lsn
            # events that every subscription of the relation has acknowledged
            least = min(x["ack"] for x in head["subscriptions"].values() if x["rel"] == s["rel"])
            names = head["log"].get(s["rel"], [])
            gone.extend(n for n in names if int(n[4:16]) <= least)
            head["log"][s["rel"]] = [n for n in names if n not in gone]

        self._commit(edit)
        if self._staged is None:
            for n in gone:
                self._fs.delete(self._path(f"{self.log_path(s['rel'])}/{n}"), True)

    # catalog

    def show(self, section: str) -> DataFrame:
        """What there is, by section: tables, columns, indexes, constraints, partitions, clones, topics,
        subscriptions, log, config, metrics, state, lsn or version."""
        now, make = self.now, self.spark.createDataFrame
        if section == "constraints":
            found = [(n, "primary key", ",".join(t["key"])) for n, t in now["tables"].items()]
            found += [(n, "not null", c) for n, t in now["tables"].items() for c in t["filled"]]
            found += [(n, "default", f"{c}={v}") for n, t in now["tables"].items() for c, v in t["defaults"].items()]
            found += [(n, "unique", ",".join(i["columns"])) for n, t in now["tables"].items() for i in t["indexes"].values() if i["unique"]]
            return make(found, "name string, kind string, columns string")
        if section == "partitions":
            found = [(n, kind, len(t[of])) for n, t in now["tables"].items() for kind, of in (("base", "base"), ("delta", "deltas"))]
            return make(found, "name string, kind string, folders int")
        if section == "log":
            return make([(r, int(n[4:16])) for r, names in now["log"].items() for n in names], "rel string, lsn long")
        if section == "config":
            return make(sorted(self.spark.sparkContext.getConf().getAll()), "name string, value string")
        if section == "metrics":
            counts = [("tables", len(now["tables"])), ("topics", len(now["topics"])), ("subscriptions", len(now["subscriptions"]))]
            counts += [("deltas", sum(len(t["deltas"]) for t in now["tables"].values())), ("log_folders", sum(map(len, now["log"].values())))]
            return make(counts, "name string, value int")
        if section in ("lsn", "version"):
            return make([(now[section],)], f"{section} long")
        if section == "tables":
            return make([(n, ",".join(t["key"]), len(t["deltas"])) for n, t in now["tables"].items()], "name string, key string, deltas int")
        if section == "columns":
            return make([(n, i, f["name"], json.dumps(f["type"]).strip('"')) for n, t in now["tables"].items() for i, f in enumerate(t["schema"]["fields"])], "name string, ord int, column string, type string")
        if section == "indexes":
            return make([(n, i, ",".join(x["columns"]), x["unique"]) for n, t in now["tables"].items() for i, x in t["indexes"].items()], "name string, index string, columns string, is_unique boolean")
        if section == "topics":
            return make([(n,) for n in now["topics"]], "name string")
        if section == "subscriptions":
            return make([(n, s["rel"], s["ack"]) for n, s in now["subscriptions"].items()], "name string, rel string, ack long")
        if section == "clones":
            return make([(n, t["of"]) for n, t in now["tables"].items() if t["of"]], "name string, of string")
        if section == "state":
            return make([(now["lsn"], now["version"])], "lsn long, version long")
        raise ValueError(f"show: unknown section {section}")
