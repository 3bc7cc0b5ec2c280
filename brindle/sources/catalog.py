"""A database of named DataFrames: DDL, DML by swapping immutable tables, triggers on deltas, ATTACH, introspection frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.dialect import SPARK_TYPES, affinity
from brindle.operators import dml
from brindle.operators.dml import ConstraintError, Definition, Rule
from brindle.plans.lineage import cut

MAX_ATTACHED = 10
MAX_TRIGGER_DEPTH = 32


@dataclass
class Trigger:
    """when: BEFORE or AFTER; event: INSERT, UPDATE or DELETE; action gets (database, delta) where delta has the columns of the
    table, for updates as structs old and new. Set-based: one call per statement."""

    table: str
    when: str
    event: str
    action: Callable[["Database", DataFrame], None]
    condition: str | None = None


@dataclass
class Database:
    spark: SparkSession
    name: str = "main"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    definitions: dict[str, Definition] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, list[str], bool, str | None]] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    attached: dict[str, "Database"] = field(default_factory=dict)
    savepoints: list[tuple[str, tuple]] = field(default_factory=list)
    changes: int = 0
    total_changes: int = 0
    _depth: int = 0

    # --- DDL ---
    def create_table(self, name: str, definition: Definition, if_not_exists: bool = False) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} already exists")
        schema = ", ".join(f"`{c}` {SPARK_TYPES[affinity(r.type)]}" for c, r in definition.columns.items())
        self.definitions[name] = definition
        self._swap(name, self.spark.createDataFrame([], schema))

    def create_table_as(self, name: str, df: DataFrame) -> None:
        names = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT", "binary": "BLOB", "double": "REAL"}
        self.definitions[name] = Definition({c: Rule(names.get(t, "NUMERIC")) for c, t in df.dtypes})
        self._swap(name, df)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise ValueError(f"no such table: {name}")
        self.tables.pop(name, None)
        self.definitions.pop(name, None)
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}
        self.spark.catalog.dropTempView(name)

    def create_view(self, name: str, sql: str) -> None:
        self.views[name] = sql
        self.spark.sql(sql).createOrReplaceTempView(name)

    def drop_view(self, name: str) -> None:
        del self.views[name]
        self.spark.catalog.dropTempView(name)

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False, where: str | None = None) -> None:
        """Metadata; a unique index is checked now and on every change."""
        rows = self.tables[table].filter(where) if where else self.tables[table]
        if unique and not dml.unique_violations(rows, columns).isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(columns)}")
        self.indexes[name] = (table, columns, unique, where)

    def drop_index(self, name: str) -> None:
        del self.indexes[name]

    def rename_table(self, old: str, new: str) -> None:
        self.definitions[new] = self.definitions.pop(old)
        df = self.tables.pop(old)
        self.spark.catalog.dropTempView(old)
        self._swap(new, df)

    def rename_column(self, table: str, old: str, new: str) -> None:
        d = self.definitions[table]
        d.columns = {new if c == old else c: r for c, r in d.columns.items()}
        d.primary_key = [new if c == old else c for c in d.primary_key]
        self._swap(table, self.tables[table].withColumnRenamed(old, new))

    def add_column(self, table: str, name: str, rule: Rule) -> None:
        if rule.not_null and rule.default is None:
            raise ConstraintError("Cannot add a NOT NULL column with default value NULL")
        self.definitions[table].columns[name] = rule
        value = F.expr(rule.generated or rule.default or "NULL").cast(SPARK_TYPES[affinity(rule.type)])
        self._swap(table, self.tables[table].withColumn(name, value))

    def drop_column(self, table: str, name: str) -> None:
        if name in self.definitions[table].primary_key:
            raise ConstraintError(f"cannot drop PRIMARY KEY column: \"{name}\"")
        del self.definitions[table].columns[name]
        self._swap(table, self.tables[table].drop(name))

    # --- DML ---
    def _keys(self, table: str, only: list[str] | None = None) -> list[list[str]]:
        """The columns that must be unique together: primary key, UNIQUE, whole unique indexes; or those named."""
        d = self.definitions[table]
        keys = [d.primary_key, *d.unique, *[columns for t, columns, unique, where in self.indexes.values() if t == table and unique and not where]]
        keys = [k for k in keys if k]
        if only is None:
            return keys
        if not any(sorted(k) == sorted(only) for k in keys):
            raise ValueError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
        return [only]

    def _numbered(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows without a value in a single INTEGER key get the numbers after the largest, in the order of `__at`."""
        d = self.definitions[table]
        if len(d.primary_key) != 1 or d.columns[d.primary_key[0]].type.upper() != "INTEGER":
            return rows
        key = d.primary_key[0]
        blank, given = rows.filter(F.col(key).isNull()), rows.filter(F.col(key).isNotNull())
        if blank.isEmpty():
            return rows
        top = self.tables[table].select(key).unionAll(given.select(key)).agg(F.max(key)).first()[0] or 0
        fresh = sequence_key(blank.drop(key), key, [F.col("__at")]).withColumn(key, F.col(key) + top)
        return cut(given.unionByName(fresh.select(*rows.columns)))

    def _new_rows(self, table: str, new: DataFrame) -> DataFrame:
        """The new rows in the table's shape, with their order in `__at`, written once."""
        d = self.definitions[table]
        return self._numbered(table, cut(dml.shape(new, d).withColumn("__at", F.monotonically_increasing_id())))

    def insert(self, table: str, new: DataFrame, on_conflict: str = "ABORT", key: list[str] | None = None) -> DataFrame:
        """The inserted rows (RETURNING). IGNORE keeps the first of rows that conflict and REPLACE the last, for every unique key
        (IGNORE: only for `key`, if given), one key after the other."""
        d, old = self.definitions[table], self.tables[table]
        rows = self._new_rows(table, new)
        if on_conflict == "IGNORE":
            bad = [c for c, r in d.columns.items() if r.not_null]
            rows = (rows.dropna(subset=bad) if bad else rows).withColumn("__at", -F.col("__at"))
            for k in self._keys(table, key):
                fresh = dml._one_per_key(rows, k, "__at")
                rows = fresh.join(old, dml._keys(fresh, old, k), "left_anti")
        elif on_conflict == "REPLACE":
            for k in self._keys(table):
                rows = dml._one_per_key(rows, k, "__at")
            rows = cut(rows)
            for k in self._keys(table):
                old = old.join(rows, dml._keys(old, rows, k), "left_anti")
        rows = cut(rows.drop("__at")) if on_conflict == "IGNORE" else rows.drop("__at")
        self._fire(table, "BEFORE", "INSERT", rows)
        self._commit(table, dml.insert(old, rows), rows.count())
        self._fire(table, "AFTER", "INSERT", rows)
        return rows

    def upsert(self, table: str, new: DataFrame, assign: dict[str, str], where: str | None = None, key: list[str] | None = None) -> DataFrame:
        """The rows of the table after the change that share their key with a new row. The key is the primary key if not named."""
        d = self.definitions[table]
        key = self._keys(table, key)[0]
        rows = self._new_rows(table, new)
        result = dml.upsert(self.tables[table].withColumn("__at", F.lit(0).cast("bigint")), rows, key, assign, where, order="__at")
        self._commit(table, dml.recompute(result.drop("__at"), d), rows.count())
        now = self.tables[table]
        return now.join(rows, dml._keys(now, rows, key), "left_semi")

    def update(self, table: str, assign: dict[str, str], where: str = "true") -> DataFrame:
        """The new rows (RETURNING)."""
        old = self.tables[table]
        names = old.columns
        hit = cut(old.filter(where).select(F.struct(*names).alias("old"), F.struct(*[F.expr(assign[c]).cast(t).alias(c) if c in assign else F.col(c) for c, t in old.dtypes]).alias("new")))
        self._fire(table, "BEFORE", "UPDATE", hit)
        changed = dml.update(old, {c: F.expr(v).cast(dict(old.dtypes)[c]) for c, v in assign.items()}, F.expr(where))
        self._commit(table, dml.recompute(changed, self.definitions[table]), hit.count())
        self._fire(table, "AFTER", "UPDATE", hit)
        return dml.recompute(hit.select("new.*"), self.definitions[table])

    def delete(self, table: str, where: str = "true") -> DataFrame:
        """The deleted rows; children follow their ON DELETE action, and theirs in turn. A refusal leaves every table as it was."""
        before = self.snapshot()
        gone = cut(self.tables[table].filter(where))
        try:
            self._fire(table, "BEFORE", "DELETE", gone)
            kept = self.tables[table].filter(~F.coalesce(F.expr(where), F.lit(False)))
            self._swap(table, cut(kept))
            self._children(table, gone)
            self._commit(table, self.tables[table], gone.count())
            self._fire(table, "AFTER", "DELETE", gone)
        except Exception:
            self.rollback(before)
            raise
        return gone

    def _children(self, table: str, gone: DataFrame) -> None:
        """Apply ON DELETE to the tables that refer to rows that have gone."""
        for child, d in list(self.definitions.items()):
            for columns, parent, key, action in d.foreign:
                if parent != table:
                    continue
                defaults = {c: r.default for c, r in d.columns.items() if r.default}
                rows = self.tables[child]
                after = cut(dml.on_delete(rows, columns, gone, key, action, defaults))
                self._swap(child, after)
                if action == "CASCADE":
                    lost = cut(rows.join(gone, [rows[c] == gone[k] for c, k in zip(columns, key)], "left_semi"))
                    if not lost.isEmpty():
                        self._children(child, lost)
                elif action.startswith("SET"):
                    dml.verify(after, d, self.tables)

    def _commit(self, table: str, df: DataFrame, n: int) -> None:
        """Write, verify, swap: a failed check leaves the old table."""
        df = cut(df)
        dml.verify(df, self.definitions[table], self.tables)
        for t, columns, unique, where in self.indexes.values():
            if t == table and unique and not dml.unique_violations(df.filter(where) if where else df, columns).isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(columns)}")
        self._swap(table, df)
        self.changes, self.total_changes = n, self.total_changes + n

    def _swap(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def _fire(self, table: str, when: str, event: str, delta: DataFrame) -> None:
        for t in [t for t in self.triggers.values() if (t.table, t.when, t.event) == (table, when, event)]:
            if self._depth >= MAX_TRIGGER_DEPTH:
                raise RuntimeError("too many levels of trigger recursion")
            rows = delta.filter(t.condition) if t.condition else delta
            self._depth += 1
            try:
                if not rows.isEmpty():
                    t.action(self, rows)
            finally:
                self._depth -= 1

    # --- transactions: tables are immutable, so a snapshot is a copy of the dictionaries ---
    def snapshot(self) -> dict[str, DataFrame]:
        return dict(self.tables)

    def rollback(self, to: dict[str, DataFrame]) -> None:
        for name in set(self.tables) - set(to):
            self.spark.catalog.dropTempView(name)
        self.tables = {}
        for name, df in to.items():
            self._swap(name, df)

    # --- several databases ---
    def attach(self, name: str, other: "Database") -> None:
        if len(self.attached) >= MAX_ATTACHED:
            raise ValueError(f"too many attached databases - max {MAX_ATTACHED}")
        self.attached[name] = other
        for t, df in other.tables.items():
            df.createOrReplaceTempView(f"{name}__{t}")

    def detach(self, name: str) -> None:
        for t in self.attached.pop(name).tables:
            self.spark.catalog.dropTempView(f"{name}__{t}")

    def vacuum_into(self, folder: str) -> None:
        """A compact copy of every table."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def open_folder(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.create_table_as(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    # --- introspection (metadata sized) ---
    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def master(self) -> DataFrame:
        rows = [("table", t, t) for t in self.tables] + [("view", v, v) for v in self.views] + [("index", i, d[0]) for i, d in self.indexes.items()] + [("trigger", n, t.table) for n, t in self.triggers.items()]
        return self._frame(rows, "type string, name string, tbl_name string")

    def table_info(self, table: str) -> DataFrame:
        d = self.definitions[table]
        return self._frame([(i, c, r.type, int(r.not_null), r.default, d.primary_key.index(c) + 1 if c in d.primary_key else 0) for i, (c, r) in enumerate(d.columns.items())], "cid int, name string, type string, notnull int, dflt_value string, pk int")

    def index_list(self, table: str) -> DataFrame:
        return self._frame([(i, n, int(d[2]), "c", int(d[3] is not None)) for i, (n, d) in enumerate((n, d) for n, d in self.indexes.items() if d[0] == table)], "seq int, name string, `unique` int, origin string, partial int")

    def index_info(self, index: str) -> DataFrame:
        t, columns, *_ = self.indexes[index]
        at = list(self.definitions[t].columns)
        return self._frame([(i, at.index(c) if c in at else -2, c) for i, c in enumerate(columns)], "seqno int, cid int, name string")

    def foreign_key_list(self, table: str) -> DataFrame:
        return self._frame([(i, s, p, c, k, "NO ACTION", a) for i, (cs, p, ks, a) in enumerate(self.definitions[table].foreign) for s, (c, k) in enumerate(zip(cs, ks))], "id int, seq int, `table` string, `from` string, `to` string, on_update string, on_delete string")

    def foreign_key_check(self, table: str) -> DataFrame:
        out = None
        for columns, parent, key, _ in self.definitions[table].foreign:
            bad = dml.foreign_key_violations(self.tables[table], columns, self.tables[parent], key).select(F.lit(table).alias("table"), F.lit(parent).alias("parent"))
            out = bad if out is None else out.unionAll(bad)
        return out if out is not None else self._frame([], "`table` string, parent string")

    def database_list(self) -> DataFrame:
        return self._frame([(i, n) for i, n in enumerate([self.name, *self.attached])], "seq int, name string")

    def analyze(self) -> DataFrame:
        """Row counts and, for indexes, average rows per key, as statistics tables hold them."""
        rows = []
        for t, df in self.tables.items():
            keys = {i: d[1] for i, d in self.indexes.items() if d[0] == t}
            r = df.agg(F.count("*").alias("n"), *[F.count_distinct(*[F.col(c) for c in k]).alias(i) for i, k in keys.items()]).first()
            rows += [(t, i, f"{r['n']} {-(-r['n'] // max(1, r[i]))}") for i in keys] or [(t, None, str(r["n"]))]
        return self._frame(rows, "tbl string, idx string, stat string")

    def explain(self, sql: str, mode: str = "formatted") -> str:
        from brindle.plans.frontend import rewrite

        return self.spark.sql(rewrite(sql))._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def sequence_key(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """A stable BIGINT key 1..n in a given order, dealt by ranges: counts per range, then offsets; no single-task window."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from pyspark.sql import Window

    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("c"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.c"), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "__part").select((F.col("before") + F.col("__at")).alias(name), *df.columns)
