"""Table changes as new DataFrames, and constraints as queries for violations. Nothing is changed in place; the caller swaps
the table (see brindle.sources.catalog.Database)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    pass


@dataclass
class Rule:
    """Constraints of one column."""

    type: str
    not_null: bool = False
    default: str | None = None
    check: str | None = None
    generated: str | None = None
    collate: str = "BINARY"


@dataclass
class Definition:
    """A table's columns, keys and references. foreign: columns -> (table, its columns, on delete)."""

    columns: dict[str, Rule]
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str], str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)


def _keys(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in key])


def shape(new: DataFrame, d: Definition) -> DataFrame:
    """New rows brought to the table's columns: defaults for missing ones, generated columns computed, types cast."""
    from brindle.functions.dialect import SPARK_TYPES, affinity

    barred = [c for c, r in d.columns.items() if r.generated and c in new.columns]
    if barred:
        raise ConstraintError(f"cannot INSERT into generated column \"{barred[0]}\"")
    unknown = [c for c in new.columns if c not in d.columns]
    if unknown:
        raise ConstraintError(f"table has no column named {unknown[0]}")
    plain = [(F.col(c) if c in new.columns else F.expr(r.default) if r.default else F.lit(None)).cast(SPARK_TYPES[affinity(r.type)]).alias(c) for c, r in d.columns.items() if not r.generated]
    out = new.select(*plain)
    for c, r in d.columns.items():
        if r.generated:
            out = out.withColumn(c, F.expr(r.generated).cast(SPARK_TYPES[affinity(r.type)]))
    return out.select(*d.columns)


def recompute(table: DataFrame, d: Definition) -> DataFrame:
    """Generated columns after a change of those that they are computed from."""
    from brindle.functions.dialect import SPARK_TYPES, affinity

    for c, r in d.columns.items():
        if r.generated and c in table.columns:
            table = table.withColumn(c, F.expr(r.generated).cast(SPARK_TYPES[affinity(r.type)]))
    return table


def insert(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new)


def _one_per_key(new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row of those with equal keys: the last by `order`, else any. A key with a NULL never equals another."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    row = F.struct(*[F.col(c) for c in new.columns])
    best = F.max_by(row, F.col(order)) if order else F.any_value(row)
    return new.filter(whole).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(best.alias("__row")).select("__row.*").unionByName(new.filter(~whole))


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """OR IGNORE / DO NOTHING: rows whose key exists are dropped; of new rows with equal keys one stays."""
    fresh = _one_per_key(new, key)
    return table.unionByName(fresh.join(table, _keys(fresh, table, key), "left_anti"))


def insert_or_replace(table: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """OR REPLACE: new rows displace old ones of their key; of new rows with equal keys the last by the column `order` stays."""
    fresh = _one_per_key(new, key, order)
    return table.join(fresh, _keys(table, fresh, key), "left_anti").unionByName(fresh)


def upsert(table: DataFrame, new: DataFrame, key: list[str], assign: dict[str, str], where: str | None = None, order: str | None = None) -> DataFrame:
    """ON CONFLICT (key) DO UPDATE SET: expressions see the old row as `old` and the new one as `excluded`. One full outer join.
    Rows with a NULL in their key conflict with nothing: old ones stay, new ones are added."""
    t, e = table.withColumn("__old", F.lit(True)).alias("old"), _one_per_key(new, key, order).withColumn("__new", F.lit(True)).alias("excluded")
    on = reduce(lambda x, y: x & y, [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in key])
    both = t.join(e, on, "full")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    hit = has_old & has_new & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True))
    return both.select(*[F.when(hit, F.expr(assign[c]) if c in assign else F.col(f"old.{c}")).when(has_old, F.col(f"old.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) for c in table.columns])


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All right sides see the old row; a NULL condition leaves the row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(hit, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, key: list[str], assign: dict[str, str]) -> DataFrame:
    """UPDATE ... FROM with at most one source row per key (one is chosen otherwise). Expressions see `old` and `src`."""
    t, s = table.alias("old"), source.dropDuplicates(key).withColumn("__hit", F.lit(True)).alias("src")
    on = reduce(lambda x, y: x & y, [F.col(f"old.{k}") == F.col(f"src.{k}") for k in key])
    return t.join(s, on, "left").select(*[F.when(F.col("src.__hit"), F.expr(assign[c])).otherwise(F.col(f"old.{c}")).alias(c) if c in assign else F.col(f"old.{c}").alias(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows whose condition is NULL stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def returning(affected: DataFrame, *columns: Column | str) -> DataFrame:
    return affected.select(*(columns or ["*"]))


# --- constraints ---------------------------------------------------------------------------------------------------


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def check_violations(df: DataFrame, *conditions: str) -> DataFrame:
    """A NULL condition passes."""
    return df.filter(reduce(lambda a, b: a | b, [~F.coalesce(F.expr(c), F.lit(True)) for c in conditions]))


def unique_violations(df: DataFrame, key: list[str], collate: dict[str, str] | None = None) -> DataFrame:
    """Keys that occur more than once; a NULL in the key never collides."""
    from brindle.functions.dialect import collate as folded

    cols = [folded(F.col(c), (collate or {}).get(c, "BINARY")).alias(c) if (collate or {}).get(c) else F.col(c) for c in key]
    return df.dropna(subset=key).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    p = parent.select(*[F.col(k).alias(f"__{k}") for k in key])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{k}") for c, k in zip(columns, key)])
    return child.dropna(subset=columns).join(p, on, "left_anti")


def on_delete(child: DataFrame, columns: list[str], gone: DataFrame, key: list[str], action: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """The child table after parent rows have gone: CASCADE, SET NULL, SET DEFAULT; RESTRICT and NO ACTION raise if rows refer."""
    g = gone.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{k}") for c, k in zip(columns, key)])
    if action in ("RESTRICT", "NO ACTION"):
        if not child.join(g, on, "left_semi").isEmpty():
            raise ConstraintError("FOREIGN KEY constraint failed")
        return child
    if action == "CASCADE":
        return child.join(g, on, "left_anti")
    hit = F.col(f"__{key[0]}").isNotNull()
    new = {c: F.expr((defaults or {})[c]) if action == "SET DEFAULT" and c in (defaults or {}) else F.lit(None) for c in columns}
    return child.join(g, on, "left").select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(dict(child.dtypes)[c]).alias(c) if c in new else F.col(c) for c in child.columns])


def verify(df: DataFrame, d: Definition, parents: dict[str, DataFrame] | None = None) -> None:
    """Raise on the first constraint that a table breaks."""
    required = [c for c, r in d.columns.items() if r.not_null]
    if required and not not_null_violations(df, required).isEmpty():
        raise ConstraintError(f"NOT NULL constraint failed: {', '.join(required)}")
    checks = [*d.checks, *[r.check for r in d.columns.values() if r.check]]
    if checks and not check_violations(df, *checks).isEmpty():
        raise ConstraintError("CHECK constraint failed")
    for key in ([d.primary_key] if d.primary_key else []) + d.unique:
        if not unique_violations(df, key, {c: d.columns[c].collate for c in key if d.columns[c].collate != "BINARY"}).isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(key)}")
    for columns, parent, key, _ in d.foreign:
        if parents and parent in parents and not foreign_key_violations(df, columns, parents[parent], key).isEmpty():
            raise ConstraintError("FOREIGN KEY constraint failed")
