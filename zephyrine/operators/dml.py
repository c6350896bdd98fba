"""INSERT, UPSERT, UPDATE, DELETE and TRUNCATE as functions of DataFrames.

Each gives a :class:`Change`: the rows to write, the keys to delete and what RETURNING sees. A change can
be applied to a DataFrame, or committed to a :class:`zephyrine.sources.store.Store`, which writes it as a
delta. Nothing here collects rows; joins are on the primary key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Change:
    """``writes``: whole new rows; ``deletes``: whole old rows; ``returning``: new rows of writes, old rows
    of deletes. Rows that a conflict clause skipped are in none."""

    key: list[str]
    writes: DataFrame | None = None
    deletes: DataFrame | None = None

    @property
    def returning(self) -> DataFrame:
        return self.writes if self.deletes is None else self.deletes

    def apply(self, table: DataFrame) -> DataFrame:
        """The table after the change."""
        out = table
        if self.deletes is not None:
            out = out.join(self.deletes.select(*self.key), self.key, "left_anti").select(*table.columns)
        if self.writes is not None:
            out = out.join(self.writes.select(*self.key), self.key, "left_anti").select(*table.columns)
            out = out.unionByName(self.writes)
        return out


def complete(rows: DataFrame, like: DataFrame, defaults: dict[str, Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the columns and types of ``like`` and those to keep: what is left out gets its default
    or NULL."""
    extra = set(rows.columns) - set(like.columns) - set(keep)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    defaults = defaults or {}
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ],
        *keep,
    )


def _refuse(rows: DataFrame, message: str) -> None:
    if not rows.isEmpty():
        raise ValueError(message)


def _fill(rows: DataFrame, filled: Sequence[str]) -> DataFrame:
    """``rows``, which raise where a column that must have values has none."""
    for c in filled:
        message = F.lit(f"NULL in column {c}")
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(message).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return rows


def insert(
    table: DataFrame, rows: DataFrame, key: Sequence[str], defaults: dict[str, Column] | None = None, checked: bool = True, filled: Sequence[str] = ()
) -> Change:
    """New rows. With ``checked``, a NULL in the key, a key twice, or a key that the table has, raises; so does
    a NULL in a column of ``filled``, when the rows are read."""
    rows = complete(rows, table, defaults)
    key = list(key)
    if checked:
        _refuse(rows.where(" OR ".join(f"`{k}` IS NULL" for k in key)), "insert: NULL in the primary key")
        _refuse(rows.groupBy(*key).count().where("count > 1"), "insert: duplicate key among the rows")
        _refuse(rows.select(*key).join(table.select(*key), key, "left_semi"), "insert: duplicate key")
    return Change(key, writes=_fill(rows, filled))


Row = Callable[[str], Column]


def upsert(
    table: DataFrame,
    rows: DataFrame,
    key: Sequence[str],
    order: str | None = None,
    update: dict[str, Callable[[Row, Row], Column] | str] | None = None,
    where: Callable[[Row, Row], Column] | str | None = None,
    defaults: dict[str, Column] | None = None,
    filled: Sequence[str] = (),
) -> Change:
    """INSERT … ON CONFLICT DO NOTHING (no ``update``) or DO UPDATE SET … [WHERE …].

    ``update`` maps columns to functions of the current and the proposed (excluded) row, or all to SQL text
    over ``now.column`` and ``excluded.column`` (then ``where`` is text too). Rows with one key
    take effect one after another by ``order`` (a column of ``rows``), each seeing what those before it left.
    Rows that change nothing are not returned. A key's proposed rows are folded together in one task.
    """
    key = list(key)
    if update and set(update) & set(key):
        raise ValueError("on conflict: a primary key column cannot be assigned")
    kinds = {f.name: f.dataType for f in table.schema.fields}
    at = F.col(order) if order else F.lit(0)
    marked = rows.withColumn("__order", at)
    if order and order not in table.columns:
        marked = marked.drop(order)
    proposed = complete(marked, table, defaults, keep=["__order"])
    columns = table.columns
    packed = F.struct(*[F.col(c) for c in columns])
    batch = proposed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("__order").alias("o"), packed.alias("r")))).alias("__rows"))
    old = table.select(*key, packed.alias("__old"))
    met = batch.join(old, key, "left")
    has = F.col("__old").isNotNull()
    first = F.when(has, F.col("__old")).otherwise(F.col("__rows")[0]["r"])
    state = F.struct(first.alias("r"), (~has).alias("changed"))
    rest = F.when(has, F.col("__rows")).otherwise(F.slice(F.col("__rows"), F.lit(2), F.size("__rows")))

    def step(acc: Column, x: Column) -> Column:
        if not update:
            return acc
        now: Row = lambda c: acc["r"][c]
        new: Row = lambda c: x["r"][c]
        changed = F.struct(*[(update[c](now, new).cast(kinds[c]) if c in update else now(c)).alias(c) for c in columns])
        out = F.struct(changed.alias("r"), F.lit(True).alias("changed"))
        return F.when(F.coalesce(where(now, new), F.lit(False)), out).otherwise(acc) if where else out

    if update and all(isinstance(u, str) for u in update.values()):
        met = met.select(rest.alias("__rest"), state.alias("__state"))
        changed = ", ".join(f"'{c}', CAST({f'({update[c]})' if c in update else f'now.`{c}`'} AS {kinds[c].simpleString()})" for c in columns)
        out = f"named_struct('r', named_struct({changed}), 'changed', true)"
        out = f"IF(coalesce({where}, false), {out}, __acc)" if where else out
        out = re.sub(r"\bnow\.", "__acc.r.", re.sub(r"\bexcluded\.", "__x.r.", out))
        folded = F.expr(f"aggregate(__rest, __state, (__acc, __x) -> {out})")
    else:
        folded = F.aggregate(rest, state, step)
    end = met.select(folded.alias("__end")).where("__end.changed")
    return Change(key, writes=_fill(end.select(*[F.col(f"__end.r.{c}").alias(c) for c in columns]), filled))


def update(table: DataFrame, key: Sequence[str], assign: dict[str, Column], where: Column | None = None, filled: Sequence[str] = ()) -> Change:
    """Rows for which ``where`` holds, with columns assigned; all expressions see the old row. A column of the
    primary key cannot be assigned; a NULL in a column of ``filled`` raises when the rows are read."""
    if set(assign) & set(key):
        raise ValueError("update: a primary key column cannot be assigned")
    hit = table.where(where) if where is not None else table
    kinds = {f.name: f.dataType for f in table.schema.fields}
    rows = hit.select(*[(assign[c].cast(kinds[c]) if c in assign else F.col(c)).alias(c) for c in table.columns])
    return Change(list(key), writes=_fill(rows, [c for c in filled if c in assign]))


def delete(table: DataFrame, key: Sequence[str], where: Column | None = None) -> Change:
    """Rows for which ``where`` holds (NULL does not)."""
    return Change(list(key), deletes=table.where(where) if where is not None else table)


def truncate(table: DataFrame, key: Sequence[str]) -> Change:
    return Change(list(key), deletes=table)
