"""Keyed state changes as pure functions ``new_state = f(state, changes)``.

Plain Parquet tables have no MERGE, so each change is a plan over the current
snapshot and a batch of changes, written afterwards as a new snapshot (or an
append where only rows are added). Single-row calls of the original become
batches of changes with an explicit arrival order where order matters.

"First arrival per key" is a ``min(struct(order...))`` aggregate over narrow
columns, not a window: it combines map-side, so a key that holds a third of
all changes still sends one row per map task. The rows follow by a semi join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.operators.ordinal import keyed_ordinal
from wirefold.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row (by ``order``, which must be unique within a key) of every
    key. Reads ``df`` twice: give a written frame."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_m"))
    if set(df.columns) <= {*keys, *order}:
        return first.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in order]).select(*df.columns)
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[F.col(f"_m.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + \
        [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    return df.join(first, reduce(lambda a, b: a & b, on), "left_semi")


def insert_or_ignore(state: DataFrame, changes: DataFrame, keys: list[str],
                     order: list[str]) -> DataFrame:
    """Rows of ``changes`` to insert under a unique key: the existing row
    wins, then the first arrival. A NULL in any key never clashes (every such
    row goes in); '' is a value like any other; comparison is exact. The
    changes are written once and read from there."""
    changes = cut_lineage(changes)
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    null_rows = changes.filter(has_null)
    firsts = first_per_key(changes.filter(~has_null), keys, order)
    fresh = firsts.join(state.select(*keys).filter(~has_null), keys, "left_anti")
    return fresh.unionByName(null_rows)


def apply_insert_or_ignore(state: DataFrame, changes: DataFrame, keys: list[str],
                           order: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """New state: state plus the accepted changes (missing columns take
    ``defaults`` or NULL)."""
    new = insert_or_ignore(state, changes, keys, order)
    return append_rows(state, new, defaults)


def append_rows(state: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Append ``rows`` in the state's schema; absent columns get ``defaults``."""
    defaults = defaults or {}
    cols = []
    for f in state.schema.fields:
        if f.name in rows.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return state.unionByName(rows.select(*cols))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], set_cols: list[str],
           seq: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Insert-or-update: per key the last change (by ``seq``) sets
    ``set_cols``; other columns of an existing row are kept; a new key gets
    ``defaults`` (else NULL) for the other columns. A change that sets a
    column to NULL does set it (the change row is present, so no coalesce
    with the old value is used for it)."""
    defaults = defaults or {}
    last = changes.groupBy(*keys).agg(
        F.max(F.struct(*seq, *set_cols)).alias("_c"))
    last = last.select(*keys, F.lit(True).alias("_hit"), *[F.col(f"_c.{c}").alias(f"_new_{c}") for c in set_cols])
    j = state.withColumn("_old", F.lit(True)).join(last, keys, "full_outer")
    out = []
    for f in state.schema.fields:
        if f.name in keys:
            out.append(F.col(f.name))
        elif f.name in set_cols:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name))
                       .cast(f.dataType).alias(f.name))
        else:
            d = defaults.get(f.name, F.lit(None))
            out.append(F.when(F.col("_old"), F.col(f.name)).otherwise(d).cast(f.dataType).alias(f.name))
    return j.select(*out)


def update_by_key(state: DataFrame, changes: DataFrame, keys: list[str],
                  set_cols: list[str], flag: str | None = "updated") -> DataFrame:
    """UPDATE .. WHERE key = ..: matched rows take the change's values; the
    ``flag`` column tells which rows matched (the 'rowcount > 0' answer).
    Changes are expected unique per key (take ``first_per_key`` before)."""
    c = changes.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in set_cols]).withColumn("_hit", F.lit(True))
    j = state.join(c, keys, "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
           if f.name in set_cols else F.col(f.name) for f in state.schema.fields]
    if flag:
        out.append(F.coalesce(F.col("_hit"), F.lit(False)).alias(flag))
    return j.select(*out)


def delete_cascade(levels: list[tuple[DataFrame, str, str]], doomed: DataFrame, doomed_key: str):
    """Delete parents and, level by level, the children that point to them.

    ``levels`` = [(table, its key, its parent-key column)] from the top table
    down (the top's parent-key column is ignored). ``doomed`` holds the keys
    of the top rows to delete. Returns the surviving tables, in order. Each
    level is one anti join on the deleted keys of the level above."""
    out = []
    gone = doomed.select(F.col(doomed_key).alias("_gone"))
    for i, (tbl, key, parent_col) in enumerate(levels):
        on = key if i == 0 else parent_col
        keep = tbl.join(gone, F.col(on) == F.col("_gone"), "left_anti")
        dead = tbl.join(gone, F.col(on) == F.col("_gone"), "left_semi")
        out.append(keep)
        gone = dead.select(F.col(key).alias("_gone"))
    return out


def fk_split(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): child rows whose parent exists / is absent."""
    p = parent.select(F.col(pk).alias("_pk"))
    return (child.join(p, F.col(fk) == F.col("_pk"), "left_semi"),
            child.join(p, F.col(fk) == F.col("_pk"), "left_anti"))


def validate(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``accepted`` and ``reason`` (name of the first rule that fails;
    a rule whose condition is NULL fails too)."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        reason = F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def assign_ids(rows: DataFrame, order: list[str], base: Column | int, out: str = "id") -> DataFrame:
    """Surrogate ids in arrival order: ``base + 1, base + 2, ...``. Numbering
    runs per partition with offsets (no single-task window) over the ``order``
    columns alone, which must be unique and not null; the rows are joined back."""
    numbered = keyed_ordinal(rows.select(*order), [], order, out="_rn")
    b = base if isinstance(base, Column) else F.lit(base)
    return rows.join(numbered, order).withColumn(out, (b + F.col("_rn")).cast("long")).drop("_rn")


def flag_by_key(ids: DataFrame, flags: DataFrame, key: str, flag: str,
                override_ids: list | None = None, out: str = "flag") -> DataFrame:
    """Per id: the stored flag (absent -> false), or true for ids in the
    fixed override list."""
    f = flags.select(F.col(key), F.col(flag).alias("_f"))
    j = ids.join(f, key, "left")
    over = F.col(key).isin(list(override_ids)) if override_ids else F.lit(False)
    return j.select(*ids.columns, (F.coalesce(F.col("_f"), F.lit(False)) | over).alias(out))


def seed_if_empty(target: DataFrame, defaults: DataFrame) -> DataFrame:
    """Target as it is, or the defaults when the target has no row. One plan:
    the defaults are anti-joined with one probe row of the target."""
    probe = target.limit(1).select(F.lit(1).alias("_probe"))
    seeded = defaults.withColumn("_probe", F.lit(1)).join(probe, "_probe", "left_anti").drop("_probe")
    return target.unionByName(seeded.select(*target.columns))
