"""References to records that do not exist.

A reference is a (possibly composite) key of a child table naming rows of a
parent table.  Child rows are grouped by *null mask* (which key columns are
null); each mask is checked on its non-null columns only, as the declared
match semantics says:

``simple``
    a reference with any null column is no reference;
``full``
    all columns null is no reference, a mixture is a failure (``partial_null``);
``partial``
    the non-null columns must agree with some parent row; all null is none.

A reference fails with reason ``missing`` (no parent row), ``deleted`` (every
matching parent row is deleted) or ``late`` (the parent arrived after the
child).  Null arrival times never make a reference late.  Repeated child rows
give repeated results unless the caller deduplicates; empty tables are legal
on either side (an empty parent fails every reference).  Extra columns of the
parent never reach the result, so clashing names are harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keys import join_verdicts, norm_id
from corpusloom.sources.tables import materialise

MATCH = ("simple", "partial", "full")


def latest_deletions(log: DataFrame, table_name: str) -> DataFrame:
    """``(_rid)``: normalised ids whose latest delete or restore entry is a delete.

    Latest by ``op_at``, then ``log_id``; other operations and entries without
    a record id are ignored.
    """
    return (
        log.where((F.lower(F.trim("table_name")) == table_name) & F.lower(F.trim("op")).isin("delete", "restore"))
        .select(norm_id("record_id").alias("_rid"), F.lower(F.trim("op")).alias("_op"), F.struct("op_at", "log_id").alias("_at"))
        .where("_rid is not null")
        .groupBy("_rid")
        .agg(F.max_by("_op", "_at").alias("_op"))
        .where("_op = 'delete'")
        .select("_rid")
    )


def parent_state(parent: DataFrame, id_col: str, arrived: str, deletions: DataFrame | None) -> DataFrame:
    """One row per key with its earliest arrival and whether it is deleted."""
    keyed = (
        parent.select(norm_id(id_col).alias("_rid"), F.col(arrived).alias("_arrived"))
        .where("_rid is not null")
        .groupBy("_rid")
        .agg(F.min("_arrived").alias("_arrived"))
    )
    if deletions is None:
        return keyed.withColumn("_deleted", F.lit(False))
    return keyed.join(deletions.withColumn("_deleted", F.lit(True)), "_rid", "left").withColumn("_deleted", F.coalesce("_deleted", F.lit(False)))


def orphan_references(
    child: DataFrame,
    parent: DataFrame,
    keys: dict[str, str],
    match: str = "simple",
    child_time: str | None = None,
    parent_time: str | None = None,
    parent_deleted: str | None = None,
) -> DataFrame:
    """Child rows whose reference fails, with a ``reason`` column.

    *keys* maps child key columns to parent key columns, both already
    comparable.  The child is pre-aggregated to distinct keys before it meets
    the parent, so a key that holds a third of the rows costs one row there;
    only failing keys are joined back to the rows, hot ones in parts (``join_verdicts``).
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    ck = list(keys)
    mask = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(ck)])
    rows = child.withColumn("_mask", mask)
    everything = (1 << len(ck)) - 1
    out: list[DataFrame] = []
    for m in range(everything):  # the all-null mask is never a reference
        there = [c for i, c in enumerate(ck) if not m >> i & 1]
        if m and match == "simple":
            continue
        group = rows.where(F.col("_mask") == m).drop("_mask")
        if m and match == "full":
            out.append(group.withColumn("reason", F.lit("partial_null")))
            continue
        out.append(_failing(group, parent, there, [keys[c] for c in there], child_time, parent_time, parent_deleted))
    return reduce(DataFrame.unionByName, out)


def _failing(group: DataFrame, parent: DataFrame, ck: list[str], pk: list[str], child_time: str | None, parent_time: str | None, parent_deleted: str | None) -> DataFrame:
    names = [f"_k{i}" for i in range(len(ck))]
    live = ~F.coalesce(F.col(parent_deleted), F.lit(False)) if parent_deleted else F.lit(True)
    when = F.coalesce(F.col(parent_time), F.lit("0001-01-01").cast("timestamp")) if parent_time else F.lit(None).cast("timestamp")
    there = (
        parent.select(*[F.col(p).alias(n) for p, n in zip(pk, names)], live.alias("_live"), when.alias("_when"))
        .groupBy(*names)
        .agg(F.max("_live").alias("_live"), F.min(F.when(F.col("_live"), F.col("_when"))).alias("_when"))
    )
    rows = group.select(*[F.col(c).alias(n) for c, n in zip(ck, names)], F.struct(*[F.col(f"`{c}`") for c in group.columns]).alias("_row"), (F.col(child_time) if child_time else F.lit(None).cast("timestamp")).alias("_seen"))
    asked = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_first"))
    verdicts = (
        asked.join(there, names, "left")
        .withColumn("_bad", F.when(F.col("_live").isNull(), F.lit("missing")).when(~F.col("_live"), F.lit("deleted")).when(F.col("_when") > F.col("_first"), F.lit("late")))
        .where("_bad is not null")
        .select(*names, "_n", "_bad", "_when")
    )
    # only keys that fail go back to the rows
    bad = join_verdicts(rows, materialise(verdicts, "reference-verdicts"), names, "_n").where("_bad <> 'late' or _when > _seen")
    return bad.select("_row.*", F.col("_bad").alias("reason"))


def corpus_references(documents: DataFrame, sections: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Failing references of a corpus: ``(ref_field, row_id, month, reason)``, one row per reference.

    ``sections.document_id`` and ``chunks.document_id`` refer to documents,
    ``chunks.section_id`` to sections.  A record arrives at the earliest
    ``loaded_at`` of its id (documents: ``ingested_at``); rows of one id
    delivered twice count once; rows without an id count by their null id.
    """
    parents = None
    for name, frame, arrived in (("documents", documents, "ingested_at"), ("sections", sections, "loaded_at")):
        state = parent_state(frame, "id", arrived, latest_deletions(log, name)).withColumn("_table", F.lit(name))
        parents = state if parents is None else parents.unionByName(state)

    def ref(field: str, to: str, column: str) -> Column:
        return F.struct(F.lit(field).alias("ref_field"), F.lit(to).alias("_to"), norm_id(column).alias("_ref"))

    own = [F.col("id").alias("row_id"), F.col("loaded_at").alias("_at")]
    rows = sections.select(*own, ref("sections.document_id", "documents", "document_id").alias("r"))
    rows = rows.unionByName(chunks.select(*own, F.explode(F.array(ref("chunks.document_id", "documents", "document_id"), ref("chunks.section_id", "sections", "section_id"))).alias("r")))
    rows = rows.select("row_id", "_at", "r.ref_field", "r._to", "r._ref")
    bad = orphan_references(rows, parents, {"_to": "_table", "_ref": "_rid"}, "simple", "_at", "_arrived", "_deleted")
    # deliveries of one row count once, by the earliest; it fails if any does
    once = bad.groupBy("ref_field", "row_id", "_ref").agg(F.min("_at").alias("_at"), F.min_by("reason", "_at").alias("reason"))
    return once.select("ref_field", "row_id", F.date_format("_at", "yyyy-MM").alias("month"), "reason")


def composite_chunk_references(sections: DataFrame, chunks: DataFrame, match: str = "partial") -> DataFrame:
    """Chunks whose composite key (document, section) names no section row, by month and null mask.

    ``(null_mask, month, reason, n)``; ``null_mask`` is ``ds`` with ``-`` for
    a null column (``d-``: only the document is known).
    """
    parent = sections.select(norm_id("document_id").alias("pd"), norm_id("id").alias("ps"))
    rows = (
        chunks.select(F.col("id").alias("row_id"), norm_id("document_id").alias("d"), norm_id("section_id").alias("s"), F.col("loaded_at").alias("_at"))
        .groupBy("row_id", "d", "s")
        .agg(F.min("_at").alias("_at"))
    )
    bad = orphan_references(rows, parent, {"d": "pd", "s": "ps"}, match)
    shape = F.concat(F.when(F.col("d").isNull(), "-").otherwise("d"), F.when(F.col("s").isNull(), "-").otherwise("s"))
    return bad.groupBy(shape.alias("null_mask"), F.date_format("_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
