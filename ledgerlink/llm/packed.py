"""Rows of packed columns: one Spark row carries, for one bucket, many entries as byte planes of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import csr_gather


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together: shuffle compression finds the empty ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(data, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Packing:
    """Names and types of an entry's columns."""

    def __init__(self, **kinds):
        self.kinds = kinds
        self.schema = "bucket int, " + ", ".join(f"{name} binary" for name in kinds)

    def pack(self, bucket: np.ndarray, columns: dict[str, np.ndarray]):
        """Arrow batch of one row per bucket; columns left out are null."""
        import pyarrow as pa

        order = np.argsort(bucket, kind="stable")
        found, begin = np.unique(bucket[order], return_index=True)
        end = np.append(begin[1:], len(order))
        blobs = []
        for name, kind in self.kinds.items():
            x = columns.get(name)
            x = None if x is None else np.ascontiguousarray(x[order].astype(kind))
            blobs.append(pa.array([None if x is None else planes(x[a:b]) for a, b in zip(begin, end)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *blobs], names=["bucket", *self.kinds])

    def unpack(self, batches: list, names: tuple[str, ...]) -> dict[str, np.ndarray]:
        out = {}
        for name in names:
            kind = self.kinds[name]
            parts = [unplanes(v.as_buffer(), kind) for b in batches for v in b.column(b.schema.get_field_index(name)) if v.is_valid]
            out[name] = np.concatenate(parts) if parts else np.zeros(0, kind)
        return out


def with_row_ids(docs: DataFrame) -> DataFrame:
    """rid (of id and text), doc_id, text (null is empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def beside_text(rows: DataFrame, marks: DataFrame, n: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Texts and packed marks dealt by rid; in every partition marks come first. Columns: bucket, late, rid, doc_id, text, `also`, marks."""
    names = [f.name for f in marks.schema if f.name != "bucket"]
    kinds = {f.name: f.dataType for f in rows.schema}
    text = rows.select(F.pmod("rid", F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("late"), F.col("rid").alias("row"), "doc_id", "text", *also, *[F.lit(None).cast("binary").alias(f"p_{c}") for c in names])
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in ("doc_id", "text", *also)]
    mark = marks.select("bucket", F.lit(0).alias("late"), F.lit(None).cast("long").alias("row"), *empty, *[F.col(c).alias(f"p_{c}") for c in names])
    return text.unionByName(mark).repartition(n, "bucket").sortWithinPartitions("late")


def marked_batches(packing: Packing, batches: Iterator, names: tuple[str, ...], only=None):
    """(batch of texts, marks sorted by rid) for every batch of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, marks = [], None
    for batch in batches:
        late = batch.column(1)
        early = batch.filter(pc.equal(late, 0))
        if len(early):
            wanted = [i for i, c in enumerate(early.schema.names) if c.startswith("p_")]
            early = pa.RecordBatch.from_arrays([early.column(i) for i in wanted], names=[early.schema.names[i][2:] for i in wanted])
            x = packing.unpack([early], names)
            held.append({k: v[only(x)] for k, v in x.items()} if only else x)
        batch = batch.filter(pc.equal(late, 1))
        if not len(batch):
            continue
        if marks is None:
            marks = {c: np.concatenate([h[c] for h in held]) if held else np.zeros(0, packing.kinds[c]) for c in names}
            by = np.argsort(marks["rid"], kind="stable")
            marks = {c: v[by] for c, v in marks.items()}
            held = []
        yield batch, marks


def of_rows(marks: dict, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' marks, one after another, and the row of each."""
    a, b = np.searchsorted(marks["rid"], rid, "left"), np.searchsorted(marks["rid"], rid, "right")
    return csr_gather(np.arange(len(marks["rid"])), a, b - a), np.repeat(np.arange(len(rid)), b - a)
