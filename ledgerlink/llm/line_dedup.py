"""Line dedup: overlapping three-line windows.

Lines are the \\n-split parts of a text; blank ones are passed over and the others are compared without surrounding
white space. Every three lines in a row are a window. Over the whole corpus a window's first occurrence, by doc_id and
then place, stays; the lines covered by its later occurrences are removed (overlapping windows merge).

Windows are hashed where they are read, to 128 bits of two independent hashes of every line (among 10**12 distinct
windows any two agree with a probability below 10**-14). Within a batch later occurrences are settled at once and only the
first goes on, so a window that everybody has sends one entry per batch. Entries are dealt by hash, marks by row.

Defined cases: null text is empty; a text of fewer than three lines loses nothing; a text whose lines all go is left
empty but stays a row. Rows equal in id and text are one occurrence and lose the same lines. Rows that share an id but
not their text come in an arbitrary but fixed order. A null doc_id comes first. Extra columns are kept. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, U64, arrow_bytes, buckets, chunk_view, cut, documents, mix, range_hashes, slices
from .packed import Packing, beside_text, marked_batches, of_rows

WINDOW = 3
_ENTRIES = Packing(rid=np.int64, doc=np.int64, h1=U64, h2=U64, line=np.int32, later=np.uint8)
_FIRST = np.iinfo(np.int64).min


def line_ranges(buf: np.ndarray, offsets: np.ndarray):
    """Row, start and end (without its \\n) of every line; an empty row has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([offsets[1:], breaks])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    by = np.lexsort((start, row))
    # the i-th start of a row goes with its i-th end
    by_end = np.lexsort((end, row))
    return row[by], start[by], end[by_end]


def _solid_lines(buf: np.ndarray, offsets: np.ndarray):
    """Row, number within the row, and trimmed start and end of every line that is not blank."""
    row, start, end = line_ranges(buf, offsets)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~_SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = b > a
    return row[full], number[full], solid[a[full]], solid[b[full] - 1] + 1


def _windows(buf: np.ndarray, offsets: np.ndarray, width: int):
    """Row, place among the row's lines that are not blank, and two hashes of every window."""
    row, number, start, end = _solid_lines(buf, offsets)
    if len(row) < width:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    view = chunk_view(buf)
    one, two = (range_hashes(buf, start, end, seed, view) for seed in (0, 1))
    n = len(one) - width + 1
    ok = row[:n] == row[width - 1 :]
    h1, h2 = np.zeros(n, U64), np.ones(n, U64)
    for i in range(width):
        h1 = mix(h1 * U64(0x9E3779B97F4A7C15) + one[i : n + i])
        h2 = mix((h2 ^ two[i : n + i]) * U64(0xC2B2AE3D27D4EB4F) + U64(i))
    place = np.arange(n) - np.searchsorted(row, row[:n])
    return row[:n][ok], place[ok], h1[ok], h2[ok]


def _later(x: dict) -> np.ndarray:
    """Order that brings equal windows together, first occurrence first, and which of them are later occurrences."""
    by = np.lexsort((x["line"], x["rid"], x["doc"], x["h2"], x["h1"]))
    same = lambda c: x[c][by][1:] == x[c][by][:-1]
    new = np.append(True, ~(same("h1") & same("h2")))
    head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = (x["rid"][head] != x["rid"][by]) | (x["line"][head] != x["line"][by])
    return by, late


def _emit_windows(width: int, n: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(int(_FIRST)).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(2))
            held = []
            for i, j in slices(np.diff(off)):
                row, place, h1, h2 = _windows(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                held.append((rid[i + row], doc[i + row], h1, h2, place))
            x = dict(zip(("rid", "doc", "h1", "h2", "line"), (np.concatenate(c) for c in zip(*held)))) if held else {"rid": ()}
            if not len(x["rid"]):
                continue
            by, late = _later(x)
            # identical rows repeat the same occurrence; each copy is dropped but one
            x = {k: v[by] for k, v in x.items()} | {"later": late}
            again = np.append(False, (x["rid"][1:] == x["rid"][:-1]) & (x["line"][1:] == x["line"][:-1]) & (x["h1"][1:] == x["h1"][:-1]))
            x = {k: v[~again] for k, v in x.items()}
            yield _ENTRIES.pack(np.where(x["later"], np.mod(x["rid"], n), (x["h1"] % U64(n)).astype(np.int64)), x)

    return run


def _mark_later(n: int):
    def run(batches: Iterator) -> Iterator:
        x = _ENTRIES.unpack(list(batches), tuple(_ENTRIES.kinds))
        if not len(x["rid"]):
            return
        settled = x["later"] == 1
        open_ = {k: v[~settled] for k, v in x.items()}
        by, late = _later(open_)
        rid = np.concatenate([x["rid"][settled], open_["rid"][by][late]])
        line = np.concatenate([x["line"][settled], open_["line"][by][late]])
        if len(rid):
            yield _ENTRIES.pack(np.mod(rid, n), {"rid": rid, "line": line})

    return run


def _strip(width: int, schema_names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, marks in marked_batches(_ENTRIES, batches, ("rid", "line")):
            rid = batch.column(2).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(4))
            for i, j in slices(np.diff(off)):
                part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                row, start, end = line_ranges(part, edge)
                solid_row, number, *_ = _solid_lines(part, edge)
                gone = np.zeros(len(row), bool)
                which, at_row = of_rows(marks, rid[i:j])
                if len(which):
                    first_line, first_solid = np.searchsorted(row, at_row), np.searchsorted(solid_row, at_row)
                    at = first_solid + marks["line"][which]
                    for k in range(width):
                        gone[first_line + number[at + k]] = True
                # a line goes with its line break; a last line with the break before what is left of it
                keep = np.ones(len(part), bool)
                lost = np.zeros(len(part) + 1, np.int32)
                np.add.at(lost, start[gone], 1)
                np.add.at(lost, np.minimum(end[gone] + 1, edge[1:][row[gone]]), -1)
                keep = np.cumsum(lost)[:-1] <= 0
                text = part[keep].tobytes()
                total = np.append(0, np.cumsum(keep))[edge]
                texts = [text[a:b] for a, b in zip(total[:-1], total[1:])]
                last_gone = gone[np.append(np.flatnonzero(np.diff(row)), len(row) - 1)]
                texts = [t[:-1] if g and t[-1:] == b"\n" else t for t, g in zip(texts, last_gone)]
                count = np.bincount(row, minlength=j - i)
                lose = np.bincount(row[gone], minlength=j - i)
                also = [batch.column(5 + c).slice(i, j - i) for c in range(len(schema_names) - 4)]
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(i, j - i), pa.array(count, pa.int64()), pa.array(lose, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *also], names=schema_names)

    return run


def remove_repeated_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left), and every other column of docs."""
    n = buckets(docs.sparkSession)
    also = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    renamed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(also)])
    rows = renamed.withColumn("rid", F.xxhash64("doc_id", "text"))
    entries = rows.select("rid", "doc_id", "text").mapInArrow(_emit_windows(width, n), _ENTRIES.schema)
    marks = cut(entries.repartition(n, "bucket").mapInArrow(_mark_later(n), _ENTRIES.schema), "lines").select("bucket", "rid", "line")
    own = [f"_c{i}" for i in range(len(also))]
    schema = "doc_id long, n_lines long, n_removed long, text string" + "".join(f", {c} {renamed.schema[c].dataType.simpleString()}" for c in own)
    out = beside_text(rows, marks, n, tuple(own)).mapInArrow(_strip(width, ["doc_id", "n_lines", "n_removed", "text", *own]), schema)
    return out.select("doc_id", "n_lines", "n_removed", "text", *[F.col(c).alias(a) for c, a in zip(own, also)])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: Expects doc_id to be unique.
ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
s AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM e),
k AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE line <> ''),
w AS (SELECT doc_id, r, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY r)),
f AS (SELECT doc_id, r, row_number() OVER (PARTITION BY win ORDER BY doc_id, r) AS nth FROM w WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, r + d AS r FROM f, (VALUES (0), (1), (2)) AS t(d) WHERE nth > 1),
x AS (SELECT k.doc_id, k.i FROM g JOIN k USING (doc_id, r)),
z AS (SELECT e.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE x.i IS NULL) AS left_text
      FROM e LEFT JOIN x ON e.doc_id = x.doc_id AND e.i = x.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(left_text, '')) AS text_sha256 FROM z
"""
