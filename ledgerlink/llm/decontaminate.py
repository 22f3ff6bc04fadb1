"""Benchmark decontamination by spaced seeds.

Words are lower-cased (A-Z) and lose ASCII punctuation. A mask such as 1101001011 hashes the words under its ones and
ignores the others, so a substituted word spoils only the seeds that look at it. Seed hashes of the benchmark are
joined with those of every position of every document; a hit fixes a benchmark item and an alignment. The alignment is
then verified word by word: the best run of matches, where a mismatch costs `penalty` matches, must have at least
`min_matches` matching words (all words but one in five of a shorter item).

The benchmark is broadcast in blocks of at most `block_bytes` of text: a benchmark of any size is handled by as many
passes as it has blocks, each a set of queries of bounded size against all rows. Documents are never shuffled.

Defined cases: null or empty texts on either side match nothing. Items shorter than the shortest mask are sought whole,
word for word, by a mask of their own length. Equal items all report; a null item_id is an id of its own. Repeated rows are each judged. Extra columns are
kept by `drop_contaminated` and ignored otherwise. Empty tables: nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_bytes, cut, documents, drop_cuts, lower_ascii, mix, range_hashes, slices, word_ranges

#: Items of six to eight words have runs of half of them besides. Weight 6, spans 8 to 10: of any 12 aligned words with one substitution at least one seed is untouched.
MASKS = ("11101011", "1101001011", "110011011", "111111")
BLOCK_BYTES = 4 << 20
MIN_MATCHES, PENALTY = 10, 2

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word that has more than punctuation."""
    keep = ~_PUNCTUATION[buf]
    low = lower_ascii(buf[keep])
    off = np.append(0, np.cumsum(keep))[offsets]
    start, end, row = word_ranges(low, off)
    return range_hashes(low, start, end), row


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), U64)
    for i, c in enumerate(mask):
        if c == "1":
            out = mix(out * U64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out


class Index:
    """Seed hashes of one block of benchmark items, sorted, with item and position of each."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...]):
        data = [t.encode() for t in texts]
        off = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
        self.words, row = _words(np.frombuffer(b"".join(data), np.uint8), off)
        self.none = np.array([i is None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.code = np.unique(np.stack([self.none.astype(np.int64), self.ids]), axis=1, return_inverse=True)[1].ravel()  # equal ids have equal codes, null its own
        self.edge = np.searchsorted(row, np.arange(len(ids) + 1))
        size = np.diff(self.edge)
        short = sorted({int(s) for s in size if 0 < s < min(map(len, masks))})
        self.masks = (*masks, *["1" * s for s in short])
        # of six to eight words, one substitution leaves a run of half of them
        halves = {"1" * (s // 2): [n for n in (6, 7, 8) if n // 2 == s // 2] for s in sorted({int(s) for s in size if 6 <= s <= 8})}
        self.tables = []
        for m, mask in enumerate((*self.masks, *halves)):
            h = _seeds(self.words, mask)
            ok = row[: len(h)] == row[len(mask) - 1 :] if len(h) else np.zeros(0, bool)
            if m >= len(self.masks):
                ok &= np.isin(size[row[: len(h)]], halves[mask])
            elif m >= len(masks):
                ok &= size[row[: len(h)]] == len(mask)
            at = np.flatnonzero(ok)
            at = at[np.argsort(h[at], kind="stable")]
            bits = np.zeros(1 << 22, bool)
            bits[(h[at] >> U64(42)).astype(np.int64)] = True
            self.tables.append((mask, h[at], at, bits))
        self.row = row

    def hits(self, words: np.ndarray, row: np.ndarray):
        """(item, row, word of the document that would stand at the item's first word) of every seed hit, distinct."""
        found = []
        for mask, keys, at, bits in self.tables:
            h = _seeds(words, mask)
            if not len(h) or not len(keys):
                continue
            maybe = np.flatnonzero(bits[(h >> U64(42)).astype(np.int64)] & (row[: len(h)] == row[len(mask) - 1 :]))
            a, b = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            n = b - a
            pos = np.repeat(maybe, n)
            which = at[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            item = self.row[which]
            found.append(np.stack([item, row[pos], pos - (which - self.edge[item])]))
        if not found:
            return np.zeros((3, 0), np.int64)
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def verify(self, words: np.ndarray, edge: np.ndarray, hits: np.ndarray, min_matches: int, penalty: int):
        """Matching words and span (item words) of the best run of each hit; 0 where it does not hold."""
        item, row, start = hits
        a, b = np.maximum(start, edge[row]), np.minimum(start + np.diff(self.edge)[item], edge[row + 1])
        n = b - a
        hit = np.repeat(np.arange(len(item)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc_at = a[hit] + step
        equal = words[doc_at] == self.words[self.edge[item[hit]] + doc_at - start[hit]]
        best = np.zeros(len(item), np.int64)
        width = int(n.max()) if len(n) else 0
        for i in range(0, len(item), 4096):
            part = slice(i, i + 4096)
            inside = (hit >= i) & (hit < i + 4096)
            score = np.zeros((len(item[part]), width), np.int64)
            match = np.zeros_like(score)
            score[hit[inside] - i, step[inside]] = np.where(equal[inside], 1, -penalty)
            match[hit[inside] - i, step[inside]] = equal[inside]
            run = np.zeros(len(score), np.int64)
            have = np.zeros(len(score), np.int64)
            top, won = run.copy(), run.copy()
            for c in range(width):
                fresh = run <= 0
                run = np.where(fresh, 0, run) + score[:, c]
                have = np.where(fresh, 0, have) + match[:, c]
                better = run > top
                top, won = np.where(better, run, top), np.where(better, have, won)
            best[part] = won
        need = np.minimum(min_matches, np.ceil(np.diff(self.edge) * 0.8).astype(np.int64))[item]
        return np.where(best >= np.maximum(need, 1), best, 0)


def _find(index, min_matches: int, penalty: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ix = index.value
        for batch in batches:
            buf, off = arrow_bytes(batch.column(1))
            for i, j in slices(np.diff(off)):
                words, row = _words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                edge = np.searchsorted(row, np.arange(j - i + 1))
                hits = ix.hits(words, row)
                good = ix.verify(words, edge, hits, min_matches, penalty)
                took = good > 0
                item, at, good = hits[0][took], hits[1][took], good[took]
                by = np.lexsort((-good, ix.code[item], at))
                item, at, good = item[by], at[by], good[by]
                one = np.append(True, (at[1:] != at[:-1]) | (ix.code[item][1:] != ix.code[item][:-1])) if len(at) else np.zeros(0, bool)
                item, at, good = item[one], at[one], good[one]
                ends = pa.array(np.searchsorted(at, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(ix.ids[item], pa.int64(), mask=ix.none[item]), pa.array(good, pa.int64()))]
                rest = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns)]
                before = rest[-2:]
                if len(before[0].values) or before[0].null_count:
                    lists = [pa.array([(x or []) + y for x, y in zip(old.to_pylist(), new.to_pylist())], pa.list_(pa.int64())) for old, new in zip(before, lists)]
                yield pa.RecordBatch.from_arrays([*rest[:-2], *lists], names=batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Benchmark items on the driver, never more than a block of them."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), masks: tuple[str, ...] = MASKS, min_matches: int = MIN_MATCHES, penalty: int = PENALTY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of docs with item_ids array<long> and matched array<long> (words of each item found)."""
    spark = docs.sparkSession
    none = F.array().cast("array<long>")
    out = docs.select(F.col(id_cols[0]), "text", *id_cols[1:]).withColumns({"item_ids": none, "matched": none})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    held = last = None
    for k, (ids, texts) in enumerate(_blocks(benchmark, block_bytes)):
        index = spark.sparkContext.broadcast(Index(ids, texts, masks))  # one block: block_bytes bounds it
        if k:  # one block in memory at a time, one table on disk
            out, before = cut(out, "leaks"), held
            last.unpersist()
            if before is not None:
                drop_cuts(before)
            held = out
        last = index
        out = out.mapInArrow(_find(index, min_matches, penalty), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, max_matched of every row."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.coalesce(F.array_max("matched"), F.lit(0)).cast("long").alias("max_matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns, that hold no benchmark passage."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumn("text", F.col(names[at]))
    kept = find_leaks(plain, benchmark, id_cols=(names[0], *names[1:]), **options)
    clean = kept.where(F.size("item_ids") == 0)
    return clean.select(*[F.col(c).alias(docs.columns[i]) for i, c in enumerate(names)])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
